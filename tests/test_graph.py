"""Triples, aliases, integrity and note edges on small fixtures."""

from pyspark.sql import functions as F

from noteskein.operators import aliases, integrity, notes_graph, patterns, triples as T
from noteskein.functions.fixed import INVERSE_RELATIONS

FACT = "source_category string, source_label string, relationship string, target_category string, target_label string, source_file string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_two_plain_triples(spark):
    df = spark.createDataFrame(
        [("Person", "Ann", "works_at", "Company", "Acme", "n.md"), ("Company", "Acme", "founded_by", "Person", "Ann", "n.md")], FACT
    )
    entities, edges = T.build_graph(df)
    assert rows(entities.select("category", "id")) == [("Company", "Acme"), ("Person", "Ann")]
    assert rows(edges) == [("PERSON_TO_COMPANY", "Ann", "Acme", "founded_by"), ("PERSON_TO_COMPANY", "Ann", "Acme", "works_at")]


def test_inverse_and_order(spark):
    data = [("Company", f"C{i}", name, "Person", f"P{i}", "n.md") for i, name in enumerate(INVERSE_RELATIONS)]
    data += [("Person", "Zoe", "reports_to", "Person", "Amy", "n.md"), ("Person", "Amy", "reports_to", "Person", "Zoe", "n.md"),
             ("Person", "X", "runs", "Company", "X", "n.md"), ("Concept", "Q", "is", "Person", "Amy", "n.md"), ("person", "q", "is", "Person", "Amy", "n.md"),
             ("Person", "Amy", "manages", "Person", "Bo", "n.md")]
    entities, edges = T.build_graph(spark.createDataFrame(data, FACT))
    found = rows(edges)
    for i, name in enumerate(INVERSE_RELATIONS):
        assert ("PERSON_TO_COMPANY", f"P{i}", f"C{i}", INVERSE_RELATIONS[name]) in found
    assert ("PERSON_TO_PERSON", "Amy", "Zoe", "reports_to") in found and ("PERSON_TO_PERSON", "Amy", "Bo", "manages") in found
    assert len(found) == len(INVERSE_RELATIONS) + 2
    names = {tuple(r) for r in entities.select("category", "id").collect()}
    assert ("Person", "X") in names and ("Company", "X") in names and not any(c not in ("Person", "Company") for c, _ in names)


def test_alias_lines(spark):
    lines = ["A -> B", " 'C' => \"D\" ", "x => y -> z", "no arrow", "-> E", "F ->", "A -> B2"]
    df = spark.createDataFrame([(lines,)], "l array<string>")
    parsed = df.select(aliases.as_mapping(aliases.parse_alias_lines(F.col("l")))).first()[0]
    assert [tuple(p) for p in parsed] == [("A", "B2"), ("C", "D"), ("x => y", "z")]
    for value, wanted in (('["A -> B", 5, "C => D"]', ["A -> B", "C => D"]), ('"A -> B, C -> D"', ["A -> B", "C -> D"]),
                          ('"A -> B\\nC, D -> E\\n"', ["A -> B", "C, D -> E"]), ("{}", []), ("7", []), ("null", [])):
        got = spark.createDataFrame([(value,)], "j string").select(aliases.alias_lines(F.parse_json("j"))).first()[0]
        assert got == wanted, value


def test_scoped_rename_follows_chains_in_one_file_only(spark):
    df = spark.createDataFrame(
        [("Person", " J ", "knows", "Person", "K", "a.md"), ("Person", "J", "knows", "Person", "K", "b.md")], FACT
    )
    declared = spark.createDataFrame([("a.md", [("J", "John"), ("John", "John H"), ("K", "J")])], f"source_file string, aliases {aliases.ALIAS_LIST}")
    renamed = rows(aliases.rename_scoped(df, declared).select("source_label", "target_label", "source_file"))
    assert renamed == [("J", "K", "b.md"), ("John H", "J", "a.md")]


def test_alias_problems(spark):
    df = spark.createDataFrame([("f", "A", "B"), ("f", "B", "A"), ("g", "B", "A"), ("g", " ", "C"), ("g", "D", "")], "source_file string, old_name string, new_name string")
    found = rows(aliases.validate_aliases(df).select("source_file", "problem"))
    assert found == [("f", "circular"), ("g", "empty new name"), ("g", "empty old name")]


def test_case_repair_prefers_the_exact_name(spark):
    entities = spark.createDataFrame([("Person", "ann"), ("Person", "Ann"), ("Company", "Acme"), ("Person", "Bo")], "category string, id string")
    edges = spark.createDataFrame(
        [("PERSON_TO_COMPANY", "ann", "ACME", "r"), ("PERSON_TO_COMPANY", "ANN ", "Acme", "r"), ("PERSON_TO_COMPANY", "BO", "Gone", "r"), ("PERSON_TO_COMPANY", "Acme", "Acme", "r")],
        "edge_type string, src string, dst string, relationship string",
    )
    resolved = integrity.resolve_ends(edges, entities)
    assert rows(integrity.valid_edges(resolved).select("src", "dst")) == [("Ann", "Acme"), ("ann", "Acme")]
    quality = integrity.edge_quality(resolved).first()
    assert (quality["n_rows"], quality["n_removed"], quality["missing_src"], quality["missing_dst"]) == (4, 2, 1, 1)


def test_hot_names(spark, no_broadcast):
    """A third of all edges share one end, and no table is small enough to be broadcast."""
    entities = spark.range(300).select(F.lit("Company").alias("category"), F.concat(F.lit("c"), "id").alias("id"))
    edges = spark.range(3000).select(
        F.lit("COMPANY_TO_COMPANY").alias("edge_type"), F.when(F.col("id") % 3 == 0, "C7").otherwise(F.concat(F.lit("c"), F.col("id") % 400)).alias("src"),
        F.concat(F.lit("c"), F.col("id") % 300).alias("dst"), F.col("id").cast("string").alias("relationship"),
    )
    resolved = integrity.resolve_ends(edges, entities)
    assert resolved.count() == 3000
    assert resolved.where("src_id = 'c7'").count() == edges.where("src = 'C7' or src = 'c7'").count()
    assert resolved.where("src_id is null").count() == edges.where("src != 'C7' and cast(substring(src, 2) as int) >= 300").count()


def test_note_links_keep_the_first_direction(spark):
    notes = spark.createDataFrame(
        [("a/x.md", "x", "[[y]] [[y|Y]] [[gone]]"), ("b/y.md", "y", "[[x]] [[y]]"), ("c/y.md", "y", "[[x]]")], "id string, label string, content string"
    )
    resolved = notes_graph.link_targets(notes)
    assert rows(notes_graph.note_links(resolved)) == [("a/x.md", "b/y.md"), ("b/y.md", "b/y.md"), ("c/y.md", "a/x.md")]
    assert rows(notes_graph.broken_links(resolved)) == [("a/x.md", "gone")]


def test_missing_entities_share_a_slug(spark):
    notes = spark.createDataFrame(
        [("p/1.md", "A. B", "Person"), ("p/2.md", "a b", "Person,VC"), ("p/3.md", "Known", "Person"), ("q/4.md", "Z", "")], "id string, label string, entity_types string"
    )
    entities = spark.createDataFrame([("Person", "known", "known", "")], "category string, id string, label string, metadata string")
    nodes, links = notes_graph.post_process(entities, notes)
    assert rows(nodes.select("category", "id", "label", "entity_types")) == [
        ("Company", "company_a_b", "a b", "Person,VC"), ("Person", "known", "known", "Person"), ("Person", "person_a_b", "A. B", "Person,VC"),
    ]
    assert ("PERSON_NOTE", "person_a_b", "p/2.md") in rows(links) and ("PERSON_NOTE", "known", "p/3.md") in rows(links)


def _typed(spark, pairs):
    return spark.createDataFrame([("COMPANY_TO_COMPANY", "Company", a, "Company", b, "r") for a, b in pairs],
                                 "edge_type string, src_type string, src string, dst_type string, dst string, relationship string")


def test_walks_and_reach_against_brute_force(spark, no_broadcast):
    pairs = [("h", f"n{i}") for i in range(20)] + [("n0", "n1"), ("n1", "m"), ("m", "k"), ("a", "b"), ("a", "b")]
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    walks = {v: [1] for v in near}
    for hop in range(3):
        for v in near:
            walks[v].append(sum(walks[o][hop] for o in near[v]))
    got = {r["node"][8:]: [int(r["walks_1"]), int(r["walks_2"]), int(r["walks_3"])] for r in patterns.walk_counts(_typed(spark, pairs)).collect()}
    assert got == {v: w[1:] for v, w in walks.items()}
    seeds = spark.createDataFrame([("Company:k",), ("Company:n5",)], "node string")
    found = {(r["seed"][8:], r["node"][8:]): r["hop"] for r in patterns.reachable(_typed(spark, pairs), seeds).collect()}
    wanted = {}
    for seed in ("k", "n5"):
        wanted[(seed, seed)], level = 0, {seed}
        for hop in (1, 2, 3):
            level = {o for v in level for o in near[v]} - {n for s, n in wanted if s == seed}
            wanted.update({(seed, n): hop for n in level})
    assert found == wanted


def test_two_hop_page_is_the_first_page(spark):
    first = _typed(spark, [(f"p{i:02}", f"c{i % 4}") for i in range(30)] + [("p00", "lonely")])
    second = _typed(spark, [(f"c{i % 3}", f"n{i:02}") for i in range(40)])
    page = [(r["a"], r["m"], r["b"]) for r in patterns.two_hop_page(first, second, 25).collect()]
    every = sorted((p, c, n) for p, c in [(f"p{i:02}", f"c{i % 4}") for i in range(30)] for c2, n in [(f"c{i % 3}", f"n{i:02}") for i in range(40)] if c == c2)
    assert page == every[:25]


def test_page_bounds(spark):
    df = spark.range(20)
    assert [r["id"] for r in patterns.page(df, ["id"], 5, 3).collect()] == [5, 6, 7]
    for skip in (10001,):
        try:
            patterns.page(df, ["id"], skip, max_skip=10000)
        except ValueError:
            continue
        raise AssertionError("a deep page must be refused")


def test_results_have_no_limit_of_their_own(spark):
    edges = spark.range(25_000).select(
        F.lit("COMPANY_TO_COMPANY").alias("edge_type"), F.lit("Company").alias("src_type"), F.concat(F.lit("a"), "id").alias("src"),
        F.lit("Company").alias("dst_type"), F.lit("b").alias("dst"), F.lit("r").alias("relationship"),
    )
    nodes = edges.select(F.lit("Company").alias("category"), F.col("src").alias("id"), F.col("src").alias("label"))
    found = patterns.graph_result(nodes, edges)
    assert found.relationships.count() == 25_000 and found.nodes.count() == 25_000
    assert patterns.graph_result(nodes, edges, limit=10).relationships.count() == 10
    assert patterns.page(edges, ["src"], skip=24_999).count() == 1
