"""Edge quality: lines, names and edges are worked out once, and keys of names are plain."""

from pyspark.sql import functions as F

from noteskein.operators import integrity, triples as T
from noteskein.plans import graph_queries


def _executed(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_marked_facts_are_those_of_the_marked_triples(spark):
    rows = [("Person", f"p{i % 5}", "manages", "Person", f"p{i % 3}", "F" if i % 4 else "O") for i in range(30)]
    rows += [("Company", "c", "employs", "Person", "p1", "O"), ("Person", "p1", "works_at", "Company", "c", "F"), ("Person", "p9", "x", "Company", "c", None), ("Concept", "k", "x", "Person", "p1", "F")]
    raw = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in [*T.FACT, "s"]))
    marked = T.graph_facts(raw, marks={"closed": F.col("s") == "F"})
    plain = lambda df: sorted(map(tuple, df.select(*T.FACT).collect()))
    assert plain(marked) == plain(T.graph_facts(raw))
    assert plain(marked.where("closed")) == plain(T.graph_facts(raw.where("s = 'F'")))


def test_quality_in_one_pass(spark):
    rows = [("A", "x", "y", "x", None), ("A", " x", "y", None, None), ("A", "x ", "z", None, "z"), ("A", None, "z", None, "z"), ("B", "x", "y", "x", "y"), (None, "x", "y", None, "y")]
    resolved = spark.createDataFrame(rows, "edge_type string, src string, dst string, src_id string, dst_id string")
    found = integrity.edge_quality(resolved)
    # As before, missing names are not counted where the type is null.
    assert {tuple(r) for r in found.collect()} == {("A", 4, 4, 1, 1), ("B", 1, 0, 0, 0), (None, 1, 1, 0, 0)}


def test_edge_quality_reads_lines_once(spark, sf_dir, monkeypatch):
    reads = []
    lines = graph_queries.V.lines
    monkeypatch.setattr(graph_queries.V, "lines", lambda *a: reads.append(_executed(lines(*a))) or lines(*a))
    written = []
    kept = graph_queries.checkpointed
    monkeypatch.setattr(graph_queries, "checkpointed", lambda df: written.append(kept(df)) or written[-1])
    plan = _executed(graph_queries.edge_quality(spark, sf_dir))
    assert len(reads) == 1 and len(written) == 2 and "lineitem" not in plan


def test_names_resolve_by_category(spark, no_broadcast):
    entities = spark.createDataFrame([("Person", "Ann"), ("Person", "ANN"), ("Company", "ann"), ("Company", None), ("Company", "Bo")], "category string, id string")
    rows = [("PERSON_TO_COMPANY", " Ann ", "BO", "r"), ("PERSON_TO_COMPANY", "anN", "ANN", "r"), ("COMPANY_TO_COMPANY", "bO", None, "r"), ("PERSON_TO_COMPANY", "Bo", "x", None)]
    found = integrity.resolve_ends(spark.createDataFrame(rows, "edge_type string, src string, dst string, relationship string"), entities)
    assert found.columns == ["edge_type", "src", "dst", "relationship", "src_id", "dst_id"]
    assert {(r["src"], r["dst"]): (r["src_id"], r["dst_id"]) for r in found.collect()} == {
        (" Ann ", "BO"): ("Ann", "Bo"), ("anN", "ANN"): ("ANN", "ann"), ("bO", None): ("Bo", None), ("Bo", "x"): (None, None),
    }
