"""Registered queries over triples, entities, edges and patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteskein.functions import fixed
from noteskein.functions.text import edge_type
from noteskein.operators import aliases, integrity, patterns, triples as T
from noteskein.plans import views as V
from noteskein.plans.registry import query
from noteskein.scale import checkpointed


@query(
    "top_companies",
    "SELECT dst AS company, count(DISTINCT src) AS n_people FROM edges WHERE edge_type = 'PERSON_TO_COMPANY' GROUP BY dst ORDER BY n_people DESC, company LIMIT 10",
    "edges",
)
def top_companies(spark, sf):
    entities, edges = V.graph(spark, sf)
    checked = patterns.typed_edges(integrity.valid_edges(integrity.resolve_ends(edges, entities)))
    matched = patterns.match_pattern(entities, checked, "Person", "Company")
    people = matched.select(F.col("dst_label").alias("company"), "src").distinct()
    return people.groupBy("company").agg(F.count(F.lit(1)).alias("n_people")).orderBy(F.desc("n_people"), "company").limit(10)


@query(
    "triple_filter",
    "SELECT count(*) AS n_triples, count(*) FILTER (known) AS n_known, count(*) FILTER (NOT known) AS n_unknown, "
    "count(*) FILTER (known AND source_label = target_label) AS n_self_loops FROM (SELECT *, source_category IN ('Person', 'Company') AND target_category IN ('Person', 'Company') AS known FROM triples)",
    "triples",
)
def triple_filter(spark, sf):
    return T.triple_quality(V.triples(spark, sf))


@query(
    "orient_relations",
    "SELECT source_category, relationship, target_category, count(*) AS n FROM oriented GROUP BY ALL",
    "oriented",
)
def orient_relations(spark, sf):
    oriented = T.orient(T.keep_known_categories(V.triples(spark, sf)))
    return oriented.groupBy("source_category", "relationship", "target_category").agg(F.count(F.lit(1)).alias("n"))


@query("canonical_edges", "SELECT * FROM edges", "edges")
def canonical_edges(spark, sf):
    return V.edges(spark, sf)


@query("distinct_entities", "SELECT * FROM entities", "entities")
def distinct_entities(spark, sf):
    return V.entities(spark, sf).select("category", "id")


@query(
    "flipped_edges",
    "SELECT source_category, relationship, count(*) AS n FROM (SELECT DISTINCT * FROM oriented) WHERE source_category = target_category AND source_label > target_label GROUP BY ALL",
    "oriented",
)
def flipped_edges(spark, sf):
    oriented = T.orient(T.distinct_facts(T.keep_known_categories(V.triples(spark, sf)))).drop("n_copies").distinct()
    flipped = T.canonical_ends(T.drop_self_loops(oriented)).where("direction_flipped")
    return flipped.groupBy("source_category", "relationship").agg(F.count(F.lit(1)).alias("n"))


@query(
    "edge_routing",
    "SELECT concat(upper(source_category), '_TO_', upper(target_category)) AS edge_type, count(*) AS n FROM triples "
    "WHERE source_category IN ('Person', 'Company') AND target_category IN ('Person', 'Company') GROUP BY ALL",
    "triples",
)
def edge_routing(spark, sf):
    known = T.keep_known_categories(V.triples(spark, sf))
    routed = known.select(edge_type(F.col("source_category"), F.col("target_category")).alias("edge_type"))
    return routed.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))




@query(
    "alias_scoped",
    "SELECT s AS source_label, relationship, t AS target_label, count(*) AS n FROM ("
    "SELECT CASE WHEN source_label = c_name THEN concat(c_name, ' / ', o_orderpriority) ELSE source_label END AS s, relationship, "
    "CASE WHEN target_label = c_name THEN concat(c_name, ' / ', o_orderpriority) ELSE target_label END AS t FROM triples "
    "JOIN orders ON source_file = concat('orders/', cast(o_orderkey as string), '.md') JOIN customer ON c_custkey = o_custkey "
    "WHERE source_category IN ('Person', 'Company') AND target_category IN ('Person', 'Company')) GROUP BY ALL",
    "triples",
)
def alias_scoped(spark, sf):
    # Few facts repeat within a file, so they are merged once only, after the renaming.
    renamed = aliases.rename_scoped(T.keep_known_categories(V.triples(spark, sf)), V.scoped_aliases(spark, sf))
    return renamed.groupBy("source_label", "relationship", "target_label").agg(F.count(F.lit(1)).alias("n"))




def _last_names_sql() -> str:
    return (
        "SELECT old_name, new_name FROM (SELECT s_name AS old_name, concat(s_name, ' ', p_brand) AS new_name, row_number() OVER (PARTITION BY s_name "
        "ORDER BY o_orderdate DESC, concat('orders/', cast(l_orderkey as string), '.md') DESC, l_linenumber DESC, p_brand DESC) AS r FROM lines) WHERE r = 1"
    )


def _last_names(spark, sf):
    declared = V.alias_declarations(spark, sf).withColumn("ord", F.struct("ord", "new_name"))
    return aliases.last_declared(declared)


@query("alias_last_declared", _last_names_sql(), "lines")
def alias_last_declared(spark, sf):
    return _last_names(spark, sf)


@query(
    "alias_global",
    "SELECT * FROM (" + V.edges_sql("o") + ")",
    "triples",
    extra={
        "names": _last_names_sql(),
        "renamed": "SELECT source_category, coalesce(a.new_name, source_label) AS source_label, relationship, target_category, coalesce(b.new_name, target_label) AS target_label "
        "FROM triples LEFT JOIN names a ON source_label = a.old_name LEFT JOIN names b ON target_label = b.old_name",
        "o": V.oriented_sql("renamed"),
    },
)
def alias_global(spark, sf):
    return T.edges(T.graph_facts(V.triples(spark, sf), _last_names(spark, sf)))


@query(
    "alias_validation",
    "SELECT 'circular' AS problem, least(a.c_name, a.contact) AS old_name, greatest(a.c_name, a.contact) AS new_name, count(*) AS n FROM "
    "(SELECT DISTINCT p_brand, c_name, contact FROM lines) a JOIN (SELECT DISTINCT p_brand, c_name, contact FROM lines) b "
    "ON a.p_brand = b.p_brand AND a.c_name = b.contact AND a.contact = b.c_name WHERE a.c_name <= a.contact GROUP BY ALL",
    "lines",
)
def alias_validation(spark, sf):
    declared = V.lines(spark, sf).select(
        F.col("p_brand").alias("source_file"), F.col("c_name").alias("old_name"), F.col("contact").alias("new_name")
    )
    found = aliases.validate_aliases(declared)
    return found.groupBy("problem", "old_name", "new_name").agg(F.count(F.lit(1)).alias("n"))


# Edges in other letters against the entities of closed lines only.
_LOOSE = (
    "SELECT DISTINCT edge_type, CASE WHEN relationship = 'supplies' THEN upper(src) ELSE src END AS src, "
    "CASE WHEN relationship = 'buys_from' THEN concat(' ', lower(dst)) ELSE dst END AS dst, relationship FROM edges"
)
_CLOSED = V.entities_sql("(" + V.oriented_sql("(SELECT * FROM triples WHERE l_linestatus = 'F')") + ")")
_RESOLVED = (
    "SELECT l.*, coalesce(a.id, c.id) AS src_id, coalesce(b.id, d.id) AS dst_id FROM "
    "(SELECT *, CASE WHEN edge_type LIKE 'PERSON%' THEN 'Person' ELSE 'Company' END AS sc, CASE WHEN edge_type LIKE '%PERSON' THEN 'Person' ELSE 'Company' END AS tc FROM loose) l "
    "LEFT JOIN closed a ON a.category = sc AND a.id = trim(src) LEFT JOIN closed b ON b.category = tc AND b.id = trim(dst) "
    "LEFT JOIN (SELECT category, lower(id) AS k, min(id) AS id FROM closed GROUP BY ALL) c ON c.category = sc AND c.k = lower(trim(src)) "
    "LEFT JOIN (SELECT category, lower(id) AS k, min(id) AS id FROM closed GROUP BY ALL) d ON d.category = tc AND d.k = lower(trim(dst))"
)
_CHECK = {"loose": _LOOSE, "closed": _CLOSED, "resolved": _RESOLVED}


def _resolved(spark, sf):
    # All facts and those of closed lines in one pass, written as both edges and entities read them.
    facts = checkpointed(T.graph_facts(V.triples(spark, sf), marks={"closed": F.col("l_linestatus") == "F"}))
    edges = T.edges(facts)
    # Edges are distinct, and other letters can make two equal only within these relations; the rest is not shuffled for that.
    respelt = F.coalesce(F.col("relationship").isin("supplies", "buys_from"), F.lit(False))
    loose = edges.where(respelt).withColumns({
        "src": F.when(F.col("relationship") == "supplies", F.upper("src")).otherwise(F.col("src")),
        "dst": F.when(F.col("relationship") == "buys_from", F.concat(F.lit(" "), F.lower("dst"))).otherwise(F.col("dst")),
    }).distinct().unionByName(edges.where(~respelt))
    closed = checkpointed(T.entities(facts.where("closed")))
    return integrity.resolve_ends(loose, closed)


@query(
    "edge_validation",
    "SELECT edge_type, src_id AS src, dst_id AS dst, relationship FROM resolved WHERE src_id IS NOT NULL AND dst_id IS NOT NULL",
    "edges", extra=_CHECK,
)
def edge_validation(spark, sf):
    return integrity.valid_edges(_resolved(spark, sf))


@query(
    "edge_quality",
    "SELECT edge_type, count(*) AS n_rows, count(*) FILTER (src_id IS NULL OR dst_id IS NULL) AS n_removed, "
    "count(DISTINCT CASE WHEN src_id IS NULL THEN trim(src) END) AS missing_src, count(DISTINCT CASE WHEN dst_id IS NULL THEN trim(dst) END) AS missing_dst FROM resolved GROUP BY edge_type",
    "edges", extra=_CHECK,
)
def edge_quality(spark, sf):
    return integrity.edge_quality(_resolved(spark, sf))


_KEYS = (
    "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'null' WHEN '2-HIGH' THEN ' None ' WHEN '3-MEDIUM' THEN ' ' "
    "WHEN '5-LOW' THEN NULL ELSE concat('order ', cast(o_orderkey as string)) END AS id FROM orders"
)
_VALID = "id IS NOT NULL AND lower(trim(id)) NOT IN ('', 'null', 'none')"


def _keys(spark, sf):
    return V.table(spark, sf, "orders").select(
        "o_orderkey",
        F.expr(
            "CASE o_orderpriority WHEN '1-URGENT' THEN 'null' WHEN '2-HIGH' THEN ' None ' WHEN '3-MEDIUM' THEN ' ' "
            "WHEN '5-LOW' THEN NULL ELSE concat('order ', cast(o_orderkey as string)) END"
        ).alias("id"),
    )


@query("invalid_keys", f"SELECT count(*) AS n_rows, count(*) FILTER (NOT ({_VALID})) AS n_invalid FROM keys", extra={"keys": _KEYS})
def invalid_keys(spark, sf):
    return integrity.key_quality(_keys(spark, sf), "id")


@query("valid_keys", f"SELECT * FROM keys WHERE {_VALID}", extra={"keys": _KEYS})
def valid_keys(spark, sf):
    return integrity.valid_rows(_keys(spark, sf), "id")


@query("invalid_sample", f"SELECT * FROM keys WHERE NOT ({_VALID}) ORDER BY o_orderkey LIMIT 5", extra={"keys": _KEYS})
def invalid_sample(spark, sf):
    return integrity.sample_invalid(_keys(spark, sf), ["o_orderkey"], "id")


@query(
    "existing_ends",
    "SELECT DISTINCT c_name AS src, s_name AS dst FROM lines WHERE o_orderstatus = 'F' AND s_name IN (SELECT s_name FROM supplier WHERE s_acctbal > 0) "
    "AND c_name IN (SELECT c_name FROM customer WHERE c_acctbal > 0)",
    "lines",
)
def existing_ends(spark, sf):
    pairs = V.lines(spark, sf).where(F.col("o_orderstatus") == "F").select(F.col("c_name").alias("src"), F.col("s_name").alias("dst")).distinct()
    people = V.table(spark, sf, "customer").where(F.col("c_acctbal") > 0).select(F.col("c_name").alias("id"))
    companies = V.table(spark, sf, "supplier").where(F.col("s_acctbal") > 0).select(F.col("s_name").alias("id"))
    return integrity.existing_ends(pairs, people, companies)


# Patterns


def _pattern_graph(spark, sf):
    entities, edges = V.graph(spark, sf)
    return entities, patterns.typed_edges(edges)


def _references(spark, sf):
    """Company-to-note edges: a supplier and the orders that name it."""
    named = V.lines(spark, sf).select(F.col("s_name").alias("src"), F.expr("concat('orders/', cast(l_orderkey as string), '.md')").alias("dst")).distinct()
    return patterns.typed_edges(named.withColumn("edge_type", F.lit("COMPANY_REFERENCE")))


_REFS = "SELECT DISTINCT s_name AS src, concat('orders/', cast(l_orderkey as string), '.md') AS dst FROM lines"
_PC = "SELECT * FROM edges WHERE edge_type = 'PERSON_TO_COMPANY'"


@query("pattern_match", "SELECT edge_type, src, src AS src_label, relationship, dst, dst AS dst_label FROM pc", "edges", extra={"pc": _PC})
def pattern_match(spark, sf):
    entities, edges = _pattern_graph(spark, sf)
    return patterns.match_pattern(entities, edges, "Person", "Company").select("edge_type", "src", "src_label", "relationship", "dst", "dst_label")


@query(
    "two_hop_counts",
    "SELECT middle, n_in, n_out, n_in * n_out AS n_paths FROM (SELECT dst AS middle, count(*) AS n_in FROM pc GROUP BY dst) JOIN (SELECT src AS middle, count(*) AS n_out FROM refs GROUP BY src) USING (middle)",
    "edges", extra={"pc": _PC, "refs": _REFS},
)
def two_hop_counts(spark, sf):
    first = patterns.typed_edges(V.edges(spark, sf)).where(F.col("edge_type") == "PERSON_TO_COMPANY")
    return patterns.two_hop_counts(first, _references(spark, sf))


@query(
    "two_hop",
    "SELECT pc.src AS a, pc.relationship AS r1, pc.dst AS m, CAST(NULL AS VARCHAR) AS r2, refs.dst AS b FROM pc JOIN refs ON pc.dst = refs.src ORDER BY a, r1, m, b LIMIT 50",
    "edges", extra={"pc": _PC, "refs": _REFS},
)
def two_hop(spark, sf):
    first = patterns.typed_edges(V.edges(spark, sf)).where(F.col("edge_type") == "PERSON_TO_COMPANY")
    return patterns.two_hop_page(first, _references(spark, sf))


_ADJ = (
    "SELECT node, other, count(*) AS m FROM (SELECT concat(initcap(split_part(edge_type, '_', 1)), ':', src) AS node, concat(initcap(split_part(edge_type, '_', 3)), ':', dst) AS other FROM edges "
    "UNION ALL SELECT concat(initcap(split_part(edge_type, '_', 3)), ':', dst), concat(initcap(split_part(edge_type, '_', 1)), ':', src) FROM edges) GROUP BY ALL"
).replace("initcap(split_part(edge_type, '_', 1))", "CASE WHEN edge_type LIKE 'PERSON%' THEN 'Person' ELSE 'Company' END").replace(
    "initcap(split_part(edge_type, '_', 3))", "CASE WHEN edge_type LIKE '%PERSON' THEN 'Person' ELSE 'Company' END"
)


@query(
    "walk_counts",
    "SELECT node, walks_1, walks_2, CAST(sum(m * w2.w) AS BIGINT) AS walks_3 FROM (SELECT node, CAST(sum(m) AS BIGINT) AS walks_1 FROM adj GROUP BY node) a "
    "JOIN (SELECT node, w AS walks_2 FROM w2) b USING (node) JOIN adj USING (node) JOIN w2 ON adj.other = w2.node GROUP BY ALL",
    "edges",
    extra={"adj": _ADJ, "w1": "SELECT node, sum(m) AS w FROM adj GROUP BY node", "w2": "SELECT adj.node, CAST(sum(m * w) AS BIGINT) AS w FROM adj JOIN w1 ON adj.other = w1.node GROUP BY adj.node"},
)
def walk_counts(spark, sf):
    counted = patterns.walk_counts(patterns.typed_edges(V.edges(spark, sf)))
    return counted.select("node", *[F.col(f"walks_{h}").cast("bigint").alias(f"walks_{h}") for h in (1, 2, 3)])


@query(
    "reach_1_3",
    "SELECT seed, node, min(hop) AS hop FROM (SELECT node AS seed, node, 0 AS hop FROM seeds UNION ALL SELECT s.node, a.other, 1 FROM seeds s JOIN adj a USING (node) "
    "UNION ALL SELECT seed, node, 2 FROM second UNION ALL SELECT seed, other, 3 FROM second JOIN adj USING (node)) GROUP BY ALL",
    "edges",
    extra={"adj": _ADJ, "seeds": "SELECT concat('Company:', s_name) AS node FROM supplier ORDER BY s_acctbal DESC, s_name LIMIT 1",
           "second": "SELECT DISTINCT s.node AS seed, b.other AS node FROM seeds s JOIN adj a USING (node) JOIN adj b ON a.other = b.node"},
)
def reach_1_3(spark, sf):
    """Everything within three steps of the supplier with the highest balance (the seed is the argument)."""
    seeds = V.table(spark, sf, "supplier").orderBy(F.desc("s_acctbal"), "s_name").limit(1).select(F.concat(F.lit("Company:"), "s_name").alias("node"))
    return patterns.reachable(patterns.typed_edges(V.edges(spark, sf)), seeds)


@query(
    "neighbourhood",
    "SELECT edge_type, src, dst, relationship FROM edges WHERE edge_type IN ('PERSON_TO_COMPANY', 'COMPANY_TO_COMPANY') AND "
    "(dst IN (SELECT s_name FROM supplier WHERE s_acctbal < 2000) OR (edge_type = 'COMPANY_TO_COMPANY' AND src IN (SELECT s_name FROM supplier WHERE s_acctbal < 2000)))",
    "edges",
)
def neighbourhood(spark, sf):
    ids = V.table(spark, sf, "supplier").where(F.col("s_acctbal") < 2000).select(F.lit("Company").alias("node_type"), F.col("s_name").alias("id"))
    edges = patterns.typed_edges(V.edges(spark, sf))
    return patterns.neighbourhood(edges, ids, ["PERSON_TO_COMPANY", "COMPANY_TO_COMPANY"]).select("edge_type", "src", "dst", "relationship")


@query("node_counts", "SELECT category, count(*) AS n FROM entities GROUP BY category", "entities")
def node_counts(spark, sf):
    return patterns.node_counts(V.entities(spark, sf))


@query("edge_counts", "SELECT edge_type, count(*) AS n FROM edges GROUP BY edge_type", "edges")
def edge_counts(spark, sf):
    return patterns.edge_counts(V.edges(spark, sf))


@query(
    "graph_first_rows",
    f"SELECT edge_type, src, dst, relationship FROM edges ORDER BY edge_type, src, dst, relationship LIMIT {fixed.DEFAULT_RESULT_ROWS}",
    "edges",
)
def graph_first_rows(spark, sf):
    """The row limit of a result as the caller's argument; the match itself has none."""
    entities, edges = _pattern_graph(spark, sf)
    found = patterns.graph_result(entities, edges, limit=fixed.DEFAULT_RESULT_ROWS).relationships
    name = lambda c: F.regexp_replace(c, "^[^:]*:", "")
    return found.select(
        F.col("type").alias("edge_type"), name("start_id").alias("src"), name("end_id").alias("dst"),
        F.try_element_at("properties", F.lit("relationship")).alias("relationship"),
    )


@query("paged_nodes", "SELECT category, id FROM entities ORDER BY id, category LIMIT 50 OFFSET 20", "entities")
def paged_nodes(spark, sf):
    nodes = V.entities(spark, sf).select("category", "id")
    return patterns.page(nodes, ["id", "category"], skip=20, limit=50, max_skip=fixed.MAX_SKIP, warn_skip=fixed.WARN_SKIP)


@query(
    "node_filters",
    "SELECT category, count(*) AS n, count(*) FILTER (regexp_matches(id, '.*[A-Z].*')) AS n_upper, count(*) FILTER (id >= 'B' AND id <= 'D') AS n_range, count(DISTINCT id) AS n_ids FROM entities WHERE id IS NOT NULL GROUP BY category",
    "entities",
)
def node_filters(spark, sf):
    nodes = V.entities(spark, sf).where(F.col("id").isNotNull() & F.col("label").isNotNull())
    return nodes.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("id").rlike(".*[A-Z].*")).alias("n_upper"),
        F.count_if(F.col("id").between("B", "D")).alias("n_range"), F.count_distinct("id").alias("n_ids"),
    )


_KIND1 = "CASE WHEN edge_type LIKE 'PERSON%' THEN 'Person' ELSE 'Company' END"
_KIND2 = "CASE WHEN edge_type LIKE '%PERSON' THEN 'Person' ELSE 'Company' END"


@query(
    "graph_relationships",
    f"SELECT concat(edge_type, ':', md5(concat(src, '|', relationship, '|', dst))) AS rel_id, concat({_KIND1}, ':', src) AS start_id, concat({_KIND2}, ':', dst) AS end_id, edge_type AS type, relationship FROM edges",
    "edges",
)
def graph_relationships(spark, sf):
    entities, edges = _pattern_graph(spark, sf)
    found = patterns.graph_result(entities, edges).relationships
    return found.withColumn("relationship", F.try_element_at("properties", F.lit("relationship"))).drop("properties")


@query(
    "graph_nodes",
    f"SELECT DISTINCT concat(category, ':', id) AS node_id, category, id AS label FROM (SELECT {_KIND1} AS category, src AS id FROM edges UNION ALL SELECT {_KIND2}, dst FROM edges)",
    "edges",
)
def graph_nodes(spark, sf):
    entities, edges = _pattern_graph(spark, sf)
    found = patterns.graph_result(entities, edges).nodes
    return found.select("node_id", F.col("labels")[0].alias("category"), F.try_element_at("properties", F.lit("label")).alias("label"))
