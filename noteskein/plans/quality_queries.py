"""Registered queries over model responses, scores and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteskein.functions import responses as R
from noteskein.operators import quality as Q
from noteskein.plans import views as V
from noteskein.plans.registry import query
from noteskein.scale import unnest

# Responses



@query(
    "json_clean",
    "SELECT doc_id, md5(CASE lang WHEN 'en' THEN regexp_replace(substr(raw, instr(raw, '{'), length(raw) - 9 - instr(raw, '{') + 1), ',(\\s*[}\\]])', '\\1', 'g') "
    "WHEN 'fr' THEN concat('{maybe}</think>Result: ', substr(raw, instr(raw, '{\"rel'), length(raw) - 10 - instr(raw, '{\"rel') + 1)) "
    "WHEN 'de' THEN substr(raw, 1, instr(raw, '}')) ELSE raw END) AS cleaned FROM responses".replace("length(raw) - 9", "length(raw) - 10"),
    "responses",
)
def json_clean(spark, sf):
    return V.responses(spark, sf).select("doc_id", F.md5(R.clean_response(F.col("raw"))).alias("cleaned"))


_SALVAGED = (
    "SELECT doc_id, 'Person' AS source_category, concat('P', cast(doc_id as string)) AS source_label, 'works_at' AS relationship, 'Company' AS target_category, source AS target_label FROM responses WHERE lang <> 'de' "
    "UNION ALL SELECT doc_id, 'Company', source, '', 'Company', concat('C', cast(doc_id as string)) FROM responses WHERE lang = 'en' "
    "UNION ALL SELECT doc_id, 'Concept', lang, 'tags', 'Company', source FROM responses WHERE lang = 'en'"
)


@query("json_salvage", _SALVAGED, "responses")
def json_salvage(spark, sf):
    cleaned = R.clean_response(R.strip_reasoning(F.col("raw")))
    return unnest(V.responses(spark, sf), ["doc_id"], R.read_triples(cleaned), "source_category")


@query(
    "json_diagnose",
    "SELECT doc_id, CASE lang WHEN 'en' THEN 3 WHEN 'es' THEN 3 ELSE 1 END AS n_objects, CASE lang WHEN 'en' THEN 2 WHEN 'es' THEN 2 END AS first_invalid, lang = 'de' AS truncated FROM responses",
    "responses",
)
def json_diagnose(spark, sf):
    return V.responses(spark, sf).select("doc_id", R.diagnose(F.col("raw")).alias("d")).select("doc_id", "d.*")


@query(
    "reasoning_strip",
    "SELECT event_id, CASE event_type WHEN 'click' THEN props WHEN 'view' THEN props WHEN 'error' THEN concat('no json ', cast(user_id as string)) ELSE props END AS answer FROM events",
)
def reasoning_strip(spark, sf):
    raw = F.expr(
        "case event_type when 'click' then concat('<think>{\"a\"}</think>', chr(10), props) when 'view' then concat('Answer: ', props, ' ok') "
        "when 'error' then concat('no json ', cast(user_id as string)) else props end"
    )
    return V.table(spark, sf, "events").select("event_id", R.strip_reasoning(raw).alias("answer"))


@query(
    "reasoning_fallback",
    "SELECT event_id, CASE event_type WHEN 'click' THEN props WHEN 'view' THEN '' ELSE 'answer' END AS answer FROM events",
)
def reasoning_fallback(spark, sf):
    content = F.when(F.col("event_type").isin("click", "view"), F.lit("")).otherwise(F.lit("answer"))
    thinking = F.when(F.col("event_type") == "click", F.concat(F.lit("hm {x} so "), "props", F.lit(" .")))
    return V.table(spark, sf, "events").select("event_id", R.answer_or_reasoning(content, thinking).alias("answer"))


@query(
    "nodes_edges_flatten",
    "SELECT o_orderkey, c_name AS source, concat('n', cast(o_custkey + 1 as string)) AS target, 'RELATED_TO' AS relationship, 'Person' AS source_category, 'Unknown' AS target_category FROM orders JOIN customer ON c_custkey = o_custkey "
    "UNION ALL SELECT o_orderkey, o_orderpriority, c_name, 'sets', 'Priority', 'Person' FROM orders JOIN customer ON c_custkey = o_custkey",
)
def nodes_edges_flatten(spark, sf):
    text = F.expr(
        "concat('{\"nodes\": [{\"id\": \"n', cast(o_custkey as string), '\", \"name\": \"', c_name, '\", \"type\": \"Person\"}, {\"id\": \"p\", \"name\": \"old\", \"type\": \"Old\"}, {\"id\": \"p\", \"name\": \"', o_orderpriority, '\", \"type\": \"Priority\"}], "
        "\"edges\": [{\"source\": \"n', cast(o_custkey as string), '\", \"target\": \"n', cast(o_custkey + 1 as string), '\"}, {\"source\": \"p\", \"target\": \"n', cast(o_custkey as string), '\", \"type\": \"sets\"}]}')"
    )
    joined = V.table(spark, sf, "orders").join(V.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return unnest(joined, ["o_orderkey"], R.graph_relations(text), "relationship")


_STRUCTURED = (
    "concat('{\"professional\": [{\"person\": \"', c_name, '\", \"company\": \"', o_orderpriority, '\", \"role\": \"Chief Buyer\"}], \"personal\": [{\"person1\": \"', c_name, '\", \"person2\": \"X\", \"relation\": \"Friend Of\"}], "
    "\"educational_background\": [{\"person\": \"', c_name, '\", \"institution\": \"U\"}], \"business_partnerships\": [{\"company1\": \"A\", \"partner\": \"B\", \"target\": \"T\", \"source_category\": \"Company\"}], \"advisory_roles\": [{\"person\": \"\", \"company\": \"Z\"}]}')"
)


def _structured(spark, sf):
    return V.table(spark, sf, "orders").join(V.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))


@query(
    "structured_flatten",
    "SELECT o_orderkey, c_name AS source, o_orderpriority AS target, 'Chief Buyer' AS relationship, 'Unknown' AS source_category, 'Unknown' AS target_category FROM oc "
    "UNION ALL SELECT o_orderkey, c_name, 'U', 'related_to', 'Unknown', 'Unknown' FROM oc UNION ALL SELECT o_orderkey, 'A', 'T', 'related_to', 'Company', 'Unknown' FROM oc",
    extra={"oc": "SELECT * FROM orders JOIN customer ON o_custkey = c_custkey"},
)
def structured_flatten(spark, sf):
    return unnest(_structured(spark, sf), ["o_orderkey"], R.structured_relations(F.expr(_STRUCTURED)), "relationship")


@query(
    "section_relations",
    "SELECT o_orderkey, c_name AS source, o_orderpriority AS target, 'chief_buyer' AS relationship FROM oc UNION ALL SELECT o_orderkey, c_name, 'X', 'friend_of' FROM oc "
    "UNION ALL SELECT o_orderkey, c_name, 'U', 'graduated_from' FROM oc UNION ALL SELECT o_orderkey, 'A', 'B', 'partners_with' FROM oc UNION ALL SELECT o_orderkey, '', 'Z', 'advises' FROM oc",
    extra={"oc": "SELECT * FROM orders JOIN customer ON o_custkey = c_custkey"},
)
def section_relations(spark, sf):
    return unnest(_structured(spark, sf), ["o_orderkey"], R.section_relations(F.expr(_STRUCTURED)), "relationship")


# Scores

_SCORE = {
    "want": "SELECT model, doc, least(lower(source), lower(target)) AS lo, greatest(lower(source), lower(target)) AS hi, count(*) AS n FROM expected_pairs GROUP BY ALL",
    "got": "SELECT model, doc, least(lower(source), lower(target)) AS lo, greatest(lower(source), lower(target)) AS hi, count(*) AS n FROM extracted_pairs GROUP BY ALL",
    "sums": "SELECT model, CAST(sum(w.n) AS BIGINT) AS n_expected, CAST(sum(CASE WHEN g.n IS NOT NULL THEN w.n ELSE 0 END) AS BIGINT) AS n_hits, "
    "(SELECT CAST(sum(n) AS BIGINT) FROM got x WHERE x.model = w.model) AS n_extracted FROM want w LEFT JOIN got g USING (model, doc, lo, hi) GROUP BY model",
    "ratios": "SELECT *, n_hits / n_extracted AS p, n_hits / n_expected AS r FROM sums",
}


def _scores(spark, sf):
    return Q.score(V.expected_pairs(spark, sf), V.extracted_pairs(spark, sf), ["model"], ["doc"])


@query(
    "pr_f1",
    "SELECT model, n_expected, n_extracted, n_hits, round(p, 9) AS precision, round(r, 9) AS recall, round(2 * p * r / (p + r), 9) AS f1 FROM ratios",
    "expected_pairs", "extracted_pairs", extra=_SCORE,
)
def pr_f1(spark, sf):
    rounded = [F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")]
    return _scores(spark, sf).select("model", "n_expected", "n_extracted", "n_hits", *rounded)


@query("accuracy", "SELECT model, round(r, 9) AS accuracy FROM ratios", "expected_pairs", "extracted_pairs", extra=_SCORE)
def accuracy(spark, sf):
    return _scores(spark, sf).select("model", F.round("accuracy", 9).alias("accuracy"))


@query(
    "model_summary",
    "SELECT (SELECT model FROM s WHERE n_hits > 0 ORDER BY total, model LIMIT 1) AS fastest, (SELECT model FROM s ORDER BY f1 DESC, model LIMIT 1) AS most_accurate, (SELECT model FROM s ORDER BY n_extracted DESC, model LIMIT 1) AS most_complete",
    "expected_pairs", "extracted_pairs",
    extra={**_SCORE, "s": "SELECT ratios.*, round(2 * p * r / (p + r), 12) AS f1, t.total FROM ratios JOIN (SELECT o_orderpriority AS model, min(o_totalprice) AS total FROM orders GROUP BY 1) t USING (model)"},
)
def model_summary(spark, sf):
    times = V.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("model")).agg(F.min("o_totalprice").alias("response_time"))
    results = _scores(spark, sf).join(times, "model").withColumns({"success": F.col("n_hits") > 0, "f1": F.round("f1", 12)})
    return Q.model_summary(results)


@query(
    "speed_table",
    "SELECT o_orderpriority AS model, min(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS extract, min(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS classify, "
    "min(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) + min(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS total FROM orders GROUP BY 1",
)
def speed_table(spark, sf):
    results = V.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("model"), F.expr("case o_orderstatus when 'O' then 'extract' when 'F' then 'classify' else 'other' end").alias("task_type"),
        F.lit(True).alias("success"), F.col("o_totalprice").alias("response_time"),
    )
    return Q.speed_table(results, ["extract", "classify"])


_LEFT = "case event_type when 'click' then 'Works_For' when 'view' then 'is_ceo_of' when 'signup' then 'studied at' when 'error' then 'likes' else 'employed_at_worksat' end"
_RIGHT = "case when value > 20 then 'works_at' when value > 10 then 'graduatedfrom' when value > 5 then 'CEO_OF' else 'chief executive officer of' end"


@query(
    "relation_match",
    "SELECT event_type, value > 20 AS high, count(*) FILTER ("
    "(event_type = 'click' AND value > 20) OR (event_type = 'view' AND value <= 10) OR (event_type = 'signup' AND value > 10 AND value <= 20) OR (event_type = 'purchase' AND value > 20)) AS n_match, count(*) AS n FROM events GROUP BY ALL",
)
def relation_match(spark, sf):
    pairs = V.table(spark, sf, "events").select("event_type", (F.col("value") > 20).alias("high"), Q.relation_matches(F.expr(_LEFT), F.expr(_RIGHT)).alias("hit"))
    return pairs.groupBy("event_type", "high").agg(F.count_if("hit").alias("n_match"), F.count(F.lit(1)).alias("n"))


# Logs


@query(
    "latency_rollup",
    "SELECT count(*) AS total, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed, round(100.0 * count(*) FILTER (success) / count(*), 6) AS success_pct, "
    "round(avg(response_time) FILTER (success), 6) AS avg_time, min(response_time) FILTER (success) AS min_time, max(response_time) FILTER (success) AS max_time FROM log",
    "log",
)
def latency_rollup(spark, sf):
    rolled = Q.request_rollup(V.request_log(spark, sf))
    return rolled.withColumns({"success_pct": F.round("success_pct", 6), "avg_time": F.round("avg_time", 6)})


@query("slow_requests", "SELECT query_id, name, response_time FROM log WHERE success AND response_time > 5", "log")
def slow_requests(spark, sf):
    return Q.slow_requests(V.request_log(spark, sf)).select("query_id", "name", "response_time")


@query("failed_requests", "SELECT query_id, name FROM log WHERE NOT success", "log")
def failed_requests(spark, sf):
    return Q.failed_requests(V.request_log(spark, sf)).select("query_id", "name")


@query(
    "query_counters",
    "SELECT count(*) AS n_queries, count(*) FILTER (NOT success) AS n_failed, round(100.0 * count(*) FILTER (success) / count(*), 6) AS success_rate, CAST(floor((max(ts_us) - min(ts_us)) / 1000000) AS BIGINT) AS uptime_seconds FROM log",
    "log",
)
def query_counters(spark, sf):
    return Q.query_counters(V.request_log(spark, sf)).withColumn("success_rate", F.round("success_rate", 6))


@query("recent_queries", "SELECT query_id, name, ts_us FROM log ORDER BY ts_us DESC, query_id DESC LIMIT 100", "log")
def recent_queries(spark, sf):
    return Q.recent_queries(V.request_log(spark, sf)).select("query_id", "name", "ts_us")
