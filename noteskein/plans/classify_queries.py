"""Registered queries over classification tasks, prompts, results and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from noteskein.functions import prompts as P, responses as R
from noteskein.functions.frontmatter import note_entries
from noteskein.functions.text import body_hash, from_julian, py_strip, to_julian
from noteskein.operators import classify as C
from noteskein.plans import views as V
from noteskein.plans.classify_run import classify, store_results
from noteskein.plans.registry import query
from noteskein.plans.stand_ins import rule_based_classifier
from noteskein.scale import unnest
from noteskein.schemas import TAG_SCHEMA


@query("worklist", "SELECT note_id, tag, state FROM states WHERE state <> 'full'", "states")
def worklist(spark, sf):
    work = C.worklist(V.note_keys(spark, sf).select("id", "entries"), V.tasks(spark, sf))
    return work.select(F.col("id").alias("note_id"), F.col("task.tag").alias("tag"), "state")


@query("already_classified", "SELECT note_id, tag FROM states WHERE state = 'full' AND starts_with(note_id, 'People/')", "states")
def already_classified(spark, sf):
    work = C.worklist(V.note_keys(spark, sf).select("id", "entries"), V.tasks(spark, sf), folder="People", force=True)
    return work.where(F.col("state") == "full").select(F.col("id").alias("note_id"), F.col("task.tag").alias("tag"))


@query(
    "coverage",
    "SELECT tag, count(*) FILTER (state = 'full') AS n_full, count(*) FILTER (state = 'partial') AS n_partial, count(*) FILTER (state = 'none') AS n_none FROM states GROUP BY tag",
    "states",
)
def coverage(spark, sf):
    return C.coverage(V.note_keys(spark, sf), V.tasks(spark, sf))


@query(
    "check_tasks",
    "SELECT r.tag, CASE WHEN t.tag IS NULL THEN concat('Task not found: ', r.tag) WHEN NOT enabled THEN concat('Task is disabled: ', r.tag) END AS problem FROM "
    "(SELECT lower(n_name) AS tag FROM nation UNION ALL SELECT lower(r_name) FROM region) r LEFT JOIN tasks t ON r.tag = t.tag",
    "tasks",
)
def check_tasks(spark, sf):
    wanted = V.table(spark, sf, "nation").select(F.lower("n_name").alias("tag")).union(V.table(spark, sf, "region").select(F.lower("r_name")))
    return C.check_tasks(wanted, V.tasks(spark, sf))


_STRIP = "trim(body, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_SINGLE_RULE = (
    "CASE output_type WHEN 'list' THEN 'Return a comma-separated list. Example: \"item1, item2, item3\". Return empty string if nothing found.' "
    "WHEN 'text' THEN 'Return a single text string. Return empty string if nothing found.' WHEN 'boolean' THEN 'Return exactly \"true\" or \"false\".' "
    "ELSE 'Return a single number. Return 0 if cannot determine.' END"
)


def _work(spark, sf):
    notes = V.note_keys(spark, sf).withColumn("body", py_strip(F.col("body")))
    return C.with_prompts(C.worklist(notes, V.tasks(spark, sf), force=True))


_SINGLE_PROMPTS = {
    "prompts": "SELECT note_id, tag, model, concat('You are a classification assistant.', chr(10), 'Analyze the note and extract the requested information.', chr(10), chr(10), 'Output format: ', output_type, chr(10), "
    f"{_SINGLE_RULE}, chr(10), chr(10), 'Return ONLY the result, no explanation, no quotes around the result.') AS system, "
    f"concat(prompt, chr(10), chr(10), '=== NOTE ===', chr(10), {_STRIP}, chr(10), '=== END ===') AS user FROM states WHERE task_type = 'single'"
}


@query("prompt_single", "SELECT note_id, tag, md5(system) AS system, md5(user) AS user FROM prompts", "states", extra=_SINGLE_PROMPTS)
def prompt_single(spark, sf):
    work = _work(spark, sf).where(F.col("task.task_type") == "single")
    return work.select(F.col("id").alias("note_id"), F.col("task.tag").alias("tag"), F.md5("system").alias("system"), F.md5("user").alias("user"))


_RULES = {
    "quality_tag": ("Number. Return 0 if cannot determine.", "42", "Quality", "number"),
    "risk_tag": ('Exactly "true" or "false".', "true", "Is it risky?", "boolean"),
}
_LIST_RULE = 'Comma-separated list (e.g., "item1, item2, item3"). Return empty string if nothing found.'


def _multi_sql() -> str:
    example = (
        "'{' || chr(10) || '    \"results\": {' || chr(10) || '        \"quality_tag\": 42,' || chr(10) || '        \"risk_tag\": true' || "
        "CASE WHEN len(expected) = 3 THEN ',' || chr(10) || '        \"' || tag || '\": \"item1, item2\"' ELSE '' END || chr(10) || '    }' || chr(10) || '}'"
    )
    rules = (
        f"'- quality_tag: {_RULES['quality_tag'][0]}' || chr(10) || '- risk_tag: {_RULES['risk_tag'][0]}' || "
        f"CASE WHEN len(expected) = 3 THEN chr(10) || '- ' || tag || ': {_LIST_RULE}' ELSE '' END"
    )
    asks = (
        "'- quality_tag: Quality (type: number)' || chr(10) || '- risk_tag: Is it risky? (type: boolean)' || "
        "CASE WHEN len(expected) = 3 THEN chr(10) || '- ' || tag || ': ' || tag || ' (type: list)' ELSE '' END"
    )
    return (
        "SELECT note_id, tag, md5('You are a classification assistant.' || chr(10) || 'Analyze the note and extract multiple pieces of information.' || chr(10) || chr(10) || "
        f"'You must return a JSON object with the following structure:' || chr(10) || {example} || chr(10) || chr(10) || 'Output format rules:' || chr(10) || {rules} || chr(10) || chr(10) || "
        "'Return ONLY valid JSON, no explanation, no markdown code blocks.') AS system, "
        f"md5(prompt || chr(10) || chr(10) || '=== NOTE ===' || chr(10) || {_STRIP} || chr(10) || '=== END ===' || chr(10) || chr(10) || 'Extract the following information:' || chr(10) || {asks}) AS user "
        "FROM states WHERE task_type = 'multi'"
    )


@query("prompt_multi", _multi_sql(), "states")
def prompt_multi(spark, sf):
    work = _work(spark, sf).where(F.col("task.task_type") == "multi")
    return work.select(F.col("id").alias("note_id"), F.col("task.tag").alias("tag"), F.md5("system").alias("system"), F.md5("user").alias("user"))


@query(
    "context_bands",
    "SELECT tag, CASE WHEN t > w * 0.9 THEN 'critical' WHEN t > w * 0.8 THEN 'large' ELSE 'ok' END AS context_band, count(*) AS n, CAST(sum(t) AS BIGINT) AS estimated_tokens FROM ("
    "SELECT tag, CASE WHEN contains(lower(model), 'qwen3') THEN 32768 ELSE 8192 END AS w, floor((length(system) + length(user)) / 4) AS t FROM prompts) GROUP BY ALL",
    "states", extra=_SINGLE_PROMPTS,
)
def context_bands(spark, sf):
    work = _work(spark, sf).where(F.col("task.task_type") == "single")
    return work.groupBy(F.col("task.tag").alias("tag"), "context_band").agg(
        F.count(F.lit(1)).alias("n"), F.sum("estimated_tokens").alias("estimated_tokens")
    )


@query(
    "combine_messages",
    "SELECT conv_id, md5(string_agg(concat(CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' ELSE 'Assistant' END, ': ', text), chr(10) || chr(10) ORDER BY turn)) AS prompt FROM conversations GROUP BY ALL",
)
def combine_messages(spark, sf):
    combined = C.combine_messages(V.table(spark, sf, "conversations"), "conv_id")
    return combined.select("conv_id", F.md5("prompt").alias("prompt"))


@query(
    "combine_prompt",
    "SELECT conv_id, md5(trim(concat(coalesce(string_agg(CASE WHEN role = 'system' THEN concat(text, chr(10), chr(10)) END, '' ORDER BY turn), ''), coalesce(string_agg(CASE WHEN role = 'user' THEN concat(text, chr(10), chr(10)) END, '' ORDER BY turn), '')), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS prompt FROM conversations GROUP BY conv_id",
)
def combine_prompt(spark, sf):
    parts = C.listed_messages(V.table(spark, sf, "conversations"), "conv_id")
    return parts.select("conv_id", F.md5(P.combined_prompt(F.col("messages"))).alias("prompt"))


# Results

_RAW_RESULT = (
    "case event_type when 'signup' then concat(' ', cast(user_id as string), ' ') when 'click' then concat('\"', cast(cast(floor(value) as bigint) as string), '.5\"') "
    "when 'view' then concat('''', case when user_id > 20 then 'Yes' else 'no' end, '''') when 'error' then '1_0' else concat(props, '.') end"
)
_KIND = "case event_type when 'view' then 'boolean' when 'purchase' then 'text' else 'number' end"


@query(
    "parse_typed",
    "SELECT event_id, CASE WHEN event_type = 'purchase' THEN concat(props, '.') END AS text_value, CASE WHEN event_type = 'view' THEN user_id > 20 END AS bool_value, "
    "CASE event_type WHEN 'signup' THEN user_id WHEN 'error' THEN 0 END AS int_value, CASE WHEN event_type = 'click' THEN floor(value) + 0.5 END AS float_value FROM events",
)
def parse_typed(spark, sf):
    raw = V.table(spark, sf, "events").select("event_id", F.expr(_RAW_RESULT).alias("raw"), F.expr(_KIND).alias("kind"))
    return raw.select("event_id", R.parse_typed(F.col("raw"), F.col("kind")).alias("p")).select("event_id", "p.*")


_MULTI_RAW = (
    "case event_type when 'signup' then concat('{\"results\": {\"quality_tag\": ', cast(user_id as string), ', \"risk_tag\": true, \"tags\": [\"a\", \"u', cast(user_id as string), '\"]}}') "
    "when 'click' then concat('```json', chr(10), '{\"results\": {\"quality_tag\": 1.5, \"risk_tag\": \"no\", \"tags\": \"', event_type, '\"}}', chr(10), '```') "
    "when 'view' then '{\"results\": {\"risk_tag\": true}}' when 'error' then 'sorry' else ' ' end"
)
_MULTI_SCHEMA = (
    '[{"tag":"quality_tag","output_type":"number"},{"tag":"risk_tag","output_type":"boolean"},{"tag":"tags","output_type":"list"}]'
)


def _multi(spark, sf):
    task = F.struct(F.from_json(F.lit(_MULTI_SCHEMA), TAG_SCHEMA).alias("tag_schema"))
    raw = V.table(spark, sf, "events").select("event_id", F.expr(_MULTI_RAW).alias("raw"), task.alias("task"))
    return C.read_multi(raw)


@query(
    "missing_tags",
    "SELECT event_id, CASE event_type WHEN 'view' THEN 'Missing tags in response: quality_tag, tags' WHEN 'error' THEN 'Invalid JSON response' WHEN 'purchase' THEN 'Empty response' END AS error FROM events",
)
def missing_tags(spark, sf):
    return _multi(spark, sf).select("event_id", "error")


@query(
    "multi_results",
    "SELECT event_id, 'quality_tag' AS tag, CASE event_type WHEN 'signup' THEN cast(user_id as string) ELSE '1.5' END AS value FROM events WHERE event_type IN ('signup', 'click') "
    "UNION ALL SELECT event_id, 'risk_tag', CASE event_type WHEN 'signup' THEN 'true' ELSE 'false' END FROM events WHERE event_type IN ('signup', 'click') "
    "UNION ALL SELECT event_id, 'tags', CASE event_type WHEN 'signup' THEN concat('\"a, u', cast(user_id as string), '\"') ELSE '\"click\"' END FROM events WHERE event_type IN ('signup', 'click')",
)
def multi_results(spark, sf):
    rows = unnest(_multi(spark, sf).where(F.col("error").isNull()), ["event_id"], F.col("parsed"), "tag")
    return rows.select("event_id", "tag", C.typed_json(F.col("parsed")).alias("value"))


# Runs


def _runs(spark, sf):
    return C.run_events_to_runs(V.run_events(spark, sf))


@query("run_lifecycle", "SELECT run_id, task_id, note_path, status, result, error, processing_time_ms FROM runs", "runs")
def run_lifecycle(spark, sf):
    return _runs(spark, sf).select("run_id", "task_id", "note_path", "status", "result", "error", "processing_time_ms")


@query(
    "run_status",
    "SELECT task_id, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'running') AS running, "
    "count(*) FILTER (status = 'pending') AS pending, count(*) AS total, count(DISTINCT note_path) AS distinct_notes FROM runs GROUP BY task_id",
    "runs",
)
def run_status(spark, sf):
    runs = _runs(spark, sf)
    return C.run_status(runs, "logs/").join(C.distinct_noted(runs), "task_id")


@query(
    "run_status_of_folder",
    "SELECT task_id, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'running') AS running, "
    "count(*) FILTER (status = 'pending') AS pending, count(*) AS total FROM runs WHERE note_path LIKE 'logs/u1%' GROUP BY task_id",
    "runs",
)
def run_status_of_folder(spark, sf):
    return C.run_status(_runs(spark, sf), "logs/u1")


@query(
    "run_history",
    "SELECT run_id, tag, task_name, status, started_us FROM (SELECT * FROM runs ORDER BY started_us DESC, run_id DESC LIMIT 100) r JOIN (SELECT id, tag, name AS task_name FROM tasks) t ON task_id = t.id",
    "runs", "tasks",
)
def run_history(spark, sf):
    return C.run_history(_runs(spark, sf), V.tasks(spark, sf)).select("run_id", "tag", "task_name", "status", "started_us")


_OUTCOME = "CASE WHEN state = 'full' THEN 'skipped' WHEN length(trim(body)) = 0 THEN 'failed' ELSE 'classified' END"
_STATS = (
    "SELECT tag, count(*) AS total, count(*) FILTER (o = 'classified') AS classified, 0 AS would_classify, count(*) FILTER (o = 'skipped') AS skipped, count(*) FILTER (o = 'failed') AS failed "
    f"FROM (SELECT tag, CASE WHEN lang = 'fr' AND state <> 'full' THEN 'failed' ELSE {_OUTCOME} END AS o FROM states) GROUP BY tag"
)


def _outcomes(spark, sf):
    """Notes in French have their body removed, so that they fail."""
    notes = V.note_keys(spark, sf).withColumn("body", F.when(F.startswith("id", F.lit("Companies/")), F.lit(" \n")).otherwise(F.col("body")))
    work = C.worklist(notes, V.tasks(spark, sf), force=True)
    return work.select(
        F.col("task.tag").alias("tag"), F.col("id").alias("note_path"), C.outcome(work).alias("outcome"), F.lit("Note content is empty").alias("error")
    )


@query("folder_stats", "SELECT * FROM stats", "states", extra={"stats": _STATS})
def folder_stats(spark, sf):
    return C.folder_stats(_outcomes(spark, sf))


@query(
    "total_stats",
    "SELECT CAST(sum(classified) AS BIGINT) AS classified, CAST(sum(failed) AS BIGINT) AS failed, CAST(sum(skipped) AS BIGINT) AS skipped FROM stats",
    "states", extra={"stats": _STATS},
)
def total_stats(spark, sf):
    return C.total_stats(C.folder_stats(_outcomes(spark, sf)))


@query("failed_notes", "SELECT tag, note_id AS note_path, 'Note content is empty' AS error FROM states WHERE lang = 'fr' AND state <> 'full'", "states")
def failed_notes(spark, sf):
    return C.failed_notes(_outcomes(spark, sf))


# Tags and tasks

_REMOVAL = {
    "hits": "SELECT 'quality_tag' AS tag, quality IS NOT NULL AS hit FROM docs UNION ALL SELECT 'risk_tag', coalesce(toxic, 0) = 1 FROM docs UNION ALL SELECT 'absent', false FROM docs",
    "stats": "SELECT tag, count(*) AS total, count(*) FILTER (hit) AS removed, count(*) FILTER (NOT hit) AS not_found FROM hits GROUP BY tag",
}


def _removal(spark, sf):
    return C.removal_stats(V.note_keys(spark, sf).select("id", "entries"), ["quality_tag", "risk_tag", "absent"])


@query("tag_removal_stats", "SELECT * FROM stats", "docs", extra=_REMOVAL)
def tag_removal_stats(spark, sf):
    return _removal(spark, sf)


@query(
    "tag_removal_totals",
    "SELECT max(total) AS total, CAST(sum(removed) AS BIGINT) AS removed, CAST(sum(not_found) AS BIGINT) AS not_found FROM stats", "docs", extra=_REMOVAL,
)
def tag_removal_totals(spark, sf):
    return C.removal_totals(_removal(spark, sf))


@query("tags_to_remove", "SELECT tag, unnest(expected) AS tag_to_remove FROM tasks", "tasks")
def tags_to_remove(spark, sf):
    return C.tags_to_remove(V.tasks(spark, sf))


@query("tasks_by_tag", "SELECT tag, name, output_type FROM tasks WHERE enabled", "tasks")
def tasks_by_tag(spark, sf):
    return V.tasks(spark, sf).where("enabled").orderBy("tag").select("tag", "name", "output_type")


_STORED = "case when n_regionkey > 2 then concat('[{\"tag\":\"', lower(n_name), '\",\"output_type\":\"list\",\"name\":\"N\",\"description\":\"\"}]') end"


@query(
    "decode_tasks",
    "SELECT lower(n_name) AS tag, CASE WHEN n_regionkey > 2 THEN 'multi' ELSE 'single' END AS task_type, 'text' AS output_type, true AS enabled, CASE WHEN n_regionkey > 2 THEN lower(n_name) END AS first_tag FROM nation",
)
def decode_tasks(spark, sf):
    """Rows as an older version stored them: JSON schema, missing types."""
    stored = V.table(spark, sf, "nation").select(
        F.lower("n_name").alias("tag"), F.when(F.col("n_regionkey") > 2, "multi").alias("task_type"),
        F.lit(None).cast("string").alias("output_type"), F.lit(None).cast("boolean").alias("enabled"), F.expr(_STORED).alias("tag_schema"),
    )
    decoded = C.decode_tasks(stored)
    return decoded.select("tag", "task_type", "output_type", "enabled", F.get("tag_schema", F.lit(0))["tag"].alias("first_tag"))


@query(
    "task_upsert",
    "SELECT tag, CASE WHEN r_name IN ('ASIA', 'AFRICA') THEN concat('New ', tag) ELSE name END AS name FROM tasks UNION ALL SELECT concat('region ', lower(r_name)), concat('New region ', lower(r_name)) FROM region",
    "tasks",
)
def task_upsert(spark, sf):
    tasks = V.tasks(spark, sf)
    again = tasks.where(F.col("output_type").isin("list", "number"))
    made = tasks.where(F.col("output_type").isNotNull()).join(
        V.table(spark, sf, "region").select(F.col("r_regionkey").cast("bigint").alias("id"), F.concat(F.lit("region "), F.lower("r_name")).alias("_tag")), "id"
    )
    incoming = again.unionByName(made.withColumn("tag", F.col("_tag")).drop("_tag"))
    incoming = incoming.withColumn("name", F.concat(F.lit("New "), "tag"))
    return C.upsert_tasks(tasks, incoming).select("tag", "name")


@query(
    "task_patch",
    "SELECT tag, CASE r_name WHEN 'ASIA' THEN 'Changed' ELSE name END AS name, CASE r_name WHEN 'AFRICA' THEN false ELSE enabled END AS enabled, CASE WHEN r_name IN ('ASIA', 'AFRICA') THEN 9 ELSE 0 END AS updated_at FROM tasks",
    "tasks",
)
def task_patch(spark, sf):
    tasks = V.tasks(spark, sf)
    patch = tasks.where(F.col("output_type").isin("list", "number")).select(
        "tag", F.when(F.col("output_type") == "list", "Changed").alias("name"), F.when(F.col("output_type") == "number", F.lit(False)).alias("enabled")
    )
    return C.patch_tasks(tasks, patch, F.lit(9).cast("bigint")).select("tag", "name", "enabled", "updated_at")


@query("task_delete", "SELECT run_id, task_id FROM runs WHERE task_id NOT IN (SELECT id FROM tasks WHERE r_name = 'ASIA')", "runs", "tasks")
def task_delete(spark, sf):
    tasks = V.tasks(spark, sf)
    gone = tasks.where(F.col("output_type") == "list").select("tag")
    return C.delete_tasks(tasks, _runs(spark, sf), gone)[1].select("run_id", "task_id")


@query(
    "julian_days",
    "SELECT event_id, round(ts_us / 1000 / 86400000.0 + 2440587.5, 4) AS julian, true AS round_trip FROM fe", "fe",
)
def julian_days(spark, sf):
    day = to_julian(F.timestamp_micros("ts_us"))
    back = F.abs(F.unix_millis(from_julian(day)) - F.floor(F.col("ts_us") / 1000)) <= 1
    return V.file_events(spark, sf).select("event_id", F.round(day, 4).alias("julian"), back.alias("round_trip"))


_RESULTS = {
    "res": f"SELECT note_id AS note_path, tag, task_type, output_type, expected, cast(length({_STRIP}) as string) AS num, "
    f"CASE WHEN contains({_STRIP}, ' the ') THEN 'true' ELSE 'false' END AS flag, '\"- Kind: note\"' AS line FROM states WHERE state <> 'full'",
    "rows": "SELECT note_path, tag, tag AS key, CASE output_type WHEN 'number' THEN num WHEN 'boolean' THEN flag ELSE line END AS value FROM res WHERE task_type = 'single' "
    "UNION ALL SELECT note_path, tag, 'quality_tag', num FROM res WHERE task_type = 'multi' UNION ALL SELECT note_path, tag, 'risk_tag', flag FROM res WHERE task_type = 'multi' "
    "UNION ALL SELECT note_path, tag, tag, line FROM res WHERE task_type = 'multi' AND len(expected) = 3",
}


@query("classification_run", "SELECT note_path, tag, 'completed' AS status, key, value FROM rows", "states", extra=_RESULTS)
def classification_run(spark, sf):
    results = classify(V.notes(spark, sf), V.tasks(spark, sf), rule_based_classifier)
    return unnest(results, ["note_path", "tag", "status"], F.col("entries"), "key")


@query(
    "classified_notes",
    "SELECT n.id, (SELECT count(DISTINCT key) FROM (SELECT key FROM rows r WHERE r.note_path = n.id UNION ALL SELECT unnest(['title', 'lang', 'source', 'resolves']) "
    "UNION ALL SELECT 'risk_tag_at' WHERE n.toxic = 1 UNION ALL SELECT 'risk_tag' WHERE n.toxic = 1 UNION ALL SELECT 'quality_tag' WHERE n.quality IS NOT NULL)) AS n_keys, "
    f"sha256({_STRIP}) AS body_hash FROM notes n",
    "states", extra=_RESULTS,
)
def classified_notes(spark, sf):
    """All results stored in the notes: the keys each note has then, and its body, which stays."""
    notes = V.notes(spark, sf)
    stored = store_results(notes, classify(notes, V.tasks(spark, sf), rule_based_classifier))
    entries = stored.select("id", note_entries(F.col("content")).alias("entries"), body_hash(F.col("content")).alias("body_hash"))
    return entries.select("id", F.size("entries").cast("bigint").alias("n_keys"), "body_hash")
