"""Inputs of the registered queries, derived from the star-schema and text tables.

The tables hold no notes, triples or runs, so each is built by a rule that grows with the tables.
Every rule exists twice: as a DataFrame, and as a SQL view for the check. Text expressions that
both engines read alike are shared.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from noteskein.functions.frontmatter import note_entries
from noteskein.functions.text import body_text, file_stem, py_strip
from noteskein.operators import triples as T
from noteskein.scale import checkpointed
from noteskein.schemas import TAG_SCHEMA


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_us(ts: Column) -> Column:
    """Microseconds of a timestamp without zone, read as UTC whatever the session zone is."""
    return F.unix_micros(F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))


# Shared text expressions


def _padded(name: str, key: str) -> str:
    return f"concat('{name}#', lpad(cast({key} as string), 9, '0'))"


STEM = (
    f"case lang when 'en' then {_padded('customer', 'doc_id')} when 'fr' then {_padded('Supplier', 'doc_id')} "
    "when 'de' then concat('Branch. ', source, ', ', cast(doc_id as string)) "
    "else concat('doc-', cast(doc_id as string)) end"
)
FOLDER = "case lang when 'en' then 'People/VC' when 'fr' then 'Companies' when 'de' then 'Family Office' else 'Journal' end"
NOTE_ID = f"concat({FOLDER}, '/', source, '/', {STEM}, '.md')"
NOTE_HEAD = (
    f"concat('---', chr(10), 'title: \"', {STEM}, '\"', chr(10), 'lang: ', lang, chr(10), 'source: ', source, chr(10), "
    "case when quality is null then '' else concat('quality_tag: ', cast(quality as string), chr(10)) end, "
    "case when toxic = 1 then concat('risk_tag: true', chr(10), 'risk_tag_at: checked', chr(10)) else '' end, "
    f"'resolves:', chr(10), '  - ', {_padded('Supplier', 'doc_id')}, ' -> ', {_padded('Supplier', 'doc_id')}, ' Holdings', chr(10), "
    "'  - \"', source, ' => The ', source, '\"', chr(10), '  - no arrow here', chr(10), '---', chr(10))"
)
NOTE_BODY = (
    f"concat(chr(10), text, chr(10), chr(10), '[[', {_padded('customer', 'doc_id')}, ']] works at [[', {_padded('Supplier', 'n_chars')}, ']].', chr(10), "
    f"'See [[doc-', cast(n_chars as string), '|that note]] and [[', source, ']] and [[ ', {_padded('Supplier', 'doc_id')}, ' ]].', chr(10), chr(10), "
    "'## Metadata', chr(10), '- **Size**: ', cast(n_chars as string), chr(10), '**Language**: ', lang, chr(10), "
    "'Group Name: ', source, chr(10), '- Kind: note', chr(10))"
)

_FIRST_ROW = (
    "concat('{\"source_category\": \"Person\", \"source_label\": \"P', cast(doc_id as string), '\", \"relationship\": \"works_at\", "
    "\"target_category\": \"Company\", \"target_label\": \"', source, '\"}')"
)
_CONCEPT_ROW = (
    "concat('{\"source_category\": \"Concept\", \"source_label\": \"', lang, '\", \"relationship\": \"tags\", "
    "\"target_category\": \"Company\", \"target_label\": \"', source, '\"}')"
)
_EMPTY_LABEL = (
    "concat('{\"source_category\": \"Company\", \"source_label\": \"', source, '\", \"relationship\": \"\", "
    "\"target_category\": \"Company\", \"target_label\": \"C', cast(doc_id as string), '\"}')"
)
_SHORT_ROW = "concat('{\"source_category\": \"Person\", \"source_label\": \"P', cast(doc_id as string), '\"}')"
# English: fenced, trailing commas. French: text around. German: cut off. Else: one row lacks fields.
RESPONSE = (
    f"case lang when 'en' then concat('Sure.', chr(10), '```json', chr(10), '{{\"relationships\": [', {_FIRST_ROW}, ', ', {_EMPTY_LABEL}, ', ', {_CONCEPT_ROW}, ',], }}', chr(10), '```', chr(10), 'Done.') "
    f"when 'fr' then concat('<think>{{maybe}}</think>Result: {{\"relationships\": [', {_FIRST_ROW}, ']}} as asked.') "
    f"when 'de' then concat('{{\"relationships\": [', {_FIRST_ROW}, ', {{\"source_category\": \"Person\", \"source_la') "
    f"else concat('{{\"relationships\": [', {_FIRST_ROW}, ', ', {_SHORT_ROW}, ', ', {_EMPTY_LABEL}, ']}}') end"
)

# Relations of orders, as triples; one row of ``lines`` gives up to six.
_TRIPLE_ROWS = [
    ("true", "'Person'", "c_name", "'buys_from'", "'Company'", "s_name"),
    ("s_nationkey = c_nationkey", "'Company'", "s_name", "'employs'", "'Person'", "c_name"),
    ("l_returnflag = 'R'", "'Company'", "p_brand", "'licenses'", "'Company'", "s_name"),
    ("l_returnflag <> 'R'", "'Company'", "s_name", "'supplies'", "'Company'", "p_brand"),
    ("true", "'Person'", "c_name", "'manages'", "'Person'", "contact"),
    ("true", "'Person'", "c_name", "'mentioned'", "'Person'", "c_name"),
    ("true", "'Person'", "c_name", "'prioritises'", "'Concept'", "o_orderpriority"),
]

CHANGE_KIND = (
    "case event_type when 'signup' then 'created' when 'purchase' then 'moved' when 'error' then 'deleted' else 'modified' end"
)
_USER_FILE = "concat('u', cast(user_id as string), '.md')"
_ARCHIVED = "concat('archive/u', cast(user_id as string), '.md')"


# DataFrames


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    contact = customer.select(F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("contact"))
    # Lines meet the small tables while they are narrow, and orders, which know their customer by then, last: so lines are
    # not shuffled by customer. Written, the suppliers have a size that Spark knows, and lines stay put while it is small.
    return (
        item.join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(checkpointed(supplier.join(contact, "s_suppkey")), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(order.join(customer, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
    )


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All triples in one pass over the joined lines; no union of repeated joins."""
    rows = []
    for test, source_category, source, relation, target_category, target in _TRIPLE_ROWS:
        row = ", ".join([
            f"'source_category', {source_category}", f"'source_label', {source}", f"'relationship', {relation}",
            f"'target_category', {target_category}", f"'target_label', {target}",
        ])
        rows.append(F.expr(f"case when {test} then named_struct({row}) end"))
    return lines(spark, sf_dir).select(
        F.inline(F.array(*rows)),
        F.expr("concat('orders/', cast(l_orderkey as string), '.md')").alias("source_file"), "l_linestatus",
    ).where(F.col("source_category").isNotNull())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = documents(spark, sf_dir).select(
        F.expr(NOTE_ID).alias("id"), F.concat(F.expr(NOTE_HEAD), F.expr(NOTE_BODY)).alias("content"), "doc_id"
    )
    return made.withColumn("label", file_stem(F.col("id")))


def note_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes as the classification sees them: frontmatter entries and body."""
    return notes(spark, sf_dir).select(
        "id", note_entries(F.col("content")).alias("entries"), body_text(F.col("content")).alias("body")
    )


def orders_as_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.expr("concat('orders/', cast(o_orderkey as string), '.md')").alias("id"), "o_orderstatus"
    )


def scoped_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order renames its customer, and the new name again (a chain within one file)."""
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    first = F.struct(F.col("c_name").alias("old_name"), F.concat("c_name", F.lit(" of "), "c_mktsegment").alias("new_name"))
    second = F.struct(
        F.concat("c_name", F.lit(" of "), "c_mktsegment").alias("old_name"),
        F.concat("c_name", F.lit(" / "), "o_orderpriority").alias("new_name"),
    )
    return order.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.expr("concat('orders/', cast(o_orderkey as string), '.md')").alias("source_file"), F.array(first, second).alias("aliases")
    )


def alias_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line declares a new name for its supplier; the newest order decides."""
    return lines(spark, sf_dir).select(
        F.expr("concat('orders/', cast(l_orderkey as string), '.md')").alias("source_file"),
        F.col("o_orderdate").alias("modified"), F.col("l_linenumber").alias("ord"),
        F.col("s_name").alias("old_name"), F.concat("s_name", F.lit(" "), "p_brand").alias("new_name"),
    )


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return T.build_graph(triples(spark, sf_dir))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.entities(T.graph_facts(triples(spark, sf_dir)))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.edges(T.graph_facts(triples(spark, sf_dir)))


def note_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons are the customers, companies the suppliers."""
    person = table(spark, sf_dir, "customer").select(F.lit("Person").alias("category"), F.col("c_name").alias("id"))
    company = table(spark, sf_dir, "supplier").select(F.lit("Company").alias("category"), F.col("s_name").alias("id"))
    return person.unionByName(company).select("category", "id", F.col("id").alias("label"), F.lit("").alias("metadata"))


def file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", F.lit("vault").alias("vault_id"), F.expr(_USER_FILE).alias("path"), F.expr(CHANGE_KIND).alias("change_type"),
        epoch_us(F.col("ts")).alias("ts_us"), "user_id", "props", "value", "event_type",
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("change_type")
    events = file_events(spark, sf_dir)
    return events.select(
        F.col("user_id").alias("file_id"), "change_type",
        F.when(kind != "created", F.col("path")).alias("old_path"),
        F.when(kind == "moved", F.expr(_ARCHIVED)).when(kind != "deleted", F.col("path")).alias("new_path"),
        F.lit(None).cast("string").alias("old_hash"),
        F.when(kind != "deleted", F.md5("props")).alias("new_hash"),
        F.col("ts_us").alias("ts"),
    )


def user_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracking rows of the files in the event log."""
    last = F.max_by(F.struct(F.col("change_type"), F.md5("props").alias("content_hash")), F.struct("ts_us", "event_id"))
    made = file_events(spark, sf_dir).groupBy("user_id", "path").agg(
        last.alias("last"), F.max("ts_us").alias("updated_at"), F.count(F.lit(1)).alias("file_size")
    )
    return made.select(
        F.col("user_id").alias("file_id"), "path", "file_size", F.col("updated_at").alias("modified"), "last.content_hash",
        F.when(F.col("last.change_type") == "deleted", "deleted").otherwise("active").alias("status"),
        F.lit(None).cast("bigint").alias("processed_at"), F.lit(False).alias("has_relationships"), "updated_at",
    )


def scan_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes found by a scan: those labelled good and toxic are gone."""
    docs = documents(spark, sf_dir)
    here = docs.where(~((F.col("quality") == 1) & (F.col("toxic") == 1)) | F.col("quality").isNull())
    touched = F.col("quality").isNotNull()
    return here.select(
        F.expr(NOTE_ID).alias("id"), F.expr(NOTE_ID).alias("path"),
        F.concat(F.expr(NOTE_HEAD), F.expr(NOTE_BODY)).alias("content"),
        F.when(touched, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("length"),
        F.when(touched, F.timestamp_seconds(F.lit(200))).otherwise(F.timestamp_seconds(F.lit(100))).alias("modified"),
    )


def state_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracking table of an earlier scan: bad toxic notes were not there, good ones had another body."""
    docs = documents(spark, sf_dir)
    known = docs.where(~((F.col("quality") == 0) & (F.col("toxic") == 1)) | F.col("quality").isNull())
    edited = (F.col("quality") == 1) & (F.col("toxic") == 0)
    old_body = F.when(edited, F.concat(F.expr(NOTE_BODY), F.lit("old"))).otherwise(F.expr(NOTE_BODY))
    return known.select(
        F.col("doc_id").alias("file_id"), F.expr(NOTE_ID).alias("path"), F.col("n_chars").alias("file_size"),
        F.timestamp_seconds(F.lit(100)).alias("modified"), F.sha2(py_strip(old_body), 256).alias("content_hash"),
        F.lit("active").alias("status"), F.lit(None).cast("timestamp").alias("processed_at"),
        F.lit(False).alias("has_relationships"), F.timestamp_seconds(F.lit(100)).alias("updated_at"),
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task per nation and output type; every region with a multi-tag task of the tags notes carry."""
    nation = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    kind = F.expr("case r_name when 'ASIA' then 'list' when 'EUROPE' then 'boolean' when 'AFRICA' then 'number' else 'text' end")
    many = F.col("r_name").isin("ASIA", "EUROPE")
    tags = F.from_json(
        F.concat(
            F.lit('[{"tag":"quality_tag","output_type":"number","name":"Quality","description":""},{"tag":"risk_tag","output_type":"boolean","name":"Risk","description":"Is it risky?"},{"tag":"'),
            F.lower("n_name"), F.lit('","output_type":"list","name":"","description":""}]'),
        ),
        TAG_SCHEMA,
    )
    short = F.slice(tags, 1, 2)
    return nation.select(
        F.col("n_nationkey").cast("bigint").alias("id"),
        F.when(F.col("r_name") == "AMERICA", F.lit("quality_tag")).otherwise(F.lower("n_name")).alias("tag_name"),
        F.lower("n_name").alias("tag"), F.when(many, "multi").otherwise("single").alias("task_type"),
        F.concat(F.lit("Look for "), "n_name").alias("prompt"), F.concat(F.lit("Task "), "n_name").alias("name"),
        F.lit("").alias("description"), F.when(many, "Qwen3:8b").otherwise("other").alias("model"), kind.alias("output_type"),
        (F.col("r_name") != "MIDDLE EAST").alias("enabled"),
        F.when(F.col("r_name") == "ASIA", tags).when(F.col("r_name") == "EUROPE", short).alias("tag_schema"),
        F.lit(0).cast("bigint").alias("created_at"), F.lit(0).cast("bigint").alias("updated_at"),
    ).drop("tag_name")


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event starts a run of the task of its value band; errors fail, purchases stay open."""
    event = file_events(spark, sf_dir)
    ended = F.when(F.col("event_type") == "error", "failed").otherwise("completed")
    states = F.when(F.col("event_type") == "purchase", F.array(F.struct(F.lit("running").alias("status"), F.col("ts_us").alias("at")))).otherwise(
        F.array(
            F.struct(F.lit("running").alias("status"), F.col("ts_us").alias("at")),
            F.struct(ended.alias("status"), (F.col("ts_us") + F.floor(F.col("value") * 1000).cast("bigint") * 1000).alias("at")),
        )
    )
    return event.select(
        F.col("event_id").alias("run_id"), F.floor(F.col("value") / 10).cast("bigint").alias("task_id"),
        F.concat(F.lit("logs/"), "path").alias("note_path"), "props", F.inline(states),
    ).select(
        "run_id", "task_id", "note_path", "status", F.col("at").alias("ts_us"),
        F.when(F.col("status") == "completed", F.col("props")).alias("result"),
        F.when(F.col("status") == "failed", F.lit("Model error")).alias("error"),
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_events(spark, sf_dir).select(
        F.col("event_id").alias("query_id"), F.col("event_type").alias("name"), "ts_us", F.col("value").alias("response_time"),
        (F.col("event_type") != "error").alias("success"),
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.expr(RESPONSE).alias("raw"))


def expected_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).where(F.col("l_returnflag") != "N").select(
        F.col("o_orderpriority").alias("model"), F.col("l_orderkey").alias("doc"), F.col("c_name").alias("source"), F.col("s_name").alias("target")
    )


def extracted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model found: the lines still open, with ends turned around and in other letters."""
    return lines(spark, sf_dir).where(F.col("l_linestatus") == "O").select(
        F.col("o_orderpriority").alias("model"), F.col("l_orderkey").alias("doc"),
        F.concat(F.lit(" "), F.upper("s_name")).alias("source"), F.concat(F.lower("c_name"), F.lit(" ")).alias("target"),
    )


# SQL

def _triple_sql() -> str:
    parts = [
        f"SELECT {sc} AS source_category, {s} AS source_label, {r} AS relationship, {tc} AS target_category, {t} AS target_label, "
        f"concat('orders/', cast(l_orderkey as string), '.md') AS source_file, l_linestatus FROM lines WHERE {test}"
        for test, sc, s, r, tc, t in _TRIPLE_ROWS
    ]
    return " UNION ALL ".join(parts)


_INVERSE_CASE = (
    "CASE relationship WHEN 'hires' THEN 'works_at' WHEN 'employs' THEN 'works_at' WHEN 'manages' THEN 'reports_to' "
    "WHEN 'supervises' THEN 'reports_to' WHEN 'leads' THEN 'reports_to' WHEN 'acquires' THEN 'acquired_by' "
    "WHEN 'purchases' THEN 'purchased_by' WHEN 'buys' THEN 'sold_to' ELSE relationship END"
)


def oriented_sql(source: str) -> str:
    turned = "source_category = 'Company' AND target_category = 'Person'"
    return (
        f"SELECT CASE WHEN {turned} THEN target_category ELSE source_category END AS source_category, "
        f"CASE WHEN {turned} THEN target_label ELSE source_label END AS source_label, "
        f"CASE WHEN {turned} THEN {_INVERSE_CASE} ELSE relationship END AS relationship, "
        f"CASE WHEN {turned} THEN source_category ELSE target_category END AS target_category, "
        f"CASE WHEN {turned} THEN source_label ELSE target_label END AS target_label FROM {source} "
        "WHERE source_category IN ('Person', 'Company') AND target_category IN ('Person', 'Company')"
    )


def entities_sql(oriented: str) -> str:
    return (
        f"SELECT DISTINCT category, id FROM (SELECT source_category AS category, source_label AS id FROM {oriented} "
        f"UNION ALL SELECT target_category, target_label FROM {oriented})"
    )


def edges_sql(oriented: str) -> str:
    return (
        "SELECT DISTINCT concat(upper(source_category), '_TO_', upper(target_category)) AS edge_type, "
        "CASE WHEN source_category = target_category THEN least(source_label, target_label) ELSE source_label END AS src, "
        "CASE WHEN source_category = target_category THEN greatest(source_label, target_label) ELSE target_label END AS dst, "
        f"relationship FROM {oriented} WHERE source_label <> target_label"
    )


VIEW_SQL: dict[str, tuple[list[str], str]] = {
    "lines": (
        [],
        "SELECT l.*, o.*, c.c_name, c.c_nationkey, c.c_mktsegment, s.s_name, s.s_nationkey, p.p_brand, m.c_name AS contact "
        "FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c.c_custkey "
        "JOIN supplier s ON l_suppkey = s_suppkey JOIN customer m ON m.c_custkey = l_suppkey JOIN part p ON l_partkey = p_partkey",
    ),
    "triples": (["lines"], _triple_sql()),
    "oriented": (["triples"], oriented_sql("triples")),
    "entities": (["oriented"], entities_sql("oriented")),
    "edges": (["oriented"], edges_sql("oriented")),
    "docs": ([], "SELECT d.*, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "notes": (
        ["docs"],
        f"SELECT {NOTE_ID} AS id, {STEM} AS label, {NOTE_HEAD} AS head, {NOTE_BODY} AS body, concat({NOTE_HEAD}, {NOTE_BODY}) AS content, * FROM docs",
    ),
    "note_nodes": (
        ["notes"],
        "SELECT id, label, CASE lang WHEN 'en' THEN 'Person,VC' WHEN 'fr' THEN 'Company' WHEN 'de' THEN 'Family Office' ELSE '' END AS entity_types FROM notes",
    ),
    "note_entities": (
        [], "SELECT 'Person' AS category, c_name AS id FROM customer UNION ALL SELECT 'Company', s_name FROM supplier",
    ),
    "mentions": (
        ["notes"],
        r"SELECT DISTINCT id AS src, trim(x) AS link FROM (SELECT id, unnest(regexp_extract_all(content, '\[\[([^|\]]+)(?:\|[^\]]+)?\]\]', 1)) AS x FROM notes)",
    ),
    "targets": (
        ["mentions", "notes"],
        "SELECT src, link, target_id FROM mentions LEFT JOIN (SELECT label, min(id) AS target_id FROM notes GROUP BY label) t ON link = label",
    ),
    "links": (
        ["note_entities", "notes"],
        "SELECT concat(upper(category), '_NOTE') AS edge_type, e.id AS src, n.id AS dst FROM note_entities e JOIN notes n ON lower(e.id) = lower(n.label)",
    ),
    "fe": (
        [],
        f"SELECT event_id, 'vault' AS vault_id, {_USER_FILE} AS path, {CHANGE_KIND} AS change_type, epoch_us(ts) AS ts_us, user_id, props, value, event_type FROM events",
    ),
    "changes": (
        ["fe"],
        "SELECT user_id AS file_id, change_type, CASE WHEN change_type <> 'created' THEN path END AS old_path, "
        f"CASE WHEN change_type = 'moved' THEN {_ARCHIVED} WHEN change_type <> 'deleted' THEN path END AS new_path, "
        "CAST(NULL AS VARCHAR) AS old_hash, CASE WHEN change_type <> 'deleted' THEN md5(props) END AS new_hash, ts_us AS ts FROM fe",
    ),
    "files": (
        ["fe"],
        "SELECT user_id AS file_id, path, count(*) AS file_size, arg_max(md5(props), ts_us) AS content_hash, "
        "CASE WHEN arg_max(change_type, ts_us) = 'deleted' THEN 'deleted' ELSE 'active' END AS status, max(ts_us) AS updated_at FROM fe GROUP BY user_id, path",
    ),
    "tasks": (
        [],
        "SELECT CAST(n_nationkey AS BIGINT) AS id, lower(n_name) AS tag, CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN 'multi' ELSE 'single' END AS task_type, "
        "concat('Look for ', n_name) AS prompt, concat('Task ', n_name) AS name, CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN 'Qwen3:8b' ELSE 'other' END AS model, "
        "CASE r_name WHEN 'ASIA' THEN 'list' WHEN 'EUROPE' THEN 'boolean' WHEN 'AFRICA' THEN 'number' ELSE 'text' END AS output_type, "
        "r_name <> 'MIDDLE EAST' AS enabled, CASE r_name WHEN 'ASIA' THEN ['quality_tag', 'risk_tag', lower(n_name)] "
        "WHEN 'EUROPE' THEN ['quality_tag', 'risk_tag'] ELSE [lower(n_name)] END AS expected, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    ),
    "states": (
        ["tasks", "notes"],
        "SELECT n.id AS note_id, t.*, n.lang, n.body, CASE WHEN len(list_filter(expected, lambda x: NOT list_contains(keys, x))) = 0 THEN 'full' "
        "WHEN len(list_filter(expected, lambda x: list_contains(keys, x))) > 0 THEN 'partial' ELSE 'none' END AS state "
        "FROM (SELECT *, list_concat(['title', 'lang', 'source', 'resolves'], list_concat(CASE WHEN quality IS NULL THEN [] ELSE ['quality_tag'] END, "
        "CASE WHEN toxic = 1 THEN ['risk_tag', 'risk_tag_at'] ELSE [] END)) AS keys FROM notes) n CROSS JOIN (SELECT * FROM tasks WHERE enabled) t",
    ),
    "runs": (
        ["fe"],
        "SELECT event_id AS run_id, CAST(floor(value / 10) AS BIGINT) AS task_id, concat('logs/', path) AS note_path, "
        "CASE event_type WHEN 'purchase' THEN 'running' WHEN 'error' THEN 'failed' ELSE 'completed' END AS status, ts_us AS started_us, "
        "CASE WHEN event_type NOT IN ('purchase', 'error') THEN props END AS result, CASE WHEN event_type = 'error' THEN 'Model error' END AS error, "
        "CASE WHEN event_type <> 'purchase' THEN CAST(floor(value * 1000) AS BIGINT) END AS processing_time_ms FROM fe",
    ),
    "log": (
        ["fe"], "SELECT event_id AS query_id, event_type AS name, ts_us, value AS response_time, event_type <> 'error' AS success FROM fe",
    ),
    "responses": ([], f"SELECT doc_id, lang, source, {RESPONSE} AS raw FROM documents"),
    "expected_pairs": (
        ["lines"], "SELECT o_orderpriority AS model, l_orderkey AS doc, c_name AS source, s_name AS target FROM lines WHERE l_returnflag <> 'N'",
    ),
    "extracted_pairs": (
        ["lines"], "SELECT o_orderpriority AS model, l_orderkey AS doc, upper(s_name) AS source, lower(c_name) AS target FROM lines WHERE l_linestatus = 'O'",
    ),
}


def with_views(select: str, *names: str) -> str:
    """A query with the views it needs, in order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in VIEW_SQL[name][0]:
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return select
    views = ", ".join(f"{name} AS ({VIEW_SQL[name][1]})" for name in ordered)
    return f"WITH {views} {select}"
