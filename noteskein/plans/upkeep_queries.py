"""Registered queries over change tracking and file events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from noteskein.functions.text import is_note_path
from noteskein.operators import places as P, tracking as K
from noteskein.plans import views as V
from noteskein.plans.registry import query
from noteskein.sinks.tables import current_triples
from noteskein.sources.tables import latest_per_hash
from noteskein.session import ensure_checkpoint_dir
from noteskein.streaming import events as E

_KIND = (
    "CASE WHEN quality IS NULL THEN 'unchanged' WHEN quality = 1 AND toxic = 1 THEN 'deleted' WHEN quality = 0 AND toxic = 1 THEN 'created' "
    "WHEN quality = 1 THEN 'modified' ELSE 'metadata_only' END"
)
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_DETECTED = {
    "detected": f"SELECT id AS path, doc_id, {_KIND} AS change_type, CASE WHEN NOT coalesce(quality = 0 AND toxic = 1, false) THEN "
    f"sha256(trim(concat(body, CASE WHEN quality = 1 AND toxic = 0 THEN 'old' ELSE '' END), {_BLANKS})) END AS old_hash, "
    f"CASE WHEN NOT coalesce(quality = 1 AND toxic = 1, false) THEN sha256(trim(body, {_BLANKS})) END AS new_hash FROM notes"
}


def _detected(spark, sf):
    scan = V.scan_now(spark, sf)
    return K.detect_changes(scan.select("path", "length", "modified"), V.state_before(spark, sf), K.hash_notes(scan))


@query("snapshot_diff", "SELECT path, change_type, old_hash, new_hash FROM detected", "notes", extra=_DETECTED)
def snapshot_diff(spark, sf):
    return _detected(spark, sf).select("path", "change_type", "old_hash", "new_hash")


@query("change_summary", "SELECT change_type, count(*) AS n_changes FROM detected GROUP BY change_type", "notes", extra=_DETECTED)
def change_summary(spark, sf):
    return K.change_summary(_detected(spark, sf))


@query(
    "change_log",
    "SELECT change_type, CASE WHEN change_type <> 'created' THEN path END AS old_path, CASE WHEN change_type <> 'deleted' THEN path END AS new_path, "
    "CASE WHEN change_type = 'modified' THEN old_hash END AS old_hash, CASE WHEN change_type <> 'deleted' THEN new_hash END AS new_hash FROM detected WHERE change_type IN ('created', 'modified', 'deleted')",
    "notes", extra=_DETECTED,
)
def change_log(spark, sf):
    return K.change_log(_detected(spark, sf), F.lit(0)).drop("file_id", "ts")


@query(
    "state_after_scan",
    "SELECT path, CASE change_type WHEN 'deleted' THEN 'deleted' ELSE 'active' END AS status, coalesce(new_hash, old_hash) AS content_hash, CASE WHEN change_type = 'unchanged' THEN 100 ELSE 300 END AS updated_at FROM detected",
    "notes", extra=_DETECTED,
)
def state_after_scan(spark, sf):
    after = K.apply_changes(V.state_before(spark, sf), _detected(spark, sf), F.timestamp_seconds(F.lit(300)))
    return after.select("path", "status", "content_hash", F.unix_seconds("updated_at").alias("updated_at"))


@query("unprocessed", "SELECT id FROM notes WHERE quality IS NULL", "notes")
def unprocessed(spark, sf):
    done = V.documents(spark, sf).where(F.col("quality").isNotNull()).select(F.expr(V.NOTE_ID).alias("id"))
    return K.unprocessed(V.notes(spark, sf), done).select("id")


@query("orphaned", "SELECT id FROM notes WHERE quality = 1 AND toxic = 1", "notes")
def orphaned(spark, sf):
    return K.orphaned(V.notes(spark, sf).select("id"), V.scan_now(spark, sf)).select("id")


@query("to_process", "SELECT path FROM detected JOIN notes ON path = id WHERE change_type IN ('created', 'modified') OR notes.lang = 'de'", "notes", extra=_DETECTED)
def to_process(spark, sf):
    missing = V.notes(spark, sf).where(F.startswith("id", F.lit("Family Office/"))).select("id")
    return K.to_process(_detected(spark, sf), missing)


@query(
    "recently_changed",
    "SELECT path FROM files WHERE status = 'active' AND file_id IN (SELECT file_id FROM changes WHERE change_type IN ('created', 'modified') AND ts > (SELECT max(ts_us) - 86400000000 FROM fe))",
    "files", "changes",
)
def recently_changed(spark, sf):
    log = V.changes(spark, sf)
    latest = V.file_events(spark, sf).agg(F.max("ts_us").alias("m")).first()["m"]
    return K.recently_changed(V.user_files(spark, sf), log, F.lit(latest - 86_400_000_000)).select("path")


@query(
    "file_history",
    "SELECT * EXCLUDE (rank), rank FROM (SELECT *, row_number() OVER (PARTITION BY current_path ORDER BY ts DESC, change_type, old_path, new_path, new_hash) AS rank FROM ("
    "SELECT DISTINCT f.path AS current_path, change_type, old_path, new_path, old_hash, c.new_hash, ts FROM changes c JOIN files f ON c.file_id = f.file_id OR old_path = f.path OR new_path = f.path)) WHERE rank <= 10",
    "files", "changes",
)
def file_history(spark, sf):
    return K.file_history(V.user_files(spark, sf), V.changes(spark, sf))


def _moves(spark, sf):
    return V.changes(spark, sf).where(F.col("change_type") == "moved").select("old_path", "new_path", "ts")


@query(
    "moves",
    "SELECT CASE WHEN moved THEN concat('archive/', path) ELSE path END AS path, status, CASE WHEN moved THEN 0 ELSE updated_at END AS updated_at FROM (SELECT *, path IN (SELECT old_path FROM changes WHERE change_type = 'moved') AS moved FROM files)",
    "files", "changes",
)
def moves(spark, sf):
    return K.apply_moves(V.user_files(spark, sf), _moves(spark, sf), F.lit(0).cast("bigint")).select("path", "status", "updated_at")


@query(
    "moved_sources",
    "SELECT CASE WHEN event_type = 'purchase' OR path IN (SELECT old_path FROM changes WHERE change_type = 'moved') THEN concat('archive/', path) ELSE path END AS source_file, event_type, count(*) AS n FROM fe GROUP BY ALL",
    "changes",
)
def moved_sources(spark, sf):
    kept = V.file_events(spark, sf).select("event_type", F.col("path").alias("source_file"))
    moved = K.rewrite_source_files(kept, _moves(spark, sf))
    return moved.groupBy("source_file", "event_type").agg(F.count(F.lit(1)).alias("n"))


# Files move to the next or the last user's path, or stay; so chains, returns and paths used again occur.
_MOVED = {
    "m": "SELECT DISTINCT CAST(floor(ts_us / 86400000000) AS BIGINT) AS batch, ts_us, concat('u', user_id) AS old_path, concat('u', user_id + event_id % 3 - 1) AS new_path "
    "FROM fe WHERE event_type = 'purchase' AND event_id % 3 <> 1",
    "away": "SELECT old_path AS path, ts_us, min(new_path) AS new_path, any_value(batch) AS batch FROM m GROUP BY 1, 2",
}


def _next_times(arrivals):
    """SQL: for paths and times, the time of the first departure from there that is later."""
    return (
        "SELECT DISTINCT path, ts_us, next_us FROM (SELECT path, ts_us, leaves, min(CASE WHEN leaves THEN ts_us END) OVER "
        "(PARTITION BY path ORDER BY ts_us RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_us "
        f"FROM (SELECT path, ts_us, true AS leaves FROM away UNION ALL SELECT path, ts_us, false FROM ({arrivals}))) WHERE NOT leaves"
    )


_MOVED["after"] = _next_times("SELECT new_path AS path, ts_us FROM m")
_MOVED["steps"] = "SELECT a.path, a.ts_us, a.new_path, a.batch, b.next_us FROM away a JOIN after b ON a.new_path = b.path AND a.ts_us = b.ts_us"


def _moves_in_time(spark, sf):
    events = V.file_events(spark, sf).where((F.col("event_type") == "purchase") & (F.col("event_id") % 3 != 1))
    return events.select(
        F.floor(F.col("ts_us") / 86_400_000_000).alias("batch"), F.timestamp_micros("ts_us").alias("ts"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("old_path"),
        F.concat(F.lit("u"), (F.col("user_id") + F.col("event_id") % 3 - 1).cast("string")).alias("new_path"),
    )


@query(
    "moves_over_time",
    "SELECT batch, ts_us, old_path, new_path, place, moved_us FROM walked WHERE next_us IS NULL", "fe",
    extra={**_MOVED, "first": "SELECT m.*, b.next_us FROM m JOIN after b ON m.new_path = b.path AND m.ts_us = b.ts_us",
           "walked": "SELECT batch, ts_us, old_path, new_path, new_path AS place, ts_us AS moved_us, next_us FROM first "
           "UNION ALL SELECT w.batch, w.ts_us, w.old_path, w.new_path, s.new_path, s.ts_us, s.next_us FROM walked w JOIN steps s ON w.place = s.path AND w.next_us = s.ts_us"},
    recursive=True,
)
def moves_over_time(spark, sf):
    found = P.moves_over_time(_moves_in_time(spark, sf))
    return found.select("batch", F.unix_micros("ts").alias("ts_us"), "old_path", "new_path", "place", F.unix_micros("moved.ts").alias("moved_us"))


@query(
    "places_now", "SELECT path, point AS batch, place, arrived FROM seen WHERE next_us IS NULL", "fe",
    extra={
        **_MOVED,
        "points": "SELECT DISTINCT concat('u', user_id) AS path, CAST(floor(ts_us / 86400000000) AS BIGINT) AS point FROM fe WHERE event_type = 'signup'",
        "ends": _next_times("SELECT path, (point + 1) * 86400000000 - 1 AS ts_us FROM points"),
        "first": "SELECT p.path, p.point, b.next_us FROM points p JOIN ends b ON p.path = b.path AND (p.point + 1) * 86400000000 - 1 = b.ts_us",
        "seen": "SELECT path, point, path AS place, point AS arrived, next_us FROM first "
        "UNION ALL SELECT w.path, w.point, s.new_path, s.batch, s.next_us FROM seen w JOIN steps s ON w.place = s.path AND w.next_us = s.ts_us",
    },
    recursive=True,
)
def places_now(spark, sf):
    """Where the files of some days are now, and the day they got there."""
    points = V.file_events(spark, sf).where(F.col("event_type") == "signup").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.floor(F.col("ts_us") / 86_400_000_000).alias("batch")
    )
    return P.placed(points.distinct(), P.moves_over_time(_moves_in_time(spark, sf)))


@query(
    "mark_processed",
    "SELECT path, CASE WHEN n > 0 THEN 7 END AS processed_at, coalesce(rels > 20, false) AS has_relationships FROM files LEFT JOIN (SELECT path, count(*) AS n, max(floor(value)) AS rels FROM fe WHERE event_type = 'signup' GROUP BY path) USING (path)",
    "files",
)
def mark_processed(spark, sf):
    done = V.file_events(spark, sf).where(F.col("event_type") == "signup").select(
        F.col("path").alias("id"), F.greatest(F.floor("value") - 20, F.lit(0)).alias("n_rels")
    )
    return K.mark_processed(V.user_files(spark, sf), done, F.lit(7).cast("bigint")).select("path", "processed_at", "has_relationships")


@query(
    "purge_deleted",
    "SELECT path FROM files WHERE status <> 'deleted' OR updated_at >= (SELECT max(ts_us) - 3600000000 FROM fe)".replace("3600000000", "86400000000"),
    "files",
)
def purge_deleted(spark, sf):
    latest = V.file_events(spark, sf).agg(F.max("ts_us").alias("m")).first()["m"]
    state = V.user_files(spark, sf).withColumn("updated_at", F.timestamp_micros("updated_at"))
    return K.purge_deleted(state, F.timestamp_micros(F.lit(latest)), days=1).select("path")


_SESSIONS = {
    "gaps": "SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (ORDER BY ts_us) < 60000000 THEN 0 ELSE 1 END AS fresh FROM fe",
    "numbered": "SELECT *, sum(fresh) OVER (ORDER BY ts_us) AS session FROM gaps",
}


@query(
    "debounce_sessions",
    "SELECT 'vault' AS vault_id, min(ts_us) AS start_us, max(ts_us) + 60000000 AS fires_us, count(*) AS n_events FROM numbered GROUP BY session",
    "fe", extra=_SESSIONS,
)
def debounce_sessions(spark, sf):
    return K.debounce_sessions(V.file_events(spark, sf)).withColumn("n_events", F.col("n_events").cast("bigint"))


@query(
    "session_paths",
    "SELECT DISTINCT 'vault' AS vault_id, min(ts_us) OVER (PARTITION BY session) AS start_us, path FROM numbered",
    "fe", extra=_SESSIONS,
)
def session_paths(spark, sf):
    events = V.file_events(spark, sf)
    return K.session_paths(events, K.debounce_sessions(events))


@query(
    "event_filter",
    "SELECT event_type, count(*) AS n FROM (SELECT event_type, CASE event_type WHEN 'view' THEN concat('.trash/', path) WHEN 'click' THEN replace(path, '.md', '.MD') WHEN 'error' THEN replace(path, '.md', '.txt') ELSE path END AS p FROM fe) "
    "WHERE lower(p) LIKE '%.md' AND NOT (p LIKE '.%' OR p LIKE '%/.%') GROUP BY event_type",
    "fe",
)
def event_filter(spark, sf):
    path = F.expr("CASE event_type WHEN 'view' THEN concat('.trash/', path) WHEN 'click' THEN replace(path, '.md', '.MD') WHEN 'error' THEN replace(path, '.md', '.txt') ELSE path END")
    events = V.file_events(spark, sf).select("event_type", path.alias("path"))
    return events.where(is_note_path(F.col("path"))).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "track_files",
    "SELECT path, status, change_type AS last_change, n AS n_changes FROM (SELECT path, arg_max(change_type, ts_us) AS change_type, CASE WHEN arg_max(change_type, ts_us) = 'deleted' THEN 'deleted' ELSE 'active' END AS status, count(*) AS n FROM fe GROUP BY path)",
    "fe",
)
def track_files_query(spark, sf):
    events = V.file_events(spark, sf).select("vault_id", "path", "change_type", F.lit(None).cast("string").alias("old_path"), F.col("ts_us").alias("ts"))
    return E.track_files(events).select("path", "status", "last_change", "n_changes")


@query(
    "latest_per_hash",
    "SELECT md5(props) AS content_hash, max(concat(md5(props), '_', lpad(cast(event_id as string), 12, '0'), '.csv')) AS file_name FROM events GROUP BY 1",
)
def latest_per_hash_query(spark, sf):
    files = V.table(spark, sf, "events").select(
        F.concat(F.lit("cache/"), F.md5("props"), F.lit("_"), F.lpad(F.col("event_id").cast("string"), 12, "0"), F.lit(".csv")).alias("path")
    )
    return latest_per_hash(files).select("content_hash", "file_name")


@query(
    "current_triples",
    "SELECT t.source_label, t.target_label, t.source_file FROM (SELECT c_name AS source_label, s_name AS target_label, concat('orders/', cast(l_orderkey as string), '.md') AS source_file, l_linenumber AS batch FROM lines) t "
    "JOIN (SELECT concat('orders/', cast(l_orderkey as string), '.md') AS id, max(l_linenumber) AS batch FROM lineitem GROUP BY 1) p ON t.source_file = p.id AND t.batch = p.batch",
    "lines",
)
def current_triples_query(spark, sf):
    """Each line number is one extraction batch of its order's note; the last one counts."""
    rows = V.lines(spark, sf).select(
        F.col("c_name").alias("source_label"), F.col("s_name").alias("target_label"),
        F.expr("concat('orders/', cast(l_orderkey as string), '.md')").alias("source_file"), F.col("l_linenumber").alias("batch"),
    )
    markers = V.table(spark, sf, "lineitem").select(
        F.expr("concat('orders/', cast(l_orderkey as string), '.md')").alias("id"), F.col("l_linenumber").alias("batch")
    )
    return current_triples(rows, markers).drop("batch")


def _worked_off(spark, sf, retain_days=None):
    """The event table worked off as a stream; every other user's note exists. Returns the folder of its tables."""
    root = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4()}"
    raw = V.table(spark, sf, "events")

    def events(rows):
        return E.note_events(rows.select(
            F.lit("vault").alias("vault_id"), F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".md")).alias("path"),
            F.expr(V.CHANGE_KIND).alias("change_type"),
            F.when(F.expr(V.CHANGE_KIND) == "moved", F.concat(F.lit("old/u"), F.col("user_id").cast("string"), F.lit(".md"))).alias("old_path"),
            F.col("ts").cast("timestamp").alias("ts"),
        ))

    notes = raw.where(F.col("user_id") % 2 == 0).select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".md")).alias("id")).distinct()
    source = events(E.read_events(spark, f"{sf}/events.parquet{{,/*}}", schema=raw.schema))
    run = E.run_on_quiet(source, E.on_sessions(lambda: events(raw), lambda: notes, root, retain_days), f"{root}/checkpoint", once=True)
    run.awaitTermination()
    return root


def _micros(c):
    return F.unix_micros(F.from_utc_timestamp(c, F.current_timezone()))


@query(
    "stream_sessions",
    "SELECT 'vault' AS vault_id, min(ts_us) AS start_us, max(ts_us) AS last_us, count(*) AS n_events FROM numbered GROUP BY session",
    "fe", extra=_SESSIONS,
)
def stream_sessions(spark, sf):
    found = spark.read.schema("vault_id string, first_event timestamp, last_event timestamp, n_events bigint").parquet(f"{_worked_off(spark, sf)}/sessions")
    return found.select("vault_id", _micros("first_event").alias("start_us"), _micros("last_event").alias("last_us"), "n_events")


@query(
    "stream_evictions",
    "SELECT DISTINCT path FROM fe WHERE user_id % 2 <> 0 UNION SELECT DISTINCT concat('old/', path) FROM fe WHERE change_type = 'moved'",
    "fe",
)
def stream_evictions(spark, sf):
    return spark.read.schema("path string").parquet(f"{_worked_off(spark, sf)}/evictions").select("path")


@query("stream_moves", "SELECT concat('old/', path) AS old_path, path AS new_path, ts_us FROM fe WHERE change_type = 'moved'", "fe")
def stream_moves(spark, sf):
    found = spark.read.schema("old_path string, new_path string, ts timestamp").parquet(f"{_worked_off(spark, sf)}/moves")
    return found.select("old_path", "new_path", _micros("ts").alias("ts_us"))


@query(
    "stream_state",
    "SELECT path, status, change_type AS last_change, n AS n_changes FROM (SELECT path, arg_max(change_type, ts_us) AS change_type, CASE WHEN arg_max(change_type, ts_us) = 'deleted' THEN 'deleted' ELSE 'active' END AS status, count(*) AS n FROM fe GROUP BY path)",
    "fe",
)
def stream_state(spark, sf):
    found = spark.read.schema(E.TRACKED).parquet(f"{_worked_off(spark, sf)}/state")
    return found.select("path", "status", "last_change", "n_changes")


@query(
    "stream_purged",
    "SELECT path, change_type AS last_change, n AS n_changes FROM (SELECT path, arg_max(change_type, ts_us) AS change_type, max(ts_us) AS last_us, count(*) AS n FROM fe GROUP BY path) "
    "WHERE change_type <> 'deleted' OR last_us >= (SELECT max(ts_us) - 10800000000 * 8 FROM fe)",
    "fe",
)
def stream_purged(spark, sf):
    found = spark.read.schema(E.TRACKED).parquet(f"{_worked_off(spark, sf, retain_days=1)}/state")
    return found.select("path", "last_change", "n_changes")
