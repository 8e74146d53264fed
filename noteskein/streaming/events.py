"""Keeping a graph current from an event log."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from noteskein.functions import fixed
from noteskein.functions.text import in_folder, is_note_path
from noteskein.operators import tracking
from noteskein.schemas import FILE_EVENTS


def read_events(
    spark: SparkSession, path: str, file_format: str = "parquet", max_files: int | None = None, schema: StructType | str = FILE_EVENTS
) -> DataFrame:
    """Stream over the event log. A stream over the notes themselves would miss changes and deletions."""
    reader = spark.readStream.schema(schema).format(file_format)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path)


def note_events(events: DataFrame, template_folder: str | None = None) -> DataFrame:
    """Events of visible notes of a known kind."""
    kept = events.where(is_note_path(F.col("path")) & F.col("change_type").isin(fixed.CHANGE_TYPES))
    return kept.where(~in_folder(F.col("path"), template_folder)) if template_folder else kept


OPEN = "vault_id string, lo bigint, hi bigint, n bigint, seen bigint"


def session_events(log: DataFrame, sessions: DataFrame) -> DataFrame:
    """Events of closed sessions, read from the event log by time bounds and a minute key."""
    minute = lambda c: F.floor(F.unix_seconds(c) / 60)
    cut = sessions.select(
        "vault_id", "first_event", "last_event",
        F.explode(F.sequence(minute(F.col("first_event")), minute(F.col("last_event")))).alias("_minute"),
    )
    keyed = log.withColumn("_minute", minute(F.col("ts")))
    inside = keyed.join(cut, ["vault_id", "_minute"]).where(F.col("ts").between(F.col("first_event"), F.col("last_event")))
    return inside.select(*log.columns)


def pending_paths(log: DataFrame, sessions: DataFrame) -> DataFrame:
    """Distinct paths of closed sessions."""
    return session_events(log, sessions).select("vault_id", "path").distinct()


def split_pending(paths: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths to process again, and paths whose note is gone."""
    ids = notes.select(F.col("id").alias("path"))
    return paths.join(ids, "path", "left_semi"), paths.join(ids, "path", "left_anti")


def latest_moves(events: DataFrame) -> DataFrame:
    """Moves in an event batch as ``old_path, new_path, ts``."""
    return events.where((F.col("change_type") == "moved") & F.col("old_path").isNotNull()).select(
        "old_path", F.col("path").alias("new_path"), "ts"
    )


def run_on_quiet(
    events: DataFrame,
    process: Callable[[DataFrame, int], None],
    checkpoint: str,
    once: bool = False,
    quiet_seconds: int = fixed.QUIET_SECONDS,
) -> StreamingQuery:
    """Call ``process(sessions, batch_id)`` for closed sessions; batches never overlap.

    Every event of a vault restarts its timer. A session closes when the next event comes later than the quiet period, or when
    none has come for so long by the clock, also while nothing else arrives: a tick a second keeps batches coming. A batch is merged
    in blocks of an hour (``tracking.session_step``), whatever a vault's share of it. Between batches, one open session per
    vault is kept in a table beside the checkpoint, a version per batch, so a batch that is repeated starts from the same.

    ``once`` works off the backlog (first run) and stops; the backlog is one batch, and all its sessions are closed with
    it. For that, read the events without a bound on the files of a batch. Else the query stays up.
    """
    spark, quiet = events.sparkSession, quiet_seconds * 1_000_000
    root = f"{checkpoint.rstrip('/')}-sessions"
    rows = events.select("vault_id", F.unix_micros("ts").alias("ts_us"))
    if not once:
        ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        rows = rows.unionByName(ticks.select(F.lit(None).cast("string").alias("vault_id"), F.lit(None).cast("bigint").alias("ts_us")))

    def handle(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        older = [v for v in _versions(session, f"{root}/open") if v < batch_id]
        still_open = session.read.schema(OPEN).parquet(f"{root}/open/version={max(older)}") if older else session.createDataFrame([], OPEN)
        fresh = batch.where(F.col("ts_us").isNotNull())
        if not once and fresh.isEmpty() and still_open.isEmpty():
            return
        now = F.lit(int(time.time() * 1_000_000)).cast("bigint")
        closed, kept = tracking.session_step(fresh, still_open, quiet, now, flush=once)
        closed.write.mode("overwrite").parquet(f"{root}/closed/batch={batch_id}")
        kept.write.mode("overwrite").parquet(f"{root}/open/version={batch_id}")
        sessions = session.read.schema(OPEN).parquet(f"{root}/closed/batch={batch_id}")
        if not sessions.isEmpty():
            micros = lambda c, name: F.timestamp_micros(c).alias(name)
            process(sessions.select("vault_id", micros("lo", "first_event"), micros("hi", "last_event"), F.col("n").alias("n_events")), batch_id)
        for version in sorted(older)[:-1]:
            _remove(session, f"{root}/open/version={version}")

    writer = rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(handle)
    return writer.trigger(availableNow=True).start() if once else writer.trigger(processingTime="10 seconds").start()


def on_sessions(
    log: Callable[[], DataFrame], notes: Callable[[], DataFrame], root: str, retain_days: int | None = None
) -> Callable[[DataFrame, int], None]:
    """A ``process`` that works sessions to the end: paths to extract again, evictions, moves and the tracked state.

    Each table of a batch has its own folder below ``root`` and overwrites it, so a repeated batch does no harm. The
    state (``track_files``) is kept in versions; each batch merges its events into the one before. With ``retain_days``, files
    deleted so long before the newest event of the batch leave the state.
    """
    def process(sessions: DataFrame, batch_id: int) -> None:
        spark = sessions.sparkSession
        events = session_events(log(), sessions)
        moves = latest_moves(events)
        changed, gone = split_pending(events.select("vault_id", "path").distinct(), notes())
        left = moves.select(F.col("old_path").alias("path")).distinct()
        tables = {
            "sessions": sessions, "to_process": changed, "evictions": gone.select("path").union(left).distinct(), "moves": moves,
        }
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")
        kept = spark.createDataFrame([], TRACKED)
        if batch_id > 0:
            older = [v for v in _versions(spark, f"{root}/state") if v < batch_id]
            kept = spark.read.schema(TRACKED).parquet(f"{root}/state/version={max(older)}") if older else kept
        state = merge_tracked(kept, track_files(events))
        if retain_days is not None:
            state = tracking.purge_deleted(state, F.lit(sessions.agg(F.max("last_event")).first()[0]), retain_days)
        state.write.mode("overwrite").parquet(f"{root}/state/version={batch_id}")

    return process


def _versions(spark: SparkSession, root: str) -> list[int]:
    hadoop = spark._jvm.org.apache.hadoop.fs
    pattern = hadoop.Path(f"{root}/version=*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return [int(str(s.getPath().getParent().getName()).split("=")[1]) for s in found or []]


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


TRACKED = "vault_id string, path string, status string, last_change string, updated_at timestamp, n_changes long"


def merge_tracked(kept: DataFrame, fresh: DataFrame) -> DataFrame:
    """Tracked state after one more batch: the newest change of a path decides, and changes add up."""
    newest = F.max_by(F.struct("status", "last_change"), F.struct("updated_at", "last_change")).alias("_last")
    both = kept.unionByName(fresh.select(kept.columns))
    merged = both.groupBy("vault_id", "path").agg(newest, F.max("updated_at").alias("updated_at"), F.sum("n_changes").alias("n_changes"))
    return merged.select("vault_id", "path", "_last.status", "_last.last_change", "updated_at", "n_changes")


def track_files(events: DataFrame) -> DataFrame:
    """Latest state per path in a batch of events: status, last change, number of changes."""
    last = F.max_by(F.struct("change_type", "old_path"), F.struct("ts", "change_type"))
    return events.groupBy("vault_id", "path").agg(last.alias("_last"), F.max("ts").alias("updated_at"), F.count(F.lit(1)).alias("n_changes")).select(
        "vault_id", "path", F.when(F.col("_last.change_type") == "deleted", "deleted").otherwise("active").alias("status"),
        F.col("_last.change_type").alias("last_change"), "updated_at", "n_changes",
    )
