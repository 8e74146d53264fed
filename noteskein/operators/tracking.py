"""Change detection against a tracking table, and upkeep of that table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from noteskein.functions import fixed
from noteskein.functions.text import body_hash
from noteskein.scale import checkpointed, lookup, union_all

HOUR_US = 3_600_000_000


def hash_notes(notes: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Hash reader over a notes table ``id, content``.

    Only the notes on the list are hashed; Spark broadcasts the list when its size at run time allows it.
    """
    def read(paths: DataFrame) -> DataFrame:
        wanted = paths.select(F.col("path").alias("id")).distinct()
        return notes.join(wanted, "id", "left_semi").select(F.col("id").alias("path"), body_hash(F.col("content")).alias("new_hash"))

    return read


def compare_listing(listing: DataFrame, state: DataFrame) -> DataFrame:
    """Listing beside the active state; ``_kind`` is created, touched, unchanged or deleted. No text is read."""
    known = state.where(F.col("status") == "active").select(
        "path", "file_id", "file_size", F.col("modified").alias("_old_modified"), F.col("content_hash").alias("old_hash")
    )
    seen = listing.select("path", "length", "modified", F.lit(True).alias("_seen"))
    both = seen.join(known, "path", "full_outer")
    same = (F.col("length") == F.col("file_size")) & (F.col("modified") == F.col("_old_modified"))
    both = both.withColumn(
        "_kind",
        F.when(F.col("_seen").isNull(), "deleted").when(F.col("file_id").isNull(), "created")
        .when(same, "unchanged").otherwise("touched"),
    )
    return checkpointed(both)


def paths_to_hash(compared: DataFrame) -> DataFrame:
    return compared.where(F.col("_kind").isin("created", "touched")).select("path")


def detect_changes(listing: DataFrame, state: DataFrame, hash_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One row per path: created, modified, metadata_only, unchanged or deleted.

    The listing (path, size, time) decides first; only new or touched paths are read and hashed.
    """
    return decide_changes(compare_listing(listing, state), hash_of)


def decide_changes(compared: DataFrame, hash_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``detect_changes`` from the compared listing on."""
    hashed = compared.join(hash_of(paths_to_hash(compared)), "path", "left")
    kind = (
        F.when(F.col("_kind") != "touched", F.col("_kind"))
        .when(F.col("new_hash") == F.col("old_hash"), "metadata_only")
        .otherwise("modified")
    )
    return hashed.select(
        F.coalesce("file_id", F.xxhash64("path")).alias("file_id"), "path", kind.alias("change_type"),
        "length", "modified", "old_hash", F.coalesce("new_hash", F.when(kind == "unchanged", F.col("old_hash"))).alias("new_hash"),
    )


def change_log(detected: DataFrame, ts: Column) -> DataFrame:
    """Rows for the change log: created, modified and deleted files."""
    logged = detected.where(F.col("change_type").isin("created", "modified", "deleted"))
    return logged.select(
        "file_id",
        "change_type",
        F.when(F.col("change_type") != "created", F.col("path")).alias("old_path"),
        F.when(F.col("change_type") != "deleted", F.col("path")).alias("new_path"),
        F.when(F.col("change_type") == "modified", F.col("old_hash")).alias("old_hash"),
        F.when(F.col("change_type") != "deleted", F.col("new_hash")).alias("new_hash"),
        ts.alias("ts"),
    )


def upsert(base: DataFrame, patch: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``patch`` replace rows of ``base`` with the same key; other rows stay."""
    return base.join(patch.select(*key), key, "left_anti").unionByName(patch.select(base.columns))


def apply_changes(state: DataFrame, detected: DataFrame, now: Column) -> DataFrame:
    """Tracking table after a scan. A path that comes back is active again."""
    touched = detected.where(F.col("change_type") != "unchanged")
    before = state.select("path", "processed_at", "has_relationships", F.col("file_size").alias("_size"),
                          F.col("modified").alias("_modified"), F.col("content_hash").alias("_hash"))
    gone = F.col("change_type") == "deleted"
    patch = touched.join(before, "path", "left").select(
        "file_id",
        "path",
        F.when(gone, F.col("_size")).otherwise(F.col("length")).alias("file_size"),
        F.when(gone, F.col("_modified")).otherwise(F.col("modified")).alias("modified"),
        F.when(gone, F.col("_hash")).otherwise(F.col("new_hash")).alias("content_hash"),
        F.when(gone, "deleted").otherwise("active").alias("status"),
        "processed_at",
        "has_relationships",
        now.alias("updated_at"),
    )
    return upsert(state, patch, ["path"])


def change_summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change_type").agg(F.count(F.lit(1)).alias("n_changes"))


def unprocessed(notes: DataFrame, processed: DataFrame) -> DataFrame:
    """Notes without a processed marker, by full path."""
    return notes.join(processed.select("id").distinct(), "id", "left_anti")


def orphaned(processed: DataFrame, notes: DataFrame) -> DataFrame:
    """Processed markers whose note is gone."""
    return processed.join(notes.select("id"), "id", "left_anti")


def to_process(detected: DataFrame, missing: DataFrame) -> DataFrame:
    """Paths to process: created or modified, and notes without a marker, each once."""
    changed = detected.where(F.col("change_type").isin("created", "modified")).select("path")
    return changed.union(missing.select(F.col("id").alias("path"))).distinct()


def recently_changed(state: DataFrame, changes: DataFrame, since: Column) -> DataFrame:
    """Active files with a created or modified change after a point in time."""
    recent = changes.where(F.col("change_type").isin("created", "modified") & (F.col("ts") > since))
    return state.where(F.col("status") == "active").join(recent.select("file_id").distinct(), "file_id", "left_semi")


def file_history(state: DataFrame, changes: DataFrame, rows: int = 10) -> DataFrame:
    """Latest changes per tracked path, found by file id, old path or new path.

    Three equi-joins and a union stand for the OR, which would be a nested loop. The top rows are
    cut per map partition before the shuffle (window group limit), so a busy path stays small.
    """
    tracked = state.select(F.col("path").alias("current_path"), F.col("file_id").alias("tracked_id"))
    columns = ["current_path", "change_type", "old_path", "new_path", "old_hash", "new_hash", "ts"]
    spread_by = ["ts", "change_type"]
    by_id = lookup(changes, tracked, F.col("file_id"), "tracked_id", spread_by, how="inner")
    paths = checkpointed(tracked.select("current_path", F.col("current_path").alias("_path")))
    by_old = lookup(changes, paths, F.col("old_path"), "_path", spread_by, how="inner")
    by_new = lookup(changes, paths, F.col("new_path"), "_path", spread_by, how="inner")
    found = union_all([part.select(*columns) for part in (by_id, by_old, by_new)]).distinct()
    newest = Window.partitionBy("current_path").orderBy(F.desc("ts"), "change_type", "old_path", "new_path", "new_hash")
    return found.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= rows)


def apply_moves(state: DataFrame, moves: DataFrame, now: Column) -> DataFrame:
    """Rename tracked paths by ``old_path, new_path``; where the new path is taken, mark as deleted.

    Several moves of one path count once, the latest by ``ts``. Of several paths that move to one
    place the smallest old path gets it.
    """
    latest = moves.groupBy("old_path").agg(F.max_by("new_path", F.struct("ts", "new_path")).alias("new_path"))
    winner = latest.groupBy("new_path").agg(F.min("old_path").alias("_winner"))
    # What moves away itself makes room.
    taken = state.join(latest.select(F.col("old_path").alias("path")), "path", "left_anti")
    taken = taken.select(F.col("path").alias("new_path"), F.lit(True).alias("_taken"))
    plan = (
        latest.join(winner, "new_path").join(taken, "new_path", "left")
        .select(
            F.col("old_path").alias("path"), "new_path",
            (F.col("_taken").isNull() & (F.col("_winner") == F.col("old_path"))).alias("_free"),
        )
    )
    joined = state.join(plan, "path", "left")
    moved = F.coalesce(F.col("_free"), F.lit(False))
    blocked = F.col("new_path").isNotNull() & ~moved & (F.col("new_path") != F.col("path"))
    return joined.select(
        *[
            F.when(moved, F.col("new_path")).otherwise(F.col("path")).alias("path") if c == "path"
            else F.when(blocked, "deleted").otherwise(F.col("status")).alias("status") if c == "status"
            else F.when(moved | blocked, now).otherwise(F.col("updated_at")).alias("updated_at") if c == "updated_at"
            else F.col(c)
            for c in state.columns
        ]
    )


def rewrite_source_files(triples: DataFrame, moves: DataFrame) -> DataFrame:
    """Point triples of a moved note at its new path."""
    latest = moves.groupBy("old_path").agg(F.max_by("new_path", F.struct("ts", "new_path")).alias("_moved"))
    spread_by = [c for c in triples.columns if c != "source_file"]
    joined = lookup(triples, latest, F.col("source_file"), "old_path", spread_by)
    return joined.withColumn("source_file", F.coalesce("_moved", "source_file")).select(triples.columns)


def rewrite_markers(processed: DataFrame, moves: DataFrame) -> DataFrame:
    """Processed markers of moved notes at their new paths."""
    renamed = rewrite_source_files(processed.withColumnRenamed("id", "source_file"), moves)
    return renamed.withColumnRenamed("source_file", "id")


def mark_processed(state: DataFrame, processed: DataFrame, now: Column) -> DataFrame:
    """Note the time, and whether any triple was found, for ``id, n_rels`` rows."""
    done = processed.groupBy("id").agg(F.max("n_rels").alias("_rels")).withColumnRenamed("id", "path")
    joined = state.join(done, "path", "left")
    hit = F.col("_rels").isNotNull()
    return joined.withColumns({
        "processed_at": F.when(hit, now).otherwise(F.col("processed_at")),
        "has_relationships": F.when(hit, F.col("_rels") > 0).otherwise(F.col("has_relationships")),
        "updated_at": F.when(hit, now).otherwise(F.col("updated_at")),
    }).select(state.columns)


def purge_deleted(state: DataFrame, now: Column, days: int = fixed.RETENTION_DAYS) -> DataFrame:
    """Drop rows of files deleted longer ago than the retention."""
    cutoff = now - F.make_dt_interval(F.lit(days))
    return state.where((F.col("status") != "deleted") | (F.col("updated_at") >= cutoff))


def debounce_sessions(events: DataFrame, quiet_seconds: int = fixed.QUIET_SECONDS) -> DataFrame:
    """Sessions of a vault: a batch fires after a quiet period, and each event restarts the timer.

    ``events`` holds ``vault_id, path, ts_us`` (microseconds). One vault may own most events, so no
    window covers a whole vault: events merge per second first.
    """
    quiet = quiet_seconds * 1_000_000
    merged = merge_sessions(per_second(events, F.lit(0).cast("bigint")), quiet)
    return merged.select(
        "vault_id", F.col("lo").alias("start_us"), (F.col("hi") + quiet).alias("fires_us"), F.col("n").alias("n_events")
    )


def per_second(events: DataFrame, seen: Column) -> DataFrame:
    """Parts of sessions ``vault_id, lo, hi, n, seen``: the events of one second."""
    return events.groupBy("vault_id", F.floor(F.col("ts_us") / 1_000_000).alias("_second")).agg(
        F.min("ts_us").alias("lo"), F.max("ts_us").alias("hi"), F.count(F.lit(1)).alias("n"), F.max(seen).alias("seen")
    ).drop("_second")


def merge_sessions(parts: DataFrame, quiet: int) -> DataFrame:
    """Sessions ``vault_id, lo, hi, n, seen`` from parts that each lie within one hour.

    Islands are found within one hour at a time, and only the first and last island of an hour are compared with their neighbours.
    """
    total = [F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"), F.max("seen").alias("seen")]
    parts = parts.withColumn("_hour", F.floor(F.col("lo") / HOUR_US))

    def apart(window) -> Column:
        # A part may end after the next one does.
        return (F.col("lo") - F.max("hi").over(window.rowsBetween(Window.unboundedPreceding, -1))) >= quiet

    order = Window.partitionBy("vault_id", "_hour").orderBy("lo", "hi")
    islands = (
        parts.withColumn("_new", F.coalesce(apart(order), F.lit(False)).cast("int"))
        .withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("vault_id", "_hour", "_island").agg(*total)
    )
    # Chains can only run through the first and the last island of an hour.
    ends = Window.partitionBy("vault_id", "_hour")
    islands = islands.withColumn("_edge", (F.col("_island") == 0) | (F.col("_island") == F.max("_island").over(ends)))
    inner = islands.where(~F.col("_edge")).select("vault_id", "lo", "hi", "n", "seen")
    along = Window.partitionBy("vault_id").orderBy("lo", "hi")
    chained = islands.where("_edge").withColumn("_new", F.coalesce(apart(along), F.lit(True)).cast("int"))
    merged = (
        chained.withColumn("_chain", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("vault_id", "_chain").agg(*total).drop("_chain")
    )
    return inner.unionByName(merged)


def hourly_parts(sessions: DataFrame) -> DataFrame:
    """Sessions as parts that each lie within one hour; the first part has the events."""
    start = lambda h: F.greatest(F.col("lo"), h * HOUR_US)
    hours = F.sequence(F.floor(F.col("lo") / HOUR_US), F.floor(F.col("hi") / HOUR_US))
    cut = sessions.withColumn("_h", F.explode(hours))
    return cut.select(
        "vault_id", start(F.col("_h")).alias("lo"), F.least(F.col("hi"), (F.col("_h") + 1) * HOUR_US - 1).alias("hi"),
        F.when(start(F.col("_h")) == F.col("lo"), F.col("n")).otherwise(0).alias("n"), "seen",
    )


def session_step(events: DataFrame, still_open: DataFrame, quiet: int, now: Column, flush: bool) -> tuple[DataFrame, DataFrame]:
    """Closed and open sessions after a batch of ``events`` (``vault_id, ts_us``) and the sessions open before it.

    The last session of a vault stays open until nothing has been seen of it for the quiet period; ``flush`` closes it at once.
    """
    parts = per_second(events, now).unionByName(hourly_parts(still_open))
    found = checkpointed(merge_sessions(parts, quiet))
    last = found.groupBy(F.col("vault_id").alias("_vault")).agg(F.max("lo").alias("_last"))
    met = found.join(last, F.col("vault_id").eqNullSafe(F.col("_vault")) & (F.col("lo") == F.col("_last")), "left")
    stays = F.lit(False) if flush else F.col("_last").isNotNull() & (now - F.col("seen") < quiet)
    columns = ["vault_id", "lo", "hi", "n", "seen"]
    return met.where(~stays).select(*columns), met.where(stays).select(*columns)


def session_paths(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Distinct paths of each session: the pending set.

    Sessions are cut at minutes, so that an event finds its session by an equi-join on the minute.
    A minute of one vault holds few sessions (each is followed by a quiet period).
    """
    minute = F.lit(60_000_000)
    cut = sessions.select(
        "vault_id", "start_us", "fires_us",
        F.explode(F.sequence(F.floor(F.col("start_us") / minute), F.floor(F.col("fires_us") / minute))).alias("_minute"),
    )
    keyed = events.groupBy("vault_id", "path", F.floor(F.col("ts_us") / F.lit(1_000_000)).alias("_second")).agg(
        F.min("ts_us").alias("ts_us")
    ).withColumn("_minute", F.floor(F.col("ts_us") / minute))
    inside = keyed.join(cut, ["vault_id", "_minute"]).where(
        (F.col("ts_us") >= F.col("start_us")) & (F.col("ts_us") < F.col("fires_us"))
    )
    return inside.select("vault_id", "start_us", "path").distinct()
