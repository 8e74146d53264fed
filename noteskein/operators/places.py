"""Where files are after many moves: chains, returns and paths that are used again.

A move takes what is at its old path at that time, and nothing that comes there later. So a place in time - a path, a batch and a time
in it - goes on with the next departure from that path, that move with the next departure from its new path, and so on.
The next departure is found per path within one batch and hour, and over the first departures of later ones; chains are
followed by pointer jumping, whose rounds double the length they cover. Moves of equal batch and time are not chained.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from noteskein.scale import checkpointed

MOVE = ["batch", "ts", "old_path", "new_path"]
HOUR = 3600


def _identity(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in MOVE])


def next_departure(points: DataFrame, moves: DataFrame) -> DataFrame:
    """``points`` (``path, batch, ts`` and more) with ``next``: the first move away from the path after that time, or null.

    A null ``ts`` stands for the end of the batch.
    """
    columns = [c for c in points.columns if c not in ("path", "batch", "ts")]
    # At one time, points come before departures, and do not see them.
    asked = points.select("path", "batch", "ts", F.struct(F.lit(0).alias("_none"), *columns).alias("_point"), F.lit(None).cast(_move_type()).alias("_move"))
    away = moves.select(F.col("old_path").alias("path"), "batch", "ts", _identity().alias("_move"))
    both = asked.unionByName(away, allowMissingColumns=True)
    hour = F.when(F.col("ts").isNull(), F.lit(None)).otherwise(F.floor(F.unix_seconds("ts") / HOUR))
    both = both.withColumn("_hour", hour).withColumn("_at", F.unix_micros("ts"))

    # Within a block, by descending time; the range leaves out what is at the same time.
    block = Window.partitionBy("path", "batch", "_hour").orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("_inside", F.min("_move").over(block))
    firsts = both.groupBy("path", "batch", "_hour").agg(F.min("_move").alias("_first"))
    later = Window.partitionBy("path").orderBy(F.desc("batch"), F.desc_nulls_first("_hour")).rowsBetween(Window.unboundedPreceding, -1)
    # Blocks come latest first, so the nearest one with a departure is the last one seen.
    after = firsts.select(
        F.col("path").alias("_path"), F.col("batch").alias("_batch"), F.col("_hour").alias("_of"), F.last("_first", ignorenulls=True).over(later).alias("_later")
    )
    same = (F.col("path") == F.col("_path")) & F.col("batch").eqNullSafe(F.col("_batch")) & F.col("_hour").eqNullSafe(F.col("_of"))
    found = both.where(F.col("_point").isNotNull()).join(after, same, "left")
    return found.select("path", "batch", "ts", "_point.*", F.coalesce("_inside", "_later").alias("next")).drop("_none")


def _move_type() -> str:
    return "struct<batch: bigint, ts: timestamp, old_path: string, new_path: string>"


def moves_over_time(moves: DataFrame) -> DataFrame:
    """Each different move (``batch, ts, old_path, new_path``) with ``place``, where its file is after all of them, and ``moved``, the last move of it."""
    known = moves.where(F.col("old_path").isNotNull() & F.col("new_path").isNotNull()).select(F.col("batch").cast("long").alias("batch"), "ts", "old_path", "new_path").distinct()
    known = checkpointed(known)
    arrivals = known.select(F.col("new_path").alias("path"), "batch", "ts", _identity().alias("id"))
    rows = next_departure(arrivals, known).select("id", F.col("path").alias("place"), F.col("id").alias("moved"), "next")
    rows = checkpointed(rows)
    while not rows.where(F.col("next").isNotNull()).isEmpty():
        steps = rows.select(F.col("id").alias("_id"), F.col("place").alias("_place"), F.col("moved").alias("_moved"), F.col("next").alias("_next"))
        met = rows.join(steps, F.col("next") == F.col("_id"), "left")
        rows = checkpointed(met.select(
            "id", F.coalesce("_place", "place").alias("place"), F.coalesce("_moved", "moved").alias("moved"), F.col("_next").alias("next"),
        ))
    return rows.select("id.*", "place", "moved")


def placed(points: DataFrame, resolved: DataFrame) -> DataFrame:
    """``points`` (``path, batch`` and more) with ``place`` now, and ``arrived``: the batch of the last move, or their own.

    A point is at its path at the end of its batch.
    """
    timed = points.withColumn("batch", F.col("batch").cast("long")).withColumn("ts", F.lit(None).cast("timestamp"))
    found = next_departure(timed, resolved.select(*MOVE)).drop("ts")
    ends = resolved.select(_identity().alias("_id"), F.col("place").alias("_place"), F.col("moved.batch").alias("_arrived"))
    met = found.join(ends, F.col("next") == F.col("_id"), "left")
    return met.select(
        *points.columns, F.coalesce("_place", "path").alias("place"), F.coalesce("_arrived", "batch").alias("arrived")
    )


def newest_at_place(points: DataFrame) -> DataFrame:
    """Of the points at one place, the one that came last: of a move and what it overwrote, the move."""
    order = F.struct("arrived", "batch", "path")
    last = points.groupBy("place").agg(F.max(order).alias("_last"))
    met = points.join(last.withColumnRenamed("place", "_place"), F.col("place") == F.col("_place"))
    return met.where((F.col("arrived") == F.col("_last.arrived")) & (F.col("batch") == F.col("_last.batch")) & (F.col("path") == F.col("_last.path"))).drop("_last", "_place")


def net_moves(moves: DataFrame) -> DataFrame:
    """``old_path, new_path, ts`` of one batch of moves: for each path, where the file that was there before is after all of them."""
    known = moves.select(F.lit(1).cast("long").alias("batch"), "ts", "old_path", "new_path")
    resolved = moves_over_time(known)
    first = resolved.groupBy("old_path").agg(F.min_by(F.struct("place", "moved.ts"), F.struct("ts", "new_path")).alias("_now"))
    return first.select("old_path", F.col("_now.place").alias("new_path"), F.col("_now.ts").alias("ts")).where("old_path != new_path")
