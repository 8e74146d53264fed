"""Building blocks that keep one hot key from deciding the run time."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from noteskein.session import ensure_checkpoint_dir

# Over so many values rows without a key are dealt out; more than any number of shuffle partitions.
NULL_SALTS = 1 << 20

# Positions per block of a blocked sum: a window over 10^12 rows of one key sees 1.5 * 10^7 block sums.
BLOCK = 65536


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through a Parquet table of the shared folder, so that a lost executor costs one stage only.

    It is a fraction of a checkpoint of rows, and Spark knows its size when it plans what is joined to it.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(columns: list[Column], salts: int) -> Column:
    """Salt from row content. It is the same on every attempt of a task, as a retry needs."""
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def lookup(facts: DataFrame, dim: DataFrame, key: Column | str, dim_key: str, salt_by: list[str], how: str = "left") -> DataFrame:
    """Join ``facts`` to another table by one key that is unique there.

    Nothing is written or measured first: Spark broadcasts the table when its size at run time allows it, and else
    splits the partitions of hot keys, which repeats only the few rows that they meet. Facts without a key
    match nothing; left joins deal them out by the columns ``salt_by`` instead of hashing them all to one place.
    A ``key`` that is a column of the facts is given by its name, so that no copy of it is shuffled.
    """
    dim = dim.withColumnRenamed(dim_key, "_dim_key")
    keyed = facts if isinstance(key, str) else facts.withColumn("_key", key)
    name = key if isinstance(key, str) else "_key"
    if how == "inner":
        return keyed.join(dim, F.col(name) == F.col("_dim_key"), how).drop("_key", "_dim_key")
    salted = keyed.withColumn("_salt", F.when(F.col(name).isNull(), spread([F.col(c) for c in salt_by], NULL_SALTS)).otherwise(0))
    # Always 0, but no literal: a literal would be taken out of the key and no longer deal out rows.
    zero = dim.withColumn("_dim_salt", F.pmod(F.hash("_dim_key"), F.lit(1)))
    joined = salted.join(zero, (F.col(name) == F.col("_dim_key")) & (F.col("_salt") == F.col("_dim_salt")), how)
    return joined.drop("_salt", "_dim_salt", "_key", "_dim_key")


def running_total(
    df: DataFrame,
    keys: list[str],
    position: str,
    value: Column,
    name: str,
    width: int = BLOCK,
    levels: int = 1,
) -> DataFrame:
    """Inclusive sum of ``value`` by ``position`` within ``keys``, without a window over a whole key.

    ``position`` is a whole number and unique within ``keys``. Rows are cut into blocks of ``width``
    positions; block sums get their own running total (in turn blocked, ``levels`` deep), and a
    window then covers one block at a time.
    """
    block = f"_block_{levels}"
    rows = df.withColumn("_value", value)
    if levels == 0:
        order = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn(name, F.sum("_value").over(order)).drop("_value")
    rows = rows.withColumn(block, F.floor(F.col(position) / F.lit(width)))
    sums = rows.groupBy(*keys, block).agg(F.sum("_value").alias("_block_sum"))
    totals = running_total(sums, keys, block, F.col("_block_sum"), "_upto", width, levels - 1)
    offsets = totals.select(*keys, block, (F.col("_upto") - F.col("_block_sum")).alias("_offset"))
    order = Window.partitionBy(*keys, block).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_local", F.sum("_value").over(order))
    # Keys may be NULL: such rows are a group like any other.
    renamed = offsets.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col(block).alias("_of_block"), "_offset")
    same = F.col(block) == F.col("_of_block")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    joined = local.join(renamed, same).drop("_of_block", *[f"_of_{k}" for k in keys])
    return joined.withColumn(name, F.col("_local") + F.col("_offset")).drop("_value", "_local", "_offset", block)


def with_previous(
    df: DataFrame, keys: list[str], position: str, columns: dict[str, str], width: int = BLOCK
) -> DataFrame:
    """Value of each column at ``position - 1``, for dense positions, with windows of one block.

    The last row of a block is sent to the next block too, so no window crosses a block.
    """
    block = F.floor(F.col(position) / F.lit(width))
    last = F.pmod(F.col(position), F.lit(width)) == width - 1
    homes = F.when(last, F.array(block, block + 1)).otherwise(F.array(block))
    rows = df.select("*", block.alias("_home"), F.explode(homes).alias("_block"))
    order = Window.partitionBy(*keys, "_block").orderBy(position)
    for source, name in columns.items():
        rows = rows.withColumn(name, F.lag(source).over(order))
    return rows.where(F.col("_home") == F.col("_block")).drop("_home", "_block")


def unnest(df: DataFrame, columns: list[str], items: Column, probe: str) -> DataFrame:
    """One row per struct of an array, with ``columns`` kept; ``probe`` names a field that is never NULL.

    The plain generator would get a filter on the size of the array, and the expression behind the
    array would then be evaluated once more per filter. The outer form does not.
    """
    return df.select(*columns, F.inline_outer(items)).where(F.col(probe).isNotNull())


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
