"""Connected components by alternating star steps, as Spark joins; no link ever reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from noteskein.llm.common import written


def _both_ways(links: DataFrame) -> DataFrame:
    back = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return links.unionByName(back)


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` (smallest node of its component) of every node that has a link.

    ``links`` has two long columns ``a`` and ``b``. A large-star step hangs every larger neighbour of a node
    under its smallest neighbour; a small-star step does so for the smaller ones. Both keep the components,
    and when nothing changes each tree is a star around its smallest node. Sums of one row tell the driver
    whether a round changed anything. Groups are only ever aggregated to a minimum, never gathered.
    """
    edges = written(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        around = _both_ways(edges)
        least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        mark = F.xxhash64("a", "b").cast("decimal(38,0)")
        now = edges.agg(F.count(F.lit(1)), F.sum(mark)).first()
        if now == before:
            return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
