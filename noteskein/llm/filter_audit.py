"""What each of five filters removes, in each of the 120 orders in which they can be applied.

A document is its mask: the set of filters that it fails. Orders stand in lexicographic (Lehmer) rank, so all orders that share
their first s letters are one interval of (5 - s)! ranks. A mask is removed at step s by exactly those prefixes whose last
letter alone is in the mask. Documents are therefore counted once per part and mask; every count is added at the start of each
interval of its mask and taken away behind its end, and a running sum over the 120 ranks gives what every step removes.

Texts are read once. Of a text only its mask and digest leave the scan; the smallest id per digest meets the documents of texts
that occur more than once, so a hot text is counted map-side and its documents are split by Spark's skew handling.

Defined results: a null text is an empty one, a null source the empty part; a null ``doc_id`` is not smaller than any id, has no
smaller one and no labels; rows that repeat an id and its text are documents each, and none is the earlier one of the others;
a document with several label rows is good (toxic) if one of them says so; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window, functions as F

from noteskein.llm.common import stored
from noteskein.scale import lookup

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT = 50
MAX_CAPITALS = 2
SYMBOLS = "[#$%&*|]"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: ``[^\x20\x09-\x0D]+`` are words, so these separate them.
WHITE = "[ \\t\\n\\x0B\\f\\r]+"


def bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def intervals() -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank behind the last): where documents of a mask are removed. 840 rows, by rule."""
    found = []
    for step in range(1, len(FILTERS) + 1):
        width = factorial(len(FILTERS) - step)
        for first in range(0, len(ORDERS), width):
            before, letter = ORDERS[first][: step - 1], ORDERS[first][step - 1]
            for mask in range(1 << len(FILTERS)):
                if mask & bit(letter) and not any(mask & bit(x) for x in before):
                    found.append((mask, step, first, first + width))
    return found


def masks(docs: DataFrame) -> DataFrame:
    """``doc_id, part, mask`` (A to D), and the text's digest."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("words", F.array_remove(F.split("text", WHITE), ""))
    n = F.size("words")
    fails = {
        "A": n < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct("words")) < MIN_DISTINCT * n,
        "C": 100 * F.length(F.regexp_replace("text", "[^A-Z]+", "")) > MAX_CAPITALS * F.length("text"),
        "D": F.col("text").rlike(SYMBOLS),
    }
    mask = sum((F.when(fail, bit(k)).otherwise(0) for k, fail in fails.items()), F.lit(0))
    return rows.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))


def judged(docs: DataFrame) -> DataFrame:
    """``doc_id, part, mask`` with filter E: a copy of the text has a smaller id."""
    rows = stored(masks(docs))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    met = rows.join(first.select(F.col("digest").alias("of"), "first"), F.col("digest") == F.col("of"), "left")
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return met.select("doc_id", "part", (F.col("mask") + F.when(later, bit("E")).otherwise(0)).alias("mask"))


def counted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: at most 32 rows per part."""
    one = lambda name: F.max(F.coalesce(F.col(name).cast("int") == 1, F.lit(False)).cast("int")).alias(name)
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("of")).agg(one("quality"), one("toxic"))
    rows = lookup(judged(docs), marks, F.col("doc_id"), "of", ["part", "mask"])
    total = lambda name: F.sum(F.coalesce(F.col(name), F.lit(0)).cast("long"))
    return rows.groupBy("part", "mask").agg(
        F.count("*").alias("n"), total("quality").alias("good"), total("toxic").alias("toxic")
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step; see the module."""
    spark = docs.sparkSession
    cells = stored(counted(docs, labels))
    where = F.broadcast(spark.createDataFrame(intervals(), "of int, step int, start int, stop int"))
    hit = cells.join(where, F.col("mask") == F.col("of"))
    ends = hit.select("part", "step", F.explode(F.array(
        *[F.struct(F.col(at).alias("at"), *[(F.col(c) * sign).alias(c) for c in ("n", "good", "toxic")])
          for at, sign in (("start", 1), ("stop", -1))]
    )).alias("end")).select("part", "step", "end.*").where(F.col("at") < len(ORDERS))

    letters = [(k, (F.col("mask").bitwiseAND(bit(k)) != 0, F.col("mask") == bit(k))) for k in FILTERS]
    share = F.expr(f"{len(ORDERS)} div bit_count(mask)")
    count_if = lambda on, of: F.sum(F.when(on, of).otherwise(F.lit(0).cast("long")))
    per_part = cells.groupBy("part").agg(
        F.sum("n").alias("total"),
        F.array(*[count_if(has, F.col("n")) for _, (has, _) in letters]).alias("fails"),
        F.array(*[count_if(only, F.col("n")) for _, (_, only) in letters]).alias("unique"),
        F.array(*[count_if(has, F.col("n") * share) for _, (has, _) in letters]).alias("shapley"),
    )
    zero = F.lit(0).cast("long")
    grid = per_part.select("part", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step")).select(
        "part", "step", F.explode(F.sequence(F.lit(0), F.lit(len(ORDERS) - 1))).alias("at"),
        zero.alias("n"), zero.alias("good"), zero.alias("toxic"),
    )
    steps = ends.unionByName(grid).groupBy("part", "step", "at").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    ranks = Window.partitionBy("part", "step").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    upto = Window.partitionBy("of", "at").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    removed = steps.select(
        F.col("part").alias("of"), "step", "at", F.sum("n").over(ranks).alias("removed"),
        F.sum("good").over(ranks).alias("good_lost"), F.sum("toxic").over(ranks).alias("toxic_lost"),
    ).withColumn("gone", F.sum("removed").over(upto))
    rows = removed.join(per_part, F.col("of") == F.col("part"))
    order = F.element_at(F.array(*[F.lit(o) for o in ORDERS]), F.col("at") + 1)
    at = F.instr(F.lit(FILTERS), F.substring(order, F.col("step"), F.lit(1)))
    mine = lambda name: F.element_at(F.col(name), at)
    return rows.select(
        "part", order.alias("filter_order"), "step", (F.col("total") - F.col("gone")).alias("kept"), "removed",
        (mine("fails") - F.col("removed")).alias("redundant"), mine("unique").alias("unique_fails"), "good_lost", "toxic_lost",
        mine("shapley").alias("shapley"),
    )


SQL = r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as words, min(doc_id) over (partition by t) as lo from d),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as bad
      from labels group by doc_id),
f as (select part, coalesce(good, 0) as good, coalesce(bad, 0) as bad, case when len(words) < 200 then 1 else 0 end as a,
      case when 100 * len(list_distinct(words)) < 50 * len(words) then 1 else 0 end as b,
      case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) then 1 else 0 end as c,
      case when regexp_matches(t, '[#$%&*|]') then 1 else 0 end as dd, case when w.doc_id > lo then 1 else 0 end as e
      from w left join l on w.doc_id = l.doc_id),
g as (select part, [a, b, c, dd, e] as bits, a + b + c + dd + e as k, count(*) as n, sum(good) as good, sum(bad) as bad
      from f group by all),
letter as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
p as (select p1.x || p2.x || p3.x || p4.x || p5.x as o from letter p1, letter p2, letter p3, letter p4, letter p5
      where len(list_distinct([p1.x, p2.x, p3.x, p4.x, p5.x])) = 5),
s as (select part, o, unnest([1, 2, 3, 4, 5]) as step, bits, k, n, good, bad from g, p),
h as (select *, bits[ascii(o[step]) - 64] = 1 as fails,
      list_sum(list_transform(range(1, step), lambda i: bits[ascii(o[i]) - 64])) > 0 as earlier from s),
r as (select part, o, step, o[step] as x, sum(case when not coalesce(earlier, false) and not fails then n else 0 end) as kept,
      sum(case when not coalesce(earlier, false) and fails then n else 0 end) as removed,
      sum(case when coalesce(earlier, false) and fails then n else 0 end) as redundant,
      sum(case when fails and k = 1 then n else 0 end) as unique_fails,
      sum(case when not coalesce(earlier, false) and fails then good else 0 end) as good_lost,
      sum(case when not coalesce(earlier, false) and fails then bad else 0 end) as toxic_lost from h group by all)
select part, o as filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
  cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost,
  cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, x) as bigint) as shapley from r
"""
