"""Scores of extraction runs, and roll-ups of request and benchmark logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from noteskein.functions import fixed
from noteskein.functions.text import py_strip


def _pair(source: str, target: str) -> Column:
    a, b = py_strip(F.lower(F.col(source))), py_strip(F.lower(F.col(target)))
    return F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))


def score(expected: DataFrame, extracted: DataFrame, by: list[str], compare_in: list[str]) -> DataFrame:
    """Precision, recall, F1 and accuracy per ``by``; a pair matches within ``compare_in``, in either direction.

    An expected row is a hit when its pair was extracted at all; repeated extractions lower the
    precision. Both sides are counted per pair first, so one join of unique keys remains.
    """
    keys = list(dict.fromkeys([*by, *compare_in]))
    want = expected.groupBy(*keys, _pair("source", "target").alias("_pair")).agg(F.count(F.lit(1)).alias("_want"))
    got = extracted.groupBy(*keys, _pair("source", "target").alias("_pair")).agg(F.count(F.lit(1)).alias("_got"))
    both = want.join(got, [*keys, "_pair"], "full_outer")
    totals = both.groupBy(*by).agg(
        F.coalesce(F.sum("_want"), F.lit(0)).alias("n_expected"),
        F.coalesce(F.sum("_got"), F.lit(0)).alias("n_extracted"),
        F.coalesce(F.sum(F.when(F.col("_got").isNotNull(), F.col("_want"))), F.lit(0)).alias("n_hits"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    totals = totals.withColumns({"precision": ratio("n_hits", "n_extracted"), "recall": ratio("n_hits", "n_expected")})
    both_parts = F.col("precision") + F.col("recall")
    f1 = F.when(both_parts > 0, 2 * F.col("precision") * F.col("recall") / both_parts).otherwise(F.lit(0.0))
    return totals.withColumns({"f1": f1, "accuracy": F.col("recall")})


def relation_matches(extracted: Column, expected: Column, variants: dict[str, list[str]] | None = None) -> Column:
    """Whether two relation names mean the same by the variant table; the first name of the table that occurs decides."""
    def bare(text: Column) -> Column:
        return F.regexp_replace(F.lower(text), "[_ ]", "")

    left, right = bare(extracted), bare(expected)
    decided = None
    for name, spellings in (variants or fixed.RELATION_VARIANTS).items():
        words = [s.replace("_", "") for s in spellings]

        def any_in(text: Column, words=words) -> Column:
            test = F.lit(False)
            for word in words:
                test = test | F.contains(text, F.lit(word))
            return test

        in_left, in_right = F.contains(left, F.lit(name)), F.contains(right, F.lit(name))
        decided = F.when(in_left, any_in(right)) if decided is None else decided.when(in_left, any_in(right))
        decided = decided.when(in_right, any_in(left))
    return decided.otherwise(F.lit(False))


def model_summary(results: DataFrame) -> DataFrame:
    """Fastest, most accurate and most productive model among successful results."""
    good = results.where("success")
    return good.agg(
        F.min_by("model", F.struct("response_time", "model")).alias("fastest"),
        F.min_by("model", F.struct(-F.col("f1"), "model")).alias("most_accurate"),
        F.min_by("model", F.struct(-F.col("n_extracted"), "model")).alias("most_complete"),
    )


def speed_table(results: DataFrame, task_types: list[str]) -> DataFrame:
    """Response time per model with one column per task type; the total needs all of them."""
    times = [F.min(F.when(F.col("success") & (F.col("task_type") == t), F.col("response_time"))).alias(t) for t in task_types]
    wide = results.groupBy("model").agg(*times)
    total = F.lit(0.0)
    for t in task_types:
        total = total + F.col(t)
    return wide.withColumn("total", total)


def request_rollup(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Requests, successes and failures, and response times of the successes."""
    good = F.when(F.col("success"), F.col("response_time"))
    n = F.count(F.lit(1))
    return log.groupBy(*(by or [])).agg(
        n.alias("total"),
        F.count_if("success").alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
        (F.count_if("success") / n * 100).alias("success_pct"),
        F.avg(good).alias("avg_time"),
        F.min(good).alias("min_time"),
        F.max(good).alias("max_time"),
    )


def slow_requests(log: DataFrame, threshold: float = 5.0) -> DataFrame:
    return log.where(F.col("success") & (F.col("response_time") > threshold))


def failed_requests(log: DataFrame) -> DataFrame:
    return log.where(~F.col("success"))


def query_counters(log: DataFrame) -> DataFrame:
    """Queries, failures, success rate and the time the log spans in seconds; ``ts_us`` in microseconds."""
    n = F.count(F.lit(1))
    return log.agg(
        n.alias("n_queries"),
        F.count_if(~F.col("success")).alias("n_failed"),
        F.when(n > 0, F.count_if("success") / n * 100).otherwise(F.lit(0.0)).alias("success_rate"),
        F.floor((F.max("ts_us") - F.min("ts_us")) / 1_000_000).alias("uptime_seconds"),
    )


def recent_queries(log: DataFrame, rows: int = 100) -> DataFrame:
    """Rolling history: the newest queries."""
    return log.orderBy(F.desc("ts_us"), F.desc("query_id")).limit(rows)
