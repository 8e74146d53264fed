"""Registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from noteskein.llm import (
    decontaminate, filter_audit, lines, packing, pii, product_codes, quality, secret_scan, simhash, suffix_array, suffix_tree, warc, wrappers,
)
from noteskein.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def vocabulary() -> str:
    """Path of the public tokenizer that sequences are packed with; it is installed on every executor."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


@query("op4_quality_cascade")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


@query("op5_secret_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@query("op8_simhash_bitsliced")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op10_pii_weak_supervision")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


@query("op3_bin_completion")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


@query("op1_greedy_string_tiling")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_line_hashing", lines.SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.deduplicate(table(spark, sf_dir, "documents"))
    spans = F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"]))
    return found.select(
        "doc_id", "n_units", F.size("spans").cast("long").alias("n_removed"), F.array_join(spans, ",").alias("spans"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


@query("op2_capture_index")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_suffix_tree_scores")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(table(spark, sf_dir, "documents"))


@query("op7_deep_shallow")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_array.deduplicate(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
        F.col("sha256").alias("kept_sha256"),
    )


@query("op13_lehmer_audit", filter_audit.SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_equal_average_codes", product_codes.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_codes.compress(table(spark, sf_dir, "embeddings"))


@query("op11_wrapper_induction")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract(table(spark, sf_dir, "pages"))
