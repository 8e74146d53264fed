"""What is written or counted several times is worked out once, in parts that one task can hold."""

import glob
import re

from pyspark.sql import functions as F, types as T

from noteskein.operators import extraction, integrity
from noteskein.plans import incremental
from noteskein.sinks import tables as W


def _counted(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    return seen, F.udf(count, T.StringType()).asNondeterministic()


def test_edges_and_entities_are_worked_out_once(spark, tmp_path):
    seen, count = _counted(spark)
    edges = spark.range(6).select(F.lit("PERSON_TO_PERSON").alias("edge_type"), count(F.col("id").cast("string")).alias("src"), F.lit("b").alias("dst"), F.lit("r").alias("relationship"))
    W.write_edges_csv(edges, str(tmp_path / "edges"))
    assert seen.value == 6
    entities = spark.range(5).select(F.lit("Person").alias("category"), count(F.col("id").cast("string")).alias("id"), F.lit("l").alias("label"), F.lit("").alias("metadata"))
    W.write_entities_csv(entities, str(tmp_path / "entities"))
    assert seen.value == 11


def test_quality_works_edges_out_once(spark):
    seen, count = _counted(spark)
    resolved = spark.range(4).select(
        F.lit("PERSON_TO_COMPANY").alias("edge_type"), count(F.col("id").cast("string")).alias("src"), F.lit("d").alias("dst"),
        F.when(F.col("id") > 1, F.lit("x")).alias("src_id"), F.lit("y").alias("dst_id"),
    )
    assert [tuple(r) for r in integrity.edge_quality(resolved).collect()] == [("PERSON_TO_COMPANY", 4, 2, 2, 0)]
    assert seen.value == 4


def test_extraction_and_replaced_batches(spark, tmp_path):
    seen, count = _counted(spark)
    root = str(tmp_path / "log")
    triples = spark.range(3).select(F.col("id").cast("string").alias("source_file"), count(F.lit("a")).alias("source_label"))
    notes = spark.range(4).select(F.col("id").cast("string").alias("id"), F.lit("h").alias("content_hash"))
    for batch in (1, 2):
        W.append_extraction(triples, notes, root, batch)
    assert seen.value == 6
    found = W.current_triples(spark.read.parquet(f"{root}/triples"), spark.read.parquet(f"{root}/processed"))
    assert sorted((r["source_file"], r["batch"]) for r in found.collect()) == [("0", 2), ("1", 2), ("2", 2)]
    assert re.search(r"PartitionFilters: \[[^\]]*batch#\d+ (=|IN) ?\(?2", found._jdf.queryExecution().toString())


def test_csv_files_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(W.CSV, "maxRecordsPerFile", 10)
    rows = spark.range(35).select(F.lit("PERSON_TO_PERSON").alias("edge_type"), F.col("id").cast("string").alias("src"), F.lit("b\nc").alias("dst"), F.lit("r").alias("relationship"))
    W.write_edges_csv(rows.coalesce(1), str(tmp_path / "e"))
    assert len(glob.glob(f"{tmp_path}/e/person_to_person.csv/*.csv")) >= 4


def test_a_bucket_is_in_few_files(spark, tmp_path):
    rows = spark.range(4000).select(F.concat(F.lit("n"), "id").alias("source_file"), F.lit(1).alias("made")).repartition(8)
    incremental._write(rows, str(tmp_path / "replaced"), "replaced")
    assert len(glob.glob(f"{tmp_path}/replaced/bucket=*/*.parquet")) <= 2 * incremental.BUCKETS


def test_model_gets_few_texts_at_once(spark):
    most = spark.sparkContext.accumulator(0)
    calls = spark.sparkContext.accumulator(0)

    def model(texts):
        calls.add(1)
        most.add(len(texts) > extraction.REQUESTS)
        return texts

    keyed = spark.range(3000).coalesce(1).select(F.col("id").cast("string").alias("chunk_key"), F.col("id").cast("string").alias("text"))
    got = extraction.ask_model(keyed, model).collect()
    assert len(got) == 3000 and all(r["chunk_key"] == r["raw"] for r in got)
    assert most.value == 0 and calls.value >= 12
