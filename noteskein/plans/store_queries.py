"""Registered queries over what was written and read back: CSV caches, extraction logs, change logs, exports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from noteskein.operators import extraction, triples as T
from noteskein.plans import views as V
from noteskein.plans.registry import query
from noteskein.scale import checkpointed
from noteskein.sinks import tables as W
from noteskein.sources import tables as R
from noteskein.session import ensure_checkpoint_dir


def _folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/store-{uuid.uuid4()}"


@query("stored_edges_csv", "SELECT * FROM edges", "edges")
def stored_edges_csv(spark, sf):
    folder = _folder(spark)
    W.write_edges_csv(V.edges(spark, sf), folder)
    return R.read_edges(spark, folder)


@query("stored_entities_csv", "SELECT category, id, id AS label, 'm' AS metadata FROM entities", "entities")
def stored_entities_csv(spark, sf):
    folder = _folder(spark)
    W.write_entities_csv(V.entities(spark, sf).select("category", "id", F.col("id").alias("label"), F.lit("m").alias("metadata")), folder)
    return R.read_entities(spark, folder)


@query("stored_nodes_csv", "SELECT id, id AS label, 'm' AS metadata FROM entities WHERE category = 'Company'", "entities")
def stored_nodes_csv(spark, sf):
    folder = _folder(spark)
    W.write_entities_csv(V.entities(spark, sf).select("category", "id", F.col("id").alias("label"), F.lit("m").alias("metadata")), folder)
    return R.read_nodes_csv(spark, f"{folder}/company.csv", "id string, label string, metadata string")


_TRIPLE_COLUMNS = "source_category, source_label, relationship, target_category, target_label, source_file"


@query("stored_triples", f"SELECT {_TRIPLE_COLUMNS}, '2024' AS extracted_at FROM triples", "triples")
def stored_triples(spark, sf):
    """Stamped triples through the append-only log, where a second batch of the same notes replaces the first."""
    folder = _folder(spark)
    found = checkpointed(V.triples(spark, sf).select(*_TRIPLE_COLUMNS.split(", ")))
    stamped = T.stamp(found, F.col("source_file"), F.lit("2024"))
    notes = stamped.select(F.col("source_file").alias("id"), F.lit("h").alias("content_hash")).distinct()
    for batch in (1, 2):
        W.append_extraction(stamped, notes, folder, batch)
    return W.current_triples(spark.read.parquet(f"{folder}/triples"), spark.read.parquet(f"{folder}/processed")).drop("batch")


@query("stored_triples_csv", f"SELECT {_TRIPLE_COLUMNS} FROM triples", "triples")
def stored_triples_csv(spark, sf):
    """Triples as the cached files of many notes, read as one scan."""
    folder = _folder(spark)
    stamped = T.stamp(V.triples(spark, sf).select(*_TRIPLE_COLUMNS.split(", ")), F.col("source_file"), F.lit("2024"))
    W.write_triples_csv(stamped, folder)
    return R.read_triples(spark, folder).drop("extracted_at")


@query("stored_changes", "SELECT file_id, change_type, old_path, new_path, new_hash FROM changes", "changes")
def stored_changes(spark, sf):
    folder = _folder(spark)
    W.append_changes(V.changes(spark, sf), folder)
    return spark.read.schema("file_id long, change_type string, old_path string, new_path string, new_hash string").parquet(folder)


@query("stored_results_json", "SELECT category, count(*) AS n FROM entities GROUP BY category", "entities")
def stored_results_json(spark, sf):
    folder = _folder(spark)
    W.write_results_json(V.entities(spark, sf).groupBy("category").agg(F.count(F.lit(1)).alias("n")), folder)
    return spark.read.schema("category string, n long").json(folder)


@query(
    "chunk_order",
    "SELECT concat('orders/', cast(l_orderkey as string), '.md') AS note_id, l_linenumber AS chunk_index, s_name AS source_label FROM lines", "lines",
)
def chunk_order(spark, sf):
    """Triples of each note in the order of its chunks; an order's lines are its chunks."""
    found = V.lines(spark, sf).select(
        F.expr("concat('orders/', cast(l_orderkey as string), '.md')").alias("note_id"), F.col("l_linenumber").alias("chunk_index"),
        F.lit(0).alias("ord"), F.col("s_name").alias("source_label"),
    )
    return extraction.in_chunk_order(found).drop("ord")
