"""Writing triples, graph tables, exports and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from noteskein.functions.text import inbox_path
from noteskein.operators.tracking import upsert
from noteskein.scale import checkpointed, lookup
from noteskein.sources.tables import EDGE_FILES


#: Rows of one CSV file: a file whose values may span lines is read by one task.
ROWS_PER_FILE = 1 << 20
CSV = {"header": True, "escape": '"', "maxRecordsPerFile": ROWS_PER_FILE}


def append_extraction(triples: DataFrame, notes: DataFrame, root: str, batch_id: int) -> None:
    """Append the triples of a batch and one marker per note, also for notes without any triple.

    Both are append-only logs keyed by note and body hash; ``current_triples`` picks what counts.
    A batch overwrites its own folders, also with no rows, and its markers come last: what has no marker does not count.
    """
    triples.write.mode("overwrite").parquet(f"{root}/triples/batch={batch_id}")
    kept = triples.sparkSession.read.schema(triples.schema).parquet(f"{root}/triples/batch={batch_id}")
    counts = kept.groupBy(F.col("source_file").alias("id")).agg(F.count(F.lit(1)).alias("_n"))
    markers = notes.select("id", "content_hash").join(counts, "id", "left").select("id", "content_hash", F.coalesce("_n", F.lit(0)).alias("n_rels"))
    markers.write.mode("overwrite").parquet(f"{root}/processed/batch={batch_id}")


def current_triples(triples: DataFrame, processed: DataFrame) -> DataFrame:
    """Triples of the latest batch of every note. A batch that is no note's latest is not opened."""
    latest = checkpointed(processed.groupBy("id").agg(F.max("batch").alias("_latest")))
    spread_by = [c for c in triples.columns if c != "source_file"]
    alive = triples.where(F.col("batch").isin([r[0] for r in latest.select("_latest").distinct().collect()]))
    found = lookup(alive, latest, F.col("source_file"), "id", spread_by, how="inner")
    return found.where(F.col("batch") == F.col("_latest")).drop("_latest")


def write_graph(entities: DataFrame, edges: DataFrame, root: str, version: int, **more: DataFrame) -> str:
    """Full rebuild into a new folder, with any further tables by name; readers switch when they find its last success marker."""
    target = f"{root}/version={version}"
    for name, rows in more.items():
        rows.write.mode("overwrite").parquet(f"{target}/{name}")
    entities.write.mode("overwrite").partitionBy("category").parquet(f"{target}/entities")
    edges.write.mode("overwrite").partitionBy("edge_type").parquet(f"{target}/edges")
    return target


def latest_version(spark: SparkSession, root: str) -> str | None:
    """Newest folder whose last table was written completely."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    pattern = hadoop.Path(f"{root}/version=*/edges/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    paths = [str(status.getPath().getParent().getParent().toString()) for status in found or []]
    return max(paths, key=lambda p: int(p.rsplit("=", 1)[1]), default=None)


def write_triples_csv(triples: DataFrame, folder: str) -> None:
    """Stamped triples as one folder of CSV parts. They are as many as the facts of all notes, with names repeated, so they are compressed."""
    triples.write.options(**CSV, compression="gzip").csv(folder)


def write_entities_csv(entities: DataFrame, folder: str) -> None:
    """One folder of CSV parts per category: id, label, metadata. The rows are worked out once."""
    entities = checkpointed(entities)
    for category in ("Person", "Company"):
        rows = entities.where(F.col("category") == category).select("id", "label", "metadata")
        rows.write.mode("overwrite").options(**CSV).csv(f"{folder}/{category.lower()}.csv")


def write_edges_csv(edges: DataFrame, folder: str) -> None:
    """One folder of CSV parts per edge type, in global order. The rows are worked out once."""
    edges = checkpointed(edges)
    for name, (edge_type, source, target) in EDGE_FILES.items():
        rows = edges.where(F.col("edge_type") == edge_type).orderBy("src", "dst", "relationship")
        rows.select(F.col("src").alias(source), F.col("dst").alias(target), "relationship").write.mode("overwrite").options(**CSV).csv(
            f"{folder}/{name}.csv"
        )


def append_changes(changes: DataFrame, path: str) -> None:
    changes.write.mode("append").parquet(path)


def write_results_json(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def upload_notes(notes: DataFrame, inbox: DataFrame, folder: str, now: Column) -> DataFrame:
    """Notes table after uploads ``filename, content``; an existing path is overwritten by its last upload."""
    path = inbox_path(F.col("filename"), folder)
    latest = inbox.groupBy(path.alias("id")).agg(F.max_by("content", F.struct("ts", "content")).alias("content"))
    rows = latest.select(
        "id", F.regexp_extract("id", r"([^/]+?)(\.[^./]+)?$", 1).alias("label"), "content",
        now.alias("modified"), F.octet_length("content").cast("bigint").alias("length"),
    )
    return upsert(notes, rows, ["id"])
