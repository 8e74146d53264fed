"""Reading triples, entities and edges kept as CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from noteskein.schemas import ENTITIES, TRIPLES, column_names
from noteskein.scale import union_all

_CSV = {"header": True, "multiLine": True, "escape": '"', "enforceSchema": False}

EDGE_FILES = {
    "person_to_person": ("PERSON_TO_PERSON", "source_id", "target_id"),
    "person_to_company": ("PERSON_TO_COMPANY", "person_id", "company_id"),
    "company_to_company": ("COMPANY_TO_COMPANY", "source_id", "target_id"),
}


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """Triples of all per-note files of a folder, as one scan."""
    return spark.read.schema(TRIPLES).options(**_CSV).csv(path)


def read_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Person and company nodes with their category."""
    parts = [
        spark.read.schema(ENTITIES).options(**_CSV).csv(f"{folder}/{category.lower()}.csv")
        .withColumn("category", F.lit(category))
        for category in ("Person", "Company")
    ]
    return union_all(parts)


def read_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of all edge files. The header is checked, as the first two columns are the ends."""
    parts = []
    for name, (edge_type, source, target) in EDGE_FILES.items():
        schema = f"{source} string, {target} string, relationship string"
        rows = spark.read.schema(schema).options(**_CSV).csv(f"{folder}/{name}.csv")
        parts.append(rows.toDF("src", "dst", "relationship").withColumn("edge_type", F.lit(edge_type)))
    return union_all(parts).select("edge_type", "src", "dst", "relationship")


def read_nodes_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Bulk load of one node table."""
    return spark.read.schema(schema).options(**_CSV).csv(path)


def latest_per_hash(files: DataFrame) -> DataFrame:
    """Of files named ``<hash>_<time>.csv``, the newest per hash; by aggregation, so no hash needs a window."""
    name = F.element_at(F.split("path", "/"), -1)
    key = F.regexp_extract(name, r"^(.*)_[^_]*\.csv$", 1)
    return files.groupBy(key.alias("content_hash")).agg(
        F.max_by("path", name).alias("path"), F.max(name).alias("file_name")
    ).where(F.col("content_hash") != "")


def read_flat_cache(spark: SparkSession, folder: str) -> DataFrame:
    """Triples of an old flat folder: its CSV files except those of entities and edges."""
    rows = spark.read.schema(TRIPLES).options(**{**_CSV, "enforceSchema": True}).csv(f"{folder}/*.csv")
    name = F.col("_metadata.file_name")
    return rows.where(~F.startswith(name, F.lit("person")) & ~F.startswith(name, F.lit("company"))).select(*column_names(TRIPLES))
