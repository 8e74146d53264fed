"""Key checks and referential checks before loading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from noteskein.functions.text import is_valid_key, let, py_strip
from noteskein.scale import lookup


def valid_rows(table: DataFrame, *key_columns: str) -> DataFrame:
    """Rows whose key columns all hold a key."""
    kept = table
    for name in key_columns:
        kept = kept.where(is_valid_key(F.col(name)))
    return kept


def invalid_rows(table: DataFrame, *key_columns: str) -> DataFrame:
    valid = F.lit(True)
    for name in key_columns:
        valid = valid & is_valid_key(F.col(name))
    return table.where(~valid)


def key_quality(table: DataFrame, *key_columns: str) -> DataFrame:
    """Total and invalid rows."""
    valid = F.lit(True)
    for name in key_columns:
        valid = valid & is_valid_key(F.col(name))
    return table.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~valid).alias("n_invalid"))


def sample_invalid(table: DataFrame, order: list[str], *key_columns: str, rows: int = 5) -> DataFrame:
    """The first few invalid rows, for a report."""
    return invalid_rows(table, *key_columns).orderBy(*order).limit(rows)


def _spellings(entities: DataFrame) -> DataFrame:
    """One row per lower-case id, with all entities spelt that way. The key is one plain text, as edges are shuffled with a copy of it."""
    return entities.groupBy(F.lower("id").alias("_lower")).agg(F.collect_set(F.struct("category", "id")).alias("_spelt"))


def _resolve(edges: DataFrame, end: str, category: Column, names: DataFrame, spread_by: list[str]) -> DataFrame:
    """Add ``<end>_id``: the entity id equal to the end, else the smallest id equal in lower case."""
    name = py_strip(F.col(end))
    found = lookup(edges, names, F.lower(name), "_lower", spread_by)
    ids = F.transform(F.filter("_spelt", lambda e: e["category"] == category), lambda e: e["id"])
    resolved = let(ids, lambda same: F.coalesce(F.when(F.array_contains(same, name), name), F.array_min(same)))
    return found.withColumn(f"{end}_id", resolved).drop("_spelt")


def resolve_ends(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Add the entity ids both ends resolve to (NULL where there is none)."""
    names = _spellings(entities)
    parts = F.split("edge_type", "_TO_")
    source, target = F.initcap(F.element_at(parts, 1)), F.initcap(F.element_at(parts, 2))
    found = _resolve(edges, "src", source, names, ["edge_type", "dst", "relationship"])
    return _resolve(found, "dst", target, names, ["edge_type", "src", "relationship"])


def valid_edges(resolved: DataFrame) -> DataFrame:
    """Edges whose ends both exist, written with the ids of the entities."""
    return resolved.where(F.col("src_id").isNotNull() & F.col("dst_id").isNotNull()).select(
        "edge_type", F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "relationship"
    )


def edge_quality(resolved: DataFrame) -> DataFrame:
    """Per edge type: rows, removed rows, and how many distinct names are missing at each end.

    All counts come from one pass: an edge is a row, perhaps a removed one, and has up to two missing names; equal ones
    are counted before they are shuffled.
    """
    lost = F.col("src_id").isNull() | F.col("dst_id").isNull()

    def entry(kind: str, test: Column | None = None, name: Column | None = None) -> Column:
        found = F.struct(F.lit(kind).alias("kind"), (F.lit(None).cast("string") if name is None else name).alias("name"))
        return found if test is None else F.when(test, found)

    def missing(end: str) -> Column:
        name = py_strip(F.col(end))
        return entry(end, F.col("edge_type").isNotNull() & F.col(f"{end}_id").isNull() & name.isNotNull(), name)

    entries = F.array(entry("row"), entry("lost", lost), missing("src"), missing("dst"))
    counted = (
        resolved.select("edge_type", F.inline(entries)).where(F.col("kind").isNotNull())
        .groupBy("edge_type", "kind", "name").agg(F.count(F.lit(1)).alias("n"))
    )
    copies = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    return counted.groupBy("edge_type").agg(
        copies("row").alias("n_rows"), copies("lost").alias("n_removed"),
        F.count_if(F.col("kind") == "src").alias("missing_src"), F.count_if(F.col("kind") == "dst").alias("missing_dst"),
    )


def existing_ends(pairs: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges ``src, dst`` whose ends are ids of the two node tables; others are dropped."""
    source_ids, target_ids = (nodes.select(F.col("id").alias("_id")).distinct() for nodes in (sources, targets))
    kept = lookup(pairs, source_ids, F.col("src"), "_id", ["dst"], how="inner")
    return lookup(kept, target_ids, F.col("dst"), "_id", ["src"], how="inner")
