"""Edges between notes, and between entities and notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from noteskein.functions import fixed
from noteskein.functions.text import path_types, slug_id, types_csv, wikilinks
from noteskein.scale import checkpointed, lookup


def note_nodes(notes: DataFrame, rules=None) -> DataFrame:
    """Notes with the entity types their path calls for."""
    return notes.withColumn("entity_types", types_csv(path_types(F.col("id"), rules)))


def note_mentions(notes: DataFrame) -> DataFrame:
    """Distinct ``src, link`` pairs: note id and link target. Copies of a link merge map-side."""
    # The outer form keeps Spark from evaluating the pattern a second time in a filter on the size.
    found = notes.select(F.col("id").alias("src"), F.explode_outer(wikilinks(F.col("content"))).alias("link"))
    return found.where(F.col("link").isNotNull()).distinct()


def labels_to_ids(notes: DataFrame) -> DataFrame:
    """One note id per label: the smallest."""
    return notes.groupBy("label").agg(F.min("id").alias("target_id"))


def link_targets(notes: DataFrame) -> DataFrame:
    """Mentions with the id of the note they resolve to (NULL for a broken link)."""
    return lookup(note_mentions(notes), labels_to_ids(notes), F.col("link"), "label", ["src"])


def note_links(resolved: DataFrame) -> DataFrame:
    """Note-to-note edges, one per pair; the direction is that of the first note in id order."""
    ends = resolved.where(F.col("target_id").isNotNull())
    low, high = F.least("src", "target_id"), F.greatest("src", "target_id")
    return ends.groupBy(low.alias("low"), high.alias("high")).agg(F.min("src").alias("src")).select(
        "src", F.when(F.col("src") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("dst")
    )


def broken_links(resolved: DataFrame) -> DataFrame:
    return resolved.where(F.col("target_id").isNull()).select("src", "link")


def reference_edges(triples: DataFrame, entities: DataFrame, notes: DataFrame) -> DataFrame:
    """Entity-to-note edges of both ends of every triple, with the number of references each stands for.

    Triples may be counted already, as ``n_copies``.
    """
    copies = F.col("n_copies") if "n_copies" in triples.columns else F.lit(1)
    ends = F.array(
        F.struct(F.col("source_category").alias("category"), F.col("source_label").alias("src")),
        F.struct(F.col("target_category").alias("category"), F.col("target_label").alias("src")),
    )
    counted = (
        triples.where(F.length("source_file") > 0)
        .select(F.inline(ends), F.col("source_file").alias("dst"), copies.alias("_n"))
        .where(F.col("category").isin(fixed.CATEGORIES))
        .groupBy("category", "src", "dst")
        .agg(F.sum("_n").alias("n_refs"))
    )
    # Only whether they exist is asked, so the counts meet the keys as they are, without a copy of their own keys.
    keys = entities.select(F.col("category").alias("_category"), F.col("id").alias("_id"))
    known = counted.join(keys, F.col("src").eqNullSafe(F.col("_id")) & (F.col("category") == F.col("_category")), "left_semi")
    known = known.join(notes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return known.select(
        F.concat(F.upper("category"), F.lit("_REFERENCE")).alias("edge_type"), "src", "dst", "n_refs"
    )


def lost_references(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """Number of references per category whose entity is not in the node table."""
    ends = F.array(
        F.struct(F.col("source_category").alias("category"), F.col("source_label").alias("src")),
        F.struct(F.col("target_category").alias("category"), F.col("target_label").alias("src")),
    )
    counted = (
        triples.select(F.inline(ends)).where(F.col("category").isin(fixed.CATEGORIES))
        .groupBy("category", "src").agg(F.count(F.lit(1)).alias("n_refs"))
    )
    keys = entities.select("category", F.col("id").alias("src"))
    return counted.join(keys, ["category", "src"], "left_anti").groupBy("category").agg(
        F.sum("n_refs").alias("n_lost")
    )


def label_links(entities: DataFrame, notes: DataFrame) -> DataFrame:
    """Entity-to-note edges where the labels are equal in lower case; many notes may share one label."""
    names = entities.select("category", F.col("id").alias("src"), F.lower("label").alias("_name"))
    targets = notes.select(F.col("id").alias("dst"), F.lower("label").alias("_label"))
    return lookup(targets, names, F.col("_label"), "_name", ["dst"], how="inner").select(
        F.concat(F.upper("category"), F.lit("_NOTE")).alias("edge_type"), "src", "dst"
    )


def notes_without_entity(note_table: DataFrame, links: DataFrame, category: str) -> DataFrame:
    """Notes whose types call for an entity of a category, and that have no link to one."""
    needs = F.lit(False)
    for word in fixed.TYPES_NEEDING_ENTITY[category]:
        needs = needs | F.contains("entity_types", F.lit(word))
    linked = links.where(F.col("edge_type") == f"{category.upper()}_NOTE").select(F.col("dst").alias("id"))
    return note_table.where(needs).join(linked, "id", "left_anti")


def missing_entities(orphans: DataFrame, category: str) -> tuple[DataFrame, DataFrame]:
    """New entities for such notes, and their links. Notes that share an id share the entity."""
    named = orphans.select(
        slug_id(category.lower(), F.col("label")).alias("entity_id"), F.col("id").alias("note_id"), "label", "entity_types"
    )
    first = F.min_by(F.struct("label", "entity_types"), "note_id")
    created = named.groupBy("entity_id").agg(first.alias("_first")).select(
        F.lit(category).alias("category"),
        F.col("entity_id").alias("id"),
        F.col("_first.label").alias("label"),
        F.lit("").alias("metadata"),
        F.col("_first.entity_types").alias("entity_types"),
    )
    links = named.select(
        F.lit(f"{category.upper()}_NOTE").alias("edge_type"), F.col("entity_id").alias("src"), F.col("note_id").alias("dst")
    )
    return created, links


def propagate_types(entities: DataFrame, links: DataFrame, note_table: DataFrame) -> DataFrame:
    """Give every entity the types of its linked note; with several notes the last id decides."""
    typed = note_table.where(F.col("entity_types").isNotNull() & (F.col("entity_types") != "")).select(
        F.col("id").alias("dst"), F.col("entity_types").alias("_types")
    )
    found = (
        links.join(typed, "dst")
        .groupBy(F.initcap(F.substring_index("edge_type", "_", 1)).alias("category"), F.col("src").alias("id"))
        .agg(F.max_by("_types", "dst").alias("_types"))
    )
    base = entities if "entity_types" in entities.columns else entities.withColumn("entity_types", F.lit(""))
    joined = base.join(found, ["category", "id"], "left")
    return joined.withColumn("entity_types", F.coalesce("_types", "entity_types")).drop("_types")


def post_process(entities: DataFrame, note_table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Link, create what is missing, link that too, and hand the types on, in this order."""
    links = checkpointed(label_links(entities, note_table))
    nodes = entities.withColumn("entity_types", F.lit(""))
    all_links = links
    for category in fixed.CATEGORIES:
        created, new_links = missing_entities(notes_without_entity(note_table, links, category), category)
        existing = entities.where(F.col("category") == category).select("id")
        nodes = nodes.unionByName(created.join(existing, "id", "left_anti").select(nodes.columns))
        all_links = all_links.unionByName(new_links)
    return propagate_types(nodes, all_links, note_table), all_links


def type_coverage(entities: DataFrame) -> DataFrame:
    """Entities that carry types, out of all, per category."""
    return entities.groupBy("category").agg(
        F.count_if(F.col("entity_types").isNotNull() & (F.col("entity_types") != "")).alias("n_typed"),
        F.count(F.lit(1)).alias("n_total"),
    )


def type_breakdown(entities: DataFrame) -> DataFrame:
    """Number of entities per combination of types, most frequent first."""
    typed = entities.where(F.col("entity_types").isNotNull() & (F.col("entity_types") != ""))
    counted = typed.groupBy("category", "entity_types").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "category", "entity_types")
