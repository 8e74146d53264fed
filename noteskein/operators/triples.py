"""Triples: clean, orient, rename, and turn into entities and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from noteskein.functions import fixed
from noteskein.functions.text import edge_type
from noteskein.scale import checkpointed, lookup

FACT = ["source_category", "source_label", "relationship", "target_category", "target_label"]


def keep_known_categories(triples: DataFrame) -> DataFrame:
    """Both ends must belong to a known category, in exact case."""
    return triples.where(
        F.col("source_category").isin(fixed.CATEGORIES) & F.col("target_category").isin(fixed.CATEGORIES)
    )


def distinct_facts(triples: DataFrame) -> DataFrame:
    """One row per fact with its number of copies; the copies merge before the shuffle."""
    return triples.groupBy(*FACT).agg(F.count(F.lit(1)).alias("n_copies"))


def inverse_relation(relationship: Column) -> Column:
    pairs = [F.lit(x) for pair in fixed.INVERSE_RELATIONS.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), relationship), relationship)


def orient(triples: DataFrame) -> DataFrame:
    """Turn company-to-person triples around; the relation is inverted where an inverse is known."""
    flip = (F.col("source_category") == "Company") & (F.col("target_category") == "Person")

    def pick(turned: str, kept: str) -> Column:
        return F.when(flip, F.col(turned)).otherwise(F.col(kept))

    rest = [c for c in triples.columns if c not in FACT]
    return triples.select(
        pick("target_category", "source_category").alias("source_category"),
        pick("target_label", "source_label").alias("source_label"),
        F.when(flip, inverse_relation(F.col("relationship"))).otherwise(F.col("relationship")).alias("relationship"),
        pick("source_category", "target_category").alias("target_category"),
        pick("source_label", "target_label").alias("target_label"),
        *rest,
    )


def drop_self_loops(triples: DataFrame) -> DataFrame:
    """Labels alone decide: a person and a company of one name count as the same."""
    return triples.where(F.col("source_label") != F.col("target_label"))


def canonical_ends(triples: DataFrame) -> DataFrame:
    """Order both ends by label where the categories are equal. The relation text is not inverted."""
    same = F.col("source_category") == F.col("target_category")
    low = F.least("source_label", "target_label")
    high = F.greatest("source_label", "target_label")
    flipped = same & (F.col("source_label") > F.col("target_label"))
    return triples.withColumns({
        "source_label": F.when(same, low).otherwise(F.col("source_label")),
        "target_label": F.when(same, high).otherwise(F.col("target_label")),
        "direction_flipped": flipped,
    })


def entities(facts: DataFrame) -> DataFrame:
    """Distinct entities of both ends, self loops included."""
    ends = F.array(
        F.struct(F.col("source_category").alias("category"), F.col("source_label").alias("id")),
        F.struct(F.col("target_category").alias("category"), F.col("target_label").alias("id")),
    )
    return (
        facts.select(F.inline(ends))
        .where(F.col("category").isin(fixed.CATEGORIES))
        .distinct()
        .select("category", "id", F.col("id").alias("label"), F.lit("").alias("metadata"))
    )


def edges(facts: DataFrame) -> DataFrame:
    """Edges of distinct facts in canonical order; self loops are dropped. No shuffle is needed here."""
    return drop_self_loops(facts).select(
        edge_type(F.col("source_category"), F.col("target_category")).alias("edge_type"),
        F.col("source_label").alias("src"),
        F.col("target_label").alias("dst"),
        "relationship",
    )


def rename_global(triples: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rename both labels by a table ``old_name, new_name`` with one row per old name; applied once."""
    renamed = triples
    for label in ("source_label", "target_label"):
        names = aliases.select(F.col("old_name"), F.col("new_name").alias("_new"))
        spread_by = [c for c in FACT if c != label]
        renamed = lookup(renamed, names, label, "old_name", spread_by)
        renamed = renamed.withColumn(label, F.coalesce("_new", label)).drop("_new")
    return renamed


def graph_facts(triples: DataFrame, aliases: DataFrame | None = None, marks: dict[str, Column] | None = None) -> DataFrame:
    """Distinct facts, oriented and in canonical order; entities and edges follow from them.

    Orienting and ordering come before the one shuffle, so copies and mirrored copies merge
    map-side. With aliases the facts are merged first, so that the renaming sees no copies.
    ``marks`` adds flags by name: whether the condition holds for any copy of a fact. So the facts of
    some of the triples need no pass of their own; they take triples without aliases.
    """
    known = keep_known_categories(triples)
    if marks:
        if aliases is not None:
            raise ValueError("marks need triples without aliases")
        marked = canonical_ends(orient(known.select(*FACT, *[test.alias(name) for name, test in marks.items()])))
        return marked.groupBy(*FACT).agg(*[F.bool_or(name).alias(name) for name in marks])
    if aliases is not None:
        known = rename_global(distinct_facts(known).select(*FACT), aliases)
    return canonical_ends(orient(known.select(*FACT))).select(*FACT).distinct()


def build_graph(triples: DataFrame, aliases: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Entities and edges of raw triples; the facts are written once and read for both."""
    facts = checkpointed(graph_facts(triples, aliases))
    return entities(facts), edges(facts)


def triple_quality(triples: DataFrame) -> DataFrame:
    """Rows kept and dropped by the category rule, and self loops among the kept rows."""
    known = F.col("source_category").isin(fixed.CATEGORIES) & F.col("target_category").isin(fixed.CATEGORIES)
    return triples.agg(
        F.count(F.lit(1)).alias("n_triples"),
        F.count_if(known).alias("n_known"),
        F.count_if(~known).alias("n_unknown"),
        F.count_if(known & (F.col("source_label") == F.col("target_label"))).alias("n_self_loops"),
    )


def stamp(triples: DataFrame, source_file: Column, extracted_at: Column | None = None) -> DataFrame:
    """Add where and when a triple was extracted; the time can be given, for repeatable runs."""
    when = extracted_at if extracted_at is not None else F.current_timestamp()
    return triples.withColumns({"source_file": source_file, "extracted_at": when})
