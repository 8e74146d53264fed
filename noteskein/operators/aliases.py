"""Alias declarations in notes, and renaming by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from noteskein.functions.text import last_per_name, py_strip
from noteskein.operators.triples import FACT
from noteskein.scale import lookup

ALIAS_LIST = "array<struct<old_name:string,new_name:string>>"


def parse_alias_lines(lines: Column) -> Column:
    """Ordered ``old -> new`` pairs of declaration lines. ``=>`` separates only where ``->`` is absent."""
    def pair(line: Column) -> Column:
        separator = F.when(F.contains(line, F.lit("->")), F.lit("->")).otherwise(F.lit("=>"))
        at = F.call_function("instr", line, separator)
        unquote = lambda part: F.btrim(py_strip(part), F.lit("\"'"))
        return F.when(
            at > 0,
            F.struct(
                unquote(F.substr(line, F.lit(1), at - 1)).alias("old_name"),
                unquote(F.substr(line, at + 2)).alias("new_name"),
            ),
        )

    pairs = F.array_compact(F.transform(lines, pair))
    return F.filter(pairs, lambda p: (F.length(p["old_name"]) > 0) & (F.length(p["new_name"]) > 0))


def alias_lines(value: Column) -> Column:
    """Declaration lines of a ``resolves`` value given as a variant: list, several lines, or commas."""
    as_list = F.try_variant_get(value, "$", "array<variant>")
    items = F.transform(as_list, lambda v: F.when(F.schema_of_variant(v) == "STRING",
                                                  F.try_variant_get(v, "$", "string")))
    text = F.try_variant_get(value, "$", "string")
    parts = F.when(F.contains(text, F.lit("\n")), F.split(py_strip(text), "\n")).otherwise(F.split(text, ","))
    lines = F.when(as_list.isNotNull(), items).when(F.schema_of_variant(value) == "STRING",
                                                    F.transform(parts, py_strip))
    return F.coalesce(F.array_compact(lines), F.array().cast("array<string>"))


def as_mapping(pairs: Column) -> Column:
    """Each old name once: at its first place, with its last new name."""
    return last_per_name(pairs, "old_name", "new_name")


def apply_in_order(label: Column, pairs: Column) -> Column:
    """Run a label through the pairs in order, so that chains collapse."""
    start = F.coalesce(pairs, F.array().cast(ALIAS_LIST))
    return F.aggregate(
        start, label, lambda now, p: F.when(py_strip(now) == p["old_name"], p["new_name"]).otherwise(now)
    )


def rename_scoped(triples: DataFrame, declared: DataFrame) -> DataFrame:
    """Rename labels by the aliases of the file a triple came from.

    ``declared`` holds ``source_file, aliases`` with one row per file, aliases being the ordered pairs.
    """
    lists = declared.select("source_file", F.col("aliases").alias("_aliases"))
    joined = lookup(triples, lists, F.col("source_file"), "source_file", FACT).withColumns({
        "source_label": apply_in_order(F.col("source_label"), F.col("_aliases")),
        "target_label": apply_in_order(F.col("target_label"), F.col("_aliases")),
    })
    return joined.drop("_aliases")


def explode_declared(declared: DataFrame) -> DataFrame:
    """One row per declaration with its place in the file."""
    rest = [c for c in declared.columns if c != "aliases"]
    return declared.select(*rest, F.posexplode("aliases").alias("ord", "_pair")).select(
        *rest, "ord", "_pair.old_name", "_pair.new_name"
    )


def last_declared(declarations: DataFrame) -> DataFrame:
    """One new name per old name over all files: newest file, then path, then place in the file."""
    order = F.struct("modified", "source_file", "ord")
    return declarations.groupBy("old_name").agg(F.max_by("new_name", order).alias("new_name"))


def validate_aliases(declarations: DataFrame) -> DataFrame:
    """Empty names, and pairs that point at each other within one file.

    A pair of names is put in one order and counted per direction, so no self-join is needed.
    """
    empty = declarations.where((F.length(py_strip(F.col("old_name"))) == 0) |
                               (F.length(py_strip(F.col("new_name"))) == 0))
    empty = empty.select(
        "source_file",
        F.when(F.length(py_strip(F.col("old_name"))) == 0, "empty old name").otherwise("empty new name")
        .alias("problem"),
        "old_name",
        "new_name",
    )
    low, high = F.least("old_name", "new_name"), F.greatest("old_name", "new_name")
    circular = (
        declarations.groupBy("source_file", low.alias("low"), high.alias("high"))
        .agg(F.count_if(F.col("old_name") == low).alias("up"), F.count_if(F.col("old_name") == high).alias("down"))
        .where((F.col("up") > 0) & (F.col("down") > 0))
        .select("source_file", F.lit("circular").alias("problem"),
                F.col("low").alias("old_name"), F.col("high").alias("new_name"))
    )
    return empty.unionByName(circular)
