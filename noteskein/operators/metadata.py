"""Metadata of a note from its frontmatter and its metadata sections, and its use for entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from noteskein.functions import fixed
from noteskein.functions.frontmatter import (
    entries_json, json_text, last_per_key, no_entries, read_entries, without_system_keys,
)
from noteskein.functions.text import frontmatter_block, let, py_strip
from noteskein.scale import lookup

# Key and value of one line of a section, tried in this order.
_LINE_FORMS = [
    r"^\*\*(.*?)\*\*:\s*(.*)$",
    r"^-\s*\*\*(.*?)\*\*:\s*(.*)$",
    r"^-\s*(.*?):\s*(.*)$",
    r"^(.*?):\s*(.*)$",
]

# Keys and values anywhere in a section, later forms win.
_PAIR_FORMS = [
    r"\*\*(.*?)\*\*:\s*([^\n]+)",
    r"^[\-\*]\s*\*\*(.*?)\*\*:\s*([^\n]+)$",
    r"^(.*?):\s*([^\n]+)$",
]
_MAX_PAIR_KEY = 50


def _section(heading: str, flags: str) -> str:
    return rf"(?{flags})##\s+{heading}\s*\n(.*?)(?=\n##|\n#|\z)"


def _raw_key(key: Column) -> Column:
    return F.replace(F.lower(py_strip(key)), F.lit(" "), F.lit("_"))


def _entry(key: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), json_text(value).alias("value"))


def _line_entry(line: Column) -> Column:
    key, value = None, None
    for form in _LINE_FORMS:
        pattern = "(?dU)" + form
        hit = line.rlike(pattern)
        k, v = py_strip(F.regexp_extract(line, pattern, 1)), py_strip(F.regexp_extract(line, pattern, 2))
        key = F.when(hit, k) if key is None else key.when(hit, k)
        value = F.when(hit, v) if value is None else value.when(hit, v)
    usable = (F.length(key) > 0) & (F.length(value) > 0) & ~F.startswith(line, F.lit("#"))
    return F.when(usable, _entry(_raw_key(key), value))


def _from_first_mark(content: Column) -> Column:
    """Text from the first ``##`` on; sections cannot start earlier, so the patterns skip the rest."""
    return F.substr(content, F.instr(content, "##"))


def section_entries(content: Column) -> Column:
    """Entries of all metadata sections, read line by line."""
    found = let(_from_first_mark(content), _all_sections)
    return F.when(F.contains(content, F.lit("##")), found).otherwise(no_entries())


def _all_sections(content: Column) -> Column:
    found = no_entries()
    for heading in fixed.SECTION_HEADINGS:
        sections = F.regexp_extract_all(content, F.lit(_section(heading, "isU")), F.lit(1))
        lines = F.flatten(F.transform(sections, lambda s: F.transform(F.split(py_strip(s), "\n"), py_strip)))
        found = F.concat(found, F.array_compact(F.transform(lines, _line_entry)))
    return found


def _section_pairs(section: Column, keep_stray: bool) -> Column:
    found = no_entries()
    for form in _PAIR_FORMS:
        pattern = F.lit("(?dmU)" + form)
        pairs = F.zip_with(
            F.regexp_extract_all(section, pattern, F.lit(1)),
            F.regexp_extract_all(section, pattern, F.lit(2)),
            lambda k, v: F.struct(py_strip(k).alias("k"), py_strip(v).alias("v")),
        )
        usable = F.filter(
            pairs,
            lambda p: (F.length(p["k"]) > 0) & (F.length(p["v"]) > 0) & (F.length(p["k"]) < _MAX_PAIR_KEY)
            & (F.lit(keep_stray) | ~p["k"].rlike(r"^[-*]")),
        )
        found = F.concat(found, F.transform(usable, lambda p: _entry(_raw_key(p["k"]), p["v"])))
    return found


def pair_entries(content: Column, keep_stray: bool = False) -> Column:
    """Entries of the first section per heading (exact case), found by patterns over its whole text.

    The loosest form also fits list items and would add keys such as ``_title`` for ``- Title: x``;
    they are dropped unless ``keep_stray`` is set.
    """
    def of_text(text: Column) -> Column:
        found = no_entries()
        for heading in fixed.PAIR_HEADINGS:
            section = F.regexp_extract(text, _section(heading, "smU"), 1)
            found = F.concat(found, let(section, lambda s: _section_pairs(s, keep_stray)))
        return found

    found = let(_from_first_mark(content), of_text)
    return F.when(F.contains(content, F.lit("##")), found).otherwise(no_entries())


def clean_entries(entries: Column) -> Column:
    """Keys in lower case without punctuation, blanks as underscores; empty values dropped."""
    def clean(entry: Column) -> Column:
        key = F.regexp_replace(py_strip(F.lower(entry["key"])), r"(?U)[^\w\s]", "")
        return F.struct(F.regexp_replace(key, r"(?U)\s+", "_").alias("key"), entry["value"].alias("value"))

    filled = F.filter(entries, lambda e: ~e["value"].rlike(r'(?sU)^"(?:\s|\\[tnrfb])*"$') & (e["value"] != "null"))
    return last_per_key(F.transform(filled, clean))


def merge_entries(frontmatter: Column, sections: Column, pairs: Column, frontmatter_wins: bool = False) -> Column:
    """One list of entries; later sources win: frontmatter, sections, pairs (or the reverse)."""
    parts = [pairs, sections, frontmatter] if frontmatter_wins else [frontmatter, sections, pairs]
    return clean_entries(last_per_key(F.concat(*parts)))


def metadata_parts(notes: DataFrame) -> DataFrame:
    """``id, label`` and the two parts of a text that metadata is read from: the frontmatter block, and all from the first ``##`` on."""
    content = F.col("content")
    marked = F.when(F.contains(content, F.lit("##")), _from_first_mark(content))
    return notes.select("id", "label", frontmatter_block(content).alias("_block"), marked.alias("_marked"))


def note_metadata(notes: DataFrame, frontmatter_wins: bool = False) -> DataFrame:
    """``id, label, entries`` of every note. The three sources are computed once, then merged."""
    return parts_metadata(metadata_parts(notes), frontmatter_wins)


def parts_metadata(parts: DataFrame, frontmatter_wins: bool = False) -> DataFrame:
    """``id, label, entries`` from ``metadata_parts``."""
    sources = parts.select(
        "id",
        "label",
        without_system_keys(read_entries(F.col("_block"))).alias("_front"),
        section_entries(F.col("_marked")).alias("_sections"),
        pair_entries(F.col("_marked")).alias("_pairs"),
    )
    merged = merge_entries(F.col("_front"), F.col("_sections"), F.col("_pairs"), frontmatter_wins)
    return sources.select("id", "label", merged.alias("entries"))


def match_notes(entities: DataFrame, notes: DataFrame) -> DataFrame:
    """The note of an entity: equal label in lower case, smallest id. No note text is moved."""
    first = notes.groupBy(F.lower("label").alias("_name")).agg(F.min("id").alias("note_id"))
    names = entities.select("category", "id", F.lower("label").alias("_name"))
    return names.join(first, "_name").select("category", "id", "note_id")


def _parts_of(notes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Parts of the notes with an ``id`` in ``wanted``, which has each id once.

    Spark would move a semi join below the cutting of texts, and shuffle whole texts; an inner join stays above it.
    """
    return metadata_parts(notes).join(wanted, "id")


def apply_metadata(entities: DataFrame, notes: DataFrame, frontmatter_wins: bool = False) -> DataFrame:
    """Entities with the metadata of their note as JSON, blank where there is none.

    Only notes that match an entity are parsed.
    """
    matches = match_notes(entities, notes)
    wanted = matches.select(F.col("note_id").alias("id")).distinct()
    metadata = parts_metadata(_parts_of(notes, wanted), frontmatter_wins).select(
        F.col("id").alias("note_id"),
        F.when(F.size("entries") > 0, entries_json(F.col("entries"))).alias("_metadata"),
    )
    found = matches.join(metadata, "note_id").select("category", "id", "_metadata")
    joined = entities.drop("metadata").join(found, ["category", "id"], "left")
    return joined.withColumn("metadata", F.coalesce("_metadata", F.lit(""))).drop("_metadata")


def lookup_metadata(notes: DataFrame, requests: DataFrame) -> DataFrame:
    """Value of one key per requested ``id, key``."""
    wanted = requests.select("id").distinct()
    entries = parts_metadata(_parts_of(notes, wanted)).select("id", "entries")
    found = lookup(requests, entries, F.col("id"), "id", ["key"])
    value = F.get(F.filter("entries", lambda e: e["key"] == F.col("key")), F.lit(0))["value"]
    return found.withColumn("value", value).drop("entries")
