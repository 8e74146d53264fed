"""Frontmatter as an ordered list of ``key, value`` entries, values being JSON texts.

YAML itself is read and written in Arrow batches; only the block goes to Python, never the body.
Everything else works on the entries with built-in array functions.
"""

from __future__ import annotations

import datetime
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from noteskein.functions import fixed
from noteskein.functions.text import body_text, frontmatter_text, last_per_name, let, py_strip

try:
    import yaml

    _LOADER = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    _DUMPER = getattr(yaml, "CSafeDumper", yaml.SafeDumper)
except ImportError:  # pragma: no cover
    yaml = None

ENTRIES = "array<struct<key:string,value:string>>"
_ENTRIES_TYPE = T.ArrayType(
    T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
)


def _plain(value):
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [_plain(v) for v in value]
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    if value is None or isinstance(value, (str, int, float, bool)):
        return value
    return str(value)


def _load(text):
    if text is None or yaml is None:
        return []
    try:
        loaded = yaml.load(text, Loader=_LOADER)
    except (yaml.YAMLError, ValueError):
        return []
    if not isinstance(loaded, dict):
        return []
    return [(str(k), json.dumps(_plain(v), ensure_ascii=False)) for k, v in loaded.items()]


def _dump(entries):
    if entries is None or len(entries) == 0:
        return None
    values = {e["key"]: json.loads(e["value"]) for e in entries}
    return yaml.dump(values, Dumper=_DUMPER, default_flow_style=False, allow_unicode=True)


def _require_yaml():
    if yaml is None:
        raise ImportError("reading and writing frontmatter needs PyYAML")


@F.pandas_udf(_ENTRIES_TYPE)
def _load_batch(texts: pd.Series) -> pd.Series:
    # Many notes share one block (exact copies, templates): parse each distinct block of a batch once.
    parsed = {text: [{"key": k, "value": v} for k, v in _load(text)] for text in texts.unique()}
    return texts.map(lambda text: parsed[text])


@F.pandas_udf(T.StringType())
def _dump_batch(entries: pd.Series) -> pd.Series:
    return entries.map(_dump)


def no_entries() -> Column:
    return F.array().cast(ENTRIES)


def read_entries(block: Column) -> Column:
    """Entries of a YAML block; none when it is missing, broken or not a mapping."""
    _require_yaml()
    return F.coalesce(_load_batch(block), no_entries())


def note_entries(content: Column) -> Column:
    return read_entries(frontmatter_text(content))


def write_note(entries: Column, body: Column) -> Column:
    """Note text from entries and a body; keys come out sorted."""
    _require_yaml()
    clean = py_strip(body)
    tail = F.when(F.length(clean) > 0, F.concat(F.lit("\n\n"), clean)).otherwise(F.lit(""))
    block = F.concat(F.lit("---\n"), _dump_batch(entries), F.lit("---"), tail)
    return F.when(F.size(entries) > 0, block).otherwise(clean)


def rewrite_notes(notes: DataFrame, change) -> DataFrame:
    """Apply ``change(entries) -> entries`` to all notes; each is written once, whatever the number of tags."""
    read = notes.withColumn("_entries", note_entries(F.col("content")))
    # A generator keeps the lambda functions of the change out of the arguments of the YAML writer,
    # where Spark cannot evaluate them.
    changed = read.withColumn("_entries", F.explode(F.array(change(F.col("_entries")))))
    return changed.withColumn("content", write_note(F.col("_entries"), body_text(F.col("content")))).drop("_entries")


def json_text(value: Column) -> Column:
    """JSON text of a plain string."""
    text = F.to_json(F.array(value))
    return F.when(value.isNotNull(), F.substring(text, 2, F.length(text) - 2))


def plain_text(value: Column) -> Column:
    """Text of a JSON value: strings without quotes, everything else as JSON; JSON null is NULL."""
    return F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")


def keys_of(entries: Column) -> Column:
    return F.transform(entries, lambda e: e["key"])


def value_of(entries: Column, key) -> Column:
    """JSON text of one key, or NULL."""
    name = F.lit(key) if isinstance(key, str) else key
    return F.get(F.filter(entries, lambda e: e["key"] == name), F.lit(0))["value"]


def last_per_key(entries: Column) -> Column:
    """Each key once: at its first place, with its last value."""
    return last_per_name(entries, "key", "value")


def set_tags(entries: Column, tags: dict[str, Column], stamped_at: Column | None = None) -> Column:
    """Add or replace tags given as JSON texts; with a time, a ``<tag>_at`` entry goes with each."""
    added = []
    for tag, value in tags.items():
        added.append(F.struct(F.lit(tag).alias("key"), value.alias("value")))
        if stamped_at is not None:
            added.append(F.struct(F.lit(f"{tag}_at").alias("key"), json_text(stamped_at.cast("string")).alias("value")))
    return last_per_key(F.concat(entries, F.array(*added)))


def remove_tags(entries: Column, tags: list[str] | Column) -> Column:
    names = F.array(*[F.lit(t) for t in tags]) if isinstance(tags, list) else tags
    return F.filter(entries, lambda e: ~F.array_contains(names, e["key"]))


def rename_tags(entries: Column, mapping: dict[str, str]) -> Column:
    """Rename tags and their ``_at`` companions; where names meet, the later rename decides."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    ranks = [F.lit(x) for i, old in enumerate(mapping, 1) for x in (old, i)]
    new_name, rank = F.create_map(*pairs), F.create_map(*ranks)

    def moved(entry: Column, names: Column) -> Column:
        key = entry["key"]
        base = F.when(F.endswith(key, F.lit("_at")), F.substring(key, 1, F.length(key) - 3))
        follows = F.array_contains(names, base) & F.try_element_at(new_name, base).isNotNull()
        own = F.try_element_at(new_name, key)
        return F.struct(
            F.coalesce(F.try_element_at(rank, key), F.when(follows, F.try_element_at(rank, base)), F.lit(0)).alias("rank"),
            F.coalesce(own, F.when(follows, F.concat(F.try_element_at(new_name, base), F.lit("_at"))), key).alias("key"),
            entry["value"].alias("value"),
        )

    ordered = F.array_sort(let(entries, lambda es: F.transform(es, lambda e: moved(e, keys_of(es)))))
    return last_per_key(F.transform(ordered, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))))


def n_renamed(entries: Column, mapping: dict[str, str]) -> Column:
    return F.size(F.array_intersect(keys_of(entries), F.array(*[F.lit(k) for k in mapping])))


def without_system_keys(entries: Column) -> Column:
    """Entries that count as metadata: no system keys, no nulls."""
    system = F.array(*[F.lit(k) for k in fixed.SYSTEM_KEYS])
    return F.filter(entries, lambda e: ~F.array_contains(system, e["key"]) & (e["value"] != "null"))


def entries_json(entries: Column) -> Column:
    """One JSON object of all entries."""
    parts = F.transform(entries, lambda e: F.concat(json_text(e["key"]), F.lit(":"), e["value"]))
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))
