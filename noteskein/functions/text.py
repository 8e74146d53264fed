"""Text and path expressions, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from noteskein.functions import fixed

# Blank characters inside one line, and around text, as a Java character class body.
_LINE_BLANK = r"[\s\x1c-\x1f&&[^\n]]*"

# A frontmatter block: an opening line that starts with three dashes, up to the next line that
# holds three dashes only. Group 1 is the block with its leading newline. The match ends with the
# closing line, so that a long body is never scanned.
_FRONTMATTER = rf"(?sU)\A---[^\n]*((?:\n.*?)??)\n{_LINE_BLANK}---{_LINE_BLANK}(?:\n|\z)"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it occurs in the result."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def py_strip(text: Column) -> Column:
    """Remove every kind of blank at both ends (``trim`` alone removes spaces only)."""
    return F.btrim(text, F.lit(fixed.WHITESPACE))


def is_blank(text: Column) -> Column:
    return F.length(py_strip(text)) == 0


def is_valid_key(value: Column) -> Column:
    """True for a key that is present and is not one of the texts that mean "no value"."""
    return value.isNotNull() & ~F.lower(py_strip(value)).isin(fixed.INVALID_KEYS)


def file_stem(path: Column) -> Column:
    """File name without its last extension; a leading dot is part of the name."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]+)?$", 1)


def relative_path(path: Column, root: str) -> Column:
    """Path below ``root``; a path outside of it stays as it is."""
    prefix = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(prefix)), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)


def safe_name(path: Column) -> Column:
    """File-system-safe name of a note path; two paths may share one."""
    name = F.regexp_replace(path, r"\.md\z", "")
    name = F.regexp_replace(name, r"(?U)[^\w\-.]", "_")
    return F.btrim(F.regexp_replace(name, r"_+", "_"), F.lit("_"))


def is_hidden(path: Column) -> Column:
    """True when any part of a relative path starts with a dot."""
    return F.startswith(path, F.lit(".")) | F.contains(path, F.lit("/."))


def in_folder(path: Column, folder: str) -> Column:
    return F.startswith(path, F.lit(folder.rstrip("/") + "/"))


def is_note_path(path: Column) -> Column:
    """Markdown file outside hidden folders, with the extension in any letter case."""
    return F.endswith(F.lower(path), F.lit(".md")) & ~is_hidden(path)


def inbox_path(file_name: Column, folder: str) -> Column:
    """Path of an uploaded note: the given folder, with the extension added when it is missing."""
    named = F.when(F.endswith(file_name, F.lit(".md")), file_name).otherwise(F.concat(file_name, F.lit(".md")))
    return F.concat(F.lit(folder.rstrip("/") + "/"), named)


def has_frontmatter(text: Column) -> Column:
    return F.startswith(text, F.lit("---")) & text.rlike(_FRONTMATTER)


def frontmatter_text(text: Column) -> Column:
    """Lines between the opening and the closing line; NULL when there is no closed block."""
    block = F.substring(F.regexp_extract(text, _FRONTMATTER, 1), 2, 1 << 30)
    return F.when(has_frontmatter(text), block)


def body_text(text: Column) -> Column:
    """Text after the block, or the whole text when there is no closed block."""
    return F.when(F.startswith(text, F.lit("---")), F.regexp_replace(text, _FRONTMATTER, "")).otherwise(text)


def tracked_body(text: Column) -> Column:
    """Body as it is hashed: stripped, but an unclosed block keeps the text untouched."""
    opened = F.startswith(text, F.lit("---"))
    return F.when(opened & ~text.rlike(_FRONTMATTER), text).otherwise(py_strip(body_text(text)))


def body_hash(text: Column) -> Column:
    return F.sha2(tracked_body(text), 256)


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def frontmatter_block(text: Column) -> Column:
    """Looser split: from the opening dashes to the next three dashes anywhere; NULL when open."""
    tail = F.substring(text, 4, 1 << 30)
    closed = F.startswith(text, F.lit("---")) & F.contains(tail, F.lit("---"))
    return F.when(closed, py_strip(F.substring_index(tail, "---", 1)))


def slug_id(prefix: str, label: Column) -> Column:
    """Id of an entity that is created from a note label."""
    slug = F.translate(F.lower(label), " .,", "_")
    return F.concat(F.lit(prefix + "_"), slug)


def path_types(path: Column, rules: list[tuple[str, list[str]]] | None = None) -> Column:
    """Entity types from keywords in a path, in rule order, each type once."""
    lowered = F.lower(path)
    hits = []
    for entity_type, keywords in rules if rules is not None else fixed.PATH_TYPE_RULES:
        if not entity_type or not keywords:
            continue
        hit = F.lit(False)
        for keyword in keywords:
            hit = hit | F.contains(lowered, F.lit(keyword.lower()))
        hits.append(F.when(hit, F.lit(entity_type)))
    if not hits:
        return F.array().cast("array<string>")
    return F.array_distinct(F.array_compact(F.array(*hits)))


def types_csv(types: Column) -> Column:
    return F.array_join(types, ",")


def wikilinks(text: Column) -> Column:
    """Targets of all links in a text, in order."""
    found = F.regexp_extract_all(text, F.lit(fixed.WIKILINK), F.lit(1))
    return F.transform(found, py_strip)


def edge_type(source_category: Column, target_category: Column) -> Column:
    """Edge type of a category pair; an unknown pair stops the job."""
    routed = None
    for (source, target), name in fixed.EDGE_TYPES.items():
        test = (source_category == source) & (target_category == target)
        routed = F.when(test, name) if routed is None else routed.when(test, name)
    message = F.concat(F.lit("unknown pair of categories: "), F.coalesce(source_category, F.lit("NULL")),
                       F.lit(" -> "), F.coalesce(target_category, F.lit("NULL")))
    return routed.otherwise(F.raise_error(message).cast("string"))


def from_julian(day: Column) -> Column:
    """Timestamp of a Julian day number."""
    return F.timestamp_millis(F.round((day - F.lit(2440587.5)) * 86400000).cast("bigint"))


def to_julian(ts: Column) -> Column:
    return F.unix_millis(ts) / F.lit(86400000.0) + F.lit(2440587.5)


def last_per_name(items: Column, key: str, value: str) -> Column:
    """Each ``key`` of an array of structs once: at its first place, with its last ``value``.

    The items are sorted by key and place once, and only neighbours are compared, so long arrays stay cheap.
    """
    def merged(ordered: Column) -> Column:
        def differs(item: Column, at: Column) -> Column:
            return (at < 0) | (at >= F.size(ordered)) | ~F.get(ordered, at)[key].eqNullSafe(item[key])

        firsts = F.filter(ordered, lambda x, i: differs(x, i - 1))
        lasts = F.filter(ordered, lambda x, i: differs(x, i + 1))
        both = F.zip_with(firsts, lasts, lambda a, b: F.struct(a["_place"].alias("_place"), b[key].alias(key), b[value].alias(value)))
        return F.transform(F.array_sort(both), lambda x: F.struct(x[key].alias(key), x[value].alias(value)))

    placed = F.transform(items, lambda x, i: F.struct(x[key].alias(key), i.alias("_place"), x[value].alias(value)))
    return let(F.array_sort(placed), merged)
