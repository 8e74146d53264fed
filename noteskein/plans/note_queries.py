"""Registered queries over notes: links, types, frontmatter, metadata, chunks, extraction."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from noteskein.functions import frontmatter as FM, text as X
from noteskein.operators import aliases, chunking, extraction, metadata, notes_graph as N
from noteskein.plans import stand_ins, views as V
from noteskein.plans import incremental
from noteskein.plans.build import MARKERS, build, declared_aliases, full_cycle
from noteskein.plans.registry import query
from noteskein.scale import unnest
from noteskein.schemas import TRACKING
from noteskein.session import ensure_checkpoint_dir
from noteskein.sinks.tables import upload_notes
from noteskein.sources import notes as S

_SQL_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


# Links


@query("note_links", "SELECT min(src) AS src, CASE WHEN min(src) = least(src, target_id) THEN greatest(src, target_id) ELSE least(src, target_id) END AS dst "
       "FROM targets WHERE target_id IS NOT NULL GROUP BY least(src, target_id), greatest(src, target_id)", "targets")
def note_links(spark, sf):
    return N.note_links(N.link_targets(V.notes(spark, sf)))


@query("broken_links", "SELECT src, link FROM targets WHERE target_id IS NULL", "targets")
def broken_links(spark, sf):
    return N.broken_links(N.link_targets(V.notes(spark, sf)))


def _pages(spark, sf):
    """Web pages as notes: local links become note links, the label is the last word of the title."""
    return V.table(spark, sf, "pages").select(
        F.col("url").alias("id"), F.regexp_extract("html", "<title>([A-Za-z]*)", 1).alias("label"),
        F.regexp_replace("html", '<a href="/([^"]*)">', "[[$1]]").alias("content"),
    )


@query(
    "page_links",
    r"SELECT m.src, m.link, t.target_id FROM (SELECT DISTINCT url AS src, trim(x) AS link FROM (SELECT url, unnest(regexp_extract_all(regexp_replace(html, '<a href=" '"' r"/([^" '"' r"]*)" '"' r">', '[[\1]]', 'g'), '\[\[([^|\]]+)(?:\|[^\]]+)?\]\]', 1)) AS x FROM pages)) m "
    "LEFT JOIN (SELECT regexp_extract(html, '<title>([A-Za-z]*)', 1) AS label, min(url) AS target_id FROM pages GROUP BY label) t ON m.link = t.label",
)
def page_links(spark, sf):
    return N.link_targets(_pages(spark, sf))


@query(
    "reference_edges",
    "SELECT concat(upper(category), '_REFERENCE') AS edge_type, src, dst, count(*) AS n_refs FROM ("
    "SELECT source_category AS category, source_label AS src, source_file AS dst FROM triples UNION ALL SELECT target_category, target_label, source_file FROM triples) r "
    "JOIN note_entities e ON e.category = r.category AND e.id = r.src JOIN orders ON dst = concat('orders/', cast(o_orderkey as string), '.md') WHERE o_orderstatus <> 'P' GROUP BY ALL".replace("upper(category)", "upper(r.category)"),
    "triples", "note_entities",
)
def reference_edges(spark, sf):
    orders = V.orders_as_notes(spark, sf).where(F.col("o_orderstatus") != "P")
    return N.reference_edges(V.triples(spark, sf), V.note_entities(spark, sf), orders)


@query(
    "lost_references",
    "SELECT r.category, CAST(count(*) AS BIGINT) AS n_lost FROM (SELECT source_category AS category, source_label AS src FROM triples UNION ALL SELECT target_category, target_label FROM triples) r "
    "LEFT JOIN note_entities e ON e.category = r.category AND e.id = r.src WHERE e.id IS NULL AND r.category IN ('Person', 'Company') GROUP BY ALL",
    "triples", "note_entities",
)
def lost_references(spark, sf):
    return N.lost_references(V.triples(spark, sf), V.note_entities(spark, sf))


# Entities and notes

_ORPHANS = (
    "SELECT '{c}' AS category, n.* FROM note_nodes n WHERE ({t}) AND id NOT IN (SELECT dst FROM links WHERE edge_type = '{u}_NOTE')"
)
_MISSING = {
    "orphans": _ORPHANS.format(c="Person", u="PERSON", t="contains(entity_types, 'Person')")
    + " UNION ALL "
    + _ORPHANS.format(c="Company", u="COMPANY", t="contains(entity_types, 'Company') OR contains(entity_types, 'Family Office') OR contains(entity_types, 'VC')"),
    "named": "SELECT *, concat(lower(category), '_', replace(replace(replace(lower(label), ' ', '_'), '.', ''), ',', '')) AS entity_id FROM orphans",
    "created": "SELECT category, entity_id AS id, arg_min(label, id) AS label, arg_min(entity_types, id) AS entity_types FROM named GROUP BY category, entity_id",
    "all_links": "SELECT * FROM links UNION ALL SELECT concat(upper(category), '_NOTE'), entity_id, id FROM named",
    "all_entities": "SELECT category, id, id AS label, '' AS entity_types FROM note_entities UNION ALL SELECT * FROM created",
    "typed": "SELECT e.category, e.id, label, coalesce(t.types, e.entity_types) AS entity_types FROM all_entities e LEFT JOIN ("
    "SELECT edge_type, src, arg_max(entity_types, n.id) AS types FROM all_links JOIN note_nodes n ON dst = n.id WHERE entity_types <> '' GROUP BY ALL) t "
    "ON t.src = e.id AND t.edge_type = concat(upper(e.category), '_NOTE')",
}


@query("label_links", "SELECT * FROM links", "links")
def label_links(spark, sf):
    return N.label_links(V.note_entities(spark, sf), V.notes(spark, sf))


def _created(spark, sf):
    nodes = N.note_nodes(V.notes(spark, sf))
    links = N.label_links(V.note_entities(spark, sf), nodes)
    parts = [N.missing_entities(N.notes_without_entity(nodes, links, c), c)[0] for c in ("Person", "Company")]
    return parts[0].unionByName(parts[1])


@query("missing_entities", "SELECT category, id, label, entity_types FROM created", "links", "note_nodes", extra=_MISSING)
def missing_entities(spark, sf):
    return _created(spark, sf).drop("metadata")


def _post(spark, sf):
    return N.post_process(V.note_entities(spark, sf), N.note_nodes(V.notes(spark, sf)))


@query("propagate_types", "SELECT category, id, label, entity_types FROM typed", "links", "note_nodes", extra=_MISSING)
def propagate_types(spark, sf):
    return _post(spark, sf)[0].drop("metadata")


@query("entity_note_links", "SELECT * FROM all_links", "links", "note_nodes", extra=_MISSING)
def entity_note_links(spark, sf):
    return _post(spark, sf)[1]


@query("type_coverage", "SELECT category, count(*) FILTER (entity_types <> '') AS n_typed, count(*) AS n_total FROM typed GROUP BY category", "links", "note_nodes", extra=_MISSING)
def type_coverage(spark, sf):
    return N.type_coverage(_post(spark, sf)[0])


@query("type_breakdown", "SELECT category, entity_types, count(*) AS n FROM typed WHERE entity_types <> '' GROUP BY ALL", "links", "note_nodes", extra=_MISSING)
def type_breakdown(spark, sf):
    return N.type_breakdown(_post(spark, sf)[0])


@query("path_types", "SELECT id, entity_types FROM note_nodes", "note_nodes")
def path_types(spark, sf):
    return N.note_nodes(V.notes(spark, sf)).select("id", "entity_types")


# Paths and hashes


@query("body_hash", f"SELECT id, sha256(trim(body, {_SQL_BLANKS})) AS body_hash FROM notes", "notes")
def body_hash(spark, sf):
    return V.notes(spark, sf).select("id", X.body_hash(F.col("content")).alias("body_hash"))


@query("file_hash", "SELECT id, sha256(content) AS file_hash FROM notes", "notes")
def file_hash(spark, sf):
    return V.notes(spark, sf).select("id", X.file_hash(F.col("content")).alias("file_hash"))


@query(
    "safe_names",
    r"SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(id, '\.md$', ''), '[^A-Za-z0-9_.-]', '_', 'g'), '_+', '_', 'g'), '_') AS safe_name, label, replace(id, 'People/', '') AS below FROM notes",
    "notes",
)
def safe_names(spark, sf):
    return V.notes(spark, sf).select(
        "id", X.safe_name(F.col("id")).alias("safe_name"), X.file_stem(F.col("id")).alias("label"),
        X.relative_path(F.col("id"), "People").alias("below"),
    )


@query(
    "visible_notes",
    "SELECT path FROM files WHERE NOT (path LIKE '.%' OR path LIKE '%/.%') AND NOT path LIKE 'Templates/%'",
    extra={"files": "SELECT concat(CASE lang WHEN 'en' THEN 'People/' WHEN 'fr' THEN 'Templates/' WHEN 'de' THEN '.trash/' ELSE 'Journal/.hidden/' END, cast(doc_id as string), '.md') AS path FROM documents"},
)
def visible_notes(spark, sf):
    listing = V.table(spark, sf, "documents").select(
        F.expr("concat(CASE lang WHEN 'en' THEN 'People/' WHEN 'fr' THEN 'Templates/' WHEN 'de' THEN '.trash/' ELSE 'Journal/.hidden/' END, cast(doc_id as string), '.md')").alias("path")
    )
    return S.visible_notes(listing, "Templates")


@query(
    "folders",
    "SELECT DISTINCT folder FROM (SELECT concat(split_part(id, '/', 1), '/') AS folder FROM notes UNION ALL SELECT concat(split_part(id, '/', 1), '/', split_part(id, '/', 2), '/') FROM notes)",
    "notes",
)
def folders(spark, sf):
    return S.folders(V.notes(spark, sf))


@query("vault_info", "SELECT count(*) AS note_count FROM documents")
def vault_info(spark, sf):
    return S.vault_info(V.notes(spark, sf))


@query("folder_scan", "SELECT id FROM notes WHERE starts_with(id, 'Companies/')", "notes")
def folder_scan(spark, sf):
    return S.notes_in_folder(V.notes(spark, sf), "Companies").select("id")


@query(
    "upload_notes",
    f"SELECT id, label, sha256(content) AS hash FROM (SELECT id, label, content FROM notes WHERE id NOT IN (SELECT concat('Journal/', source, '/', label, '.md') FROM notes WHERE lang = 'es') "
    "UNION ALL SELECT concat('Journal/', source, '/', label, '.md'), label, body FROM notes WHERE lang IN ('es', 'fr'))",
    "notes",
)
def upload_notes_query(spark, sf):
    notes = V.notes(spark, sf).withColumns({"modified": F.timestamp_seconds(F.lit(0)), "length": F.octet_length("content").cast("bigint")}).drop("doc_id")
    inbox = V.documents(spark, sf).where(F.col("lang").isin("es", "fr")).select(
        F.expr(f"concat(source, '/', {V.STEM})").alias("filename"), F.expr(V.NOTE_BODY).alias("content"), F.lit(1).alias("ts")
    )
    return upload_notes(notes, inbox, "Journal", F.timestamp_seconds(F.lit(1))).select("id", "label", F.sha2("content", 256).alias("hash"))


# Frontmatter and metadata

_FRONT = (
    "SELECT id, 'title' AS key, label AS value FROM notes UNION ALL SELECT id, 'lang', lang FROM notes UNION ALL SELECT id, 'source', source FROM notes "
    "UNION ALL SELECT id, 'quality_tag', cast(quality as string) FROM notes WHERE quality IS NOT NULL UNION ALL SELECT id, 'risk_tag', 'true' FROM notes WHERE toxic = 1 "
    "UNION ALL SELECT id, 'risk_tag_at', 'checked' FROM notes WHERE toxic = 1"
)
_MERGED = (
    "SELECT * FROM front UNION ALL SELECT id, 'size', cast(n_chars as string) FROM notes UNION ALL SELECT id, 'language', lang FROM notes "
    "UNION ALL SELECT id, 'group_name', source FROM notes UNION ALL SELECT id, 'kind', 'note' FROM notes"
)


@query("frontmatter_keys", "SELECT * FROM front", "notes", extra={"front": _FRONT})
def frontmatter_keys(spark, sf):
    entries = unnest(V.notes(spark, sf), ["id"], FM.without_system_keys(FM.note_entries(F.col("content"))), "key")
    return entries.select("id", "key", FM.plain_text(F.col("value")).alias("value"))


@query("frontmatter_value", "SELECT id, source AS value FROM notes", "notes")
def frontmatter_value(spark, sf):
    found = V.notes(spark, sf).select("id", FM.value_of(FM.note_entries(F.col("content")), "source").alias("value"))
    return found.select("id", FM.plain_text(F.col("value")).alias("value"))


@query(
    "section_metadata",
    "SELECT id, key, value FROM (SELECT id, 'size' AS key, cast(n_chars as string) AS value FROM notes UNION ALL SELECT id, 'language', lang FROM notes "
    "UNION ALL SELECT id, 'group_name', source FROM notes UNION ALL SELECT id, 'kind', 'note' FROM notes)",
    "notes",
)
def section_metadata(spark, sf):
    entries = unnest(V.notes(spark, sf), ["id"], metadata.section_entries(F.col("content")), "key")
    return entries.select("id", "key", FM.plain_text(F.col("value")).alias("value"))


@query(
    "pair_metadata",
    "SELECT id, key, value FROM (SELECT id, 'size' AS key, cast(n_chars as string) AS value FROM notes UNION ALL SELECT id, 'language', lang FROM notes UNION ALL SELECT id, 'group_name', source FROM notes)",
    "notes",
)
def pair_metadata(spark, sf):
    entries = unnest(V.notes(spark, sf), ["id"], FM.last_per_key(metadata.pair_entries(F.col("content"))), "key")
    cleaned = entries.select("id", F.regexp_replace("key", r"\*", "").alias("key"), FM.plain_text(F.col("value")).alias("value"))
    return cleaned.distinct()


@query("metadata_merge", "SELECT * FROM merged", "notes", extra={"front": _FRONT, "merged": _MERGED})
def metadata_merge(spark, sf):
    entries = unnest(metadata.note_metadata(V.notes(spark, sf)), ["id"], F.col("entries"), "key")
    return entries.select("id", "key", FM.plain_text(F.col("value")).alias("value"))


@query(
    "metadata_match",
    "SELECT category, e.id, min(n.id) AS note_id FROM note_entities e JOIN notes n ON lower(e.id) = lower(n.label) GROUP BY ALL",
    "note_entities", "notes",
)
def metadata_match(spark, sf):
    return metadata.match_notes(V.note_entities(spark, sf), V.notes(spark, sf))


@query(
    "metadata_apply",
    "SELECT category, e.id, n_chars AS size, n.lang AS language, n.label AS title FROM note_entities e LEFT JOIN notes n ON lower(e.id) = lower(n.label)",
    "note_entities", "notes",
)
def metadata_apply(spark, sf):
    applied = metadata.apply_metadata(V.note_entities(spark, sf), V.notes(spark, sf))
    get = lambda k: F.get_json_object("metadata", f"$.{k}")
    return applied.select("category", "id", get("size").cast("bigint").alias("size"), get("language").alias("language"), get("title").alias("title"))


@query(
    "metadata_lookup",
    "SELECT id, 'language' AS key, lang AS value FROM notes UNION ALL SELECT id, 'absent', NULL FROM notes",
    "notes",
)
def metadata_lookup(spark, sf):
    notes = V.notes(spark, sf)
    requests = notes.select("id", F.explode(F.array(F.lit("language"), F.lit("absent"))).alias("key"))
    found = metadata.lookup_metadata(notes, requests)
    return found.select("id", "key", FM.plain_text(F.col("value")).alias("value"))


_RENAMES = {"quality_tag": "_quality", "risk_tag": "_risk"}


def _entries(spark, sf, change):
    notes = V.notes(spark, sf).select("id", FM.note_entries(F.col("content")).alias("entries"))
    changed = unnest(notes, ["id"], FM.without_system_keys(change(F.col("entries"))), "key")
    return changed.select("id", "key", FM.plain_text(F.col("value")).alias("value"))


@query(
    "tag_set",
    "SELECT id, key, CASE WHEN key = 'quality_tag' THEN '9' ELSE value END AS value FROM front WHERE key <> 'quality_tag' UNION ALL SELECT id, 'quality_tag', '9' FROM notes UNION ALL SELECT id, 'note', label FROM notes",
    "notes", extra={"front": _FRONT},
)
def tag_set(spark, sf):
    notes = V.notes(spark, sf).select("id", "label", FM.note_entries(F.col("content")).alias("entries"))
    tagged = FM.set_tags(F.col("entries"), {"quality_tag": F.lit("9"), "note": FM.json_text(F.col("label"))})
    changed = unnest(notes, ["id"], FM.without_system_keys(tagged), "key")
    return changed.select("id", "key", FM.plain_text(F.col("value")).alias("value"))


@query("tag_remove", "SELECT * FROM front WHERE key NOT IN ('quality_tag', 'lang')", "notes", extra={"front": _FRONT})
def tag_remove(spark, sf):
    return _entries(spark, sf, lambda e: FM.remove_tags(e, ["quality_tag", "lang"]))


@query(
    "tag_rename",
    "SELECT id, CASE key WHEN 'quality_tag' THEN '_quality' WHEN 'risk_tag' THEN '_risk' WHEN 'risk_tag_at' THEN '_risk_at' ELSE key END AS key, value FROM front",
    "notes", extra={"front": _FRONT},
)
def tag_rename(spark, sf):
    return _entries(spark, sf, lambda e: FM.rename_tags(e, _RENAMES))


@query(
    "tag_rename_stats",
    "SELECT count(*) AS total, count(*) FILTER (quality IS NOT NULL OR toxic = 1) AS migrated, "
    "CAST(count(*) FILTER (quality IS NOT NULL) + count(*) FILTER (toxic = 1) AS BIGINT) AS tags_migrated FROM notes",
    "notes",
)
def tag_rename_stats(spark, sf):
    n = V.notes(spark, sf).select(FM.n_renamed(FM.note_entries(F.col("content")), _RENAMES).alias("n"))
    return n.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("n") > 0).alias("migrated"), F.sum("n").cast("bigint").alias("tags_migrated"))


@query(
    "note_rewrite",
    f"SELECT id, sha256(concat('---', chr(10), 'checked: true', chr(10), 'kind: ', lang, chr(10), '---', chr(10), chr(10), trim(body, {_SQL_BLANKS}))) AS hash FROM notes",
    "notes",
)
def note_rewrite(spark, sf):
    """Two tags replace all others, and the note is written once."""
    def change(entries):
        lang = FM.value_of(entries, "lang")
        return FM.set_tags(FM.no_entries(), {"kind": lang, "checked": F.lit("true")})

    return FM.rewrite_notes(V.notes(spark, sf), change).select("id", F.sha2("content", 256).alias("hash"))


@query(
    "alias_parse",
    "SELECT id AS source_file, 0 AS ord, concat('Supplier#', lpad(cast(doc_id as string), 9, '0')) AS old_name, concat('Supplier#', lpad(cast(doc_id as string), 9, '0'), ' Holdings') AS new_name FROM notes "
    "UNION ALL SELECT id, 1, source, concat('The ', source) FROM notes",
    "notes",
)
def alias_parse(spark, sf):
    notes = V.notes(spark, sf).withColumn("modified", F.lit(0))
    return aliases.explode_declared(declared_aliases(notes)).drop("modified")


# Chunks and extraction


@query(
    "chunk_coverage",
    "SELECT doc_id, length(text) AS n_chars, true AS whole, true AS bounded FROM documents WHERE length(text) > 0",
)
def chunk_coverage(spark, sf):
    """Chunks of every document: joined they are the text again, and none is above the bound."""
    pieces = chunking.chunk_texts(F.col("text"), 256)
    docs = V.table(spark, sf, "documents").select("doc_id", "text", pieces.alias("chunks"))
    return docs.where(F.length("text") > 0).select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), (F.array_join("chunks", "") == F.col("text")).alias("whole"),
        F.forall("chunks", lambda c: F.length(c) <= 1024).alias("bounded"),
    )


def _sentences(spark, sf):
    """Vectors as sentences; the vectors of a label are one note, in id order, 64 tokens each."""
    rows = V.table(spark, sf, "embeddings").select(
        F.concat(F.lit("label-"), F.col("label").cast("string")).alias("note_id"), "vec_id", "embedding", F.lit(64).alias("token_count")
    )
    return chunking.dense_positions(rows, "note_id", "vec_id")


_COSINE = "list_sum([e[i]::DOUBLE * p[i]::DOUBLE FOR i IN range(1, 65)]) / (sqrt(list_sum([e[i]::DOUBLE * e[i]::DOUBLE FOR i IN range(1, 65)])) * sqrt(list_sum([p[i]::DOUBLE * p[i]::DOUBLE FOR i IN range(1, 65)])))"
_CHUNKS = {
    "sent": "SELECT concat('label-', cast(label as string)) AS note_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos, embedding AS e, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings",
    "opened": f"SELECT note_id, pos, CASE WHEN p IS NULL OR {_COSINE} < 0.5 THEN 1 ELSE 0 END AS opens FROM sent",
    "seg": "SELECT *, sum(opens) OVER (PARTITION BY note_id ORDER BY pos) AS segment FROM opened",
    "parts": "SELECT *, floor((row_number() OVER (PARTITION BY note_id, segment ORDER BY pos) - 1) * 64 / 256) AS part FROM seg",
    "numbered": "SELECT note_id, pos, dense_rank() OVER (PARTITION BY note_id ORDER BY segment, part) - 1 AS chunk_index FROM parts",
}


@query("semantic_chunks", "SELECT note_id, CAST(chunk_index AS BIGINT) AS chunk_index, count(*) AS n_sentences, min(pos) AS first_pos, CAST(count(*) * 64 AS BIGINT) AS token_count FROM numbered GROUP BY note_id, chunk_index", extra=_CHUNKS)
def semantic_chunks(spark, sf):
    return chunking.semantic_chunks(_sentences(spark, sf), threshold=0.5, max_tokens=256)


_GREEDY = {
    **_CHUNKS, "opened": _CHUNKS["opened"].replace("< 0.5", "< 0"),
    "rows_of": "SELECT s.note_id, s.pos, s.opens, 16 + (v.vec_id * 37) % 160 AS tokens FROM seg s JOIN "
    "(SELECT concat('label-', cast(label as string)) AS note_id, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS pos FROM embeddings) v USING (note_id, pos)",
    "walked": "SELECT note_id, pos, tokens, tokens AS held, 0 AS chunk FROM rows_of WHERE pos = 0 "
    "UNION ALL SELECT r.note_id, r.pos, r.tokens, CASE WHEN r.opens = 1 OR w.held + r.tokens > 256 THEN r.tokens ELSE w.held + r.tokens END, "
    "CASE WHEN r.opens = 1 OR w.held + r.tokens > 256 THEN w.chunk + 1 ELSE w.chunk END FROM walked w JOIN rows_of r ON r.note_id = w.note_id AND r.pos = w.pos + 1",
}


@query(
    "semantic_chunks_greedy",
    "SELECT note_id, CAST(chunk AS BIGINT) AS chunk_index, count(*) AS n_sentences, min(pos) AS first_pos, CAST(sum(tokens) AS BIGINT) AS token_count FROM walked GROUP BY note_id, chunk",
    extra=_GREEDY, recursive=True,
)
def semantic_chunks_greedy(spark, sf):
    """Sentences of different lengths, so that a chunk is full at another place than a multiple of the bound."""
    vectors = V.table(spark, sf, "embeddings")
    rows = vectors.select(
        F.concat(F.lit("label-"), F.col("label").cast("string")).alias("note_id"), "vec_id", "embedding", (16 + (F.col("vec_id") * 37) % 160).alias("token_count")
    )
    return chunking.semantic_chunks(chunking.dense_positions(rows, "note_id", "vec_id"), threshold=0.0, max_tokens=256)


@query(
    "extracted_triples",
    "SELECT id AS note_id, 'Person' AS source_category, concat('customer#', lpad(cast(doc_id as string), 9, '0')) AS source_label, 'works_at' AS relationship, 'Company' AS target_category, concat('Supplier#', lpad(cast(n_chars as string), 9, '0')) AS target_label FROM notes",
    "notes",
)
def extracted_triples(spark, sf):
    notes = V.notes(spark, sf).select("id", X.body_text(F.col("content")).alias("body"))
    keyed = extraction.with_chunk_key(chunking.chunk_notes(notes), "Extract relationships.")
    responses = extraction.ask_model(keyed, stand_ins.rule_based_model)
    return extraction.triples_from_responses(keyed, responses).drop("chunk_index", "ord")


# The whole build: triples of the notes, scoped aliases, checks, links, references

_BUILT = {
    "found": "SELECT id AS source_file, concat('customer#', lpad(cast(doc_id as string), 9, '0')) AS person, concat('Supplier#', lpad(cast(n_chars as string), 9, '0'), "
    "CASE WHEN n_chars = doc_id THEN ' Holdings' ELSE '' END) AS company FROM notes",
}


def _built(spark, sf):
    notes = V.notes(spark, sf).withColumn("modified", F.timestamp_seconds(F.lit(0)))
    bodies = notes.select("id", X.body_text(F.col("content")).alias("body"))
    keyed = extraction.with_chunk_key(chunking.chunk_notes(bodies), "Extract relationships.")
    found = extraction.triples_from_responses(keyed, extraction.ask_model(keyed, stand_ins.rule_based_model))
    return build(notes, found.withColumn("source_file", F.col("note_id")).drop("note_id", "chunk_index", "ord"))


@query("built_edges", "SELECT DISTINCT 'PERSON_TO_COMPANY' AS edge_type, person AS src, company AS dst, 'works_at' AS relationship FROM found", "notes", extra=_BUILT)
def built_edges(spark, sf):
    return _built(spark, sf).edges


@query(
    "built_references",
    "SELECT 'PERSON_REFERENCE' AS edge_type, person AS src, source_file AS dst, count(*) AS n_refs FROM found GROUP BY ALL UNION ALL SELECT 'COMPANY_REFERENCE', company, source_file, count(*) FROM found GROUP BY ALL",
    "notes", extra=_BUILT,
)
def built_references(spark, sf):
    return _built(spark, sf).references


# One whole cycle over the notes, and what it wrote

_CYCLES: dict[tuple[str, str], str] = {}


def _cycle(spark, sf):
    """Folder of the tables that a first cycle wrote; it runs once per session and table folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _CYCLES:
        root = f"{ensure_checkpoint_dir(spark)}/cycle-{uuid.uuid4()}"
        notes = V.notes(spark, sf).select(
            "id", "label", "content", F.octet_length("content").cast("long").alias("length"), F.timestamp_seconds(F.lit(0)).alias("modified")
        )
        full_cycle(notes, stand_ins.rule_based_model, "Extract relationships.", root, 1, now=F.timestamp_seconds(F.lit(500)))
        _CYCLES[key] = root
    return _CYCLES[key]


@query("cycle_edges", "SELECT DISTINCT 'PERSON_TO_COMPANY' AS edge_type, person AS src, company AS dst, 'works_at' AS relationship FROM found", "notes", extra=_BUILT)
def cycle_edges(spark, sf):
    return spark.read.schema("edge_type string, src string, dst string, relationship string").parquet(f"{_cycle(spark, sf)}/graph/version=1/edges")


@query(
    "cycle_references",
    "SELECT 'PERSON_REFERENCE' AS edge_type, person AS src, source_file AS dst, count(*) AS n_refs FROM found GROUP BY ALL UNION ALL SELECT 'COMPANY_REFERENCE', company, source_file, count(*) FROM found GROUP BY ALL",
    "notes", extra=_BUILT,
)
def cycle_references(spark, sf):
    return spark.read.schema("edge_type string, src string, dst string, n_refs long").parquet(f"{_cycle(spark, sf)}/graph/version=1/references")


@query("cycle_note_links", "SELECT min(src) AS src, CASE WHEN min(src) = least(src, target_id) THEN greatest(src, target_id) ELSE least(src, target_id) END AS dst "
       "FROM targets WHERE target_id IS NOT NULL GROUP BY least(src, target_id), greatest(src, target_id)", "targets")
def cycle_note_links(spark, sf):
    return spark.read.schema("src string, dst string").parquet(f"{_cycle(spark, sf)}/graph/version=1/note_links")


@query(
    "cycle_entity_links", "SELECT * FROM all_links", "note_nodes",
    extra={
        **_BUILT,
        "links": "SELECT 'PERSON_NOTE' AS edge_type, e.id AS src, n.id AS dst FROM (SELECT DISTINCT person AS id FROM found) e JOIN notes n ON lower(e.id) = lower(n.label) "
        "UNION ALL SELECT 'COMPANY_NOTE', e.id, n.id FROM (SELECT DISTINCT company AS id FROM found) e JOIN notes n ON lower(e.id) = lower(n.label)",
        **_MISSING,
    },
)
def cycle_entity_links(spark, sf):
    return spark.read.schema("edge_type string, src string, dst string").parquet(f"{_cycle(spark, sf)}/graph/version=1/entity_links")


@query("cycle_notes", "SELECT id, label, entity_types FROM note_nodes", "note_nodes")
def cycle_notes(spark, sf):
    return spark.read.schema("id string, label string, entity_types string").parquet(f"{_cycle(spark, sf)}/graph/version=1/notes")


@query(
    "cycle_state",
    f"SELECT id AS path, 'active' AS status, sha256(trim(body, {_SQL_BLANKS})) AS content_hash, 500 AS processed_at, true AS has_relationships FROM notes",
    "notes",
)
def cycle_state(spark, sf):
    state = spark.read.schema(TRACKING).parquet(f"{_cycle(spark, sf)}/state/version=1")
    return state.select("path", "status", "content_hash", F.unix_seconds("processed_at").cast("int").alias("processed_at"), "has_relationships")


@query("cycle_markers", "SELECT id, 1 AS n_rels, 1 AS batch FROM notes", "notes")
def cycle_markers(spark, sf):
    found = spark.read.schema(MARKERS).parquet(f"{_cycle(spark, sf)}/processed")
    return found.select("id", F.col("n_rels").cast("int").alias("n_rels"), "batch")


# A second cycle: notes came, changed, moved and went; the graph follows from what they say alone

_TWO = "CASE WHEN quality IS NULL AND doc_id % 7 = 3 THEN concat('Archive/', id) ELSE id END"
_AFTER = {
    "here": f"SELECT *, {_TWO} AS now_id FROM notes WHERE NOT coalesce(quality = 1 AND toxic = 1, false)",
    "found": "SELECT now_id AS source_file, concat('customer#', lpad(cast(doc_id as string), 9, '0')) AS person, concat('Supplier#', lpad(cast(n_chars as string), 9, '0'), "
    "CASE WHEN n_chars = doc_id THEN ' Holdings' ELSE '' END) AS company FROM here",
}


def _two_cycles(spark, sf):
    """Folder of a store after two cycles; they run once per session and table folder, and again if it was cleared."""
    key = (spark.sparkContext.applicationId, sf, "two")
    if key not in _CYCLES or incremental.published(spark, f"{_CYCLES[key]}/facts") != 2:
        root = f"{ensure_checkpoint_dir(spark)}/cycle-{uuid.uuid4()}"
        docs = V.notes(spark, sf).join(V.table(spark, sf, "labels"), "doc_id", "left")
        kind = F.struct("quality", "toxic")
        is_kind = lambda q, t: F.coalesce(kind == F.struct(F.lit(q).alias("quality"), F.lit(t).alias("toxic")), F.lit(False))
        edited, gone, fresh = is_kind(1, 0), is_kind(1, 1), is_kind(0, 1)
        old = F.when(edited, F.replace("content", F.lit("works at [[Supplier#"), F.lit("works at [[Older#"))).otherwise(F.col("content"))
        away = F.col("quality").isNull() & (F.col("doc_id") % 7 == 3)
        new_id = F.when(away, F.concat(F.lit("Archive/"), "id")).otherwise(F.col("id"))

        def listed(rows, name, content, at):
            made = rows.select(name.alias("id"), "label", content.alias("content"), at.alias("modified"))
            return made.withColumn("length", F.octet_length("content").cast("long"))

        second = lambda n: F.timestamp_seconds(F.lit(n))
        before = listed(docs.where(~fresh), F.col("id"), old, second(0))
        after = listed(docs.where(~gone), new_id, F.col("content"), F.when(edited | fresh, second(700)).otherwise(second(0)))
        moves = docs.where(away).select(F.col("id").alias("old_path"), new_id.alias("new_path"), second(600).alias("ts"))
        full_cycle(before, stand_ins.rule_based_model, "Extract relationships.", root, 1, now=second(500))
        full_cycle(after, stand_ins.rule_based_model, "Extract relationships.", root, 2, moves=moves, now=second(800))
        _CYCLES[key] = root
    return _CYCLES[key]


@query("delta_edges", "SELECT DISTINCT 'PERSON_TO_COMPANY' AS edge_type, person AS src, company AS dst, 'works_at' AS relationship FROM found", "notes", extra=_AFTER)
def delta_edges(spark, sf):
    return incremental.edges_at(spark, f"{_two_cycles(spark, sf)}/facts", 2)


@query("delta_entities", "SELECT DISTINCT 'Person' AS category, person AS id FROM found UNION SELECT 'Company', company FROM found", "notes", extra=_AFTER)
def delta_entities(spark, sf):
    return incremental.entities_at(spark, f"{_two_cycles(spark, sf)}/facts", 2).select("category", "id")


@query(
    "delta_references",
    "SELECT 'PERSON_REFERENCE' AS edge_type, person AS src, source_file AS dst, count(*) AS n_refs FROM found GROUP BY ALL UNION ALL SELECT 'COMPANY_REFERENCE', company, source_file, count(*) FROM found GROUP BY ALL",
    "notes", extra=_AFTER,
)
def delta_references(spark, sf):
    return incremental.references_at(spark, f"{_two_cycles(spark, sf)}/facts", 2)


@query(
    "delta_changes",
    "SELECT edge_type, src, dst, relationship, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'PERSON_TO_COMPANY' AS edge_type, 'works_at' AS relationship, concat('customer#', lpad(cast(doc_id as string), 9, '0')) AS src, "
    "unnest(CASE WHEN quality = 1 AND toxic = 0 THEN [concat('Older#', lpad(cast(n_chars as string), 9, '0')), company] ELSE [company] END) AS dst, "
    "unnest(CASE WHEN quality = 1 AND toxic = 0 THEN [-1, 1] WHEN quality = 1 THEN [-1] ELSE [1] END) AS n "
    "FROM (SELECT *, concat('Supplier#', lpad(cast(n_chars as string), 9, '0'), CASE WHEN n_chars = doc_id THEN ' Holdings' ELSE '' END) AS company FROM notes) "
    "WHERE (quality = 1 AND toxic IN (0, 1)) OR (quality = 0 AND toxic = 1)) GROUP BY ALL",
    "notes",
)
def delta_changes(spark, sf):
    """What the second cycle wrote of the edges: those that came, and those that went."""
    log = spark.read.schema(incremental.TABLES["edges"] + ", bucket int").parquet(f"{_two_cycles(spark, sf)}/facts/changes/edges/batch=2")
    return log.drop("bucket")


@query("cycle_after_moves", f"SELECT {_TWO} AS path, CASE WHEN quality = 1 AND toxic = 1 THEN 'deleted' ELSE 'active' END AS status, CASE WHEN (quality = 1 AND toxic = 0) OR (quality = 0 AND toxic = 1) THEN 800 ELSE 500 END AS processed_at FROM notes", "notes")
def cycle_after_moves(spark, sf):
    """The tracked files after the second cycle: moved notes are not read again."""
    state = spark.read.schema(TRACKING).parquet(f"{_two_cycles(spark, sf)}/state/version=2")
    return state.select("path", "status", F.unix_seconds("processed_at").cast("int").alias("processed_at"))


@query("notes_with_results", "SELECT concat('orders/', cast(o_orderkey as string), '.md') AS id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lines WHERE l_linestatus = 'F')", "lines")
def notes_with_results(spark, sf):
    return extraction.notes_with_results(V.orders_as_notes(spark, sf), V.triples(spark, sf).where(F.col("l_linestatus") == "F")).select("id")
