"""The full cycle, as one plan from notes to a post-processed graph."""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from noteskein.functions.frontmatter import note_entries, value_of
from noteskein.functions.text import body_hash, body_text, let
from noteskein.operators import aliases, integrity, metadata, notes_graph, places, tracking, triples
from noteskein.operators.chunking import chunk_notes
from noteskein.operators.extraction import ModelFunction, cached_responses, triples_from_responses, with_chunk_key
from noteskein.operators.triples import FACT
from noteskein.plans import incremental
from noteskein.scale import checkpointed, lookup
from noteskein.schemas import TRACKING
from noteskein.sinks import tables


@dataclass
class Graph:
    entities: DataFrame
    edges: DataFrame
    note_links: DataFrame
    references: DataFrame
    entity_links: DataFrame
    notes: DataFrame


def declared_aliases(notes: DataFrame) -> DataFrame:
    """``source_file, modified, aliases`` of notes that declare any."""
    read = notes.where(F.contains("content", F.lit("resolves"))).select(
        F.col("id").alias("source_file"), "modified", note_entries(F.col("content")).alias("_entries")
    )
    value = F.parse_json(value_of(F.col("_entries"), "resolves"))
    pairs = aliases.as_mapping(aliases.parse_alias_lines(let(value, aliases.alias_lines)))
    # Behind a generator the filter on the size reads what was parsed; else the YAML of every note is parsed for the filter, and again.
    declared = read.select("source_file", "modified", F.explode_outer(F.array(pairs)).alias("aliases"))
    return declared.where(F.size("aliases") > 0)


def extract(notes: DataFrame, ask: ModelFunction, prompt: str, cache_path: str, parallel: int | None = None) -> DataFrame:
    """Triples of notes, through the response cache."""
    bodies = notes.select("id", body_text(F.col("content")).alias("body"))
    # Chunks are cut and hashed once; what needs no text reads keys only.
    keyed = checkpointed(with_chunk_key(chunk_notes(bodies), prompt))
    responses = cached_responses(keyed, ask, cache_path, parallel)
    return triples_from_responses(keyed, responses).select(*FACT, F.col("note_id").alias("source_file"))


def renamed_triples(notes: DataFrame, raw_triples: DataFrame, alias_scope: str = "file") -> DataFrame:
    """Triples of known categories with the aliases of their notes applied, and ``n_copies`` of each within a note."""
    declared = declared_aliases(notes)
    # Copies of a fact within a note merge before anything is joined.
    counted = triples.keep_known_categories(raw_triples).groupBy(*FACT, "source_file").agg(F.count(F.lit(1)).alias("n_copies"))
    renamed = aliases.rename_scoped(counted, declared)
    if alias_scope == "global":
        renamed = triples.rename_global(renamed, aliases.last_declared(aliases.explode_declared(declared)))
    return checkpointed(renamed)


def assemble(entities: DataFrame, edges: DataFrame, references: DataFrame, notes: DataFrame) -> Graph:
    """A graph from its entities and edges: metadata, links of notes, and types."""
    with_metadata = checkpointed(metadata.apply_metadata(entities, notes))
    nodes = notes_graph.note_nodes(notes)
    # Links and types ask for names only, several times: they are written once, without the texts.
    typed, links = notes_graph.post_process(with_metadata, checkpointed(nodes.select("id", "label", "entity_types")))
    return Graph(
        entities=typed,
        edges=edges,
        note_links=notes_graph.note_links(notes_graph.link_targets(notes)),
        references=references,
        entity_links=links,
        notes=nodes,
    )


def build(notes: DataFrame, raw_triples: DataFrame, alias_scope: str = "file") -> Graph:
    """Resolve, organise, check, link and post-process. ``alias_scope`` is ``file`` or ``global``."""
    renamed = renamed_triples(notes, raw_triples, alias_scope)
    entities, edges = triples.build_graph(renamed)
    entities = checkpointed(integrity.valid_rows(entities, "id"))
    edges = integrity.valid_edges(integrity.resolve_ends(integrity.valid_rows(edges, "src", "dst"), entities))
    return assemble(entities, edges, notes_graph.reference_edges(renamed, entities, notes), notes)


def run_cycle(
    notes: DataFrame,
    changed_ids: DataFrame,
    ask: ModelFunction,
    prompt: str,
    root: str,
    batch_id: int,
    alias_scope: str = "file",
) -> Graph:
    """One cycle: extract the changed notes, then rebuild the graph from all current triples.

    Triples are the only thing kept; entities and edges are always derived, so a deleted note
    takes its edges along. Running a cycle twice changes nothing.
    """
    spark = notes.sparkSession
    changed = notes.join(changed_ids.select("id").distinct(), "id", "left_semi")
    fresh = extract(changed, ask, prompt, f"{root}/responses").withColumn("extracted_at", F.current_timestamp())
    hashed = changed.select("id", body_hash(F.col("content")).alias("content_hash"))
    tables.append_extraction(fresh, hashed, root, batch_id)
    return rebuild(notes, kept_triples(spark, root), root, batch_id, alias_scope)


STORED_TRIPLES = ", ".join(f"{c} string" for c in (*FACT, "source_file")) + ", extracted_at timestamp, batch int"
MARKERS = "id string, content_hash string, n_rels bigint, batch int"


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log of batch folders; one that was never written is an empty table."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def kept_markers(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """Processed markers with the ``place`` of their note now; of several at one place the one that came there last."""
    markers, moves = stored(spark, f"{root}/processed", MARKERS), stored(spark, f"{root}/moves", MOVES)
    if before is not None:
        markers = markers.where(F.col("batch") < before)
    points = markers.select(F.col("id").alias("path"), "content_hash", "n_rels", "batch")
    # A note is asked again in a later batch at its place, so only the last marker of a path and batch counts.
    points = points.groupBy("path", "batch").agg(F.max("content_hash").alias("content_hash"), F.max("n_rels").alias("n_rels"))
    return places.newest_at_place(places.placed(points, places.moves_over_time(moves)))


def kept_triples(spark: SparkSession, root: str, only: DataFrame | None = None) -> DataFrame:
    """Triples of the marker that counts at every place, with that place as their source; only at places ``id`` if given."""
    rows = stored(spark, f"{root}/triples", STORED_TRIPLES)
    markers = kept_markers(spark, root)
    if only is not None:
        markers = checkpointed(markers.join(only.select(F.col("id").alias("place")), "place", "left_semi"))
        # A batch folder without a marker of these notes is not opened.
        rows = rows.where(F.col("batch").isin([r[0] for r in markers.select("batch").distinct().collect()]))
    at = markers.select(F.struct(F.col("path"), F.col("batch").cast("int").alias("batch")).alias("_marker"), "place")
    spread_by = [c for c in rows.columns if c not in ("source_file", "batch")]
    met = lookup(rows, at, F.struct(F.col("source_file").alias("path"), "batch"), "_marker", spread_by, how="inner")
    return met.withColumn("source_file", F.col("place")).select(*rows.columns)


MOVES = "old_path string, new_path string, ts timestamp, batch int"


def rebuild(notes: DataFrame, triples_now: DataFrame, root: str, batch_id: int, alias_scope: str = "file") -> Graph:
    """Build from all triples of notes that exist, and write every table of the graph."""
    alive = triples_now.join(notes.select(F.col("id").alias("source_file")), "source_file", "left_semi")
    return publish(build(notes, alive.select(*FACT, "source_file"), alias_scope), root, batch_id)


def publish(graph: Graph, root: str, batch_id: int) -> Graph:
    """Write every table of a graph as one version, and read it back."""
    target = tables.write_graph(
        graph.entities, graph.edges, f"{root}/graph", batch_id, notes=graph.notes, note_links=graph.note_links,
        references=graph.references, entity_links=graph.entity_links,
    )
    return read_graph(graph.notes.sparkSession, target, graph)


def grow(notes: DataFrame, replaced: DataFrame, root: str, batch_id: int, texts: DataFrame | None = None) -> Graph:
    """The graph after a batch that replaced some notes (``id``): their facts alone are taken out and put in.

    Where no batch was published before, all notes count as replaced. ``texts`` are some of the notes, with all replaced ones among them.
    """
    spark = notes.sparkSession
    log = f"{root}/facts"
    first = incremental.published(spark, log, batch_id) is None
    wanted = notes.select("id") if first else replaced.select("id").distinct()
    wanted = checkpointed(wanted)
    # The first time that is all notes, whose texts need not be shuffled to meet their own ids.
    here = notes.where(F.col("id").isNotNull()) if first else (notes if texts is None else texts).join(wanted, "id", "left_semi")
    said = renamed_triples(here, kept_triples(spark, root, here).select(*FACT, "source_file"))
    incremental.apply_batch(spark, log, batch_id, wanted.select(F.col("id").alias("source_file")), said)
    return publish(assemble(
        checkpointed(incremental.entities_at(spark, log, batch_id)), incremental.edges_at(spark, log, batch_id),
        incremental.references_at(spark, log, batch_id), notes,
    ), root, batch_id)


def read_graph(spark: SparkSession, target: str, like: Graph) -> Graph:
    """The graph as it was written to a version folder."""
    return Graph(**{
        f.name: spark.read.schema((table := getattr(like, f.name)).schema).parquet(f"{target}/{f.name}").select(*table.columns)
        for f in fields(Graph)
    })


def full_cycle(
    notes: DataFrame,
    ask: ModelFunction,
    prompt: str,
    root: str,
    batch_id: int,
    moves: DataFrame | None = None,
    alias_scope: str = "file",
    now: Column | None = None,
) -> Graph:
    """Detect, evict, extract, resolve, organise, read metadata, build - with the tracking state kept in ``root``.

    ``notes`` holds ``id, label, content, length, modified``. The state of each batch is a version of its own,
    so a cycle that is repeated starts from the same state. ``moves`` (``old_path, new_path, ts``) are applied first: a
    moved note keeps its triples and is not read again. Only new, changed and unmarked notes are asked about. Entities, edges and
    references follow from the facts of touched notes (``incremental``); the first cycle of a store builds them all.
    """
    spark, now = notes.sparkSession, F.current_timestamp() if now is None else now
    # Notes may come from files or joins: they are read once, and what needs no text reads the other columns.
    notes = checkpointed(notes)
    state = stored(spark, f"{root}/state", TRACKING + ", version int").where(F.col("version") < batch_id)
    last = state.agg(F.max("version")).first()[0]
    state = state.where(F.col("version") == F.lit(last)).drop("version")
    if moves is not None:
        moves.select("old_path", "new_path", "ts").write.mode("overwrite").parquet(f"{root}/moves/batch={batch_id}")
        state = tracking.apply_moves(state, places.net_moves(moves), now)
        state = state.where((F.col("status") != "deleted") | F.col("path").isNotNull())
    listing = notes.select(F.col("id").alias("path"), "length", "modified")
    compared = tracking.compare_listing(listing, state)
    markers = checkpointed(kept_markers(spark, root, batch_id).select(F.col("place").alias("id")))
    missing = tracking.unprocessed(notes.select("id"), markers)
    moved = [] if moves is None else [moves.select(F.col(c).alias("id")) for c in ("old_path", "new_path")]
    if last is None:
        # Without a state every note is new, and its text need not be shuffled to meet its own id.
        texts = notes.where(F.col("id").isNotNull())
        hash_of = lambda _: texts.select(F.col("id").alias("path"), body_hash(F.col("content")).alias("new_hash"))
    else:
        # All texts meet the ids of this batch once; what asks for some of them later reads these.
        asked = [tracking.paths_to_hash(compared).select(F.col("path").alias("id")), missing.select("id"), *moved]
        # Written, the ids have a size that Spark knows, and texts stay put while it is small.
        asked = checkpointed(reduce(DataFrame.unionByName, asked).distinct())
        texts = checkpointed(notes.join(asked, "id", "left_semi"))
        hash_of = tracking.hash_notes(texts)
    tracking.decide_changes(compared, hash_of).write.mode("overwrite").parquet(f"{root}/detected/batch={batch_id}")
    detected = spark.read.parquet(f"{root}/detected/batch={batch_id}")
    tracking.change_log(detected, now).write.mode("overwrite").parquet(f"{root}/changes/batch={batch_id}")

    tracking.orphaned(markers, notes).write.mode("overwrite").parquet(f"{root}/evicted/batch={batch_id}")
    todo = tracking.to_process(detected, missing)
    todo = checkpointed(todo)
    if last is None:
        changed = texts.select("id", "content")
    else:
        changed = checkpointed(texts.join(todo.select(F.col("path").alias("id")), "id", "left_semi").select("id", "content"))
    fresh = extract(changed, ask, prompt, f"{root}/responses").withColumn("extracted_at", now)
    hashed = changed.select("id", body_hash(F.col("content")).alias("content_hash"))
    tables.append_extraction(fresh, hashed, root, batch_id)

    done = spark.read.schema(MARKERS).parquet(f"{root}/processed").where(F.col("batch") == batch_id)
    after = tracking.mark_processed(tracking.apply_changes(state, detected, now), done, now)
    after = tracking.purge_deleted(after, now)
    after.write.mode("overwrite").parquet(f"{root}/state/version={batch_id}")
    if alias_scope == "global":
        # An alias of one note renames in all others.
        return rebuild(notes, kept_triples(spark, root), root, batch_id, alias_scope)
    touched = [detected.where(F.col("change_type") != "unchanged").select(F.col("path").alias("id")), todo.select(F.col("path").alias("id"))]
    touched.append(spark.read.schema("id string").parquet(f"{root}/evicted/batch={batch_id}"))
    return grow(notes, reduce(DataFrame.unionByName, touched + moved), root, batch_id, texts)
