"""Asking a model about chunks or notes, through any function from texts to texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from noteskein.functions import fixed
from noteskein.functions.responses import clean_response, read_triples, strip_reasoning
from noteskein.scale import lookup
from noteskein.schemas import RESPONSES

ModelFunction = Callable[[list[str]], list[str]]

#: Texts that are given to the model function at once.
REQUESTS = 256


def with_chunk_key(chunks: DataFrame, prompt: str) -> DataFrame:
    """Key of a request: equal text under an equal prompt is asked once."""
    return chunks.withColumn("chunk_key", F.sha2(F.concat(F.lit(prompt + "\n"), F.col("text")), 256))


def ask_model(
    keyed: DataFrame, ask: ModelFunction, cached: DataFrame | None = None, parallel: int | None = None,
    texts: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Responses ``chunk_key, raw`` for the keys that have none yet.

    Copies of a text are merged map-side before anything is sent. Requests run in parts of Arrow batches, so a
    worker holds few texts as Python values, with at most ``parallel`` of them at a time. With ``texts``, ``keyed`` has no text, but different keys
    that are still to be asked are given to it, and it adds the text: so no text is shuffled to be compared.
    """
    todo = keyed.select("chunk_key", "text").distinct() if texts is None else keyed
    if cached is not None:
        todo = todo.join(cached.select("chunk_key"), "chunk_key", "left_anti")
    if texts is not None:
        todo = texts(todo).select("chunk_key", "text")
    if parallel:
        todo = todo.repartition(parallel, "chunk_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, REQUESTS):
                part = batch.slice(start, REQUESTS)
                raw = pa.array(ask(part.column("text").to_pylist()), pa.string())
                yield pa.RecordBatch.from_arrays([part.column("chunk_key"), raw], ["chunk_key", "raw"])

    return todo.select("chunk_key", "text").mapInArrow(run, RESPONSES)


def cached_responses(
    keyed: DataFrame, ask: ModelFunction, cache_path: str, parallel: int | None = None,
    texts: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Ask for what the cache lacks, append it to the cache, and read everything from there.

    A model may answer differently the second time, so nothing downstream may recompute a call:
    only written responses are used.
    """
    spark = keyed.sparkSession
    stored = f"{RESPONSES}, asked_at timestamp"
    spark.createDataFrame([], stored).write.mode("append").parquet(cache_path)  # the first run has no cache
    cached = spark.read.schema(stored).parquet(cache_path)
    asked = ask_model(keyed, ask, cached, parallel, texts).withColumn("asked_at", F.current_timestamp())
    asked.write.mode("append").parquet(cache_path)
    wanted = keyed.select("chunk_key").distinct()
    kept = spark.read.schema(stored).parquet(cache_path).join(wanted, "chunk_key", "left_semi")
    # A key that two runs asked at once has two answers: the first one counts, the smaller text on a tie.
    return kept.groupBy("chunk_key").agg(F.min_by("raw", F.struct("asked_at", "raw")).alias("raw"))


def triples_from_responses(keyed: DataFrame, responses: DataFrame) -> DataFrame:
    """Triples of every chunk. Each distinct response is parsed once, before it meets its chunks."""
    parsed = responses.select(
        "chunk_key", read_triples(clean_response(strip_reasoning(F.col("raw")))).alias("_triples")
    )
    known = lambda t: t["source_category"].isin(fixed.CATEGORIES) & t["target_category"].isin(fixed.CATEGORIES)
    # Behind a generator the filter on the size reads what was parsed, and does not parse again.
    parsed = parsed.select("chunk_key", F.explode_outer(F.array(F.filter("_triples", known))).alias("_triples")).where(F.size("_triples") > 0)
    places = keyed.select("note_id", "chunk_index", "chunk_key")
    found = lookup(places, parsed, F.col("chunk_key"), "chunk_key", ["note_id", "chunk_index"], how="inner")
    return found.select("note_id", "chunk_index", F.posexplode("_triples").alias("ord", "_t")).select(
        "note_id", "chunk_index", "ord", "_t.*"
    )


def in_chunk_order(triples: DataFrame) -> DataFrame:
    """Triples of each note in the order of its chunks."""
    return triples.orderBy("note_id", "chunk_index", "ord")


def notes_with_results(notes: DataFrame, triples: DataFrame) -> DataFrame:
    """Notes that have extracted triples, found by their path."""
    return notes.join(triples.select(F.col("source_file").alias("id")).distinct(), "id", "left_semi")
