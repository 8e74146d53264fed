"""Substring dedup by hashing lines: one copy of each repeated line stays, the earliest by document id and place.

Lines are normalised (A-Z in lower case, white space runs as one blank, none at the ends) and hashed where they lie. A
global aggregate finds the earliest place and the number of each digest; combined before the shuffle, a line that
is everywhere is one row per task. Digests found once go no further. Lines below ``min_words`` words stay always.
Removed lines are given by their offsets in the original text (code points, end exclusive, without the line feed);
the kept text is the other lines joined by line feeds.

Defined results: a null or empty text is one empty line, which stays; rows without a ``doc_id`` come last in rank;
rows with equal id and equal text are one document and get the same answer; an empty table gives no rows;
other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from noteskein.llm.common import decode, id_and_text, map_rows, stored, text_bytes, to_batch

MIN_WORDS = 5


def _signed(data: bytes) -> tuple[int, int]:
    return int.from_bytes(data[:8], "little", signed=True), int.from_bytes(data[8:16], "little", signed=True)


def digest(data: bytes) -> tuple[int, int]:
    """128 bits of a hash as two numbers."""
    return _signed(hashlib.blake2b(data, digest_size=16).digest())


def units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Lines of at least ``min_words`` words: id, hash of the text, place, offsets, digest."""
    def make():
        def rows_of(doc_id, data):
            part, at = digest(data)[0], 0
            for unit, line in enumerate(decode(data).split("\n")):
                words = line.encode().lower().split()
                if len(words) >= min_words:
                    yield (doc_id, part, unit, at, at + len(line), *digest(b" ".join(words)))
                at += len(line) + 1
        return rows_of

    return map_rows(id_and_text(docs), make, "doc_id long, part long, unit int, start long, end long, d1 long, d2 long")


def removals(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, part, spans`` of each document that loses lines; spans are (unit, start, end), in order."""
    rows = units(docs, min_words)
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "part", "unit")
    repeated = rows.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # Written, so that the join reads two shuffles and Spark can split a line that is everywhere among tasks.
    met = rows.join(stored(repeated.select("d1", "d2", "first")), ["d1", "d2"]).where(~place.eqNullSafe(F.col("first")))
    return met.groupBy("doc_id", "part").agg(F.array_sort(F.collect_set(F.struct("unit", "start", "end"))).alias("spans"))


def deduplicate(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id``, kept ``text``, ``n_units`` and the removed ``spans`` (start, end) of every row."""
    def with_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [digest(t)[0] for t in text_bytes(batch.column(1))]
            yield batch.append_column("part", pa.array(parts, pa.int64()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("doc_id", pa.int64()), ("text", pa.string()), ("n_units", pa.int64()),
            ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ])
        for batch in batches:
            rows = []
            for doc_id, data, spans in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist()):
                lines = decode(data).split("\n")
                gone = {s["unit"] for s in spans or ()}
                kept = "\n".join(line for k, line in enumerate(lines) if k not in gone)
                rows.append((doc_id, kept, len(lines), [{"start": s["start"], "end": s["end"]} for s in spans or ()]))
            if rows:
                yield to_batch(rows, schema)

    texts = id_and_text(docs).mapInArrow(with_part, "doc_id long, text string, part long")
    gone = removals(docs, min_words).select(F.col("doc_id").alias("_id"), F.col("part").alias("_part"), "spans")
    joined = texts.join(gone, (F.col("part") == F.col("_part")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(
        cut, "doc_id long, text string, n_units long, spans array<struct<start: long, end: long>>"
    )


SQL = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS unit
    FROM documents
), normal AS (
    SELECT *, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm,
           CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY unit) AS BIGINT) AS upto
    FROM lines
), ranked AS (
    SELECT *, norm <> '' AND length(norm) - length(replace(norm, ' ', '')) + 1 >= 5
              AND row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST, unit) > 1 AS gone
    FROM normal
)
SELECT doc_id, count(*) AS n_units, count(*) FILTER (WHERE gone) AS n_removed,
       coalesce(string_agg((upto - length(line) - 1) || ':' || (upto - 1), ',' ORDER BY unit) FILTER (WHERE gone), '') AS spans,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY unit) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM ranked GROUP BY doc_id
"""
