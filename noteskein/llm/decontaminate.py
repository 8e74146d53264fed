"""Benchmark decontamination by greedy string tiling.

Seeds are windows of five words. A bitmap of fixed size holds the hashes of all benchmark seeds; documents look their windows up in
it where they lie and send on only those that may occur in the benchmark. Joined to the benchmark on the seed, they give
the pairs of document and item that share text. Each pair is tiled: Karp-Rabin hashes find the longest common
runs of unmarked words, the longest are marked first without overlap, and the search is repeated with ever shorter runs
down to the seed. The tiles cover an item's words in whatever order its passages stand in the document, so
a reordered copy counts like a straight one. A pair whose coverage reaches the threshold is a leak.

Words are compared in lower case (A-Z) without the ASCII punctuation around them. Defined results: a null or
empty text has no words and no leak; an item with fewer words than a seed is looked for as a whole; an item without
words or with a null text is never found; a null ``doc_id`` or ``item_id`` stays null; rows with equal id
and equal text are one document, others with that id are further ones; empty tables give no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from noteskein.llm.common import id_and_text, text_bytes, text_key, to_batch, written

SEED_WORDS = 5
COVERAGE = 0.6

#: Bits of the bitmap of benchmark seeds: its size does not depend on the tables.
BITMAP_BITS = 26
_EDGES = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_MIX = np.uint64(0x9E3779B97F4A7C15)

#: Words a task keeps the hash of; beyond it the cache starts anew. It has no part in any result.
CACHE = 1_000_000


class Words:
    """64-bit hashes of the words of texts, with the hashes of frequent words kept."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        known = self.known
        if len(known) > CACHE:
            known.clear()
        for word in set(words).difference(known):
            bare = word.strip(_EDGES)
            known[word] = xxhash.xxh64_intdigest(bare) | 1 if bare else 0
        found = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        return found[found != 0]


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of ``width`` word hashes."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = (total ^ words[k : k + n]) * _MIX
        total ^= total >> np.uint64(29)
    return total


def _tables(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Words of each item, and its seeds: (item, item_id, words), (seed, item, at, width).

    ``item`` is a hash of id and text, because different texts may have one id or none.
    """
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Words()
        for batch in batches:
            found = [hashes(t).view(np.int64) for t in text_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], ["item", "item_id", "words"])

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                width = min(SEED_WORDS, len(own))
                found = windows(np.array(own, np.int64).view(np.uint64), width) if width else []
                rows += [(int(s), item, at, width) for at, s in enumerate(np.asarray(found, np.uint64).view(np.int64))]
            schema = pa.schema([("seed", pa.int64()), ("item", pa.int64()), ("at", pa.int32()), ("width", pa.int32())])
            yield to_batch(rows, schema)

    texts = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text")
    own = written(texts.mapInArrow(words, "item long, item_id long, words array<long>").where("size(words) > 0"))
    return own, written(own.select("item", "words").mapInArrow(seeds, "seed long, item long, at int, width int"))


def _bitmap(seeds: DataFrame) -> tuple[np.ndarray, list[int]]:
    """Bits that some seed sets, as bytes, and the widths in use (five words, and those of shorter items)."""
    slots = seeds.select(F.shiftrightunsigned("seed", 64 - BITMAP_BITS).alias("slot"))
    words = slots.selectExpr("slot div 64 AS w", "shiftleft(1L, CAST(slot % 64 AS INT)) AS b")
    bits = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    for row in words.groupBy("w").agg(F.bit_or("b").alias("b")).collect():
        bits[row["w"]] = row["b"]
    return bits.view(np.uint8), [r["width"] for r in seeds.select("width").distinct().collect()]


def _hits(docs: DataFrame, bits: np.ndarray, widths: list[int]) -> DataFrame:
    """Windows of documents that may be benchmark seeds: (doc_id, part, at, seed); ``part`` is a hash of the text, which tells rows of one id apart."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    rows = id_and_text(docs).select("doc_id", text_key().alias("part"), "text")
    shift = np.uint64(64 - BITMAP_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bitmap = Words(), shared.value
        for batch in batches:
            ids, parts, ats, found = [], [], [], []
            for doc, part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2))):
                words = hashes(text)
                for width in widths:
                    seeds = windows(words, width)
                    slot = (seeds >> shift).astype(np.int64)
                    at = np.flatnonzero(bitmap[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                    if len(at):
                        ids += [doc] * len(at)
                        parts += [part] * len(at)
                        ats.append(at)
                        found.append(seeds[at].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(parts, pa.int64()), *[pa.array(np.concatenate(c) if c else [], pa.int64()) for c in (ats, found)]],
                ["doc_id", "part", "at", "seed"],
            )

    return rows.mapInArrow(run, "doc_id long, part long, at long, seed long")


_BASE = np.uint64(0x100000001B3)


def _rolling(words: np.ndarray) -> np.ndarray:
    """Karp-Rabin hashes of all prefixes, modulo 2^64."""
    found = np.zeros(len(words) + 1, np.uint64)
    total = 0
    for k, word in enumerate(words.astype(np.uint64).tolist()):
        total = (total * int(_BASE) + word) & 0xFFFFFFFFFFFFFFFF
        found[k + 1] = total
    return found


def _open(free: np.ndarray, length: int) -> np.ndarray:
    """Starts of windows of ``length`` unmarked words."""
    if len(free) < length:
        return np.empty(0, np.int64)
    taken = np.concatenate([[0], np.cumsum(~free)])
    return np.flatnonzero(taken[length:] == taken[:-length])


def tiles(document: np.ndarray, item: np.ndarray, least: int = SEED_WORDS) -> list[tuple[int, int, int]]:
    """Greedy tiling of two word sequences: (place in document, place in item, length).

    Word 0 matches nothing. Each round hashes all unmarked windows of the current length on both sides, extends equal ones
    to maximal runs, and marks the longest first where they do not meet marked words. A run of more than twice the
    length restarts the round at that length; a round that had to leave out a run that met a tile is repeated; else
    the length is halved down to ``least``.
    """
    free_d, free_i = document != 0, item != 0
    hashes_d, hashes_i = _rolling(document), _rolling(item)
    made: list[tuple[int, int, int]] = []
    length = max(least, min(len(document), len(item)))
    while True:
        power = np.uint64(pow(int(_BASE), length, 2**64))
        at_d, at_i = _open(free_d, length), _open(free_i, length)
        of_d = (hashes_d[at_d + length] - hashes_d[at_d] * power).tolist()
        of_i = (hashes_i[at_i + length] - hashes_i[at_i] * power).tolist()
        places: dict[int, list[int]] = {}
        for h, at in zip(of_i, at_i.tolist()):
            places.setdefault(h, []).append(at)
        runs = []
        for h, d in zip(of_d, at_d.tolist()):
            for i in places.get(h, ()):
                if d and i and free_d[d - 1] and free_i[i - 1] and document[d - 1] == item[i - 1]:
                    continue  # this run begins further left
                n = 0
                while d + n < len(document) and i + n < len(item) and free_d[d + n] and free_i[i + n] and document[d + n] == item[i + n]:
                    n += 1
                if n >= length:
                    runs.append((-n, d, i))
        runs.sort()
        if runs and -runs[0][0] > 2 * length:
            length = -runs[0][0]
            continue
        left_out = False
        for n, d, i in runs:
            if free_d[d : d - n].all() and free_i[i : i - n].all():
                free_d[d : d - n] = False
                free_i[i : i - n] = False
                made.append((d, i, -n))
            else:
                left_out = True
        if left_out:
            continue
        if length == least:
            return made
        length = max(least, length // 2)


def leaks(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, n_words, covered, coverage, n_tiles, starts) of each document that holds an item.

    ``starts`` are the places of the tiles, counted in words of the document.
    """
    return leaking(docs, items, coverage).drop("part")


def leaking(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``leaks`` with ``part``, the hash of the document's text."""
    words, seeds = _tables(items)
    bits, widths = _bitmap(seeds)
    hits = _hits(docs, bits, widths).join(seeds.withColumnRenamed("at", "item_at"), "seed")
    found = hits.groupBy("doc_id", "item", "part", "at").agg(F.min("item_at").alias("item_at"), F.max("width").alias("width"))
    pairs = found.groupBy("doc_id", "item", "part").agg(F.collect_list(F.struct("at", "item_at", "width")).alias("seeds"))
    pairs = pairs.join(words, "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_words", pa.int64()), ("covered", pa.int64()),
            ("coverage", pa.float64()), ("n_tiles", pa.int64()), ("starts", pa.list_(pa.int64())), ("part", pa.int64()),
        ])
        for batch in batches:
            rows = []
            for doc, item, part, seeds, own in zip(*[batch.column(k).to_pylist() for k in range(5)]):
                item_words = np.array(own, np.int64)
                text, places = shared_text(seeds, item_words)
                made = tiles(text, item_words, min(SEED_WORDS, len(own)))
                covered = sum(n for _, _, n in made)
                if covered >= coverage * len(own):
                    rows.append((doc, item, len(own), covered, covered / len(own), len(made), sorted(places[d] for d, _, _ in made), part))
            if rows:
                yield to_batch(rows, schema)

    return pairs.select("doc_id", "item_id", "part", "seeds", "words").mapInArrow(
        run, "doc_id long, item_id long, n_words long, covered long, coverage double, n_tiles long, starts array<long>, part long"
    )


def shared_text(seeds: list[dict], item: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The words of a document that its seeds with one item cover, in order, and their places.

    A seed's words are known from the item. Between stretches stands word 0.
    """
    text: list[int] = []
    places: list[int] = []
    last = None
    for seed in sorted(seeds, key=lambda s: (s["at"], -s["width"])):
        at = seed["at"]
        if last is not None and at <= last:
            known = last - at
        else:
            if last is not None:
                text.append(0)
                places.append(-1)
            known = 0
        for k in range(known, seed["width"]):
            text.append(int(item[seed["item_at"] + k]))
            places.append(at + k)
        if seed["width"] > known:
            last = at + seed["width"]
    return np.array(text, np.int64), places


def remove_leaks(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item, with all columns."""
    found = written(leaking(docs, items, coverage).select(F.col("doc_id").alias("_leak"), F.col("part").alias("_part")).distinct())
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("_leak")) & (text_key() == F.col("_part"))
    return docs.join(found, same, "left_anti")
