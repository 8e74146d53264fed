"""Scoring texts with a probabilistic suffix tree, beside a smoothed count of whole words.

The tree's symbols are the 256 byte values of the lower-cased words with a blank between words, and an end. Its contexts are up to
``DEPTH`` symbols long. A context stays where it occurs ``LEAST`` times or more and its next-symbol distribution diverges from
that of its suffix: its count times the Kullback-Leibler divergence must beat the cost of its parameters; the suffixes of a
context that stays do so too. Distributions are smoothed towards the suffix's with a weight of the number of different
symbols seen (Witten-Bell), that of no context by one for each symbol. A symbol is scored in the state of the longest suffix that
stays. No bound depends on the size of the corpus: the contexts grow with it.

Neither contexts nor words are held in one place. A window is a context of full length and the symbol after it, newest context
symbol first, so that all windows of a shorter context are neighbours in order. Texts are packed into chunks as they lie; of a
chunk, the different windows and words (by 64-bit hash) with their counts go out as sorted, compressed runs, by bucket. A bucket has
all windows that share their two newest context symbols, and so all of the tree that they need but the counts of pairs of symbols,
which are 65,536 numbers. Runs of a bucket are added up one after the other, and what is left is one entry for each different
window or word. A second pass answers each run with the windows' probabilities and the words' counts, and the answers meet
their chunk's texts again.

Defined results: a null or empty text is the end alone; the id of a null ``doc_id`` counts as empty text, whose
remainder is 0; repeated rows count and are scored repeatedly; with no training text every count is 0; an empty
table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from noteskein.llm.common import id_and_text, stored, text_bytes

DEPTH = 6
LEAST = 8
SYMBOLS = 256
END = b"\n"
#: Positions handled at a time, bytes of text in a packed block and in a chunk, entries of a run that are sent as one row.
BLOCK = 1 << 22
PACKED = 2 << 20
CHUNK = 32 << 20
ENTRIES = 1 << 20
WORDS, WINDOWS, PAIRS = 0, 1, 2

Run = tuple[np.ndarray, np.ndarray]
RUNS = "space int, bucket int, chunk long, n int, codes binary, counts binary"
VALUES = "space int, bucket int, first long, n int, codes binary, found binary, total long, known long"
ANSWERS = "chunk long, space int, codes binary, found binary"


def training(docs: DataFrame) -> DataFrame:
    """``doc_id, text, train``."""
    remainder = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7))
    return id_and_text(docs).withColumn("train", remainder != 2)


def normal(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


# Runs: sorted different codes, and a number for each.


def planes(values: np.ndarray) -> bytes:
    """Bytes of numbers, all first ones together, and so on: most planes of small numbers are zeros."""
    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), 1)


def unplanes(data: bytes, n: int, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(-1, n).T).view(kind).ravel() if n else np.empty(0, kind)


def pack_codes(codes: np.ndarray) -> bytes:
    return planes(np.diff(codes, prepend=np.uint64(0)))


def unpack_codes(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(unplanes(data, n, np.uint64), dtype=np.uint64)


def merged(runs: list[Run]) -> Run:
    """One run with the sums of equal codes."""
    if len(runs) == 1:
        return runs[0]
    codes = np.concatenate([c for c, _ in runs])
    counts = np.concatenate([n for _, n in runs])
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.empty(0, np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


class Sum:
    """Adds runs up; holds no more than twice the different codes and a few runs."""

    def __init__(self) -> None:
        self.runs: list[Run] = []
        self.size = self.settled = 0

    def add(self, codes: np.ndarray, counts: np.ndarray) -> None:
        self.runs.append((codes, counts.astype(np.int64)))
        self.size += len(codes)
        if self.size > 2 * self.settled + 2 * BLOCK:
            self.runs = [merged(self.runs)]
            self.size = self.settled = len(self.runs[0][0])

    def total(self) -> Run:
        return merged(self.runs) if self.runs else (np.empty(0, np.uint64), np.empty(0, np.int64))


# Texts


def stream(texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts, each after ``DEPTH`` ends and with one behind it; first position and length (with the end) of each."""
    pad = END * DEPTH
    pieces, starts, sizes, at = [], [], [], 0
    for text in texts:
        pieces += [pad, text, END]
        starts.append(at + DEPTH)
        sizes.append(len(text) + 1)
        at += DEPTH + len(text) + 1
    return np.frombuffer(b"".join(pieces), np.uint8), np.array(starts, np.int64), np.array(sizes, np.int64)


def scored(starts: np.ndarray, sizes: np.ndarray, total: int) -> np.ndarray:
    """Which positions are symbols of texts, not padding."""
    steps = np.zeros(total + 1, np.int8)
    steps[starts] = 1
    np.subtract.at(steps, starts + sizes, 1)
    return np.cumsum(steps[:total], dtype=np.int8).view(bool)


def windows(symbols: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first position, codes) of the windows that end at each position from ``DEPTH`` on, block by block."""
    for first in range(DEPTH, len(symbols), BLOCK):
        part = symbols[first - DEPTH : first + BLOCK]
        n = len(part) - DEPTH
        codes = part[DEPTH:].astype(np.uint64)
        for k in range(1, DEPTH + 1):
            codes |= part[DEPTH - k : DEPTH - k + n].astype(np.uint64) << np.uint64(8 * (DEPTH + 1 - k))
        yield first, codes


def word_codes(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)


def packed(docs: DataFrame) -> DataFrame:
    """``chunk, size, block``: the normalised texts as they lie, in compressed blocks; rows of a chunk are neighbours."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = TaskContext.get().partitionId() << 24, 0
        ids, marks, texts, size = [], [], [], 0

        def block() -> pa.RecordBatch:
            columns = [pa.array(ids, pa.int64()), pa.array(marks, pa.bool_()), pa.array(texts, pa.large_binary())]
            sink, options = pa.BufferOutputStream(), pa.ipc.IpcWriteOptions(compression="zstd")
            with pa.ipc.new_stream(sink, pa.schema([("id", pa.int64()), ("train", pa.bool_()), ("text", pa.large_binary())]), options=options) as out:
                out.write_batch(pa.RecordBatch.from_arrays(columns, ["id", "train", "text"]))
            row = [[chunk], [size], [sink.getvalue().to_pybytes()]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.int64(), pa.binary()))], ["chunk", "size", "block"])

        for batch in batches:
            for doc_id, text, train in zip(batch.column(0), batch.column(1).cast(pa.large_binary()), batch.column(2)):
                own = normal(text.as_py())
                ids.append(doc_id.as_py())
                marks.append(train.as_py())
                texts.append(own)
                size += len(own) + 16
                if size >= PACKED:
                    yield block()
                    held += size
                    ids, marks, texts, size = [], [], [], 0
                    if held >= CHUNK:
                        chunk, held = chunk + 1, 0
        if ids:
            yield block()

    return training(docs).mapInArrow(run, "chunk long, size long, block binary")


def unpacked(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


# Counting


def bucket_of(space: int, codes: np.ndarray, buckets: int) -> np.ndarray:
    """Words by hash; windows by their two newest context symbols."""
    if space == WINDOWS:
        codes = (codes >> np.uint64(8 * (DEPTH - 1))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
    return (codes % np.uint64(buckets)).astype(np.int64)


def requests(blocks: DataFrame, buckets: int) -> DataFrame:
    """Runs of each chunk by bucket: words and windows of all texts with their counts in training texts, and pairs of these."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, words, found, pairs = None, Counter(), Sum(), np.zeros(1 << 16, np.int64)
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if current is not None and chunk != current:
                    yield from rows(current, words, found, pairs)
                    words, found, pairs = Counter(), Sum(), np.zeros(1 << 16, np.int64)
                current = chunk
                block = unpacked(data.as_py())
                texts, marks = text_bytes(block.column(2)), block.column(1).to_pylist()
                for train in (True, False):
                    mine = [text for text, mark in zip(texts, marks) if mark == train]
                    if not mine:
                        continue
                    own = Counter(b" ".join(mine).split())
                    own[END] = len(mine)
                    for word, n in own.items():
                        words[word] += n if train else 0
                    symbols, starts, sizes = stream(mine)
                    use = scored(starts, sizes, len(symbols))
                    for first, codes in windows(symbols):
                        codes, n = np.unique(codes[use[first : first + len(codes)]], return_counts=True)
                        found.add(codes, n if train else np.zeros(len(n), np.int64))
                        if train:
                            at = (codes >> np.uint64(8 * DEPTH) << np.uint64(8) | codes & np.uint64(255)).astype(np.int64)
                            pairs += np.bincount(at, n, 1 << 16).astype(np.int64)
        if current is not None:
            yield from rows(current, words, found, pairs)

    def rows(chunk: int, words: Counter, found: Sum, pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
        # Two words of one hash are one word.
        codes = word_codes(list(words))
        order = np.argsort(codes)
        of_words = merged([(codes[order], np.fromiter(words.values(), np.int64, len(words))[order]), (np.empty(0, np.uint64), np.empty(0, np.int64))])
        seen = np.flatnonzero(pairs)
        for space, (codes, counts) in ((WORDS, of_words), (WINDOWS, found.total()), (PAIRS, (seen.astype(np.uint64), pairs[seen]))):
            made = []
            bucket = bucket_of(space, codes, buckets) if space != PAIRS else np.zeros(len(codes), np.int64)
            order = np.argsort(bucket, kind="stable")
            bounds = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=buckets))
            for a, b in zip(bounds, bounds[1:]):
                for c in range(a, b, ENTRIES):
                    own = order[c : min(b, c + ENTRIES)]
                    made.append((space, int(bucket[own[0]]), chunk, len(own), pack_codes(codes[own]), planes(counts[own])))
            if made:
                yield batch_of(made, RUNS)

    return blocks.select("chunk", "block").mapInArrow(run, RUNS)


_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def batch_of(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    fields = [f.split() for f in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(zip(*rows), fields)], [name for name, _ in fields])


def pair_counts(runs: DataFrame) -> np.ndarray:
    """[symbol, symbol after it] over all training texts: 65,536 numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for n, codes, own in zip(*(c.to_pylist() for c in batch.columns)):
                counts[unpack_codes(codes, n).astype(np.int64)] += unplanes(own, n, np.int64)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["at", "n"])

    rows = runs.where(F.col("space") == PAIRS).select("n", "codes", "counts").mapInArrow(run, "at long, n long")
    found = rows.groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << 16, np.int64)
    counts[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return counts.reshape(SYMBOLS, SYMBOLS)


# The tree


def probabilities(codes: np.ndarray, counts: np.ndarray, pairs: np.ndarray, least: int = LEAST) -> np.ndarray:
    """log10 probability of the last symbol of each window in its state, from all windows of a bucket.

    The tree's levels are worked out from the deepest upwards for the counts, and back downwards for the probabilities.
    """
    low, eight, sixteen = np.uint64(255), np.uint64(8), np.uint64(16)
    # For each level: windows of that context length, their counts, the window of the level above of each, their contexts.
    keys, seen, up, context, total, kinds, stays = {DEPTH: codes}, {DEPTH: counts}, {}, {}, {}, {}, {}
    for k in range(DEPTH, 0, -1):
        if k > 1:
            keys[k - 1], up[k] = np.unique((keys[k] >> sixteen << eight) | (keys[k] & low), return_inverse=True)
            seen[k - 1] = np.zeros(len(keys[k - 1]), np.int64)
            np.add.at(seen[k - 1], up[k], seen[k])
        own = keys[k] >> eight
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        context[k] = np.repeat(np.arange(len(first)), np.diff(first, append=len(own)))
        if k > 1:
            total[k], kinds[k] = np.add.reduceat(seen[k], first), np.add.reduceat((seen[k] > 0).astype(np.int64), first)
        else:
            # A bucket has all windows of its contexts of two symbols and more, but not those of one.
            symbol, after = (own[first]).astype(np.int64), (keys[1] & low).astype(np.int64)
            seen[1] = pairs[symbol[context[1]], after]
            total[1], kinds[1] = pairs[symbol].sum(1), (pairs[symbol] > 0).sum(1)
    for k in range(DEPTH, 1, -1):
        n, above = seen[k], seen[k - 1][up[k]]
        parent = total[k - 1][context[k - 1][up[k]]]
        with np.errstate(divide="ignore", invalid="ignore"):
            terms = np.where(n > 0, n * np.log(n * parent.astype(float) / (total[k][context[k]] * above.astype(float))), 0.0)
        gain = np.bincount(context[k], terms, len(total[k]))
        keep = (total[k] >= least) & (gain > 0.5 * kinds[k] * np.log(np.maximum(total[k], 2)))
        stays[k] = keep | stays.get(k, np.zeros(len(keep), bool))
        # The suffixes of what stays.
        mine = stays[k][context[k]]
        stays[k - 1] = np.zeros(len(total[k - 1]), bool)
        stays[k - 1][context[k - 1][up[k][mine]]] = True
    root = pairs.sum(0)
    p = ((root + 1) / (root.sum() + SYMBOLS))[(keys[1] & low).astype(np.int64)]
    for k in range(1, DEPTH + 1):
        p = p[up[k]] if k > 1 else p
        own, kind = total[k][context[k]], kinds[k][context[k]]
        smooth = (seen[k] + kind * p) / np.maximum(own + kind, 1)
        use = stays[k][context[k]] if k > 1 else own > 0
        p = np.where(use, smooth, p)
    return np.log10(p)


def sorted_by_bucket(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("space", "bucket").sortWithinPartitions("space", "bucket", *order)


def valued(runs: DataFrame, pairs: np.ndarray, least: int = LEAST) -> DataFrame:
    """One entry for each different word and window: its count, or its log10 probability; with sums over a bucket's words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total = None, Sum()
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(3)]
            for space, bucket, n, codes, counts in zip(*columns, batch.column(3), batch.column(4)):
                if current is not None and (space, bucket) != current:
                    yield from rows(*current, *total.total())
                    total = Sum()
                current = space, bucket
                total.add(unpack_codes(codes.as_py(), n), unplanes(counts.as_py(), n, np.int64))
        if current is not None:
            yield from rows(*current, *total.total())

    def rows(space: int, bucket: int, codes: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = counts if space == WORDS else probabilities(codes, counts, pairs, least).astype(np.float32)
        for a in range(0, len(codes), ENTRIES):
            part, own = codes[a : a + ENTRIES], found[a : a + ENTRIES]
            known = own > 0 if space == WORDS else own[:0]
            sums = (int(own.sum()), int(known.sum())) if space == WORDS else (0, 0)
            yield batch_of([(space, bucket, a, len(part), pack_codes(part), planes(own), *sums)], VALUES)

    ordered = sorted_by_bucket(runs.where(F.col("space") != PAIRS))
    return ordered.select("space", "bucket", "n", "codes", "counts").mapInArrow(run, VALUES)


def answered(runs: DataFrame, values: DataFrame) -> DataFrame:
    """For each run of a chunk, what was found for its codes."""
    asked = runs.where(F.col("space") != PAIRS).select(
        "space", "bucket", F.lit(1).alias("kind"), "chunk", "n", "codes", F.lit(None).cast("binary").alias("found")
    )
    known = values.select("space", "bucket", F.lit(0).alias("kind"), F.col("first").alias("chunk"), "n", "codes", "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts = None, []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(5)]
            for space, bucket, kind, chunk, n, codes, found in zip(*columns, batch.column(5), batch.column(6)):
                if (space, bucket) != current:
                    current, parts = (space, bucket), []
                own = unpack_codes(codes.as_py(), n)
                if kind == 0:
                    parts.append((own, unplanes(found.as_py(), n, np.int64 if space == WORDS else np.float32)))
                    continue
                if len(parts) > 1:
                    parts = [tuple(np.concatenate(c) for c in zip(*parts))]
                made = parts[0][1][np.searchsorted(parts[0][0], own)]
                yield batch_of([(chunk, space, codes.as_py(), planes(made))], ANSWERS)

    return sorted_by_bucket(known.unionByName(asked), "kind", "chunk").mapInArrow(run, ANSWERS)


# Scoring


class Found:
    """What was found for codes, in a hash table with open places, for many lookups at once."""

    FREE = np.uint64(0xFFFFFFFFFFFFFFFF)

    def __init__(self, codes: np.ndarray, found: np.ndarray):
        bits = max(4, int(2 * len(codes)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, self.FREE), np.zeros(1 << bits, found.dtype)
        place = self.place(codes)
        while len(codes):
            free = self.keys[place] == self.FREE
            self.keys[place[free]] = codes[free]
            here = self.keys[place] == codes
            self.values[place[here]] = found[here]
            codes, found, place = codes[~here], found[~here], (place[~here] + 1) & self.mask

    def place(self, codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __getitem__(self, codes: np.ndarray) -> np.ndarray:
        """Values of codes that are all in the table."""
        place = self.place(codes)
        lost = np.flatnonzero(self.keys[place] != codes)
        while len(lost):
            place[lost] = (place[lost] + 1) & self.mask
            lost = lost[self.keys[place[lost]] != codes[lost]]
        return self.values[place]


class Scores:
    """Scores of texts by the answers of their chunk."""

    def __init__(self, answers: list[tuple[int, bytes, bytes]], n_train: int, n_distinct: int):
        self.n_train, self.norm = n_train, float(np.log10(n_train + n_distinct + 1))
        self.found = {}
        for space, kind in ((WORDS, np.int64), (WINDOWS, np.float32)):
            raw = [(np.frombuffer(zstandard.decompress(c), np.uint8).size // 8, c, f) for s, c, f in answers if s == space]
            codes = np.concatenate([unpack_codes(c, n) for n, c, _ in raw]) if raw else np.empty(0, np.uint64)
            found = np.concatenate([unplanes(f, n, kind) for n, _, f in raw]) if raw else np.empty(0, kind)
            self.found[space] = Found(codes, found)
        self.logs: dict[bytes, float] = {}

    def words(self, texts: list[bytes]) -> tuple[list[int], list[int], list[float]]:
        split = [text.split() for text in texts]
        new = list(set().union(*split, [END]).difference(self.logs))
        counts = self.found[WORDS][word_codes(new)]
        self.logs.update(zip(new, np.log10(counts + 1.0).tolist()))
        n_tokens, n_known, base = [], [], []
        for tokens in split:
            tokens.append(END)
            values = np.fromiter(map(self.logs.__getitem__, tokens), np.float64, len(tokens))
            n_tokens.append(len(tokens))
            n_known.append(int(np.count_nonzero(values)))
            base.append(float(values.sum()) - len(tokens) * self.norm)
        return n_tokens, n_known, base

    def tree(self, texts: list[bytes]) -> np.ndarray:
        symbols, starts, sizes = stream(texts)
        found = np.zeros(len(symbols), np.float32)
        use = scored(starts, sizes, len(symbols))
        for first, codes in windows(symbols):
            at = np.flatnonzero(use[first : first + len(codes)])
            found[first + at] = self.found[WINDOWS][codes[at]]
        sums = np.concatenate([[0.0], np.cumsum(found, dtype=np.float64)])
        return sums[starts + sizes] - sums[starts]


def score(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Scores of every document under the tree and under the smoothed word counts."""
    blocks = stored(packed(docs))
    size = blocks.agg(F.sum("size")).first()[0] or 0
    runs = stored(requests(blocks, max(16, 2 * size // CHUNK)))
    values = stored(valued(runs, pair_counts(runs), least))
    sums = values.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum("known"), F.lit(0)).alias("v")).first()
    n_train, n_distinct = sums["n"], sums["v"]
    texts = blocks.select("chunk", F.lit(1).alias("kind"), F.lit(0).alias("space"), F.col("block").alias("codes"), F.lit(None).cast("binary").alias("found"))
    answers = answered(runs, values).select("chunk", F.lit(0).alias("kind"), "space", "codes", "found")
    schema = pa.schema([
        ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, scores = None, [], None
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(3)]
            for chunk, kind, space, codes, found in zip(*columns, batch.column(3), batch.column(4)):
                if chunk != current:
                    current, parts, scores = chunk, [], None
                if kind == 0:
                    parts.append((space, codes.as_py(), found.as_py()))
                    continue
                if scores is None:
                    scores, parts = Scores(parts, n_train, n_distinct), []
                block = unpacked(codes.as_py())
                own = text_bytes(block.column(2))
                n_tokens, n_known, base = scores.words(own)
                held = [not mark for mark in block.column(1).to_pylist()]
                made = [block.column(0), held, n_tokens, n_known, [n_train] * len(own), base, scores.tree(own)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, schema)], schema=schema)

    together = answers.unionByName(texts).repartition("chunk").sortWithinPartitions("chunk", "kind")
    return together.mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
