"""Exact removal of repeated byte strings by sorting the suffixes at anchors, deep-shallow.

A byte is removed when a string of ``length`` bytes that covers it starts anywhere else, in any document.

Each window of ``length`` bytes has one anchor, the position of the smallest hash among its ``SEED``-byte seeds
(the leftmost on ties), so equal windows have it at the same offset. The windows of one anchor are neighbours; together
they are its segment. Documents send a fixed-size row per segment: hash of the seed, hash of the
segment. Segments that occur twice as a whole are covered. Where different segments share a seed, one copy of each is
fetched and sorted: the suffixes from the anchor, and the reversed prefixes, each by multikey quicksort to a shallow
depth and by blind tries where prefixes stay equal beyond it. Windows shared by two segments are those
within their common prefix and suffix around the anchor. Going up the tree of common prefixes, sets of suffix ranks are
joined, the smaller into the larger, and only neighbours by rank are compared, so no pairs of a group are listed.

A seed with more than ``GROUP`` different segments is split by window offset: the lower and the upper half of the
offsets become segments of their own, under the hash of the bytes that all their windows share. A single offset is left
at last, where segments are windows and equal ones were merged, so the split always ends and nothing is cut.

Defined results: a null or empty text has no bytes; a null ``doc_id`` stays null; rows that repeat id and text count
as occurrences of each other; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from noteskein.llm.common import id_and_text, stored, text_bytes, to_batch

LENGTH = 400
SEED = 64
#: Different segments of one seed that are sorted together; more are split first.
GROUP = 4096
#: Characters that quicksort looks at beyond the known common prefix, before blind tries take over.
SHALLOW = 16
_BITS = 20
_PLACE = np.uint64((1 << _BITS) - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def seed_hashes(data: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hash of the ``seed`` (a power of two) bytes from each position, by doubling."""
    hashes, width, factor = _BYTES[data], 1, 0x100000001B3
    while width < seed:
        hashes = hashes[:-width] * np.uint64(factor) + hashes[width:]
        factor, width = factor * factor % 2**64, 2 * width
    hashes ^= hashes >> np.uint64(32)
    hashes *= _MIX
    hashes ^= hashes >> np.uint64(29)
    return hashes


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    least, done = values, 1
    while 2 * done <= width:
        least, done = np.minimum(least[:-done], least[done:]), 2 * done
    rest = width - done
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def segments(data: np.ndarray, ends: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of joined texts: anchor, first and last window start of its segment, seed hash.

    ``ends`` has for each position the end of its text; windows that would cross it are none.
    """
    found = []
    step = (1 << _BITS) - length - seed
    for first in range(0, len(data) - length + 1, step):
        part = data[first : first + step + length - 1]
        hashes = seed_hashes(part, seed)
        packed = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
        anchor = (sliding_least(packed, length - seed + 1) & _PLACE).astype(np.int64)
        starts = np.arange(len(anchor)) + first
        anchor = np.where(starts + length <= ends[first : first + len(anchor)], anchor, -1)
        cuts = np.flatnonzero(np.diff(anchor, prepend=-2))
        lasts = np.append(cuts[1:], len(anchor)) - 1
        use = anchor[cuts] >= 0
        cuts, lasts = cuts[use], lasts[use]
        at = anchor[cuts]
        found.append((at + first, cuts + first, lasts + first, hashes[at]))
    if not found:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    return tuple(np.concatenate(c) for c in zip(*found))


def _two(data: bytes) -> tuple[int, int]:
    value = xxhash.xxh3_128_digest(data)
    return int.from_bytes(value[:8], "little", signed=True), int.from_bytes(value[8:], "little", signed=True)


def part_of(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 1


ANCHORS = "doc_id long, part long, at long, before int, after int, seed long, c1 long, c2 long"


def anchors(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """A row per segment: text (``doc_id, part``), anchor, bytes before and from it, seed hash, segment hash."""
    names = [c.split(" ")[0] for c in ANCHORS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), text_bytes(batch.column(1))
            group, size = [], 0
            for k, text in enumerate(texts):
                if len(text) >= length:
                    group.append(k)
                    size += len(text)
                if size > 1 << 22 or (k == len(texts) - 1 and group):
                    yield rows_of(ids, texts, group)
                    group, size = [], 0

    def rows_of(ids, texts, group) -> pa.RecordBatch:
        joined = b"".join(texts[k] for k in group)
        sizes = np.array([len(texts[k]) for k in group])
        ends = np.cumsum(sizes)
        at, low, high, seeds = segments(np.frombuffer(joined, np.uint8), np.repeat(ends, sizes), length, seed)
        own = np.searchsorted(ends, at, "right")
        before, after = at - low, high + length - at
        hashed = [_two(joined[a:b] + x.to_bytes(4, "little")) for a, b, x in zip(low.tolist(), (high + length).tolist(), before.tolist())]
        parts = [part_of(texts[k]) for k in group]
        columns = [
            pa.array([ids[group[k]] for k in own], pa.int64()), pa.array([parts[k] for k in own], pa.int64()),
            pa.array(at - (ends - sizes)[own]), pa.array(before.astype(np.int32)), pa.array(after.astype(np.int32)),
            pa.array(seeds.view(np.int64)), pa.array([c[0] for c in hashed], pa.int64()), pa.array([c[1] for c in hashed], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names)

    return id_and_text(docs).mapInArrow(run, ANCHORS)


# Sorting.

def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix; the first ``start`` bytes are known to agree."""
    most, at, step = min(len(a), len(b)), start, 32
    while at < most and a[at : at + step] == b[at : at + step]:
        at += step
        step *= 2
    if at >= most:
        return most
    a, b = a[at : at + step], b[at : at + step]
    width = min(len(a), len(b))
    differ = int.from_bytes(a[:width], "big") ^ int.from_bytes(b[:width], "big")
    return at + (width if not differ else width - (differ.bit_length() + 7) // 8)


def deep_shallow(strings: list[bytes], depth: int = 0, shallow: int = SHALLOW) -> list[int]:
    """Order of different strings that agree in the first ``depth`` bytes."""
    order: list[int] = []
    stack = [(list(range(len(strings))), depth)]
    while stack:
        group, at = stack.pop()
        if len(group) == 1:
            order.append(group[0])
        elif at >= depth + shallow:
            order += blind_trie(strings, group, at)
        else:
            # Three parts by the character at this depth; an ended string comes before all.
            chars = [strings[k][at] if at < len(strings[k]) else -1 for k in group]
            pivot = sorted((chars[0], chars[len(chars) // 2], chars[-1]))[1]
            less = [k for k, c in zip(group, chars) if c < pivot]
            same = [k for k, c in zip(group, chars) if c == pivot]
            more = [k for k, c in zip(group, chars) if c > pivot]
            if more:
                stack.append((more, at))
            stack.append((same, at + 1 if pivot >= 0 else depth + shallow))
            if less:
                stack.append((less, at))
    return order


def blind_trie(strings: list[bytes], group: list[int], depth: int) -> list[int]:
    """Order of strings with a long common prefix: inner nodes know only where their strings part, and by which character.

    A new string goes down blindly to some leaf, is compared with that leaf once, and is hung in where they differ.
    """
    root: list | int = group[0]
    for k in group[1:]:
        own = strings[k]
        node = root
        while isinstance(node, list):
            c = own[node[0]] if node[0] < len(own) else -1
            child = node[1].get(c)
            node = child if child is not None else next(iter(node[1].values()))
        other = strings[node]
        at = common(own, other, depth)
        c = own[at] if at < len(own) else -1
        old = other[at] if at < len(other) else -1
        above, node = None, root
        while isinstance(node, list) and node[0] < at:
            above, key = node, own[node[0]] if node[0] < len(own) else -1
            node = node[1][key]
        if isinstance(node, list) and node[0] == at:
            node[1][c] = k
            continue
        fresh = [at, {old: node, c: k}]
        if above is None:
            root = fresh
        else:
            above[1][key] = fresh
    order: list[int] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
        else:
            order.append(node)
    return order


def shared_spans(before: list[bytes], after: list[bytes], length: int, known: int) -> list[list[tuple[int, int]]]:
    """For each of some different segments (bytes before the anchor, bytes from it on) the spans that it shares with others.

    A span (l, r) reaches ``l`` bytes before the anchor and ``r`` from it on, and has at least ``length`` bytes.
    ``known`` bytes from the anchor on agree in all.
    """
    n = len(after)
    spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    turned = [b[::-1] for b in before]
    by_after = _ordered(after, known)
    by_before = _ordered(turned, 0)
    rank = [0] * n
    for r, k in enumerate(by_after):
        rank[k] = r
    joins = sorted(((common(turned[a], turned[b]), i) for i, (a, b) in enumerate(zip(by_before, by_before[1:]))), reverse=True)
    parent = list(range(n))
    sets: list[list[int]] = [[rank[k]] for k in by_before]

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for left, i in joins:
        a, b = find(i), find(i + 1)
        if len(sets[a]) < len(sets[b]):
            a, b = b, a
        large = sets[a]
        for r in sets[b]:
            at = bisect_left(large, r)
            for near in large[max(0, at - 1) : at + 1]:
                x, y = by_after[r], by_after[near]
                right = common(after[x], after[y], known)
                if left + right >= length:
                    spans[x].append((left, right))
                    spans[y].append((left, right))
            large.insert(at, r)
        parent[b], sets[b] = a, []
    return [joined_spans(s) for s in spans]


def _ordered(strings: list[bytes], depth: int) -> list[int]:
    """``deep_shallow`` where strings may be equal: equal ones come one after the other."""
    places: dict[bytes, list[int]] = {}
    for k, s in enumerate(strings):
        places.setdefault(s, []).append(k)
    different = list(places)
    return [k for d in deep_shallow(different, depth) for k in places[different[d]]]


def joined_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """All spans contain the anchor: their union is one span, from the furthest start to the furthest end."""
    return [(max(s[0] for s in spans), max(s[1] for s in spans))] if spans else []


# Groups.

def _sorted_groups(rows: DataFrame, length: int, known: int) -> DataFrame:
    """``key, c1, c2, l, r``: what each segment shares with others of its group.

    Rows: ``key, c1, c2, before, after``. In a group, ``known`` bytes from the anchor on agree.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("l", pa.int32()), ("r", pa.int32())])
        held: list[tuple] = []
        out: list[tuple] = []

        def close() -> None:
            if len(held) > 1:
                for row, spans in zip(held, shared_spans([h[3] for h in held], [h[4] for h in held], length, known)):
                    out.extend((row[0], row[1], row[2], left, right) for left, right in spans)
            held.clear()

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and held[0][0] != row[0]:
                    close()
                held.append(row)
            if len(out) > 10_000:
                yield to_batch(out, schema)
                out.clear()
        close()
        if out:
            yield to_batch(out, schema)

    ordered = rows.select("key", "c1", "c2", "before", "after").repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(run, "key long, c1 long, c2 long, l int, r int")


def _halves(rows: DataFrame, length: int) -> DataFrame:
    """Segments of large groups as two: those of the lower and of the upper half of their group's window offsets.

    Rows: ``seed, s1, s2`` (the segment they come from), ``low, high`` (window offsets), ``n, before, after``. A window at
    offset a takes a bytes before the anchor. All windows of a half share its least offset before the anchor and the
    bytes after it up to its greatest one; their hash is the half's key.
    """
    names = ["seed", "s1", "s2", "low", "high", "n", "before", "after", "key", "c1", "c2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.binary() if n in ("before", "after") else pa.int64()) for n in names])
        for batch in batches:
            rows = []
            for seed, s1, s2, low, high, n, before, after in zip(*[batch.column(k).to_pylist() for k in range(8)]):
                middle = (low + high) // 2
                for a, b in ((low, middle), (middle + 1, high)):
                    # Offsets that this segment has of the half.
                    first, last = max(a, length - len(after)), min(b, len(before))
                    if a > b or first > last:
                        continue
                    own_before, own_after = before[len(before) - last :], after[: length - first]
                    shared = own_before[len(own_before) - a :] if a else b""
                    key = _two(b"%d,%d,%d|%d|" % (seed, a, b, len(shared)) + shared + own_after[: length - b])[0]
                    c1, c2 = _two(len(own_before).to_bytes(4, "little") + own_before + own_after)
                    rows.append((seed, s1, s2, a, b, n, own_before, own_after, key, c1, c2))
            if rows:
                yield to_batch(rows, schema)

    return rows.select(*names[:8]).mapInArrow(
        run, ", ".join(f"{n} {'binary' if n in ('before', 'after') else 'long'}" for n in names)
    )


def covers(docs: DataFrame, rows: DataFrame, length: int, group: int, seed: int) -> DataFrame:
    """``seed, c1, c2, l, r``: the part around its anchor that a segment shares with any other occurrence."""
    distinct = stored(rows.groupBy("seed", "c1", "c2").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "part", "at", "before", "after")).alias("place")
    ))
    whole = distinct.where("n > 1").select("seed", "c1", "c2", F.col("place.before").alias("l"), F.col("place.after").alias("r"))
    mixed = distinct.groupBy("seed").agg(F.count(F.lit(1)).alias("_segments")).where("_segments > 1")
    wanted = distinct.join(mixed, "seed").select(
        "seed", "c1", "c2", "n", "_segments", F.col("place.doc_id").alias("doc_id"), F.col("place.part").alias("part"),
        F.col("place.at").alias("at"), F.col("place.before").alias("b"), F.col("place.after").alias("a"),
    )
    fetched = stored(fetch(docs, wanted))
    small = fetched.where(F.col("_segments") <= group).withColumn("key", F.col("seed"))
    parts = [whole, _sorted_groups(small, length, seed).withColumnRenamed("key", "seed")]
    large = fetched.where(F.col("_segments") > group).select(
        "seed", F.col("c1").alias("s1"), F.col("c2").alias("s2"), F.lit(0).cast("long").alias("low"),
        F.lit(length).cast("long").alias("high"), "n", "before", "after",
    )
    while not large.isEmpty():
        halves = stored(_halves(large, length))
        merged = halves.groupBy("key", "c1", "c2").agg(F.sum("n").alias("n"), F.min(F.struct("before", "after")).alias("bytes"))
        merged = stored(merged.select("key", "c1", "c2", "n", "bytes.before", "bytes.after"))
        sizes = merged.groupBy("key").agg(F.count(F.lit(1)).alias("_segments"))
        again = merged.where("n > 1").select("key", "c1", "c2", F.length("before").alias("l"), F.length("after").alias("r"))
        few = merged.join(sizes.where((F.col("_segments") > 1) & (F.col("_segments") <= group)), "key", "left_semi")
        found = again.unionByName(_sorted_groups(few, length, 0))
        back = halves.join(found, ["key", "c1", "c2"]).select("seed", F.col("s1").alias("c1"), F.col("s2").alias("c2"), "l", "r")
        parts.append(stored(back.distinct()))
        large = halves.join(sizes.where(F.col("_segments") > group), "key", "left_semi").select(*large.columns)
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    # Written, so that the join with all segments reads two shuffles and Spark can split a hot segment among tasks.
    return stored(found.groupBy("seed", "c1", "c2").agg(F.max("l").alias("l"), F.max("r").alias("r")))


def fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``before`` and ``after`` of each wanted segment, cut from one text that has it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("seed", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("n", pa.int64()), ("_segments", pa.int64()), ("before", pa.binary()), ("after", pa.binary())])
        for batch in batches:
            rows, size = [], 0
            for text, places in zip(text_bytes(batch.column(0)), batch.column(1).to_pylist()):
                for w in places:
                    at = w["at"]
                    rows.append((w["seed"], w["c1"], w["c2"], w["n"], w["_segments"], text[at - w["b"] : at], text[at : at + w["a"]]))
                    size += w["b"] + w["a"]
                    if size > 1 << 22:
                        yield to_batch(rows, schema)
                        rows, size = [], 0
            if rows:
                yield to_batch(rows, schema)

    places = wanted.groupBy(F.col("doc_id").alias("_id"), F.col("part").alias("_part")).agg(
        F.collect_list(F.struct("seed", "c1", "c2", "n", "_segments", "at", "b", "a")).alias("places")
    )
    same = (F.col("part") == F.col("_part")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    texts = with_part(docs).join(places, same).select("text", "places")
    found = texts.mapInArrow(run, "seed long, c1 long, c2 long, n long, _segments long, before binary, after binary")
    return found.dropDuplicates(["seed", "c1", "c2"])


def with_part(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("part", pa.array([part_of(t) for t in text_bytes(batch.column(1))], pa.int64()))

    return id_and_text(docs).mapInArrow(run, "doc_id long, text string, part long")


def repeated_spans(docs: DataFrame, length: int = LENGTH, group: int = GROUP, seed: int = SEED) -> DataFrame:
    """``doc_id, part, spans`` of texts with repeated bytes; spans (start, end) in bytes, in order, may meet."""
    rows = stored(anchors(docs, length, seed))
    found = rows.join(covers(docs, rows, length, group, seed), ["seed", "c1", "c2"])
    span = F.struct((F.col("at") - F.col("l")).alias("start"), (F.col("at") + F.col("r")).alias("end"))
    return found.groupBy("doc_id", "part").agg(F.array_sort(F.collect_set(span)).alias("spans"))


def deduplicate(docs: DataFrame, length: int = LENGTH, group: int = GROUP, seed: int = SEED) -> DataFrame:
    """``doc_id``, kept bytes ``text`` and ``removed`` spans (start, end) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        schema = pa.schema([("doc_id", pa.int64()), ("text", pa.binary()), ("n_bytes", pa.int64()), ("removed", pa.list_(span)), ("sha256", pa.string())])
        for batch in batches:
            rows = []
            for doc_id, text, spans in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist()):
                runs: list[dict] = []
                for s in spans or ():
                    if runs and s["start"] <= runs[-1]["end"]:
                        runs[-1]["end"] = max(runs[-1]["end"], s["end"])
                    else:
                        runs.append(dict(s))
                cuts = [0, *[x for r in runs for x in (r["start"], r["end"])], len(text)]
                kept = b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
                rows.append((doc_id, kept, len(text), runs, hashlib.sha256(kept).hexdigest()))
            if rows:
                yield to_batch(rows, schema)

    spans = repeated_spans(docs, length, group, seed).select(F.col("doc_id").alias("_id"), F.col("part").alias("_part"), "spans")
    same = (F.col("part") == F.col("_part")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    joined = with_part(docs).join(spans, same, "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(
        run, "doc_id long, text binary, n_bytes long, removed array<struct<start: long, end: long>>, sha256 string"
    )
