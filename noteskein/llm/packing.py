"""Packing token sequences by bin completion on the histogram of piece lengths.

Texts are tokenised where they lie and cut into pieces of at most ``capacity`` tokens. Only the number of pieces of
each length is gathered, ``capacity`` rows at most whatever the size of the table. On it a branch-and-bound search
builds sequences around the largest remaining length: it enumerates undominated fillings of the rest of the sequence,
uses each one as often as the counts allow, and prunes a branch whose waste cannot beat the incumbent, which
begins as the best-fit-decreasing solution. A use takes some length's count to zero, so a plan has no more kinds of
sequences than there are lengths. Pieces get their place by rank within their length: ranks come from counts of
(length, bucket), so a length that very many pieces share is spread over all buckets.

Defined results: a null or empty text is one piece, the end token alone; a null ``doc_id`` stays null;
repeated rows are packed repeatedly; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from noteskein.llm.common import id_and_text, map_rows, decode, written

CAPACITY = 4096
END_ID = 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: Words a task keeps ids of; beyond it the cache starts anew. It has no part in any result.
CACHE = 600_000

#: Work bounds of the search: fillings looked at around one length, and steps in all. The best plan so far counts.
FILLING_NODES = 400
FILLINGS = 6
STEPS = 20_000


def _packed(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def _visible_bytes() -> dict[int, str]:
    """The character by which a byte-level vocabulary writes each byte: itself where it can be seen, else the next from U+0100."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, with the ids of words kept.

    The vocabulary's tokenizer drops white space and never joins across it, so a text's ids are those of its words
    one after the other, and letters followed by plain punctuation are two parts of a word.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.visible = _visible_bytes()
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {"": b""}

    def _plain(self, core: str) -> bytes:
        """Ids of lower-case letters up to U+00FF: nothing to normalise or to split, so the vocabulary's merges alone."""
        shown = core if core.isascii() else core.encode().decode("latin-1").translate(self.visible)
        return _packed([token.id for token in self.model.tokenize(shown)])

    def _encode_parts(self, parts: list[str]) -> None:
        for part, found in zip(parts, self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)):
            self.parts[part] = _packed(found.ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [text.replace("\n", " ").split(" ") for text in texts]
        if len(self.words) > CACHE:
            self.words, self.parts = {}, {"": b""}
        unknown = set().union(*split).difference(self.words)
        cut = {}
        for word in unknown:
            core = word.rstrip(".,;:!?")
            if not core.isalpha():
                cut[word] = word, ""
                continue
            tail = word[len(core):]
            if max(core) < "\u0100":
                core = core.lower()
                if core not in self.parts:
                    self.parts[core] = self._plain(core)
            cut[word] = core, tail
        need = {part for pair in cut.values() for part in pair if part not in self.parts}
        self._encode_parts(sorted(need))
        for word, (core, tail) in cut.items():
            self.words[word] = self.parts[core] + self.parts[tail]
        ids_of = self.words.__getitem__
        return [b"".join(map(ids_of, words)) for words in split]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of every document; ``with_ids`` adds their ids as little-endian unsigned 32-bit bytes."""
    end = np.array([end_id], "<u4").tobytes()
    width = 4 * capacity

    def make():
        encoder = Encoder(tokenizer_path)

        def rows_of(doc_id, data):
            ids = encoder.encode([decode(data)])[0] + end
            for piece, at in enumerate(range(0, len(ids), width)):
                part = ids[at : at + width]
                yield (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), *([part] if with_ids else []))
        return rows_of

    return map_rows(id_and_text(docs), make, PIECES + (", ids binary" if with_ids else ""))


Filling = tuple[tuple[int, int], ...]
Plan = list[tuple[int, Filling]]


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing, equal sequences together: (uses, ((length, number in the sequence), ...))."""
    open_bins: dict[int, dict[Filling, int]] = {capacity: {(): sum(counts.values())}}
    rests = [capacity]
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            rest = rests[bisect_right(rests, length - 1)]
            filling, free = open_bins[rest].popitem()
            used = min(left, free)
            if free > used:
                open_bins[rest][filling] = free - used
            elif not open_bins[rest]:
                del open_bins[rest]
                rests.remove(rest)
            left -= used
            more = (*filling[:-1], (length, filling[-1][1] + 1)) if filling and filling[-1][0] == length else (*filling, (length, 1))
            target = open_bins.setdefault(rest - length, {})
            if not target:
                rests.insert(bisect_right(rests, rest - length), rest - length)
            target[more] = target.get(more, 0) + used
    return [(uses, filling) for bins in open_bins.values() for filling, uses in bins.items() if filling]


def fillings(counts: list[int], lengths: list[int], room: int, capacity_nodes: int = FILLING_NODES) -> list[tuple[int, ...]]:
    """Undominated ways to fill ``room`` from the remaining lengths, the least waste first.

    Only maximal ones are made: one that another piece would still fit into is dominated. Of the rest, one is
    dominated whose pieces fit into the pieces of another.
    """
    found: list[tuple[int, ...]] = []
    nodes = 0
    taken: list[int] = []
    used: dict[int, int] = {}
    # Depth first without recursion, as thousands of short pieces may go into one sequence: each frame has its room, the
    # place of the next length to try, and whether any piece fitted. ``enter`` is the room and the longest piece of a new node.
    stack: list[list] = []
    enter: tuple[int, int] | None = (room, room)
    while enter or stack:
        if enter:
            (room, most), enter = enter, None
            nodes += 1
            if room == 0 or not lengths or lengths[0] > room:
                found.append(tuple(taken))
            elif room <= most and counts[room] > used.get(room, 0):
                found.append((*taken, room))
            else:
                stack.append([room, bisect_right(lengths, min(room, most)) - 1, False])
                continue
        else:
            room, at, any_fits = stack[-1]
            while at >= 0 and counts[lengths[at]] <= used.get(lengths[at], 0):
                at -= 1
            if at >= 0:
                length = lengths[at]
                stack[-1][1:] = at - 1, True
                taken.append(length)
                used[length] = used.get(length, 0) + 1
                enter = room - length, length
                continue
            stack.pop()
            if not any_fits:
                found.append(tuple(taken))
        if len(found) >= FILLINGS or nodes >= capacity_nodes:
            break
        if taken:
            used[taken.pop()] -= 1
    found = sorted(set(found), key=lambda f: (-sum(f), len(f)))
    kept: list[tuple[int, ...]] = []
    for filling in found:
        if not any(dominates(other, filling) for other in kept):
            kept.append(filling)
    return kept


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the pieces of ``b`` can be packed into pieces of ``a``; long fillings are not tested."""
    if len(b) > 8 or sum(b) > sum(a):
        return False

    def fits(rooms: list[int], rest: tuple[int, ...]) -> bool:
        if not rest:
            return True
        tried = set()
        for i, room in enumerate(rooms):
            if room >= rest[0] and room not in tried:
                tried.add(room)
                if fits([*rooms[:i], room - rest[0], *rooms[i + 1 :]], rest[1:]):
                    return True
        return False

    return fits(list(a), tuple(sorted(b, reverse=True)))


def bin_completion(histogram: dict[int, int], capacity: int) -> Plan:
    """A plan with as few sequences as the search finds; it stops at the bound that no plan can beat."""
    total = sum(length * n for length, n in histogram.items())
    bound = -(-total // capacity)
    best = best_fit(histogram, capacity)
    best_size = sum(uses for uses, _ in best)
    counts = [0] * (capacity + 1)
    for length, n in histogram.items():
        counts[length] = n
    steps = 0

    def step(counts: list[int]) -> tuple[int, list[tuple[int, ...]]]:
        lengths = [k for k in range(1, capacity + 1) if counts[k]]
        largest = lengths[-1]
        counts[largest] -= 1
        if not counts[largest]:
            lengths.pop()
        options = fillings(counts, lengths, capacity - largest)
        counts[largest] += 1
        return largest, options

    # Depth first without recursion: each frame has the counts before it, what is used so far, and options left.
    stack: list[tuple[list[int], int, int, int, list[tuple[int, ...]], int]] = []
    made: Plan = []
    size, rest = 0, total
    while best_size > bound and steps < STEPS:
        if rest == 0:
            if size < best_size:
                best, best_size = list(made), size
            going = False
        else:
            # Waste so far counts against the plan: what is left needs at least this many sequences more.
            going = size + -(-rest // capacity) < best_size
        if going:
            steps += 1
            largest, options = step(counts)
            stack.append((counts, size, rest, len(made), options, 0))
        while stack:
            counts, size, rest, depth, options, k = stack.pop()
            if k < len(options):
                break
        else:
            break
        stack.append((counts, size, rest, depth, options, k + 1))
        largest = max(i for i in range(1, capacity + 1) if counts[i])
        del made[depth:]
        pattern: dict[int, int] = {largest: 1}
        for length in options[k]:
            pattern[length] = pattern.get(length, 0) + 1
        uses = min(counts[length] // n for length, n in pattern.items())
        counts = counts.copy()
        for length, n in pattern.items():
            counts[length] -= uses * n
            rest -= uses * n * length
        size += uses
        made.append((uses, tuple(sorted(pattern.items(), reverse=True))))
    return best


def slots(plan: Plan) -> np.ndarray:
    """Rows (length, first rank, sequence, number in the sequence, offset), by length and first rank."""
    rows, ranks, sequence = [], {}, 0
    for uses, filling in plan:
        offset = 0
        for length, n in filling:
            first = ranks.get(length, 0)
            rows.append((length, first, sequence, n, offset))
            ranks[length] = first + uses * n
            offset += length * n
        sequence += uses
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def ranked(rows: DataFrame) -> DataFrame:
    """``rank`` from 0 within ``length``, without one task for a length: buckets are counted, then numbered."""
    buckets = 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int")
    rows = rows.withColumn("_bucket", bucket)
    counts = rows.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    order = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    numbered = rows.withColumn("_k", F.row_number().over(order))
    return numbered.join(starts, ["length", "_bucket"]).withColumn("rank", F.col("_before") + F.col("_k") - 1).drop("_bucket", "_k", "_before")


def placed(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``sequence_id`` and ``offset`` for rows with ``doc_id, piece, ids_crc32, length``; other columns stay."""
    histogram = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    table = slots(bin_completion(histogram, capacity))
    scale = np.int64(1) << np.int64(46)
    keys = table[:, 0] * scale + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            at = batch.schema.get_field_index("rank")
            rank = batch.column(at).to_numpy()
            slot = table[np.searchsorted(keys, length * scale + rank, "right") - 1]
            k = rank - slot[:, 1]
            sequence = slot[:, 2] + k // slot[:, 3]
            offset = slot[:, 4] + k % slot[:, 3] * length
            batch = batch.remove_column(at).append_column("sequence_id", pa.array(sequence, pa.int64()))
            yield batch.append_column("offset", pa.array(offset, pa.int64()))

    numbered = ranked(rows).select(*rows.columns, "rank")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return numbered.mapInArrow(run, fields + ", sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of every document with their places. Texts are tokenised once; the pieces are written first."""
    return placed(written(pieces(docs, tokenizer_path, capacity, end_id, with_ids)), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed ids of each sequence, from rows made ``with_ids``: at most ``capacity`` tokens each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda done, part: F.concat(done, part["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("n_tokens"))
