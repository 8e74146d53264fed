"""Compressing vectors to product codes: each of 16 parts of a vector becomes the number of its nearest codebook entry.

Components are whole numbers, floor(256 * x). Entries are sorted by the sum of their components, and a part looks for its nearest
one outwards from its own sum (equal-average search). By the Cauchy-Schwarz inequality, the squared gap of two sums is at most
the dimension times the squared distance; so a side is done as soon as its squared gap over the dimension strictly exceeds the
best distance, and no entry that is as near as the best is passed over. The lower index wins ties.

A round is one pass over the vectors: tasks send, per batch, the count and component sums of each entry, and Spark adds them up. Only
codebooks reach the driver and the tasks: ``ENTRIES`` rows of one vector's length, whatever the table's size.

Defined results: vectors that are null, or hold null or non-finite components, are dropped. The dimension is that of the
smallest kept ``vec_id`` whose vector can be cut into 16 parts. A vector of another length, or with a component beyond what
squares in 64 bits allow, is kept with null code and error, and takes no part in the codebooks. Rows that repeat an id are rows each;
of equal ids the smaller vector comes first into the codebooks, null ids come last. Fewer than 64 vectors make fewer entries.
Labels may be null, together one label. An empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from noteskein.llm.common import stored

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256.0
#: Vectors handled at a time.
BLOCK = 4096


def kept(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, vector`` of the rows that are not dropped."""
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return rows.where(F.col("vector").isNotNull() & ~odd)


def limit_of(width: int) -> int:
    """Components up to this size have squared distances over ``width`` of them within 64 bits."""
    return isqrt((1 << 62) // max(width, 1)) // 2


def first_entries(rows: DataFrame) -> np.ndarray:
    """Codebooks to start with, [part, entry, component]; of no entries where no vector can be used."""
    usable = rows.where((F.size("vector") > 0) & (F.size("vector") % PARTS == 0))
    order = [F.col("vec_id").asc_nulls_last(), F.col("vector").asc()]
    first = usable.orderBy(*order).limit(1).collect()
    if not first:
        return np.zeros((PARTS, 0, 1), np.int64)
    size = len(first[0]["vector"])
    bound = limit_of(size // PARTS)
    whole = usable.where(F.size("vector") == size).where(~F.exists("vector", lambda x: F.abs(x * SCALE) > bound))
    head = whole.orderBy(*order).limit(ENTRIES).collect()
    if not head:
        return np.zeros((PARTS, 0, size // PARTS), np.int64)
    table = np.floor(np.array([r["vector"] for r in head]) * SCALE).astype(np.int64)
    return np.ascontiguousarray(table.reshape(len(head), PARTS, -1).transpose(1, 0, 2))


class Codebook:
    """Entries of all parts in the order of their sums, for searches of many vectors at once."""

    def __init__(self, entries: np.ndarray):
        self.parts, self.size, self.width = entries.shape
        sums = entries.sum(axis=2)
        order = np.argsort(sums, axis=1, kind="stable")
        self.sums = np.take_along_axis(sums, order, axis=1)
        self.index = order.ravel()
        self.entries = np.take_along_axis(entries, order[:, :, None], axis=1).reshape(-1, self.width)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry, each [vector, part]."""
        n, size = len(vectors), self.size
        pieces = vectors.reshape(n, self.parts, self.width)
        totals = pieces.sum(axis=2)
        start = np.stack([np.searchsorted(self.sums[p], totals[:, p]) for p in range(self.parts)], axis=1).ravel()
        pieces, totals = pieces.reshape(-1, self.width), totals.ravel()
        base = np.tile(np.arange(self.parts) * size, n)
        sums = self.sums.ravel()
        best = np.full(len(totals), np.iinfo(np.int64).max)
        which = np.full(len(totals), size)
        # For those still searching: the next entry downwards and upwards, as places below ``size``.
        at, low, high = np.arange(len(totals)), start - 1, start
        far = np.inf
        while len(at):
            down = np.where(low >= 0, np.abs(totals[at] - sums[base[at] + np.maximum(low, 0)]).astype(float), far)
            up = np.where(high < size, np.abs(sums[base[at] + np.minimum(high, size - 1)] - totals[at]).astype(float), far)
            below = down <= up
            gap = np.where(below, down, up)
            # A float gap is compared with room for its rounding: an entry too many is looked at, never one too few.
            going = (gap < far) & (gap * gap * (1 - 1e-9) <= best[at].astype(float) * self.width * (1 + 1e-9))
            at, low, high, below = at[going], low[going], high[going], below[going]
            place = base[at] + np.where(below, low, high)
            gaps = pieces[at] - self.entries[place]
            distance = np.einsum("ij,ij->i", gaps, gaps)
            index = self.index[place]
            better = (distance < best[at]) | ((distance == best[at]) & (index < which[at]))
            won = at[better]
            best[won], which[won] = distance[better], index[better]
            low, high = low - below, high + ~below
        return which.reshape(n, self.parts), best.reshape(n, self.parts)


def blocks(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, which rows of the block have a usable vector, their whole numbers)."""
    bound = limit_of(size // PARTS)
    for first in range(0, len(column), BLOCK):
        part = column.slice(first, BLOCK)
        fits = np.asarray(part.value_lengths()) == size
        values = np.asarray(part.filter(pa.array(fits)).flatten(), dtype=float).reshape(-1, size) * SCALE
        small = (np.abs(values) <= bound).all(axis=1)
        fits[fits] = small
        yield first, fits, np.floor(values[small]).astype(np.int64)


def refined(rows: DataFrame, entries: np.ndarray) -> np.ndarray:
    """Each entry replaced by the floored mean of the parts nearest to it; unused ones stay."""
    parts, size, width = entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(entries)
        count, total = np.zeros(parts * size, np.int64), np.zeros((parts * size, width), np.int64)
        for batch in batches:
            for _, _, values in blocks(batch.column(0), parts * width):
                index, _ = book.nearest(values)
                cell = (index + np.arange(parts) * size).ravel()
                count += np.bincount(cell, minlength=parts * size)
                np.add.at(total, cell, values.reshape(-1, width))
                # Partial sums leave before they can pass 64 bits.
                if np.abs(total).max(initial=0) > 1 << 61:
                    yield packed(count, total)
                    count, total = np.zeros_like(count), np.zeros_like(total)
        yield packed(count, total)

    def packed(count: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        used = np.flatnonzero(count)
        cell, at = np.repeat(used, width), np.tile(np.arange(width), len(used))
        columns = [cell, at, np.repeat(count[used], width), total[used].ravel()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["cell", "at", "n", "total"])

    sums = rows.select("vector").mapInArrow(run, "cell long, at long, n long, total long")
    # At most one row per component of the codebooks.
    found = sums.groupBy("cell", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    new = entries.reshape(-1, width).copy()
    for r in found:
        new[r["cell"], r["at"]] = int(r["total"]) // r["n"]
    return new.reshape(entries.shape)


def coded(rows: DataFrame, entries: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error``."""
    parts, size, width = entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(entries) if size else None
        for batch in batches:
            codes: list[str | None] = [None] * len(batch)
            errors: list[int | None] = [None] * len(batch)
            for first, fits, values in blocks(batch.column(2), parts * width) if book else ():
                index, distance = book.nearest(values)
                for at, code, far in zip(np.flatnonzero(fits) + first, index.astype(np.uint8), distance):
                    codes[at], errors[at] = code.tobytes().hex(), sum(far.tolist())
            errors = [e if e is None or e < 1 << 63 else None for e in errors]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())],
                ["vec_id", "label", "code", "error"],
            )

    return rows.mapInArrow(run, "vec_id long, label long, code string, error long")


def trained(rows: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    entries = first_entries(rows)
    for _ in range(rounds if entries.shape[1] else 0):
        entries = refined(rows, entries)
    return entries


def digest_of(entries: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, entries.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame) -> DataFrame:
    """``vec_id, code, error, label, label_error, codebooks_sha256``; see the module."""
    rows = kept(vectors)
    entries = trained(rows)
    codes = stored(coded(rows, entries))
    total = F.expr("try_cast(sum(cast(error as decimal(38,0))) as bigint)")
    per_label = codes.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"))
    met = codes.join(per_label, F.col("label").eqNullSafe(F.col("of")))
    return met.select("vec_id", "code", "error", "label", "label_error", F.lit(digest_of(entries)).alias("codebooks_sha256"))


SQL = """
with kept as materialized (
  select vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
x as materialized (
  select vec_id, (j - 1) // (len(v) // 16) as part, (j - 1) % (len(v) // 16) as pos, v[j] as c
  from (select vec_id, v, unnest(range(1, len(v) + 1)) as j from kept)),
seed as (select vec_id, row_number() over (order by vec_id) - 1 as entry from kept order by vec_id limit 64),
b0 as materialized (select part, entry, pos, c from x join seed using (vec_id)),
d0 as (select x.vec_id, x.part, entry, sum((x.c - b.c) * (x.c - b.c)) as d from x join b0 b using (part, pos) group by all),
a0 as (select vec_id, part, arg_min(entry, d * 64 + entry) as entry from d0 group by all),
m0 as (select part, entry, pos, cast(floor(sum(c)::hugeint / count(*)) as bigint) as c from x join a0 using (vec_id, part) group by all),
b1 as materialized (select part, entry, pos, coalesce(m.c, b.c) as c from b0 b left join m0 m using (part, entry, pos)),
d1 as (select x.vec_id, x.part, entry, sum((x.c - b.c) * (x.c - b.c)) as d from x join b1 b using (part, pos) group by all),
a1 as (select vec_id, part, arg_min(entry, d * 64 + entry) as entry from d1 group by all),
m1 as (select part, entry, pos, cast(floor(sum(c)::hugeint / count(*)) as bigint) as c from x join a1 using (vec_id, part) group by all),
b2 as materialized (select part, entry, pos, coalesce(m.c, b.c) as c from b1 b left join m1 m using (part, entry, pos)),
d2 as (select x.vec_id, x.part, entry, sum((x.c - b.c) * (x.c - b.c)) as d from x join b2 b using (part, pos) group by all),
a2 as (select vec_id, part, arg_min(entry, d * 64 + entry) as entry, min(d) as d from d2 group by all),
codes as (select vec_id, string_agg(printf('%02x', cast(entry as int)), '' order by part) as code, cast(sum(d) as bigint) as error from a2 group by 1),
book as (select sha256(string_agg(cast(c as varchar), ',' order by part, entry, pos)) as codebooks_sha256 from b2)
select vec_id, code, error, cast(label as bigint) as label, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
from kept join codes using (vec_id), book
"""
