"""SimHash near-duplicates: fingerprints, a bit-sliced search for close ones, and their components.

A fingerprint has a bit set where more than half of the 64-bit hashes of the text's word shingles have it.
Equal fingerprints are one node, so copies cost nothing in the search. Nodes meet where two of the four
16-bit quarters agree, which any two within two bits do; a pair of quarters that very many nodes share
is divided again by thirds of the other half, of which two such nodes have one in common, so no
group grows with the table for long. Inside a group the fingerprints are stored as bit planes (one bit
vector for each of the 64 bits). A probe adds the planes that differ into carry-save counters, bit vectors
again, and gives a block up as soon as each of its members is beyond the radius. Of the links found, a
spanning forest of the group leaves it; components of all links follow by star steps.

Defined results: a text without words has fingerprint zero and is linked like any other; a null
``doc_id`` gets its fingerprint and the component of its links, with null as the smallest id only where every
member is null; repeated rows give repeated rows; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from noteskein.llm import minhash
from noteskein.llm.common import id_and_text, sliced, text_bytes, text_key, written
from noteskein.llm.components import components
from noteskein.llm.minhash import shingles

SHINGLE = 3
RADIUS = 2

#: Members of a group up to which it is compared as it is; larger ones are divided by a further key first.
GROUP = 4096
#: Fingerprints in one bit-sliced block.
BLOCK = 1024


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    hashes = shingles(text, width)
    if not len(hashes):
        return 0
    bits = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)]
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed 64-bit number, of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            found = np.array([fingerprint(t) for t in text_bytes(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, fp long")


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of up to 64 * n fingerprints: row b holds bit b of all of them."""
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    padded = np.zeros((64, -(-len(values) // 64) * 64), np.uint8)
    padded[:, : len(values)] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def close(block: np.ndarray, size: int, probes: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[int, np.ndarray]]:
    """For each probe the members of a bit-sliced block within ``radius`` bits of it.

    All probes go through the planes together. ``counters[j]`` are the j-th bits of the distances so far, ``over`` the
    members already beyond the radius. A probe whose members all are gives the block up.
    """
    n_words = block.shape[1]
    unused = np.zeros(n_words * 64, np.uint8)
    unused[size:] = 1
    outside = np.packbits(unused, bitorder="little").view(np.uint64)
    n_bits = (radius + 1).bit_length()
    limit = radius + 1
    alive = np.arange(len(probes))
    counters = np.zeros((n_bits, len(probes), n_words), np.uint64)
    over = np.repeat(outside[None, :], len(probes), 0)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for b in range(64):
        mask = np.where((probes[alive] >> np.uint64(b)) & np.uint64(1), full, np.uint64(0))
        carry = block[b][None, :] ^ mask[:, None]
        for j in range(n_bits):
            counters[j], carry = counters[j] ^ carry, counters[j] & carry
        reached = np.full_like(over, full)
        for j in range(n_bits):
            reached &= counters[j] if limit >> j & 1 else ~counters[j]
        over |= carry | reached
        if b % 4 == 3:
            going = (over != full).any(1)
            if not going.all():
                alive, counters, over = alive[going], counters[:, going], over[going]
                if not len(alive):
                    return
    for k, bits in zip(alive, ~over):
        yield int(k), np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))


def spanning_links(values: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A forest with the components of all pairs of ``values`` within ``radius``: at most one link less than values."""
    n = len(values)
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []

    def join(a: int, b: int) -> None:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            links.append((a, b))

    for start in range(0, n, BLOCK):
        part = values[start : start + BLOCK]
        sliced = planes(part)
        for first in range(start, n, BLOCK):
            for k, members in close(sliced, len(part), values[first : first + BLOCK], radius):
                for m in members:
                    if start + int(m) != first + k:
                        join(first + k, start + int(m))
    return links


PAIRS = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]


def _quarter(k: int):
    return F.shiftrightunsigned("fp", 16 * k).bitwiseAND(0xFFFF)


def keyed(nodes: DataFrame) -> DataFrame:
    """Each fingerprint under its six pairs of quarters."""
    keys = [F.struct(F.lit(n).alias("pair"), (_quarter(a) * 65536 + _quarter(b)).alias("key")) for n, (a, b) in enumerate(PAIRS)]
    return nodes.select("fp", F.inline(F.array(*keys)))


def divided(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Members of groups beyond ``GROUP`` under one more key each: a third of their other 32 bits.

    Two fingerprints within two bits that share a group differ in at most two of three parts.
    """
    rest = [[k for k in range(4) if k not in pair] for pair in PAIRS]
    other = F.lit(None).cast("long")
    for n, (a, b) in enumerate(rest):
        other = F.when(F.col("pair") == n, _quarter(a) * 65536 + _quarter(b)).otherwise(other)
    parts = F.array(*[
        F.struct(F.lit(k).alias("part"), F.shiftrightunsigned(other, 11 * k).bitwiseAND(0x7FF if k < 2 else 0x3FF).alias("third"))
        for k in range(3)
    ])
    large = rows.join(sizes, ["pair", "key"], "left_semi")
    return large.select("fp", "pair", "key", F.inline(parts))


def links(nodes: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints that have all components of the pairs within the radius."""
    rows = keyed(nodes)
    sizes = rows.groupBy("pair", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    small = rows.join(sizes.where(F.col("n") <= GROUP), ["pair", "key"], "left_semi")
    small = small.withColumns({"part": F.lit(0), "third": F.lit(0).cast("long")})
    large = divided(rows, sizes.where(F.col("n") > GROUP))
    groups = small.unionByName(large.select(*small.columns)).repartition("pair", "key", "part", "third")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups arrive sorted; a batch may end inside one."""
        held: list[pd.DataFrame] = []
        names = ["pair", "key", "part", "third"]

        def flush(frame: pd.DataFrame) -> pa.RecordBatch:
            """Small groups share a block: a link between two of them is a link all the same."""
            found: list[list[int]] = [[], []]
            keys, fps = frame[names].to_numpy(), frame["fp"].to_numpy()
            cuts = [*(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(frame)]
            start = end = 0
            for cut in cuts:
                if cut - start > BLOCK and end > start:
                    compare(fps[start:end], found)
                    start = end
                end = cut
            compare(fps[start:end], found)
            return pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], ["a", "b"])

        def compare(fps: np.ndarray, found: list[list[int]]) -> None:
            for x, y in spanning_links(np.ascontiguousarray(fps).view(np.uint64)):
                if fps[x] != fps[y]:
                    found[0].append(int(fps[x]))
                    found[1].append(int(fps[y]))

        for batch in batches:
            frame = batch.to_pandas()
            if not len(frame):
                continue
            held.append(frame)
            whole = pd.concat(held, ignore_index=True)
            last = (whole[names].to_numpy() == whole[names].to_numpy()[-1]).all(1)
            if last.all():
                held = [whole]
                continue
            cut = len(whole) - int(last[::-1].argmin())
            yield flush(whole[:cut])
            held = [whole[cut:]]
        if held:
            yield flush(pd.concat(held, ignore_index=True))

    ordered = groups.select("pair", "key", "part", "third", "fp").sortWithinPartitions("pair", "key", "part", "third")
    return ordered.mapInArrow(run, "a long, b long")


def classified(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fingerprint of every row, and ``fp``, ``root``, ``component_id`` of every distinct fingerprint."""
    prints = written(fingerprints(docs))
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes.select("fp")))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints, written(rooted.join(least, "root").select("fp", "root", "component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` of every row of ``docs``."""
    prints, classes = classified(docs)
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def close_texts(docs: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` of different texts, by their hashes, that have all components of those with close fingerprints.

    A text is paired with the smallest text of its fingerprint, and such texts along the links of the bit-sliced search.
    """
    prints = written(fingerprints(docs.select(text_key().alias("doc_id"), "text")).distinct())
    first = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    equal = prints.join(first, "fp").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    of_a, of_b = (first.select(F.col("fp").alias(c), F.col("first").alias(f"of_{c}")) for c in ("a", "b"))
    near = links(first.select("fp")).join(of_a, "a").join(of_b, "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    return equal.unionByName(near).where("a != b").distinct()


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component of similar texts (``minhash``), the one with the smallest id, with all columns.

    Candidates are the texts that the bit-sliced search links, and those that share min-hashes, as most near copies are
    beyond the radius of the fingerprints; the texts decide both.
    Rows that repeat an id, or have none, are told apart by text: of the rows with the smallest id of a
    component one stays, and a row without an id stays only where no row of its component has one.
    """
    prints, classes = minhash.classified(docs, close_texts(docs))
    marked = prints.join(classes, "fp")
    gone = marked.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone")).distinct()
    repeated = written(prints.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_twice")))
    odd = not repeated.isEmpty() or not prints.where("doc_id IS NULL").isEmpty()
    doc_id = docs["doc_id"].cast("long")
    if not odd:
        return docs.join(gone, doc_id == F.col("_gone"), "left_anti")
    single = docs.where(doc_id.isNotNull()).join(repeated, doc_id == F.col("_twice"), "left_anti")
    plain = single.join(gone, single["doc_id"].cast("long") == F.col("_gone"), "left_anti")
    rest = docs.where(doc_id.isNull()).unionByName(docs.join(repeated, doc_id == F.col("_twice"), "left_semi"))
    named = classes.select(F.col("fp").alias("_fp"), F.col("root").alias("_root"), F.col("component_id").alias("_component"))
    rest = rest.withColumn("_print", text_key()).join(named, F.col("_print") == F.col("_fp"))
    rest = rest.where(F.col("doc_id").cast("long").eqNullSafe(F.col("_component"))).dropDuplicates(["_root"])
    return plain.unionByName(rest.select(*docs.columns))
