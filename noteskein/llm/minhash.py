"""Texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8, and their components.

A 64-bit fingerprint does not tell such texts apart: they differ in up to 12 bits and more, where no key of equal bits is
left that is not shared by a good part of a large table. So candidates share one of ``BANDS`` keys of ``ROWS``
min-hashes each, and every candidate pair is decided on the shingle sets of the texts themselves. A pair at exactly 0.8 has no key
in common with probability (1 - 0.8^4)^20 = 2.6e-5, and less above.

Texts with the same shingles are one node. First each member of a bucket is compared with the bucket's hub, the node whose buckets hold
most nodes: what copies of one text keep in common is the text itself, so a family costs one pair a member. Where a bucket then
still holds several components, its members outside the largest one meet all members of others, block against block. A task
compares two blocks of about ``SIDE`` members on ``BITS`` bits of their shingle sets: bits that only one of two sets has are a lower
bound of their difference, so what is passed over is below 0.8. Of the pairs left, a first round hands on those that would
join components, the second all that are still between different ones. Both are decided on the texts. No pair is a row before that, and no result has a cap.

Defined results: a null text is an empty one; texts without words are similar to each other and to no others; rows that repeat an id, a
text or both, or have no id, are rows each, told apart by their text; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from noteskein.llm.common import sliced, stored, text_bytes, text_key, written
from noteskein.llm.components import components

SEED = 42
WIDTH = 5
#: Smallest similarity, as a fraction.
LEAST = (4, 5)
BANDS, ROWS = 20, 4
BITS = 2048
#: Members of a bucket that a task compares with as many others.
SIDE = 1024

_RANDOM = np.random.default_rng(20).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, width: int) -> np.ndarray:
    """Hash of each window of ``width`` words in lower case, or of all words where there are fewer; none without words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    width = min(width, len(words))
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: len(words) - width]]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :])], np.uint64)


def minima(found: np.ndarray) -> np.ndarray:
    """Min-hashes of a set of shingles; a set without any has those of zero."""
    found = found if len(found) else np.zeros(1, np.uint64)
    least = np.full(BANDS * ROWS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k in range(0, len(found), 2048):
        mixed = (found[k : k + 2048, None] ^ _RANDOM[0]) * _RANDOM[1]
        np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(0), out=least)
    return least


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fp`` (hash of the text), ``node`` (hash of its shingle set), ``size`` of the set, ``keys`` of its bands, and ``bits`` of its shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            nodes, sizes, keys, bits = [], [], [], []
            for text in text_bytes(batch.column(2)):
                found = np.unique(shingles(text, WIDTH))
                least = minima(found)
                nodes.append(xxhash.xxh64_intdigest(found.tobytes()))
                sizes.append(len(found))
                keys.append([xxhash.xxh64_intdigest(band.tobytes()) for band in least.reshape(BANDS, ROWS)])
                own = np.zeros(BITS, bool)
                own[(found % np.uint64(BITS)).astype(np.int64)] = True
                bits.append(np.packbits(own).tobytes())
            signed = lambda rows: pa.array(list(np.array(rows, np.uint64).view(np.int64)), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), signed(keys), pa.array(bits, pa.binary())],
                ["doc_id", "fp", "node", "size", "keys", "bits"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("fp"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long, node long, size long, keys array<long>, bits binary")


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``) whose texts are similar, by the shingle sets of one text of each node."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            found = [np.unique(shingles(t, WIDTH)).view(np.int64) for t in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "own"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for left, right in zip(batch.column(2), batch.column(3)):
                x, y = left.values.to_numpy(), right.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(LEAST[1] * both >= LEAST[0] * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "rep"), "node")
    texts = docs.select(text_key().alias("rep"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.join(written(wanted), "rep").groupBy("node").agg(F.first("text").alias("text"))
    own = stored(texts.mapInArrow(sets, "node long, own array<long>"))
    of_b = pairs.join(own.select(F.col("node").alias("b"), F.col("own").alias("of_b")), "b")
    both = of_b.join(own.select(F.col("node").alias("a"), F.col("own").alias("of_a")), "a")
    return both.select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long")


def _near_in_size(x: str, y: str) -> Column:
    return F.least(x, y) * LEAST[1] >= F.greatest(x, y) * LEAST[0]


def block_rows(members: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, once for each pair of blocks that they are in.

    Left are members outside the largest component of a bucket, right all members.
    """
    rooted = members.select("band", "key", "node").join(roots.withColumnRenamed("root", "_root"), "node", "left")
    rooted = stored(rooted.withColumn("root", F.coalesce("_root", "node")).drop("_root"))
    sizes = rooted.groupBy("band", "key", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("band", "key").agg(
        F.count(F.lit(1)).alias("n_roots"), F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most")
    )
    mixed = written(mixed.where("n_roots > 1").select(
        "band", "key", "main", F.ceil((F.col("n") - F.col("most")) / SIDE).cast("int").alias("n_left"), F.ceil(F.col("n") / SIDE).cast("int").alias("n_right")
    ))
    inside = rooted.join(mixed, ["band", "key"]).join(nodes.select("node", "size", "keys", "bits"), "node")
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    left = F.when(F.col("root") != F.col("main"), F.transform(every("n_right"), lambda j: F.struct(own("n_left").alias("i"), j.alias("j"), F.lit(0).alias("side"))))
    right = F.transform(every("n_left"), lambda i: F.struct(i.alias("i"), own("n_right").alias("j"), F.lit(1).alias("side")))
    at = F.concat(F.coalesce(left, F.array().cast("array<struct<i:int,j:int,side:int>>")), right)
    rows = inside.select(F.inline(at), "band", "key", "main", "node", "root", "size", "keys", "bits")
    return rows.repartition("band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j", "side")


class Side:
    """Columns of the members of a block."""

    def __init__(self, rows: list[tuple]):
        self.node, self.root, self.size = (np.array([r[k] for r in rows], np.int64) for k in (0, 1, 2))
        self.keys = np.array([r[3] for r in rows], np.int64).reshape(len(rows), BANDS)
        self.bits = np.frombuffer(b"".join(r[4] for r in rows), np.uint64).reshape(len(rows), BITS // 64)


def near_pairs(left: Side, right: Side, band: int, main: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of different components that may be similar and have no earlier band in common."""
    ok = left.root[:, None] != right.root[None, :]
    ok &= (right.root == main)[None, :] | (left.root[:, None] < right.root[None, :])
    low, high = np.minimum(left.size[:, None], right.size[None, :]), np.maximum(left.size[:, None], right.size[None, :])
    ok &= low * LEAST[1] >= high * LEAST[0]
    for b in range(band):
        ok &= left.keys[:, b, None] != right.keys[None, :, b]
    x, y = np.nonzero(ok)
    good = np.zeros(len(x), bool)
    for first in range(0, len(x), 1 << 15):
        part = slice(first, first + (1 << 15))
        a, b = left.bits[x[part]], right.bits[y[part]]
        only_a = np.bitwise_count(a & ~b).sum(1, dtype=np.int64)
        only_b = np.bitwise_count(b & ~a).sum(1, dtype=np.int64)
        # What both have is at most the one set without its own bits, what either has at least that set and the other's.
        most_both = np.minimum(left.size[x[part]] - only_a, right.size[y[part]] - only_b)
        least_all = np.maximum(left.size[x[part]] + only_b, right.size[y[part]] + only_a)
        good[part] = LEAST[1] * most_both >= LEAST[0] * least_all
    return x[good], y[good]


def rest_pairs(members: DataFrame, nodes: DataFrame, roots: DataFrame, joining: bool) -> DataFrame:
    """Pairs of different components that share a bucket and may be similar; with ``joining`` a forest of each pair of blocks."""
    def forest(left: Side, right: Side, x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, int]]:
        above: dict[int, int] = {}

        def top(root: int) -> int:
            while above.get(root, root) != root:
                above[root] = root = above.get(above[root], above[root])
            return root

        for i, j in zip(x.tolist(), y.tolist()):
            a, b = top(int(left.root[i])), top(int(right.root[j]))
            if a != b:
                above[max(a, b)] = min(a, b)
                yield i, j

    def compared(rows: list[tuple], band: int, main: int) -> pa.RecordBatch:
        left, right = (Side([r[1:] for r in rows if r[0] == side]) for side in (0, 1))
        x, y = near_pairs(left, right, band, main)
        if joining:
            kept = list(forest(left, right, x, y))
            x, y = (np.array([k[side] for k in kept], np.int64) for side in (0, 1))
        a, b = left.node[x], right.node[y]
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows = None, []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for i, j, side, band, key, main, *member in zip(*columns):
                if current is not None and current[:4] != (band, key, i, j):
                    yield compared(rows, current[0], current[4])
                    rows = []
                current = band, key, i, j, main
                rows.append((side, *member))
        if current is not None:
            yield compared(rows, current[0], current[4])

    return block_rows(members, nodes, roots).mapInArrow(run, "a long, b long").distinct()


def similar_links(docs: DataFrame, nodes: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """``node`` and ``root`` of the nodes with a similar one; ``candidates`` (``a``, ``b``) are tried beside those of the buckets."""
    keyed = nodes.select("node", "size", F.posexplode("keys").alias("band", "key"))
    buckets = keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"))
    members = stored(keyed.join(stored(buckets.where("n > 1")), ["band", "key"]))
    score = members.groupBy("node").agg(F.sum("n").alias("score"))
    scored = members.join(score, "node")
    hubs = scored.groupBy("band", "key").agg(F.max_by(F.struct("node", "size"), F.struct("score", "node")).alias("hub"))
    stars = members.join(stored(hubs), ["band", "key"]).where(F.col("node") != F.col("hub.node")).withColumn("other", F.col("hub.size"))
    stars = stars.where(_near_in_size("size", "other")).select(F.greatest("node", "hub.node").alias("a"), F.least("node", "hub.node").alias("b"))
    tried = stored((stars if candidates is None else stars.unionByName(candidates)).distinct())
    links = stored(verified(tried, docs, nodes))
    roots = written(components(links))
    for joining in (True, False):
        rest = stored(rest_pairs(members, nodes, roots, joining).join(tried, ["a", "b"], "left_anti"))
        if rest.isEmpty():
            continue
        links, tried = links.unionByName(stored(verified(rest, docs, nodes))), tried.unionByName(rest)
        roots = written(components(links))
    return roots


def classified(docs: DataFrame, candidates: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``doc_id``, ``fp`` of every row, and ``fp``, ``root``, ``component_id`` of every distinct text.

    ``candidates`` are pairs of texts ``a``, ``b`` (``fp``) found elsewhere, to be decided on like those of the buckets.
    """
    signed = stored(signatures(docs))
    texts = stored(signed.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min("node").alias("node")))
    nodes = signed.groupBy("node").agg(F.min("fp").alias("rep"), F.min("size").alias("size"), F.min("keys").alias("keys"), F.min("bits").alias("bits"))
    if candidates is not None:
        of_a, of_b = (texts.select(F.col("fp").alias(c), F.col("node").alias(f"of_{c}")) for c in ("a", "b"))
        candidates = candidates.join(of_a, "a").join(of_b, "b").where("of_a != of_b")
        candidates = candidates.select(F.greatest("of_a", "of_b").alias("a"), F.least("of_a", "of_b").alias("b"))
    roots = similar_links(docs, stored(nodes), candidates)
    rooted = stored(texts.join(roots, "node", "left").select("fp", "least", F.coalesce("root", "node").alias("root")))
    least = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    return signed.select("doc_id", "fp"), written(rooted.join(least, "root").select("fp", "root", "component_id"))
