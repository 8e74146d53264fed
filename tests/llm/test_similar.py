"""The pipeline's near-duplicate stage against a brute force on whole texts, at five words and a similarity of 0.8."""

import numpy as np
from pyspark.sql import functions as F

from noteskein.llm import minhash, simhash
from tests.llm import brute


def grams(text):
    own = brute.words((text or "").translate(brute.LOWER))
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))}


def similar(a, b):
    both = len(a & b)
    return 5 * both >= 4 * (len(a) + len(b) - both)


def kept(pairs):
    """Ids of the smallest document of each component."""
    sets, parent = [grams(t) for _, t in pairs], list(range(len(pairs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(pairs)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {pairs[find(i)][0] for i in range(len(pairs))}


def test_near_copies(spark):
    rng = np.random.default_rng(11)
    word = lambda: f"w{rng.integers(0, 5000)}"
    pairs = []
    for family in range(30):
        base = [word() for _ in range(120)]
        for copy in range(6):
            own = list(base)
            for at in rng.choice(120, rng.integers(0, 5), replace=False):
                own[at] = word()
            pairs.append((len(pairs), " ".join(own)))
    pairs += [(len(pairs), ""), (len(pairs) + 1, None), (len(pairs) + 2, "two words"), (len(pairs) + 3, "Two  WORDS")]
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == kept(pairs)


def test_whole_table(spark, docs, pairs):
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == kept(sorted(pairs))


def test_members_beside_the_first(spark):
    """In one bucket, two similar texts of which neither is similar to the smallest node are found as well."""
    rng = np.random.default_rng(5)
    texts = []
    base = [f"w{k}" for k in range(100)]
    for _ in range(40):
        own = list(base)
        for at in rng.choice(100, rng.integers(1, 7), replace=False):
            own[at] = f"x{rng.integers(0, 9)}"
        texts.append((len(texts), " ".join(own)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == kept(texts)
    assert minhash.BANDS * minhash.ROWS % 16 == 0


def family(rng, n, changed, words=120, vocabulary=5000):
    base = [f"b{rng.integers(0, vocabulary)}" for _ in range(words)]
    for _ in range(n):
        own = list(base)
        for at in rng.choice(words, changed, replace=False):
            own[at] = f"x{rng.integers(0, 10 * vocabulary)}"
        yield " ".join(own)


def test_large_families_in_small_blocks(spark, monkeypatch):
    """Copies that are similar to their base alone, copies near 0.8, and form letters that are not similar, over many blocks."""
    monkeypatch.setattr(minhash, "SIDE", 8)
    rng = np.random.default_rng(23)
    texts = [*family(rng, 60, 2), *family(rng, 60, 3), *family(rng, 60, 4), *family(rng, 120, 6)]
    pairs = [(i, text) for i, text in enumerate(rng.permutation(texts).tolist())]
    docs = spark.createDataFrame(pairs, "doc_id long, text string").repartition(5)
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} == kept(pairs)


def test_form_letters_make_few_rows(spark):
    """Letters that differ in six words share most buckets; no pair of them becomes a row."""
    letters = list(enumerate(family(np.random.default_rng(2), 400, 6)))
    docs = spark.createDataFrame(letters, "doc_id long, text string")
    nodes = minhash.signatures(docs).drop("doc_id", "fp").persist()
    members = nodes.selectExpr("node", "size", "posexplode(keys) as (band, key)").persist()
    roots = spark.createDataFrame([], "node long, root long")
    assert members.groupBy("band", "key").count().selectExpr("sum(count * (count - 1) / 2)").first()[0] > 50_000
    assert minhash.rest_pairs(members, nodes, roots, joining=False).count() < 400


def test_bound_passes_over_no_similar_pair():
    rng = np.random.default_rng(9)
    texts = [t for changed in (1, 2, 3, 4, 5) for t in family(rng, 40, changed, words=int(rng.integers(6, 400)), vocabulary=300)]
    sets = [np.unique(minhash.shingles(t.encode(), minhash.WIDTH)) for t in texts]
    rows = []
    for k, found in enumerate(sets):
        own = np.zeros(minhash.BITS, bool)
        own[(found % np.uint64(minhash.BITS)).astype(np.int64)] = True
        rows.append((k, k + 1, len(found), [k * 100 + b for b in range(minhash.BANDS)], np.packbits(own).tobytes()))
    side = minhash.Side(rows)
    x, y = minhash.near_pairs(side, side, 0, 0)
    passed = set(zip(x.tolist(), y.tolist()))
    similar_pairs = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if similar(set(sets[i].tolist()), set(sets[j].tolist()))}
    assert similar_pairs and similar_pairs <= passed and len(passed) < 2 * len(similar_pairs) + 200


def test_similar_odd(spark, odd_docs, no_docs):
    rows = [(1, "same words here now ok"), (1, "same words here now ok"), (None, "same words here now ok"), (2, None), (3, ""), (None, None), (4, "other")]
    found = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, found), key=str) == [(1, "same words here now ok"), (2, None), (4, "other")]
    assert simhash.keep_one(odd_docs).count() < odd_docs.count() and simhash.keep_one(no_docs).isEmpty()


def test_bit_sliced_search_finds_candidates(spark, monkeypatch):
    """Without a candidate from min-hashes, texts within two bits are found by their fingerprints, and the texts decide."""
    rng = np.random.default_rng(7)
    base = [f"w{n}" for n in range(2000)]
    pairs = []
    for k in range(12):
        own = list(base)
        own[k * 150] = f"x{k}"
        pairs.append((k, " ".join(own)))
    # Equal fingerprints by a long repeated line, and other texts beside it.
    line = "red green blue grey pink gold lime " * 60
    pairs += [(20 + k, line + " ".join(f"t{k}x{n}" for n in range(12))) for k in range(2)]
    pairs += [(30, "two words"), (31, "Two  WORDS"), (32, " ".join(f"y{rng.integers(0, 900)}" for _ in range(300)))]
    prints = {i: simhash.fingerprint(t.encode()) for i, t in pairs}
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    key = dict(docs.select(simhash.text_key(), "doc_id").collect())
    parent = {i: i for i in prints}
    for a, b in sorted((sorted((key[r["a"]], key[r["b"]])) for r in simhash.close_texts(docs).collect())):
        low, high = sorted((parent[a], parent[b]))
        parent = {i: low if p == high else p for i, p in parent.items()}
    close = [(i, j) for i in prints for j in prints if i < j and (prints[i] ^ prints[j]).bit_count() <= simhash.RADIUS]
    assert len(close) > 3 and (20, 21) in close and all(parent[i] == parent[j] for i, j in close)

    monkeypatch.setattr(minhash, "_near_in_size", lambda x, y: F.lit(False))
    monkeypatch.setattr(minhash, "rest_pairs", lambda members, *_: members.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0))
    stay = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert stay == {i for i in parent if parent[i] == i or i == 21}
