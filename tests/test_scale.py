"""Blocked sums, lookups and sessions against brute force, with tiny blocks and hot keys."""

import random

from pyspark.sql import functions as F

from noteskein import scale
from noteskein.operators import chunking, tracking as K


def test_running_total_levels(spark):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(4)}", i * 3 + rng.randrange(3), rng.randrange(-5, 9)) for i in range(800)]
    df = spark.createDataFrame(data, "k string, pos bigint, v int")
    wanted, sums = {}, {}
    for k, pos, v in sorted(data, key=lambda r: r[1]):
        sums[k] = sums.get(k, 0) + v
        wanted[(k, pos)] = sums[k]
    for width, levels in ((7, 1), (5, 3), (100000, 1)):
        got = scale.running_total(df, ["k"], "pos", F.col("v"), "s", width, levels).collect()
        assert {(r["k"], r["pos"]): r["s"] for r in got} == wanted
        assert len(got) == len(data)


def test_previous_crosses_blocks(spark):
    df = spark.range(50).select(F.lit("a").alias("k"), F.col("id").alias("pos"), (F.col("id") * 2).alias("v"))
    got = {r["pos"]: r["p"] for r in scale.with_previous(df, ["k"], "pos", {"v": "p"}, 4).collect()}
    assert got == {i: (2 * (i - 1) if i else None) for i in range(50)}


def _facts(spark, hot, rows=40_000):
    """``hot`` of every hundred rows have one key (NULL where the key is None), the others keys of their own."""
    return lambda key: spark.range(0, rows, 1, 8).select(
        F.when(F.col("id") % 100 < hot, F.lit(key)).otherwise((F.col("id") % 5000).cast("string")).alias("k"), "id",
        F.repeat(F.md5(F.col("id").cast("string")), 4).alias("pad"),
    )


def test_lookup_ways_agree(spark):
    facts = _facts(spark, 33)("hot").union(spark.createDataFrame([(None, 50_000, "")], "k string, id bigint, pad string"))
    dim = spark.range(40).select(F.col("id").cast("string").alias("name"), F.col("id").alias("v")).union(spark.createDataFrame([("hot", 99)], "name string, v bigint"))
    results = []
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for threshold in (before, "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        for how in ("left", "inner"):
            joined = scale.lookup(facts, dim, F.col("k"), "name", ["id"], how)
            results.append(sorted((r["id"], r["v"] if r["v"] is not None else -1) for r in joined.select("id", "v").collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert results[0] == results[2] and results[1] == results[3]
    assert len(results[0]) == 40_001 and len(results[1]) < 40_001


def _rows_per_task(spark, joined):
    """Rows by task of the join; the wide column takes part, so that it is read."""
    counted = joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.max("pad"), F.max("v"))
    return [r["n"] for r in counted.collect()]


def test_lookup_spreads_hot_and_missing_keys(spark, no_broadcast):
    dim = spark.range(5000).select(F.col("id").cast("string").alias("name"), F.col("id").alias("v")).union(spark.createDataFrame([("hot", 99)], "name string, v bigint"))
    conf = {
        "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for hot, key in ((99, None), (33, "hot")):
            for how in ("left", "inner"):
                rows = _rows_per_task(spark, scale.lookup(_facts(spark, hot)(key), dim, F.col("k"), "name", ["id"], how))
                assert sum(rows) == (40_000 if how == "left" or key else 400) and max(rows) < 0.2 * max(sum(rows), 2000), (hot, key, how, rows)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_missing_keys_are_a_group_of_running_totals(spark):
    df = spark.createDataFrame([(None, 0, 1), (None, 1, 2), ("a", 0, 5)], "k string, pos bigint, v int")
    got = scale.running_total(df, ["k"], "pos", F.col("v"), "s", 1).collect()
    assert sorted((r["k"] or "", r["pos"], r["s"]) for r in got) == [("", 0, 1), ("", 1, 3), ("a", 0, 5)]


def test_sessions_against_brute_force(spark):
    rng = random.Random(7)
    data = []
    for vault in ("a", "b"):
        now = 3_599_000_000
        for _ in range(400):
            now += rng.choice([1, 500_000, 59_999_999, 60_000_000, 60_000_001, 30_000_000, 3_700_000_000])
            data.append((vault, f"p{rng.randrange(9)}.md", now))
    wanted, paths = [], set()
    for vault in ("a", "b"):
        rows = sorted((t, p) for v, p, t in data if v == vault)
        start, last, n = None, None, 0
        for t, p in rows:
            if last is None or t - last >= 60_000_000:
                if last is not None:
                    wanted.append((vault, start, last + 60_000_000, n))
                start, n = t, 0
            last, n = t, n + 1
            paths.add((vault, start, p))
        wanted.append((vault, start, last + 60_000_000, n))
    events = spark.createDataFrame(data, "vault_id string, path string, ts_us bigint")
    sessions = K.debounce_sessions(events)
    assert sorted(tuple(r) for r in sessions.collect()) == sorted(wanted)
    assert {tuple(r) for r in K.session_paths(events, sessions).collect()} == paths


def test_sessions_of_the_fixture(spark):
    seconds = [0, 30, 50, 300]
    events = spark.createDataFrame([("v", "a.md", s * 1_000_000) for s in seconds], "vault_id string, path string, ts_us bigint")
    assert sorted((r["start_us"], r["fires_us"]) for r in K.debounce_sessions(events).collect()) == [(0, 110_000_000), (300_000_000, 360_000_000)]


def test_chunks_are_whole_and_prefer_good_ends(spark):
    texts = ["", "a" * 95, "One two. Three four.\n\nFive six seven.\n\n# Head\nmore text here. And so on.", "x" * 10 + " " + "y" * 30, "é\n" * 50]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, body string")
    rows = df.select("id", "body", chunking.chunk_texts(F.col("body"), 10).alias("c")).collect()
    for row in rows:
        assert "".join(row["c"]) == row["body"] and all(len(c) <= 40 for c in row["c"])
    assert rows[2]["c"][0] == "One two. Three four.\n\nFive six seven.\n\n"[:len(rows[2]["c"][0])] and rows[2]["c"][0].endswith("\n\n")
    assert rows[3]["c"][0] == "x" * 10 + " "
    assert [r["chunk_index"] for r in chunking.chunk_notes(df.where("id = '1'"), 10).orderBy("chunk_index").collect()] == [0, 1, 2]


def test_semantic_chunks_with_tiny_blocks(spark):
    rng = random.Random(3)
    data = []
    for note, n in (("hot", 60), ("b", 7), ("c", 1)):
        for pos in range(n):
            data.append((note, pos, [1.0, rng.choice([0.0, 0.1, 0.1, 0.1, 3.0])], rng.choice([0, 10, 40, 60, 250])))
    wanted = []
    for note in ("hot", "b", "c"):
        rows = [r for r in data if r[0] == note]
        held, chunks = 0, []
        for i, (_, pos, v, tokens) in enumerate(rows):
            if i:
                p = rows[i - 1][2]
                like = (v[0] * p[0] + v[1] * p[1]) / ((v[0] ** 2 + v[1] ** 2) * (p[0] ** 2 + p[1] ** 2)) ** 0.5
            # A sentence that does not fit opens the next chunk.
            if i == 0 or like < 0.75 or held + tokens > 100:
                held = 0
                chunks.append([])
            chunks[-1].append((pos, tokens))
            held += tokens
        for index, members in enumerate(chunks):
            wanted.append((note, index, len(members), members[0][0], sum(t for _, t in members)))
    df = spark.createDataFrame(data, "note_id string, pos bigint, embedding array<double>, token_count int")
    got = chunking.semantic_chunks(df, max_tokens=100, width=4).select("note_id", "chunk_index", "n_sentences", "first_pos", "token_count")
    assert sorted(tuple(r) for r in got.collect()) == sorted(wanted)
