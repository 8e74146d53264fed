"""Tiling, lines, suffix arrays, SimHash, packing, suffix trees, archives: plain versions and odd inputs."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from noteskein.llm import components, decontaminate, lines, packing, simhash, suffix_array, suffix_tree, warc
from noteskein.llm.queries import ORACLES, QUERIES, vocabulary
from tests.compare import connect, difference
from tests.llm import brute


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(name, spark, sf_dir):
    assert difference(spark, connect(sf_dir), QUERIES[name], ORACLES[name], sf_dir) is None


# Decontamination

def test_leaks(spark, sf_dir, docs, pairs):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = {(r["doc_id"], r["item_id"], r["covered"]) for r in decontaminate.leaks(docs, items).collect()}
    assert found == brute.leaks(pairs, [(r["item_id"], r["text"]) for r in items.collect()]) and found


def test_reordered_and_short_items(spark):
    item = "one two three four five six seven. eight nine ten eleven twelve thirteen"
    turned = "so eight nine ten eleven twelve thirteen, then ONE two three four five six seven ok"
    docs = spark.createDataFrame([(1, turned), (2, "one two three four"), (3, "a tiny item here"), (3, "again"), (None, item)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item, 1), (8, "tiny item", 2), (9, None, 3), (10, "...", 4), (None, "tiny item here", 5)], "item_id long, text string, width int")
    found = decontaminate.leaks(docs, items).collect()
    assert {(r["doc_id"], r["item_id"], r["n_tiles"]) for r in found} == {(1, 7, 2), (None, 7, 1), (3, 8, 1), (3, None, 1)}
    kept = decontaminate.remove_leaks(docs, items)
    assert Counter(map(tuple, kept.collect())) == Counter([(2, "one two three four"), (3, "again")]) and kept.columns == docs.columns


def test_items_of_one_id(spark):
    """Items without an id, or with the same one, are different items where their texts differ."""
    long, short = "one two three four five six seven eight nine ten", "five six seven eight nine"
    other, tail = "a b c d e f g h i j k l", "g h i j k l"
    rows = [(None, long), (None, short), (4, other), (4, tail)]
    items = spark.createDataFrame(rows, "item_id long, text string")
    docs = [(1, "so " + long), (2, "and " + short + " only"), (3, other), (4, "x " + tail), (5, "c d e f g h i")]
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert {(r["doc_id"], r["item_id"], r["covered"]) for r in found} == brute.leaks(docs, rows)
    assert Counter((r["doc_id"], r["item_id"], r["n_words"]) for r in found)[1, None, 10] == 1


def test_clean_rows_beside_a_leak_stay(spark):
    """A leak removes its own text alone, not the others that have its id, or none either."""
    item = "one two three four five six seven"
    rows = [(None, "x " + item), (None, "a clean text"), (None, None), (2, item), (2, item), (2, "clean as well"), (3, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = decontaminate.remove_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert Counter(map(tuple, kept.collect())) == Counter([(None, "a clean text"), (None, None), (2, "clean as well"), (3, "clean")])


def test_tiles_like_plain():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = rng.integers(1, 4, rng.integers(5, 60)), rng.integers(1, 4, rng.integers(5, 30))
        made = decontaminate.tiles(a, b, 3)
        assert all((a[d : d + n] == b[i : i + n]).all() for d, i, n in made)
        for side in (0, 1):
            places = [p for t in made for p in range(t[side], t[side] + t[2])]
            assert len(places) == len(set(places))
        assert max((n for _, _, n in made), default=0) == max(
            (n for n in range(3, 31) for i in range(len(b) - n + 1) for d in range(len(a) - n + 1) if (a[d : d + n] == b[i : i + n]).all()), default=0
        )


def test_leaks_odd(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta")], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.leaks(odd_docs, items).collect()} == {1, 2}
    assert decontaminate.leaks(no_docs, items).isEmpty() and decontaminate.leaks(odd_docs, items.where("false")).isEmpty()
    assert decontaminate.remove_leaks(odd_docs, items).count() == 9


# Lines

def test_lines_odd(odd_docs, no_docs):
    rows = lines.deduplicate(odd_docs).collect()
    assert len(rows) == 12 and lines.deduplicate(no_docs).isEmpty()
    assert [r["text"] for r in rows if r["doc_id"] == 2] == ["", ""]
    assert all(not r["spans"] for r in rows if r["doc_id"] != 2)


def test_lines_keep_offsets(spark):
    docs = spark.createDataFrame([(2, "x\nÉ same line of five words\ny"), (1, "é a\nÉ  same LINE of five words\nshort one")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in lines.deduplicate(docs).collect()}
    assert rows[1]["spans"] == [] and [tuple(s) for s in rows[2]["spans"]] == [(2, 27)] and rows[2]["text"] == "x\ny"


# Suffix arrays

def _removed(docs, **how):
    found = suffix_array.deduplicate(docs, **how).collect()
    return {(r["doc_id"], r["n_bytes"]): (bytes(r["text"]), [tuple(s) for s in r["removed"]]) for r in found}


def _wanted(pairs, length):
    texts = [(t or "").encode() for _, t in pairs]
    wanted = {}
    for (doc_id, _), text, mask in zip(pairs, texts, brute.repeated_bytes(texts, length)):
        runs, start = [], None
        for i, bit in enumerate([*mask, 0]):
            if bit and start is None:
                start = i
            elif not bit and start is not None:
                runs.append((start, i))
                start = None
        wanted[doc_id, len(text)] = bytes(b for b, bit in zip(text, mask) if not bit), runs
    return wanted


def test_repeated_bytes(docs, pairs):
    assert _removed(docs) == _wanted(pairs, 400)


@pytest.mark.parametrize("group", [4096, 3])
def test_repeated_bytes_in_small_alphabets(spark, group):
    """Texts glued from few pieces: many segments share seeds; with a small bound all groups are split."""
    rng = np.random.default_rng(group)
    pieces = ["".join(rng.choice(list("ab"), rng.integers(5, 60))) for _ in range(12)]
    pairs = [(i, "".join(pieces[k] + "c" * rng.integers(0, 3) for k in rng.integers(0, 12, rng.integers(1, 12)))) for i in range(40)]
    pairs += [(100, "ab" * 200), (101, "a" * 150), (102, "")]
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    assert _removed(docs, length=40, group=group, seed=8) == _wanted(pairs, 40)


def test_deep_shallow_order():
    rng = np.random.default_rng(5)
    for size in (1, 2, 50, 300):
        stem = bytes(rng.integers(97, 99, 80).astype(np.uint8))
        strings = list({stem[: rng.integers(10, 80)] + bytes(rng.integers(97, 100, rng.integers(0, 60)).astype(np.uint8)) for _ in range(size)})
        order = suffix_array.deep_shallow(strings, 10, 4)
        assert [strings[k] for k in order] == sorted(strings)


def test_repeated_bytes_odd(odd_docs, no_docs):
    rows = suffix_array.deduplicate(odd_docs).collect()
    assert len(rows) == 12 and suffix_array.deduplicate(no_docs).isEmpty()
    long = next(r for r in rows if r["doc_id"] == 5)
    assert long["text"] == b"" and [tuple(s) for s in long["removed"]] == [(0, 220_000)]


# SimHash

def test_near_duplicates(docs, pairs):
    prints = [(i, brute.fingerprint(t)) for i, t in pairs]
    wanted = dict(zip([i for i, _ in pairs], brute.near_components(prints)))
    found = simhash.near_duplicates(docs).collect()
    assert {r["doc_id"]: r["fp"] % 2**64 for r in found} == dict(prints)
    assert {r["doc_id"]: r["component_id"] for r in found} == wanted


@pytest.mark.parametrize("group", [4096, 8])
def test_dense_fingerprints(spark, monkeypatch, group):
    """Few different bits: large groups, long chains, and groups that have to be divided."""
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = np.random.default_rng(7)
    prints = {int(sum(1 << int(b) for b in rng.choice([1, 2, 3, 20, 21, 40, 41, 60, 61, 63], 4))) for _ in range(150)}
    prints |= {int(rng.integers(0, 2**63)) for _ in range(50)}
    values = [(i, v - 2**64 if v >= 2**63 else v) for i, v in enumerate(sorted(prints))]
    nodes = spark.createDataFrame([(v,) for _, v in values], "fp long")
    roots = {r["node"]: r["root"] for r in components.components(simhash.links(nodes)).collect()}
    wanted = brute.near_components([(i, v % 2**64) for i, v in values])
    classes = defaultdict(set)
    for (_, v), w in zip(values, wanted):
        classes[w].add(roots.get(v, v))
    assert all(len(c) == 1 for c in classes.values()) and len({next(iter(c)) for c in classes.values()}) == len(classes)


def test_components_of_a_chain(spark):
    links = spark.range(300).select(((F.col("id") * 37) % 301).alias("a"), ((F.col("id") * 37 + 37) % 301).alias("b"))
    found = components.components(links.unionByName(spark.createDataFrame([(900, 901), (5, 5)], "a long, b long"))).collect()
    assert Counter(r["root"] for r in found) == {0: 301, 900: 2}
    assert components.components(links.where("false")).isEmpty()


def test_simhash_odd(odd_docs, no_docs):
    found = simhash.near_duplicates(odd_docs).collect()
    assert len(found) == 12 and simhash.near_duplicates(no_docs).isEmpty() and simhash.keep_one(no_docs).isEmpty()
    # The empty texts, one of them without id, are linked at fingerprint zero.
    assert {(r["doc_id"], r["component_id"]) for r in found if r["fp"] == 0} == {(3, 3), (4, 3), (None, 3), (6, 3)}
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter((r["doc_id"], r["text"] or "") for r in kept.collect()) == Counter({
        (i, t or "") for i, t in {(r["doc_id"], r["text"]) for r in odd_docs.collect()} if i not in (2, 4, 6) and (i, t) != (None, None)
    })


# Packing

def test_packing(docs, pairs):
    from tokenizers import Tokenizer

    tokenizer, rows = Tokenizer.from_file(vocabulary()), packing.pack(docs, vocabulary(), with_ids=True)
    found = defaultdict(list)
    for r in rows.collect():
        found[r["doc_id"]].append(r)
    for doc_id, text in pairs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        data = np.array(ids, "<u4").tobytes()
        own = sorted(found[doc_id], key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in own] == [(a, min(4096, len(ids) - a)) for a in range(0, len(ids), 4096)]
        assert all(r["ids_crc32"] == zlib.crc32(data[4 * r["start"] : 4 * (r["start"] + r["length"])]) for r in own)
    sequences = defaultdict(list)
    for own in found.values():
        for r in own:
            sequences[r["sequence_id"]].append((r["offset"], r["length"], bytes(r["ids"])))
    for parts in sequences.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r["length"] for own in found.values() for r in own)
    assert len(sequences) <= -(-total // 4096) + 1
    for r in packing.sequences(rows).collect():
        assert bytes(r["ids"]) == b"".join(p[2] for p in sorted(sequences[r["sequence_id"]]))


def test_words_encode_like_texts():
    from tokenizers import Tokenizer

    tokenizer, encoder = Tokenizer.from_file(vocabulary()), packing.Encoder(vocabulary())
    texts = ["It's  we'll,' o'er... Été́ é ΣΣΣ ẞİ 　 x y 12½² \t\r\n\x0b z", "中文字符. हिन्दी \U0001f600\U0001f600 a.b,c don't can't''s", "", " ", "\n\n\n", "ABC ABC. abc, Abc! abc!? abc;:"]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def _fewest(pieces, capacity):
    """Least number of bins, by trying all."""
    pieces, best = sorted(pieces, reverse=True), len(pieces)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(pieces):
            best = len(rooms)
            return
        for i in range(len(rooms)):
            if rooms[i] >= pieces[k] and rooms[i] not in rooms[:i]:
                place(k + 1, [*rooms[:i], rooms[i] - pieces[k], *rooms[i + 1 :]])
        place(k + 1, [*rooms, capacity - pieces[k]])

    place(0, [])
    return best


def test_bin_completion_is_best_on_small_cases():
    rng = np.random.default_rng(11)
    better = 0
    for _ in range(150):
        pieces = rng.integers(10, 60, rng.integers(3, 12)).tolist()
        counts = dict(Counter(pieces))
        plan = packing.bin_completion(counts, 100)
        assert Counter({k: sum(u * n for u, f in plan for length, n in f if length == k) for k in counts}) == Counter(pieces)
        assert all(sum(length * n for length, n in f) <= 100 for _, f in plan)
        size = sum(u for u, _ in plan)
        assert size == _fewest(pieces, 100)
        better += size < sum(u for u, _ in packing.best_fit(counts, 100))
    assert better > 0


def test_dominance():
    assert packing.dominates((50,), (20, 30)) and packing.dominates((30, 20), (25, 20)) and not packing.dominates((30, 20), (40,))


def test_packing_odd(odd_docs, no_docs):
    rows = packing.pack(odd_docs, vocabulary()).collect()
    assert packing.pack(no_docs, vocabulary()).isEmpty()
    assert sum(r["piece"] == 0 for r in rows) == 12 and sum(r["length"] == 1 for r in rows if r["piece"] == 0) == 4


# Suffix trees

def test_word_counts(docs, pairs):
    wanted = brute.unigrams(pairs)
    for r in suffix_tree.score(docs).collect():
        held, tokens, known, total, base = wanted[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, tokens, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0


def _plain_tree(texts, scored, least):
    """Scores by dictionaries of contexts."""
    depth, end = suffix_tree.DEPTH, b"\n"
    counts = defaultdict(Counter)
    for text in texts:
        symbols = end * depth + b" ".join((text or "").encode().lower().split()) + end
        for i in range(depth, len(symbols)):
            for k in range(depth + 1):
                counts[symbols[i - k : i]][symbols[i]] += 1
    total = sum(counts[b""].values())
    kept = {context for context in counts if len(context) < 2} | {b""}
    for context, after in list(counts.items()):
        n = sum(after.values())
        if len(context) < 2 or n < least:
            continue
        above = counts[context[1:]]
        gain = sum(c * math.log(c / n / (above[s] / sum(above.values()))) for s, c in after.items())
        if gain > 0.5 * len(after) * math.log(max(n, 2)):
            kept |= {context[k:] for k in range(len(context))}

    def p(context, symbol):
        if not context:
            return (counts[b""][symbol] + 1) / (total + 256)
        after = counts[context]
        return (after[symbol] + len(after) * p(context[1:], symbol)) / (sum(after.values()) + len(after))

    found = []
    for text in scored:
        symbols = end * depth + b" ".join((text or "").encode().lower().split()) + end
        states = (next(symbols[i - k : i] for k in range(depth, -1, -1) if symbols[i - k : i] in kept) for i in range(depth, len(symbols)))
        found.append(sum(math.log10(p(state, symbols[i])) for i, state in enumerate(states, depth)))
    return found


@pytest.mark.parametrize("least", [2, 8, 50])
def test_tree_scores(spark, monkeypatch, least):
    rng = np.random.default_rng(13)
    names = ["the", "of", "tion", "heather", "Thing", "a", "дом", "\x00", "été", "家"]
    pairs = [(i, " ".join(rng.choice(names, rng.integers(0, 40)))) for i in range(120)] + [(7, "again"), (7, "again"), (None, "no id"), (8, None)]
    docs = spark.createDataFrame(pairs, "doc_id long, text string").repartition(5)
    held = {i for i, _ in pairs if zlib.crc32(str("" if i is None else i).encode()) % 7 == 2}
    wanted = _plain_tree([t for i, t in pairs if i not in held], [t for _, t in pairs], least)
    found = sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in suffix_tree.score(docs, least).collect())
    wanted = sorted((str(i), len((t or "").split()) + 1, s) for (i, t), s in zip(pairs, wanted))
    assert [r[:2] for r in found] == [r[:2] for r in wanted]
    assert [r[2] for r in found] == pytest.approx([r[2] for r in wanted], rel=1e-5)


def test_tree_in_small_parts(spark, docs, monkeypatch):
    """Neither chunks nor blocks nor the length of runs change a score."""
    whole = {r["doc_id"]: r["score"] for r in suffix_tree.score(docs).collect()}
    monkeypatch.setattr(suffix_tree, "ENTRIES", 999)
    blocks = suffix_tree.stored(suffix_tree.packed(docs))
    runs = suffix_tree.stored(suffix_tree.requests(blocks, 7))
    values = suffix_tree.valued(runs, suffix_tree.pair_counts(runs))
    assert values.count() > 20 and len(whole) == docs.count()
    found = {}
    for r in values.where("space = 1").collect():
        codes = suffix_tree.unpack_codes(r["codes"], r["n"]).tolist()
        found.update(zip(codes, suffix_tree.unplanes(r["found"], r["n"], np.float32).tolist()))
    for r in docs.limit(20).collect():
        symbols, _, _ = suffix_tree.stream([suffix_tree.normal((r["text"] or "").encode())])
        codes = np.concatenate([c for _, c in suffix_tree.windows(symbols)]).tolist()
        assert whole[r["doc_id"]] == pytest.approx(sum(map(found.__getitem__, codes)), rel=1e-5)


def test_contexts_grow_with_the_table(spark, docs):
    """Ten times the text keeps contexts that a tenth has too rarely."""
    def windows(frame):
        blocks = suffix_tree.stored(suffix_tree.packed(frame))
        return suffix_tree.valued(runs := suffix_tree.stored(suffix_tree.requests(blocks, 4)), suffix_tree.pair_counts(runs)).where("space = 1").agg(F.sum("n")).first()[0]

    assert windows(docs) > 2 * windows(docs.where("doc_id % 10 = 0"))


def test_tree_learns(spark, sf_dir):
    """Held-out texts are more likely under the tree than under smoothed words, on the larger table."""
    import os

    folder = sf_dir.replace("sf0.001", "sf0.1")
    if not os.path.isdir(folder):
        pytest.skip("no larger table")
    rows = suffix_tree.score(spark.read.parquet(f"{folder}/documents.parquet")).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert rows["s"] > rows["b"]


def test_tree_odd(odd_docs, no_docs):
    rows = suffix_tree.score(odd_docs).collect()
    assert len(rows) == 12 and all(math.isfinite(r["score"]) for r in rows)
    assert suffix_tree.score(no_docs).isEmpty()
    only_held = odd_docs.where("doc_id = 5").withColumn("doc_id", F.lit(next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)))
    row = suffix_tree.score(only_held).first()
    assert row["held_out"] and row["n_known"] == 0 and row["train_tokens"] == 0


# Archives

def test_archives(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    wanted = brute.warc([(r["page_id"], r["html"]) for r in pages.collect()])
    rows = QUERIES["op2_capture_index"](spark, sf_dir).collect()
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows} == wanted
    assert len(rows) == len(wanted)


def test_index_finds_every_key(spark, tmp_path):
    rng = np.random.default_rng(17)
    urls = [f"http://{'abc'[k % 3]}.example.org/{int(n)}" for k, n in enumerate(rng.integers(0, 60, 400))] + ["http://hot.example.org/"] * 300
    pages = spark.createDataFrame([(i, u, f"<p>{i % 150}</p>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    folder = str(tmp_path / "warc")
    captures = warc.write_archives(pages, folder)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    shards = warc.write_index(captures, folder, block_lines=7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert shards.count() > 1
    for url in (*set(urls[:40]), "http://hot.example.org/", "http://no.example.org/", "http://zzz.example/"):
        keys = spark.createDataFrame([(warc.url_key(url),)], "key string")
        records = warc.read_records(warc.lookup(keys, shards, folder), folder).collect()
        assert sorted(r["page_id"] for r in records) == [i for i, u in enumerate(urls) if u == url]
        assert all(bytes(r["payload"]).decode() == f"<p>{r['page_id'] % 150}</p>" for r in records if r["record_type"] == "response")


def test_archives_odd(spark):
    rows = [(1, None, None, 3), (2, "http://a.b/ c\r\nX: y", "", 3), (None, "::bad::[", "x", 3), (3, "https://Ü.example/é?q#f", "é\r\n\r\nWARC/1.1", 3), (None, None, "only", 3), (3, "", "é\r\n\r\nWARC/1.1", 3), (4, "http://h:99999/", "x", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    found = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect())
    assert found == Counter([
        (1, 0, "revisit", 2), (2, 0, "response", None), (None, 1, "revisit", 4), (4, 1, "response", None),
        (3, 14, "response", None), (3, 14, "response", None), (None, 4, "response", None),
    ])
    assert warc.round_trip(pages.where("false")).isEmpty()
    assert warc.url_key("HTTPS://Sub.Example.COM:8443/a b?c=d#e") == "com,example,sub:8443)/a%20b?c=d"
