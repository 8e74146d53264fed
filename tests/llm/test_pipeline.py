"""The pipeline against plain versions of its stages, and stage by stage on odd inputs."""

import zlib
from collections import defaultdict

import numpy as np

import corpus_pipeline
from noteskein.llm import pii, quality
from noteskein.llm.queries import vocabulary
from tests.llm import brute
from tests.llm.test_similar import kept as similar_kept


def test_stages_in_order(spark, sf_dir, docs, tmp_path):
    columns, rows = docs.columns, docs
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, rows, sf_dir).write.parquet(str(tmp_path / name))
        rows = spark.read.parquet(str(tmp_path / name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert rows.columns == columns
        kept.append(rows)

    plain = {r["doc_id"]: r["text"] for r in docs.collect()}
    facts = {i: quality.Facts((t or "").encode()) for i, t in plain.items()}
    plain = {i: t for i, t in plain.items() if not brute.quality(t)[5] and quality.passes(facts[i], quality.RULES)}
    assert {r["doc_id"] for r in kept[0].collect()} == set(plain)
    stay = similar_kept(sorted(plain.items()))
    plain = {i: t for i, t in plain.items() if i in stay}
    assert {r["doc_id"] for r in kept[1].collect()} == set(plain)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    gone = {d for d, _, _ in brute.leaks(plain.items(), [(r["item_id"], r["text"]) for r in items])}
    plain = {i: t for i, t in plain.items() if i not in gone}
    assert {r["doc_id"] for r in kept[2].collect()} == set(plain)
    for r in kept[3].collect():
        spans = brute.personal(plain[r["doc_id"]])
        if not pii.loose_spans(plain[r["doc_id"]], spans):
            assert r["text"] == pii.masked(plain[r["doc_id"]], spans) and r["n_chars"] == len(r["text"])
        plain[r["doc_id"]] = r["text"]
    from tokenizers import Tokenizer

    tokenizer, tokens = Tokenizer.from_file(vocabulary()), defaultdict(int)
    for r in kept[4].collect():
        ids = np.array(tokenizer.encode(plain[r["doc_id"]], add_special_tokens=False).ids + [1], "<u4").tobytes()
        assert r["ids_crc32"] == zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])])
        tokens[r["sequence_id"]] += r["length"]
    assert max(tokens.values()) <= 4096 and set(plain) == {r["doc_id"] for r in kept[4].collect()}


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(rows.columns) and rows.count() > 0


def test_odd_documents(spark, sf_dir, odd_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, odd_docs, sf_dir).collect()
        assert stage(spark, no_docs, sf_dir).isEmpty(), name
