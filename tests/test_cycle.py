"""Whole cycles over a small vault, classification with a cache, and the stream."""

import datetime
import os

from pyspark.sql import functions as F

from noteskein.operators.extraction import cached_responses, with_chunk_key
from noteskein.plans.build import full_cycle, run_cycle
from noteskein.plans.classify_run import classify, store_results
from noteskein.plans.stand_ins import rule_based_classifier, rule_based_model
from noteskein.schemas import FILE_EVENTS, TASKS
from noteskein.sources.notes import load_notes
from noteskein.streaming import events as E
from tests.test_files import write

VAULT = {
    "People/ann.md": "---\nage: 7\nresolves:\n  - ACME -> Acme Corp\n---\n[[ann]] works at [[ACME]].\n[[ann]] advises [[ann]].\n",
    "People/bo.md": "[[bo]] works at [[ACME]].\n[[ann]]\n",
    "Companies/Zeta.md": "[[Zeta]] partners with [[ACME]].\n",
}


def snapshot(graph):
    return {
        "entities": sorted((r["category"], r["id"], r["entity_types"], r["metadata"]) for r in graph.entities.collect()),
        "edges": sorted(map(tuple, graph.edges.collect())),
        "links": sorted(map(tuple, graph.note_links.collect())),
        "references": sorted(map(tuple, graph.references.collect())),
        "entity_links": sorted(map(tuple, graph.entity_links.collect())),
    }


def test_cycles(spark, tmp_path):
    vault, root = str(tmp_path / "vault"), str(tmp_path / "store")
    write(vault, VAULT)


    def ask(texts):
        with open(f"{tmp_path}/calls", "a") as log:
            log.write("x" * len(texts))
        return rule_based_model(texts)

    notes = load_notes(spark, vault)
    first = snapshot(run_cycle(notes, notes, ask, "p", root, 1))
    asked = os.path.getsize(f"{tmp_path}/calls")
    assert first["edges"] == [
        ("COMPANY_TO_COMPANY", "ACME", "Zeta", "partners_with"), ("PERSON_TO_COMPANY", "ann", "Acme Corp", "works_at"), ("PERSON_TO_COMPANY", "bo", "ACME", "works_at"),
    ]
    names = {(c, i) for c, i, *_ in first["entities"]}
    assert {("Person", "ann"), ("Company", "ann"), ("Company", "Acme Corp"), ("Company", "ACME"), ("Company", "Zeta")} <= names
    assert ("People/bo.md", "People/ann.md") in first["links"] or ("People/ann.md", "People/ann.md") in first["links"]
    assert ("PERSON_NOTE", "ann", "People/ann.md") in first["entity_links"]
    metadata = {i: m for c, i, t, m in first["entities"] if c == "Person"}
    assert metadata["ann"] == '{"age":7}' and metadata["bo"] == ""
    types = {(c, i): t for c, i, t, m in first["entities"]}
    assert types[("Person", "ann")] == "Person" and types[("Company", "Zeta")] == "Company"
    # The same cycle again changes nothing and asks for nothing.
    assert snapshot(run_cycle(notes, notes, ask, "p", root, 2)) == first
    assert os.path.getsize(f"{tmp_path}/calls") == asked
    # Every edge ends in a node; no self loops; equal kinds in order.
    for kind, a, b, _ in first["edges"]:
        source, target = kind.split("_TO_")
        assert (source.title(), a) in names and (target.title(), b) in names and a != b and (source != target or a <= b)
    # A note is gone: its edges go too, without asking.
    write(vault, {"People/ann.md": VAULT["People/ann.md"]})
    fewer = notes.where("id != 'People/bo.md'")
    last = snapshot(run_cycle(fewer, notes.limit(0), ask, "p", root, 3))
    assert [e for e in last["edges"] if e[1] == "bo"] == [] and len(last["edges"]) == 2
    assert os.path.getsize(f"{tmp_path}/calls") == asked


def test_response_cache_asks_once_per_text(spark, tmp_path):
    chunks = spark.createDataFrame([("a", 0, "same"), ("b", 0, "same"), ("c", 1, "other")], "note_id string, chunk_index int, text string")
    keyed = with_chunk_key(chunks, "p")
    seen = str(tmp_path / "seen")

    def ask(texts):
        with open(seen, "a") as log:
            log.write("".join(t + "\n" for t in texts))
        return [t.upper() for t in texts]

    for _ in range(2):
        answers = cached_responses(keyed, ask, str(tmp_path / "cache"))
        assert sorted(r["raw"] for r in answers.collect()) == ["OTHER", "SAME"]
    assert sorted(open(seen).read().split()) == ["other", "same"]


def test_classification(spark):
    schema = [("q", "number", "", "Quality"), ("r", "boolean", "R", "")]
    rows = [
        (1, "len", "single", "How long?", "L", "", None, "number", True, None, None, None),
        (2, "both", "multi", "Both?", "B", "", None, "text", True, schema, None, None),
        (3, "off", "single", "No", "O", "", None, "text", False, None, None, None),
    ]
    tasks = spark.createDataFrame(rows, TASKS.replace("enabled boolean, tag_schema", "enabled boolean, tag_schema"))
    notes = spark.createDataFrame(
        [("a.md", "---\nlen: 1\n---\nbody of the note"), ("b.md", "---\nq: 1\n---\n"), ("c.md", "plain")], "id string, content string"
    )
    results = classify(notes, tasks, rule_based_classifier)
    got = {(r["note_path"], r["tag"]): (r["status"], r["error"], {e["key"]: e["value"] for e in r["entries"]}) for r in results.collect()}
    assert got == {
        ("a.md", "both"): ("completed", None, {"q": "16", "r": "true"}), ("b.md", "len"): ("failed", "Note content is empty", {}),
        ("b.md", "both"): ("failed", "Note content is empty", {}), ("c.md", "len"): ("completed", None, {"len": "5"}), ("c.md", "both"): ("completed", None, {"q": "5", "r": "false"}),
    }
    stored = {r["id"]: r["content"] for r in store_results(notes, results).collect()}
    assert stored["a.md"] == "---\nlen: 1\nq: 16\nr: true\n---\n\nbody of the note" and stored["b.md"] == "---\nq: 1\n---\n"
    assert stored["c.md"] == "---\nlen: 5\nq: 5\nr: false\n---\n\nplain"
    again = classify(spark.createDataFrame(list(stored.items()), "id string, content string"), tasks, rule_based_classifier)
    assert {r["note_path"] for r in again.collect()} == {"b.md"}


def test_prompts_are_not_shuffled(spark, monkeypatch):
    import re

    from noteskein.plans import classify_run

    plans = []
    kept = classify_run.checkpointed
    monkeypatch.setattr(classify_run, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    tasks = spark.createDataFrame([(i, f"t{i}", "single", f"p{i % 3}", "n", "", None, "text", True, None, None, None) for i in range(6)], TASKS)
    notes = spark.createDataFrame([("a.md", "one body"), ("b.md", "one body"), ("c.md", "other"), (None, "other"), ("d.md", " ")], "id string, content string")
    asked = spark.sparkContext.accumulator(0)

    def model(prompts):
        asked.add(len(prompts))
        return [p[-20:] for p in prompts]

    results = classify(notes, tasks, model).collect()
    assert len(results) == 30 and sum(r["status"] == "failed" for r in results) == 6
    # Two bodies with three wordings; of a prompt, only its key and its body's key are dealt out.
    assert asked.value == 6
    assert not any(re.search(r"Exchange hashpartitioning\([^)]*text#", plan) for plan in plans)


def test_large_task_list(spark, no_broadcast):
    from noteskein.operators import classify as C

    tasks = spark.createDataFrame([(i, f"t{i}", "single", "p", "n", "", None, "text", i % 2 == 0, None, None, None) for i in range(30)], TASKS)
    notes = spark.range(20).select(F.col("id").cast("string").alias("id"))
    pairs = sorted((r["id"], r["task"]["tag"]) for r in C.pair_with_tasks(notes, tasks).collect())
    assert pairs == sorted((str(n), f"t{i}") for n in range(20) for i in range(0, 30, 2))


def test_a_long_conversation_is_one_prompt(spark):
    from noteskein.operators import classify as C

    turns = spark.range(2500).select(F.lit("c").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("m"), "id").alias("text"))
    rows = C.combine_messages(turns, "conv_id").collect()
    assert len(rows) == 1 and rows[0]["prompt"].count("m") == 2500 and rows[0]["prompt"].endswith("m2499")


def _vault(spark, notes, changed=()):
    rows = [(i, i.rsplit("/", 1)[-1][:-3], c, len(c), datetime.datetime(2024, 1, 2 if i in changed else 1)) for i, c in notes.items()]
    return spark.createDataFrame(rows, "id string, label string, content string, length long, modified timestamp")


def test_whole_cycle_keeps_state(spark, tmp_path):
    root = str(tmp_path / "store")

    def ask(texts):
        with open(f"{tmp_path}/calls", "a") as log:
            log.write("x" * len(texts))
        return rule_based_model(texts)

    def state(version):
        rows = spark.read.parquet(f"{root}/state/version={version}").collect()
        return {r["path"]: (r["status"], r["has_relationships"]) for r in rows}

    first = snapshot(full_cycle(_vault(spark, VAULT), ask, "p", root, 1))
    calls = os.path.getsize(f"{tmp_path}/calls")
    assert len(first["edges"]) == 3 and state(1) == {p: ("active", True) for p in VAULT}
    for name in ("notes", "note_links", "references", "entity_links", "entities", "edges"):
        assert spark.read.parquet(f"{root}/graph/version=1/{name}").count() > 0
    # Nothing changed: nothing is asked, the graph stays.
    assert snapshot(full_cycle(_vault(spark, VAULT), ask, "p", root, 2)) == first and os.path.getsize(f"{tmp_path}/calls") == calls
    # A note loses its sentence; the batch, run again, does not bring it back.
    fewer = {**VAULT, "People/bo.md": "nothing here\n"}
    for _ in range(2):
        third = snapshot(full_cycle(_vault(spark, fewer, {"People/bo.md"}), ask, "p", root, 3))
        assert [e[1] for e in third["edges"]] == ["ACME", "ann"] and state(3)["People/bo.md"] == ("active", False)
    # A moved note keeps its triples without being asked again, a deleted one takes them along.
    asked = os.path.getsize(f"{tmp_path}/calls")
    moved = {"Archive/Zeta.md": VAULT["Companies/Zeta.md"], "People/bo.md": fewer["People/bo.md"]}
    moves = spark.createDataFrame([("Companies/Zeta.md", "Archive/Zeta.md", datetime.datetime(2024, 1, 3))], "old_path string, new_path string, ts timestamp")
    fourth = snapshot(full_cycle(_vault(spark, moved, {"People/bo.md"}), ask, "p", root, 4, moves))
    assert [e[1] for e in fourth["edges"]] == ["ACME"] and os.path.getsize(f"{tmp_path}/calls") == asked
    assert {r[2] for r in fourth["references"]} == {"Archive/Zeta.md"}
    assert state(4)["Archive/Zeta.md"] == ("active", True) and state(4)["People/ann.md"][0] == "deleted"
    assert [r["id"] for r in spark.read.parquet(f"{root}/evicted/batch=4").collect()] == ["People/ann.md"]


def test_a_cycle_without_triples(spark, tmp_path):
    graph = full_cycle(_vault(spark, {"a.md": "[[b]]", "b.md": "x"}), rule_based_model, "p", str(tmp_path / "store"), 1)
    assert graph.edges.count() == 0 and graph.notes.count() == 2 and graph.note_links.count() == 1


def test_sessions_fire_by_the_clock(spark, tmp_path):
    """One event, then silence: the session is closed by time alone."""
    import time

    log, seen = str(tmp_path / "log"), []
    spark.createDataFrame([("v", "a.md", "created", None, datetime.datetime(2024, 1, 1))], FILE_EVENTS).coalesce(1).write.parquet(log)
    query = E.run_on_quiet(E.read_events(spark, log), lambda s, _: seen.extend(s.collect()), str(tmp_path / "checkpoint"), quiet_seconds=1)
    until = time.time() + 120
    while not seen and time.time() < until:
        time.sleep(1)
    query.stop()
    assert [(r["vault_id"], r["n_events"]) for r in seen] == [("v", 1)]


def test_stream_equals_batch(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    at = lambda s: start + datetime.timedelta(seconds=s)
    rows = [
        ("v", "a.md", "created", None, at(0)), ("v", "b.MD", "modified", None, at(30)), ("v", "a.md", "modified", None, at(50)), ("v", ".x/a.md", "modified", None, at(100)),
        ("v", "t.txt", "modified", None, at(105)), ("v", "c.md", "moved", "a.md", at(300)), ("v", "z.md", "created", None, at(9000)), ("v", "z.md", "created", None, at(20000)),
    ]
    log = str(tmp_path / "log")
    spark.createDataFrame(rows, FILE_EVENTS).coalesce(1).write.parquet(log)
    seen = []

    def process(sessions, batch_id):
        kept = sessions.persist()
        pending = E.pending_paths(E.note_events(spark.read.schema(FILE_EVENTS).parquet(log)), kept)
        seen.append(([(r["first_event"], r["last_event"], r["n_events"]) for r in kept.collect()], sorted(r["path"] for r in pending.collect())))

    stream = E.note_events(E.read_events(spark, log))
    query = E.run_on_quiet(stream, process, str(tmp_path / "checkpoint"), once=True)
    assert query.awaitTermination(240) and query.exception() is None
    sessions = sorted(s for batch, _ in seen for s in batch)
    assert [(int((a - start).total_seconds()), int((b - start).total_seconds()), n) for a, b, n in sessions] == [(0, 50, 3), (300, 300, 1), (9000, 9000, 1), (20000, 20000, 1)]
    assert {p for _, paths in seen for p in paths} == {"a.md", "b.MD", "c.md", "z.md"}
    moves = E.latest_moves(spark.read.schema(FILE_EVENTS).parquet(log)).collect()
    assert [(m["old_path"], m["new_path"]) for m in moves] == [("a.md", "c.md")]
    again, gone = E.split_pending(spark.createDataFrame([("a.md",), ("c.md",)], "path string"), spark.createDataFrame([("c.md",)], "id string"))
    assert [r["path"] for r in again.collect()] == ["c.md"] and [r["path"] for r in gone.collect()] == ["a.md"]
