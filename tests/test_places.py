"""Moves over time and the incremental graph against plain versions."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from noteskein.operators import places
from noteskein.plans import incremental
from noteskein.plans.build import build, full_cycle, kept_triples
from noteskein.plans.stand_ins import rule_based_model
from noteskein.scale import checkpointed
from tests.test_cycle import _vault, snapshot


def at(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def follow(moves, path, key):
    last = None
    while True:
        away = sorted(m for m in moves if m[2] == path and (m[0], m[1]) > key)
        if not away:
            return path, last
        path, key, last = away[0][3], (away[0][0], away[0][1]), away[0]


@pytest.mark.parametrize("seed", [2])
def test_moves_against_following_each(spark, seed):
    rng = random.Random(seed)
    rows = {
        (b, at(b * 100_000 + 1700 * rng.randint(0, 9)), *rng.sample("abcdef", 2)) for b in (1, 2, 3, 4, 5) for _ in range(7)
    }
    moves = spark.createDataFrame([*rows, *list(rows)[:3], (1, at(0), None, "x"), (1, at(0), "x", None)], "batch int, ts timestamp, old_path string, new_path string")
    resolved = places.moves_over_time(moves)
    found = {(r["batch"], r["ts"], r["old_path"], r["new_path"]): r["place"] for r in resolved.collect()}
    assert found == {m: follow(rows, m[3], (m[0], m[1]))[0] for m in rows}
    points = [(p, b, f"{p}{b}") for p in "abcdefg" for b in range(6)]
    seen = places.placed(spark.createDataFrame(points, "path string, batch int, name string"), resolved)
    for r in seen.collect():
        place, last = follow(rows, r["path"], (r["batch"], datetime.datetime(9999, 1, 1)))
        assert (r["place"], r["arrived"]) == (place, last[0] if last else r["batch"])


def test_no_moves(spark):
    none = spark.createDataFrame([], "batch int, ts timestamp, old_path string, new_path string")
    assert places.moves_over_time(none).isEmpty() and places.net_moves(none).isEmpty()
    assert places.placed(spark.createDataFrame([("a", 1)], "path string, batch int"), places.moves_over_time(none)).first()["place"] == "a"


def test_net_moves_of_a_batch(spark):
    moves = [("a", "b", at(1)), ("b", "c", at(2)), ("x", "t", at(1)), ("y", "x", at(2)), ("t", "y", at(3)), ("r", "s", at(1)), ("s", "r", at(2)), ("a", "d", at(9))]
    found = places.net_moves(spark.createDataFrame(moves, "old_path string, new_path string, ts timestamp"))
    assert {(r["old_path"], r["new_path"]) for r in found.collect()} == {("a", "c"), ("b", "c"), ("x", "y"), ("y", "x"), ("t", "y"), ("s", "r")}


def note(*companies):
    return "".join(f"[[ann]] works at [[{c}]].\n" for c in companies) or "nothing"


def edges(graph):
    return sorted((r["src"], r["dst"]) for r in graph.edges.collect())


def test_cycle_follows_chains_returns_and_paths_used_again(spark, tmp_path):
    root, calls = str(tmp_path / "store"), str(tmp_path / "calls")

    def ask(texts):
        with open(calls, "a") as log:
            log.write("x" * len(texts))
        return rule_based_model(texts)

    def cycle(number, notes, moves=(), changed=()):
        rows = [(a, b, at(1000 * number + k)) for k, (a, b) in enumerate(moves)]
        frame = spark.createDataFrame(rows, "old_path string, new_path string, ts timestamp") if rows else None
        return full_cycle(_vault(spark, notes, changed), ask, "p", root, number, moves=frame)

    def sources():
        return sorted((r["source_file"], r["target_label"]) for r in kept_triples(spark, root).collect())

    first = cycle(1, {"a.md": note("A"), "x.md": note("X"), "r.md": note("R")})
    assert edges(first) == [("ann", "A"), ("ann", "R"), ("ann", "X")]
    asked = len(open(calls).read())
    # a.md moves and a new a.md comes; x.md goes one step of a chain; r.md leaves.
    notes = {"b.md": note("A"), "a.md": note("New"), "y.md": note("X"), "away.md": note("R")}
    second = cycle(2, notes, [("a.md", "b.md"), ("x.md", "y.md"), ("r.md", "away.md")])
    assert sources() == [("a.md", "New"), ("away.md", "R"), ("b.md", "A"), ("y.md", "X")]
    assert edges(second) == [("ann", "A"), ("ann", "New"), ("ann", "R"), ("ann", "X")] and len(open(calls).read()) == asked + 1
    # The chain goes on, r.md comes back, and the moved note is overwritten by the new one.
    notes = {"b.md": note("New"), "z.md": note("X"), "r.md": note("R")}
    third = cycle(3, notes, [("y.md", "z.md"), ("away.md", "r.md"), ("a.md", "b.md")])
    assert sources() == [("b.md", "New"), ("r.md", "R"), ("z.md", "X")]
    assert edges(third) == [("ann", "New"), ("ann", "R"), ("ann", "X")]
    assert {(r["src"], r["dst"]) for r in third.references.collect()} == {("ann", p) for p in notes} | {("New", "b.md"), ("R", "r.md"), ("X", "z.md")}
    state = {r["path"]: r["status"] for r in spark.read.parquet(f"{root}/state/version=3").collect()}
    assert {p for p, s in state.items() if s == "active"} == set(notes)


SAID = "source_category string, source_label string, relationship string, target_category string, target_label string, source_file string, n_copies long"


def test_signed_changes_equal_a_whole_build(spark, tmp_path):
    """Random batches with spellings, copies, self loops, company-to-person facts and odd labels."""
    rng = random.Random(7)
    names = ["Ann", "ann", "ANN ", " ann", "Bo", "bo", "Cy", "", "null", "Dee"]
    root, log = str(tmp_path / "facts"), {}

    def facts(n):
        return [(rng.choice(["Person", "Company", "Concept"]), rng.choice(names), rng.choice(["works_at", "founded_by", "knows"]), rng.choice(["Person", "Company"]), rng.choice(names), rng.randint(1, 3)) for _ in range(n)]

    for batch in range(1, 5):
        replaced = [f"n{k}.md" for k in range(12) if batch == 1 or rng.random() < 0.3]
        for path in replaced:
            log[path] = facts(rng.randint(0, 4)) if rng.random() < 0.8 else []
        rows = [(*f[:5], path, f[5]) for path in replaced for f in dict.fromkeys(log[path])]
        notes = spark.createDataFrame([(p,) for p in replaced], "source_file string")
        incremental.apply_batch(spark, root, batch, notes, spark.createDataFrame(rows, SAID))
        if batch == 2:
            # The same batch again, and a reader of the one before.
            before = sorted(map(tuple, incremental.edges_at(spark, root, 1).collect()))
            incremental.apply_batch(spark, root, batch, notes, spark.createDataFrame(rows, SAID))
            assert sorted(map(tuple, incremental.edges_at(spark, root, 1).collect())) == before
        if batch == 3:
            incremental.compact(spark, root, 3)
        whole = [(*f[:5], path) for path, said in log.items() for f in dict.fromkeys(said) for _ in range(f[5])]
        ids = spark.createDataFrame([(p, p, "", at(0)) for p in log], "id string, label string, content string, modified timestamp")
        graph = build(ids, spark.createDataFrame(whole, SAID.rsplit(", ", 1)[0]))
        assert sorted(map(tuple, incremental.edges_at(spark, root, batch).collect())) == sorted(map(tuple, graph.edges.collect()))
        known = {(r["category"], r["id"]) for r in incremental.entities_at(spark, root, batch).collect()}
        assert known == {(r["category"], r["id"]) for r in graph.entities.collect()}
        assert sorted(map(tuple, incremental.references_at(spark, root, batch).collect())) == sorted(map(tuple, graph.references.collect()))
    assert incremental.published(spark, root) == 4 and incremental.expire(spark, root, keep=2) == [1, 2, 3]
    assert sorted(map(tuple, incremental.edges_at(spark, root, 4).collect())) == sorted(map(tuple, graph.edges.collect()))


def test_unpublished_batch_is_not_seen(spark, tmp_path):
    root = str(tmp_path / "facts")
    notes = spark.createDataFrame([("a.md",)], "source_file string")
    fact = ("Person", "ann", "works_at", "Company", "Zed", "a.md", 1)
    incremental.apply_batch(spark, root, 1, notes, spark.createDataFrame([fact], SAID))
    # A batch that fails half-way leaves its folders, but no mark.
    spark.createDataFrame([("x", "y", "z", "w", 1, 0)], incremental.TABLES["edges"] + ", bucket int").write.partitionBy("bucket").parquet(f"{root}/changes/edges/batch=2")
    assert incremental.published(spark, root) == 1 and incremental.edges_at(spark, root, 1).count() == 1
    incremental.apply_batch(spark, root, 2, notes, spark.createDataFrame([], SAID))
    assert incremental.edges_at(spark, root, 2).isEmpty() and incremental.entities_at(spark, root, 2).isEmpty()


def test_delta_opens_the_buckets_of_its_names(spark, tmp_path):
    root = str(tmp_path / "facts")
    rows = [("Person", f"p{k}", "works_at", "Company", f"c{k}", f"n{k}.md", 1) for k in range(500)]
    said = checkpointed(spark.createDataFrame(rows, SAID))
    incremental.apply_batch(spark, root, 1, said.select("source_file"), said)
    read = incremental.read_log(spark, root, "ends", 1, [3, 5])
    files = read.select(F.input_file_name().alias("f")).distinct().collect()
    assert {f["f"].split("bucket=")[1].split("/")[0] for f in files} == {"3", "5"}
