"""What is shuffled for a join: no copies of keys, no lines by customer, no texts to meet their own ids."""

import re

import pytest
from pyspark.sql import functions as F

from noteskein.operators.notes_graph import reference_edges
from noteskein.plans import build, views
from noteskein.scale import lookup


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_key_given_by_name_is_not_copied(spark, no_broadcast):
    facts = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 3)], "name string, n int")
    dim = spark.createDataFrame([("a", "x"), (None, "y")], "id string, value string")
    for how, wanted in (("left", [("a", 1, "x")] * 2 + [("b", 2, None), (None, 3, None)]), ("inner", [("a", 1, "x")] * 2)):
        found = lookup(facts, dim, "name", "id", ["n"], how=how)
        assert found.columns == ["name", "n", "value"]
        assert sorted(map(tuple, found.collect()), key=str) == sorted(wanted, key=str)
        assert sorted(map(tuple, lookup(facts, dim, F.col("name"), "id", ["n"], how=how).collect()), key=str) == sorted(wanted, key=str)
        assert "_key#" not in _plan(found).replace("_dim_key#", "")


def test_reference_counts_meet_their_keys_without_copies(spark, no_broadcast):
    rows = [("A", "B", "n1"), ("A", "B", "n1"), ("A", None, "n2"), ("C", "A", "n1"), ("A", "B", "gone"), ("A", "B", "")]
    triples = spark.createDataFrame([("Person", s, "knows", "Person", t, f) for s, t, f in rows],
                                    "source_category string, source_label string, relationship string, target_category string, target_label string, source_file string")
    entities = spark.createDataFrame([("Person", "A"), ("Person", "A"), ("Person", "B"), ("Company", "C"), ("Person", None)], "category string, id string")
    notes = spark.createDataFrame([("n1",), ("n1",), ("n2",), ("",), (None,)], "id string")
    found = reference_edges(triples, entities, notes)
    assert sorted(map(tuple, found.collect()), key=str) == sorted([
        ("PERSON_REFERENCE", "A", "n1", 3), ("PERSON_REFERENCE", "B", "n1", 2), ("PERSON_REFERENCE", "A", "n2", 1), ("PERSON_REFERENCE", None, "n2", 1),
    ], key=str)
    assert "_key#" not in _plan(found) and "_entity#" not in _plan(found)


def test_lines_are_not_shuffled_by_customer(spark, tmp_path, no_broadcast):
    tables = {
        "lineitem": ([(1, 5, 0, 1, "R", "F"), (1, 5, 0, 1, "R", "F"), (2, 6, 1, 1, "N", "O"), (9, 5, 0, 1, "N", "O"), (None, 5, 0, 2, "N", "O")],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string"),
        "orders": ([(1, 0, "F", "2-HIGH"), (2, 1, "O", "5-LOW"), (3, None, "O", "5-LOW")], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string"),
        "customer": ([(0, "C0", 1, "M"), (1, "C1", 2, "M"), (1, "C1b", 2, "M")], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"),
        "supplier": ([(0, "S0", 1), (1, "S1", 2)], "s_suppkey long, s_name string, s_nationkey int"),
        "part": ([(5, "B5"), (6, "B6")], "p_partkey long, p_brand string"),
    }
    for name, (rows, schema) in tables.items():
        df = spark.createDataFrame(rows, schema)
        if name == "orders":
            df = df.withColumn("o_orderdate", F.lit("1996-01-01"))
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    lines = views.lines(spark, str(tmp_path))
    kept = lines.select("l_orderkey", "c_name", "s_name", "contact", "p_brand")
    # Customer 1 is there twice: as the customer and as the contact of an order.
    assert sorted(map(tuple, kept.collect())) == sorted(
        [(1, "C0", "S0", "C0", "B5")] * 2 + [(2, a, "S1", b, "B6") for a in ("C1", "C1b") for b in ("C1", "C1b")]
    )
    plan = _plan(kept).split("\n")
    at = next(i for i, line in enumerate(plan) if "hashpartitioning(o_custkey" in line)
    depth = lambda line: len(re.match(r"[\s:|+\-*()0-9]*", line).group())
    below = []
    for line in plan[at + 1:]:
        if depth(line) <= depth(plan[at]):
            break
        below.append(line)
    assert below and not any("l_orderkey" in line for line in below)


def test_first_cycle_reads_all_notes_without_a_join(spark, tmp_path, monkeypatch):
    class Seen(Exception):
        pass

    def stop(here, *_):
        raise Seen(here)

    monkeypatch.setattr(build, "renamed_triples", stop)
    notes = spark.createDataFrame([("a.md", "a", "text"), ("a.md", "a", "text"), (None, "b", "text")], "id string, label string, content string")
    with pytest.raises(Seen) as seen:
        build.grow(notes, notes.limit(0).select("id"), str(tmp_path), 1)
    here = seen.value.args[0]
    assert [r.id for r in here.collect()] == ["a.md", "a.md"]
    assert "Join" not in _plan(here)
