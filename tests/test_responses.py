"""Model responses and prompts on edge cases."""

import json

from pyspark.sql import functions as F

from noteskein.functions import frontmatter as FM, responses as R
from noteskein.operators import metadata
from noteskein.operators.quality import relation_matches

GOOD = {"source_category": "Person", "source_label": "A", "relationship": "r", "target_category": "Company", "target_label": "B"}


def one(spark, value, build):
    return spark.createDataFrame([(value,)], "t string").select(build(F.col("t"))).first()[0]


def test_clean(spark):
    for raw, wanted in (
        ('x ```json\n{"a": [1,],}\n``` y', '{"a": [1]}'), ('```\n{"a": 1}\n```', '{"a": 1}'), ('```json {"a": 1}', '{"a": 1}'),
        ('say {"a": {"b": 2}} ok', '{"a": {"b": 2}}'), ("  none  ", "none"), ("}{", "}{"), ("", ""),
    ):
        assert one(spark, raw, R.clean_response) == wanted, raw


def test_read_all_or_save_some(spark):
    empty = {**GOOD, "relationship": ""}
    number = {**GOOD, "target_label": 5}
    lacking = {k: v for k, v in GOOD.items() if k != "target_label"}
    pick = lambda rows: [tuple(r) for r in rows]
    full = tuple(GOOD.values())
    for items, wanted in (([GOOD, empty], [full, tuple(empty.values())]), ([GOOD, empty, number], [full]), ([lacking, GOOD], [full]), ([], [])):
        assert pick(one(spark, json.dumps({"relationships": items}), R.read_triples)) == wanted, items
    for text in ("", "[1]", '{"relationships": 5}', '{"relationships": [', "{}"):
        assert one(spark, text, R.read_triples) is None, text


def test_typed_numbers(spark):
    cases = {"5": 5, "3.5": 3.5, "3.": 3.0, "1e3": 0, "4d": 0, "abc": 0, "-2": -2, "1_0": 0, "+7": 7, ".5": 0.5, "1.5e2": 150.0, "": 0, "1.2.3": 0, '"8"': 8}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    for text, parsed in df.select("t", R.parse_typed(F.col("t"), F.lit("number"))).collect():
        got = parsed["float_value"] if parsed["float_value"] is not None else parsed["int_value"]
        assert got == cases[text], text
    words = {'"true"': True, "Yes": True, "1": True, "no": False, "'YES'": True, '"unbalanced': False}
    df = spark.createDataFrame([(k,) for k in words], "t string")
    assert {t: p["bool_value"] for t, p in df.select("t", R.parse_typed(F.col("t"), F.lit("boolean"))).collect()} == words
    assert one(spark, "'a, b'", lambda c: R.parse_typed(c, F.lit("list")))["text_value"] == "a, b"
    assert one(spark, '"', lambda c: R.parse_typed(c, F.lit("text")))["text_value"] == ""


NOTE = """---
title: "T é"
born: 2020-01-02
tags: [a, b]
nested: {x: 1}
empty: ''
nothing:
resolves: [x -> y]
---
Text **Not**: here

## Metadata
**Role**: CEO
- **Seat**: Rome
- Age: 7
City: Oslo
# gone: x

## info
Plan: A
## Other
Skip: 1
## Additional Info
Extra Key!: z
"""


def test_metadata_forms(spark):
    notes = spark.createDataFrame([("n.md", "n", NOTE), ("m.md", "m", "no data"), ("k.md", "k", "---\n: bad: [\n---\n")], "id string, label string, content string")
    found = {r["id"]: {e["key"]: json.loads(e["value"]) for e in r["entries"]} for r in metadata.note_metadata(notes).collect()}
    assert found["m.md"] == {} and found["k.md"] == {}
    assert found["n.md"] == {
        "title": "T é", "born": "2020-01-02", "tags": ["a", "b"], "nested": {"x": 1}, "role": "CEO", "seat": "Rome", "age": "7", "city": "Oslo",
        "plan": "A", "extra_key": "z",
    }


def test_priority_of_sources(spark):
    text = "---\nrole: front\nRole Name: f\n---\n## Metadata\nRole: section\n"
    notes = spark.createDataFrame([("n", "n", text)], "id string, label string, content string")
    get = lambda **kw: {e["key"]: json.loads(e["value"]) for e in metadata.note_metadata(notes, **kw).first()["entries"]}
    assert get() == {"role": "section", "role_name": "f"} and get(frontmatter_wins=True)["role"] == "front"


def test_rewrite_keeps_values(spark):
    notes = spark.createDataFrame([("n", NOTE), ("m", "plain"), ("k", "---\na: 1\n---\n\n text ")], "id string, content string")
    changed = FM.rewrite_notes(notes, lambda e: FM.rename_tags(FM.set_tags(e, {"a": F.lit("[1, 2]")}, F.lit("now")), {"a": "b"}))
    texts = {r["id"]: r["content"] for r in changed.collect()}
    assert texts["k"] == "---\nb:\n- 1\n- 2\nb_at: now\n---\n\ntext"
    assert texts["m"].startswith("---\nb:") and texts["m"].endswith("---\n\nplain")
    assert "born: '2020-01-02'" in texts["n"] and "title: T é" in texts["n"]
    cleared = FM.rewrite_notes(notes, lambda e: FM.remove_tags(e, ["a"])).where("id = 'k'").first()["content"]
    assert cleared == "text"


def test_relation_names(spark):
    df = spark.createDataFrame(
        [("works at", "employed_at", False), ("works_at", "works_for", True), ("Married To", "is_married_to", True), ("likes", "loves", False), ("teaches_at", "professor_at", True)],
        "a string, b string, ok boolean",
    )
    rows = {(r["a"], r["b"]): r["hit"] for r in df.withColumn("hit", relation_matches(F.col("a"), F.col("b"))).collect()}
    assert rows[("works_at", "works_for")] and rows[("Married To", "is_married_to")] and rows[("teaches_at", "professor_at")]
    assert not rows[("likes", "loves")] and rows[("works at", "employed_at")]
