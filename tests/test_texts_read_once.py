"""A cycle reads its notes once, parses once, and shuffles no text to find the few that it asks about."""

import datetime
import os
import re

from noteskein.operators import extraction, metadata
from noteskein.plans import build
from noteskein.plans.stand_ins import rule_based_model
from noteskein.schemas import RESPONSES

NOTES = "id string, label string, content string, length long, modified timestamp"
TEXT = "---\nsize: 1\nresolves:\n  - B -> C\n---\n[[a]] works at [[B]].\n\n## Metadata\n- Kind: note\n"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _depth(line):
    return len(re.match(r"[\s:|+\-]*", line).group())


def test_a_cycle_reads_its_notes_once(spark, tmp_path):
    def counted(rows):
        log = str(tmp_path / f"reads-{len(os.listdir(tmp_path))}")

        def read(batches):
            for batch in batches:
                with open(log, "a") as out:
                    out.write("x" * batch.num_rows)
                yield batch

        return log, spark.createDataFrame(rows, NOTES).coalesce(1).mapInArrow(read, NOTES)

    at = lambda day: datetime.datetime(2024, 1, day)
    row = lambda name, text, day: (f"{name}.md", name, text, len(text), at(day))
    log, notes = counted([row("a", TEXT, 1), row("b", TEXT, 1), row("b", TEXT, 1), (None, "c", TEXT, 1, at(1)), row("d", "plain", 1)])
    graph = build.full_cycle(notes, rule_based_model, "p", str(tmp_path / "store"), 1)
    assert os.path.getsize(log) == 5
    assert {(r["src"], r["dst"]) for r in graph.edges.collect()} == {("a", "C")}
    assert sorted(r["path"] or "" for r in spark.read.parquet(str(tmp_path / "store/detected/batch=1")).collect()) == ["", "a.md", *["b.md"] * 4, "d.md"]

    # One note changes, one is touched only, one is moved, one goes.
    changed = TEXT.replace("works at [[B]]", "advises [[D]]")
    log, notes = counted([row("a", changed, 2), row("d", "plain", 2), ("e/b.md", "b", TEXT, len(TEXT), at(1))])
    moves = spark.createDataFrame([("b.md", "e/b.md", at(2))], "old_path string, new_path string, ts timestamp")
    graph = build.full_cycle(notes, rule_based_model, "p", str(tmp_path / "store"), 2, moves)
    assert os.path.getsize(log) == 3
    assert {(r["src"], r["dst"], r["relationship"]) for r in graph.edges.collect()} == {("a", "C", "works_at"), ("a", "D", "advises")}
    assert {r["dst"] for r in graph.references.collect()} == {"a.md", "e/b.md"}
    detected = spark.read.parquet(str(tmp_path / "store/detected/batch=2"))
    kinds = {r["path"]: r["change_type"] for r in detected.collect()}
    assert kinds["a.md"] == "modified" and kinds["d.md"] == "metadata_only"


def test_yaml_of_aliases_is_parsed_once(spark):
    notes = spark.createDataFrame([("a.md", "a", TEXT, 1, None), ("b.md", "b", "resolves nothing", 1, None)], NOTES)
    declared = build.declared_aliases(notes)
    assert _plan(declared).count("ArrowEvalPython") == 1
    assert [(r["source_file"], [tuple(p) for p in r["aliases"]]) for r in declared.collect()] == [("a.md", [("B", "C")])]


def test_responses_are_parsed_once(spark):
    keyed = spark.createDataFrame([("a.md", 0, "k"), ("b.md", 0, "l")], "note_id string, chunk_index int, chunk_key string")
    answers = zip(("k", "l"), rule_based_model(["[[a]] works at [[B]]", "nothing"]), strict=True)
    found = extraction.triples_from_responses(keyed, spark.createDataFrame(list(answers), RESPONSES))
    filters = [line for line in _plan(found).split("\n") if re.search(r"\bFilter\b", line) and "size(" in line]
    assert filters and all(re.search(r"size\(_triples#\d+", line) for line in filters)
    assert [(r["note_id"], r["target_label"]) for r in found.collect()] == [("a.md", "B")]


def test_metadata_shuffles_no_whole_texts(spark, tmp_path, no_broadcast):
    rows = [("a.md", "a", TEXT, 1, None), ("b.md", "b", "---\nsize: 2\n---\nno mark", 1, None), ("c.md", "c", "## Metadata\n- Kind: c", 1, None), ("d.md", "d", None, 1, None)]
    spark.createDataFrame(rows, NOTES).write.parquet(str(tmp_path / "notes"))
    notes = spark.read.parquet(str(tmp_path / "notes"))
    entities = spark.createDataFrame([("Person", n, n, "") for n in "ABCDE"], "category string, id string, label string, metadata string")
    applied = metadata.apply_metadata(entities, notes)
    asked = spark.createDataFrame([("a.md", "kind"), ("c.md", "kind"), ("x.md", "kind")], "id string, key string")
    plans = [_plan(applied), _plan(metadata.lookup_metadata(notes, asked))]
    assert {r["id"]: r["metadata"] for r in applied.collect()} == {
        "A": '{"size":1,"kind":"note"}', "B": '{"size":2}', "C": '{"kind":"c"}', "D": "", "E": "",
    }
    assert {r["id"]: r["value"] for r in metadata.lookup_metadata(notes, asked).collect()} == {"a.md": '"note"', "c.md": '"c"', "x.md": None}
    for plan in plans:
        # A node may span lines, as its texts do.
        nodes = re.split(r"\n(?=[\s:|]*[+:]- )", plan)
        scan = next(i for i, node in enumerate(nodes) if "FileScan" in node and "content#" in node)
        above, depth = [], _depth(nodes[scan])
        for node in reversed(nodes[:scan]):
            if _depth(node) < depth:
                above.append(node)
                depth = _depth(node)
        # Between the scan of the texts and their first shuffle they are cut to what is read.
        first = next(i for i, node in enumerate(above) if re.search(r"- Exchange", node))
        assert any("AS _block" in node for node in above[:first])
