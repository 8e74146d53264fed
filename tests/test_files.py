"""Reading a folder of notes, CSV caches, and writing tables."""

import os

from pyspark.sql import functions as F

from noteskein.operators import triples as T
from noteskein.sinks import tables as W
from noteskein.sources import notes as S, tables as R

FILES = {
    "a.md": "alpha", "_Drafts/x.md": "draft", ".hidden/x.md": "no", "sub/.dot.md": "no", "Templates/t.md": "no", "empty.md": "", "John Smith.md": "space",
    "Ä/ü.md": "über", "deep/er/_n.md": "deep", "X.MD": "other case", "note.txt": "no",
}


def write(folder, files):
    for name, text in files.items():
        path = os.path.join(folder, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8") as out:
            out.write(text)


def test_load_notes(spark, tmp_path):
    write(tmp_path, FILES)
    notes = S.load_notes(spark, str(tmp_path), "Templates")
    got = {r["id"]: (r["label"], r["content"], r["length"]) for r in notes.collect()}
    assert sorted(got) == ["John Smith.md", "_Drafts/x.md", "a.md", "deep/er/_n.md", "empty.md", "Ä/ü.md"]
    assert got["Ä/ü.md"] == ("ü", "über", 5) and got["empty.md"] == ("empty", "", 0) and got["John Smith.md"][0] == "John Smith"
    assert [r["folder"] for r in S.folders(notes).collect()] == ["_Drafts/", "deep/", "deep/er/", "Ä/"]
    settings = tmp_path / "templates.json"
    settings.write_text('{\n "folder": "Templates"\n}')
    assert S.template_folder(spark, str(settings)) == "Templates"


HEADER = "source_category,source_label,relationship,target_category,target_label,source_file,extracted_at\n"


def test_csv_caches(spark, tmp_path):
    rows = 'Person,"Ann ""A"", B",works_at,Company,"Ac\nme",n.md,2024-01-01T00:00:00Z\nCompany,Acme,hires,Person,Bo,n.md,2024-01-01T00:00:00Z\n'
    write(tmp_path, {"content/n.csv": HEADER + rows, "content/empty.csv": HEADER, "flat/h_1.csv": HEADER + rows, "flat/person.csv": "id,label,metadata\nx,x,\n"})
    read = R.read_triples(spark, str(tmp_path / "content"))
    assert sorted((r["source_label"], r["target_label"]) for r in read.collect()) == [('Acme', 'Bo'), ('Ann "A", B', "Ac\nme")]
    assert R.read_flat_cache(spark, str(tmp_path / "flat")).count() == 2
    entities, edges = T.build_graph(read)
    W.write_entities_csv(entities, str(tmp_path / "db"))
    W.write_edges_csv(edges, str(tmp_path / "db"))
    assert sorted(map(tuple, R.read_edges(spark, str(tmp_path / "db")).collect())) == sorted(map(tuple, edges.collect()))
    assert sorted((r["category"], r["id"]) for r in R.read_entities(spark, str(tmp_path / "db")).collect()) == sorted((r["category"], r["id"]) for r in entities.collect())


def test_versions(spark, tmp_path):
    root = str(tmp_path / "graph")
    assert W.latest_version(spark, root) is None
    entities = spark.createDataFrame([("Person", "a")], "category string, id string")
    edges = spark.createDataFrame([("PERSON_TO_PERSON", "a", "b")], "edge_type string, src string, dst string")
    for version in (2, 10):
        W.write_graph(entities, edges, root, version)
    os.makedirs(f"{root}/version=11/edges")
    assert W.latest_version(spark, root).endswith("version=10")


def test_extraction_log_is_repeatable(spark, tmp_path):
    root = str(tmp_path)
    notes = spark.createDataFrame([("a.md", "h"), ("b.md", "h")], "id string, content_hash string")
    triples = lambda *labels: spark.createDataFrame([(x, "a.md") for x in labels], "source_label string, source_file string")
    for batch, found in ((1, triples("x", "y")), (2, triples("z")), (2, triples("z"))):
        W.append_extraction(found, notes, root, batch)
    kept = W.current_triples(spark.read.parquet(f"{root}/triples"), spark.read.parquet(f"{root}/processed"))
    assert [r["source_label"] for r in kept.collect()] == ["z"]
    assert {(r["id"], r["batch"]): r["n_rels"] for r in spark.read.parquet(f"{root}/processed").collect()} == {("a.md", 1): 2, ("a.md", 2): 1, ("b.md", 1): 0, ("b.md", 2): 0}


def test_legacy_cache_names(spark):
    df = spark.createDataFrame([("c/h1_2024-01.csv",), ("c/h1_2024-03.csv",), ("c/h2_2023-01.csv",), ("c/plain.csv",)], "path string")
    assert {r["content_hash"]: r["path"] for r in R.latest_per_hash(df).collect()} == {"h1": "c/h1_2024-03.csv", "h2": "c/h2_2023-01.csv"}


def test_bulk_load_checks_the_header(spark, tmp_path):
    write(tmp_path, {"person_to_person.csv": "target_id,source_id,relationship\na,b,r\n", "person_to_company.csv": "person_id,company_id,relationship\n", "company_to_company.csv": "source_id,target_id,relationship\n"})
    try:
        R.read_edges(spark, str(tmp_path)).select(F.max("src")).collect()
    except Exception as error:
        assert "header" in str(error).lower()
    else:
        raise AssertionError("columns in another order must not be taken by position")


def test_logs_results_and_uploads(spark, tmp_path):
    from noteskein.operators import patterns
    from noteskein.schemas import CHANGES

    changes = spark.createDataFrame([(1, "created", None, "a.md", None, "h", None)], CHANGES)
    for _ in range(2):
        W.append_changes(changes, str(tmp_path / "changes"))
    assert spark.read.schema(CHANGES).parquet(str(tmp_path / "changes")).count() == 2
    W.write_results_json(spark.createDataFrame([("m", 0.5)], "model string, f1 double"), str(tmp_path / "results"))
    assert spark.read.schema("model string, f1 double").json(str(tmp_path / "results")).first()["f1"] == 0.5
    nodes = spark.createDataFrame([("Person", "a", "a", None), ("Company", "b", "b", "m"), ("Company", "c", "c", "m")], "category string, id string, label string, metadata string")
    edges = patterns.typed_edges(spark.createDataFrame([("PERSON_TO_COMPANY", "a", "b", "r")], "edge_type string, src string, dst string, relationship string"))
    result = patterns.graph_result(nodes, edges, ["id", "metadata"])
    result.write(str(tmp_path / "out"))
    back = {r["node_id"]: r["properties"] for r in spark.read.parquet(str(tmp_path / "out/nodes")).collect()}
    assert back == {"Person:a": {"id": "a"}, "Company:b": {"id": "b", "metadata": "m"}}
    rel = spark.read.parquet(str(tmp_path / "out/relationships")).first()
    assert (rel["start_id"], rel["end_id"], rel["type"], rel["properties"]) == ("Person:a", "Company:b", "PERSON_TO_COMPANY", {"relationship": "r"})
    notes = spark.createDataFrame([("Inbox/a.md", "a", "old", None, 3)], "id string, label string, content string, modified timestamp, length bigint")
    inbox = spark.createDataFrame([("a", "first", 1), ("a.md", "last", 2), ("b", "é", 1)], "filename string, content string, ts int")
    uploaded = W.upload_notes(notes, inbox, "Inbox", F.lit(None).cast("timestamp"))
    assert {r["id"]: (r["content"], r["length"]) for r in uploaded.collect()} == {"Inbox/a.md": ("last", 4), "Inbox/b.md": ("é", 2)}


def test_uris_and_line_ends(spark, tmp_path):
    vault = tmp_path / "vault"
    deep = vault / "/".join(["d"] * 70)
    os.makedirs(deep)
    (vault / "a.md").write_bytes(b"one\r\ntwo\rthree")
    (vault / "b.md").write_bytes(b"one\ntwo\nthree")
    (deep / "c.md").write_bytes(b"deep")
    plain = sorted((r["id"], r["content"]) for r in S.load_notes(spark, str(vault)).collect())
    assert plain == sorted((r["id"], r["content"]) for r in S.load_notes(spark, f"file://{vault}").collect())
    assert plain[0][1] == plain[1][1] == "one\ntwo\nthree" and plain[2][0].endswith("d/c.md")
