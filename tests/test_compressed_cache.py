"""CSV caches of triples take a fraction of the disk of their text."""

import os

from noteskein.plans import store_queries
from noteskein.sinks import tables as W
from noteskein.sources import tables as R

ROWS = [("Person", f"Customer#{i % 60:09d}", "says \"x\",\nand", "Company", f"Supplier#{i % 7:09d}", f"orders/{i % 900}.md", "2024") for i in range(20_000)]
COLUMNS = "source_category string, source_label string, relationship string, target_category string, target_label string, source_file string, extracted_at string"


def test_triples_are_compressed_and_come_back(spark, tmp_path):
    folder = str(tmp_path / "cache")
    W.write_triples_csv(spark.createDataFrame(ROWS, COLUMNS), folder)
    assert sorted(map(tuple, R.read_triples(spark, folder).collect())) == sorted(ROWS)
    parts = [os.path.join(folder, f) for f in os.listdir(folder) if f.startswith("part-")]
    assert sum(map(os.path.getsize, parts)) < sum(len(",".join(r)) for r in ROWS) / 4


def test_the_query_stores_them_so(spark, sf_dir, tmp_path, monkeypatch):
    folder = str(tmp_path / "stored")
    monkeypatch.setattr(store_queries, "_folder", lambda spark: folder)
    rows = store_queries.stored_triples_csv(spark, sf_dir)
    assert all(f.endswith(".csv.gz") for f in os.listdir(folder) if f.startswith("part-"))
    assert rows.count() > 0
