"""Text expressions against plain Python, including texts made up by hypothesis."""

import hashlib
import pathlib
import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from noteskein.functions import text as X

CASES = [
    "", "---", "---\n", "---\n---", "---\n---\n", "---\na: 1\n---\nbody\n", "---\na: 1\n --- \r\nb\n---\nc", "---\nopen", "no block",
    "--- x\na\n---\t\n\n text ", "----\na\n---\nb", " ---\na\n---\nb", "---\na: 'x --- y'\n---\n", "---\n\n---\n　b \x1c", "﻿---\n---\n",
]


def split(text):
    """Block and body by lines; block is None when nothing is closed."""
    if text.startswith("---"):
        lines = text.split("\n")
        for i in range(1, len(lines)):
            if lines[i].strip() == "---":
                return "\n".join(lines[1:i]), "\n".join(lines[i + 1 :])
    return None, text


def tracked(text):
    block, body = split(text)
    return text if text.startswith("---") and block is None else body.strip()


def check(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    rows = df.select(t, X.py_strip(t), X.frontmatter_text(t), X.body_text(t), X.body_hash(t), X.frontmatter_block(t)).collect()
    for text, stripped, block, body, digest, loose in rows:
        assert stripped == text.strip(), repr(text)
        assert (block, body) == split(text), repr(text)
        assert digest == hashlib.sha256(tracked(text).encode()).hexdigest(), repr(text)
        end = text.find("---", 3) if text.startswith("---") else -1
        assert loose == (text[3:end].strip() if end != -1 else None), repr(text)


def test_frontmatter_cases(spark):
    check(spark, CASES)


PIECES = st.sampled_from(["---", "\n", " ", "\t", "\r", "a", "b: c", "\x1c", " ", "\u0085", "-", "\n---\n"])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=12).map("".join), min_size=40, max_size=80))
def test_frontmatter_random(spark, texts):
    check(spark, texts)
    check(spark, ["---\n" + t for t in texts])


def test_paths(spark):
    paths = [
        "30. People/John Smith.md", "a/b.md", "a b.md", "x.tar.md", ".md", "a/.md", "a.", "noext", "ä/Müller & Söhne.md", "A.MD", "_Drafts/x__y.md", "a\\b.md",
    ]

    def safe(path):
        path = path.removesuffix(".md").replace("/", "__").replace("\\", "__").replace(" ", "_")
        return re.sub("_+", "_", re.sub(r"[^\w\-.]", "_", path)).strip("_")

    df = spark.createDataFrame([(p,) for p in paths], "p string")
    for path, stem, name, note in df.select("p", X.file_stem(F.col("p")), X.safe_name(F.col("p")), X.is_note_path(F.col("p"))).collect():
        assert stem == pathlib.PurePosixPath(path).stem, path
        assert name == safe(path), path
        assert note == (path.lower().endswith(".md") and not any(p.startswith(".") for p in path.split("/"))), path


def test_links_types_keys(spark):
    df = spark.createDataFrame([("[[ A ]] [[B|b]] [[C#x]] ![[D]] [[]] [[E\nF]]",)], "t string")
    assert df.select(X.wikilinks(F.col("t"))).first()[0] == ["A", "B", "C#x", "D", "E\nF"]
    wanted = {
        "Persons/VC/a.md": "Person,VC", "Companies/VC/a.md": "VC,Company", "george/x.md": "Company", "My Family/x.md": "Family Office", "x.md": "",
    }
    df = spark.createDataFrame([(p,) for p in wanted], "p string")
    assert {p: t for p, t in df.select("p", X.types_csv(X.path_types(F.col("p")))).collect()} == wanted
    keys = [("a", True), (" NULL ", False), ("None", False), ("", False), (None, False), ("nullable", True), (" ", False)]
    df = spark.createDataFrame(keys, "k string, ok boolean")
    assert all(ok == got for ok, got in df.select("ok", F.coalesce(X.is_valid_key(F.col("k")), F.lit(False))).collect())
    slugs = df.limit(1).select(X.slug_id("person", F.lit("A. B, C"))).first()[0]
    assert slugs == "person_a_b_c"


def test_edge_type_rejects_unknown_pairs(spark):
    df = spark.createDataFrame([("Person", "Concept")], "a string, b string")
    try:
        df.select(X.edge_type(F.col("a"), F.col("b"))).collect()
    except Exception as error:
        assert "Person -> Concept" in str(error)
    else:
        raise AssertionError("an unknown pair must fail")


def test_last_per_name_is_quick_on_long_arrays(spark):
    import time

    from noteskein.functions.text import last_per_name

    items = F.transform(F.sequence(F.lit(0), F.lit(99_999)), lambda i: F.struct((i % 60_000).cast("string").alias("key"), i.cast("string").alias("value")))
    began = time.time()
    got = spark.range(1).select(last_per_name(items, "key", "value").alias("x")).select(F.size("x").alias("n"), F.col("x")[0].alias("a"), F.col("x")[59_999].alias("b")).first()
    assert (got["n"], tuple(got["a"]), tuple(got["b"])) == (60_000, ("0", "60000"), ("59999", "59999")) and time.time() - began < 60
    odd = spark.sql("SELECT array(named_struct('key', 'b', 'value', '1'), named_struct('key', cast(null as string), 'value', '2'), named_struct('key', 'b', 'value', cast(null as string)), named_struct('key', 'a', 'value', '4')) AS x")
    assert [tuple(r) for r in odd.select(last_per_name(F.col("x"), "key", "value").alias("y")).first()["y"]] == [("b", None), (None, "2"), ("a", "4")]
