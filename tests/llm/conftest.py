import pytest

LONG = "word " * 30_000 + "x" * 70_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, ties, and columns named like those of the operators."""
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta. " * 3, "en"), (2, "Alpha beta gamma delta epsilon zeta. " * 3, "en"),
        (2, "Alpha beta gamma delta epsilon zeta. " * 3, "en"), (3, "", None), (4, None, "de"), (None, "no id here, but a text", None),
        (None, None, None), (5, LONG, "en"), (6, "\n\n \t\n", "fr"), (7, "é" * 500 + " über ñ \U0001f600", "es"),
        (3, "the same id with another text and a mail: a.b@c.example.org", "en"), (8, "one", "en"),
    ]
    rows = [(i, t, lang, "s", len(t) if t is not None else None, 9, 9, 9, "x") for i, t, lang in rows]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, fp long, chunk int, length long, spans string"
    )


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
