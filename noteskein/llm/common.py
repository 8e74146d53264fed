"""What several operators share: reading text columns, words, and rows that pass through Arrow unchanged.

Words are runs of characters other than ASCII white space, so they can be cut on the UTF-8 bytes:
``bytes.split()`` splits at exactly those six characters, and ``bytes.lower()`` changes A-Z only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from noteskein.session import ensure_checkpoint_dir

WHITE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, so that no other column can clash; a null text is an empty one."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )


def text_key() -> Column:
    """Hash of the text of a row, which tells rows of one id apart."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def text_bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.large_binary()).to_pylist()


def sliced(batches: Iterable[pa.RecordBatch], column: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in parts of about ``size`` bytes of one text column, so that no task holds copies of a whole batch."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        first = 0
        while first < len(batch):
            upto = (ends[first - 1] if first else 0) + size
            last = max(int(np.searchsorted(ends, upto, "right")), first + 1)
            yield batch.slice(first, last - first)
            first = last


def decode(data: bytes) -> str:
    """Text of UTF-8 bytes; a byte that is none of UTF-8 counts as one replacement character."""
    return data.decode("utf-8", "replace")


def map_rows(df: DataFrame, make: Callable[[], Callable[[int | None, bytes], Iterator[tuple]]], schema: str) -> DataFrame:
    """Rows made from each (doc_id, text bytes). ``make`` runs once per task and may keep caches."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_of = make()
        for batch in sliced(batches, 1):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                rows.extend(rows_of(doc_id, text))
                if len(rows) >= 20_000:
                    yield to_batch(rows, arrow)
                    rows = []
            if rows:
                yield to_batch(rows, arrow)

    return df.mapInArrow(run, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def replace_column(batch: pa.RecordBatch, name: str, values: list) -> pa.RecordBatch:
    at = batch.schema.get_field_index(name)
    return batch.set_column(at, batch.schema.field(at), pa.array(values, batch.schema.field(at).type))


def written(df: DataFrame) -> DataFrame:
    """The rows from the shared checkpoint folder: computed once, and still there when executors are lost."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Like ``written``, as a Parquet table of the shared folder: smaller than a checkpoint where rows are many."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
