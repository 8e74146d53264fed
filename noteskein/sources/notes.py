"""Reading notes: a listing first, texts only for the paths that are wanted."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from noteskein.functions.text import file_stem, in_folder, is_hidden
from noteskein.scale import checkpointed, union_all

def _system(root: str):
    """File system and path of a folder: local, or any cluster or object store by its URI."""
    from pyarrow import fs

    for scheme in ("s3a://", "s3n://"):
        root = root.replace(scheme, "s3://", 1) if root.startswith(scheme) else root
    if root.startswith("file:/") and not root.startswith("file://"):
        root = "file://" + root[5:]
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


_ENTRY = "path string, is_dir boolean, length bigint, modified timestamp"


def _list_folders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Entries of the folders of a task, one listing call per folder."""
    from pyarrow import fs

    for batch in batches:
        for folder in batch["path"]:
            system, path = _system(folder)
            rows = [
                (folder + info.path[len(path):], info.type == fs.FileType.Directory, int(info.size or 0), info.mtime)
                for info in system.get_file_info(fs.FileSelector(path))
                if not info.base_name.startswith(".")
            ]
            for start in range(0, len(rows), 10_000):
                frame = pd.DataFrame(rows[start : start + 10_000], columns=["path", "is_dir", "length", "modified"])
                frame["modified"] = pd.to_datetime(frame["modified"], utc=True).dt.tz_localize(None)
                yield frame


def list_notes(spark: SparkSession, root: str, template_folder: str | None = None) -> DataFrame:
    """``path`` (below the root), ``length``, ``modified`` of all notes, listed by the executors level by level.

    Unlike the built-in file listing it keeps names that start with an underscore, and empty files.
    Hidden names and the template folder are left out.
    """
    root = root.rstrip("/")
    folders = spark.createDataFrame([(root,)], "path string")
    levels = []
    while True:
        entries = checkpointed(folders.mapInPandas(_list_folders, _ENTRY))
        levels.append(entries.where(~F.col("is_dir") & F.endswith("path", F.lit(".md"))))
        folders = entries.where("is_dir").select("path")
        if folders.isEmpty():
            break
        folders = folders.repartition(spark.sparkContext.defaultParallelism, "path")
    found = union_all(levels).select(
        F.substring("path", len(root) + 2, 1 << 30).alias("path"), "length", "modified"
    )
    return visible_notes(found, template_folder)


def visible_notes(listing: DataFrame, template_folder: str | None = None) -> DataFrame:
    """Leave out hidden paths and the template folder."""
    kept = listing.where(~is_hidden(F.col("path")))
    return kept.where(~in_folder(F.col("path"), template_folder)) if template_folder else kept


def template_folder(spark: SparkSession, config_path: str) -> str | None:
    """Template folder named by the editor's one-object settings file, if there is one."""
    rows = spark.read.schema("folder string").json(config_path, multiLine=True).limit(1).collect()
    return rows[0]["folder"] if rows else None


# Text bytes one task reads.
_TASK_BYTES = 128 * 1024 * 1024


def read_texts(listing: DataFrame, root: str) -> DataFrame:
    """A listing with the ``content`` of its notes, read by the executors. Bytes that are no UTF-8 are replaced,
    and line ends of any system become line feeds, as in text mode.

    Paths are spread over tasks by the bytes to read, so a folder with most notes is no single task.
    """
    root = root.rstrip("/")
    total = listing.agg(F.sum("length")).first()[0] or 0
    parallel = max(listing.sparkSession.sparkContext.defaultParallelism, -(-total // _TASK_BYTES))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _system(root)
        for batch in batches:
            for start in range(len(batch)):
                row = batch.iloc[start : start + 1].copy()
                with system.open_input_stream(f"{base}/{row['path'].iloc[0]}") as stream:
                    row["content"] = stream.read().decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")
                yield row

    wanted = listing.select("path", "length", "modified").repartition(parallel, "path")
    return wanted.mapInPandas(read, "path string, length bigint, modified timestamp, content string")


def load_notes(spark: SparkSession, root: str, template: str | None = None) -> DataFrame:
    """The notes table of a folder: ``id, label, content, modified, length``."""
    return read_texts(list_notes(spark, root, template), root).select(
        F.col("path").alias("id"), file_stem(F.col("path")).alias("label"), "content", "modified", "length"
    )


def notes_in_folder(notes: DataFrame, folder: str) -> DataFrame:
    return notes.where(in_folder(F.col("id"), folder))


def folders(notes: DataFrame) -> DataFrame:
    """Folders of the first two levels, sorted."""
    parts = F.split("id", "/")
    depth = F.size(parts)
    first = F.when(depth > 1, F.concat(F.element_at(parts, 1), F.lit("/")))
    second = F.when(depth > 2, F.concat_ws("/", F.element_at(parts, 1), F.try_element_at(parts, F.lit(2)), F.lit("")))
    return notes.select(F.explode(F.array_compact(F.array(first, second))).alias("folder")).distinct().orderBy("folder")


def vault_info(notes: DataFrame) -> DataFrame:
    return notes.agg(F.count(F.lit(1)).alias("note_count"))
