"""A graph kept current by signed changes: a cycle reads what its notes touch, not all facts.

What every note says is kept per batch. A batch replaces the notes that changed, moved, came or went: the difference of what they
say now and what they said is a count to add to each fact, positive or negative. A fact is there while its count is above zero.
From the facts whose counts change follow the names they end in (in lower case, per category), from these the facts
that touch them, before and after; and only for those are entities and edges worked out, twice, and their difference is written.

All tables are logs of batch folders, split by a bucket of the name or note, so a reader of some names opens their buckets only.
A batch overwrites its own folders and is published last; readers name the batch they want, so one that runs during a write,
or after one that failed, sees the graph of the batch before. ``compact`` sums a log up into a base.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from noteskein.functions import fixed
from noteskein.functions.text import py_strip
from noteskein.operators import integrity, notes_graph, triples
from noteskein.operators.triples import FACT
from noteskein.scale import checkpointed

BUCKETS = 64
#: A base is written after so many batches.
COMPACT_EVERY = 16

_FACT = ", ".join(f"{c} string" for c in FACT)
TABLES = {
    "said": f"{_FACT}, source_file string, n_copies bigint, made int",
    "replaced": "source_file string, made int",
    "ends": f"category string, key string, {_FACT}, n bigint",
    "entities": "category string, id string, n bigint",
    "edges": "edge_type string, src string, dst string, relationship string, n bigint",
    "references": "edge_type string, src string, dst string, n bigint",
}
_BUCKETED = {"said": "source_file", "replaced": "source_file", "ends": "key", "entities": "id", "edges": "src", "references": "dst"}


def _bucket(name: str) -> Column:
    return F.pmod(F.xxhash64(name), F.lit(BUCKETS)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def _numbers(spark: SparkSession, root: str, kind: str) -> list[int]:
    """Numbers of the folders ``kind=N`` below ``root`` that were written completely."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    pattern = hadoop.Path(f"{root}/{kind}=*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(int(str(s.getPath().getParent().getName()).split("=")[1]) for s in found or [])


def published(spark: SparkSession, root: str, before: int | None = None) -> int | None:
    """The newest batch that readers may see, below ``before``; none where nothing was built yet."""
    done = [n for n in _numbers(spark, f"{root}/published", "batch") if before is None or n < before]
    return max(done, default=None)


def read_log(spark: SparkSession, root: str, name: str, upto: int | None, buckets: list[int] | None = None) -> DataFrame:
    """Rows of a table up to a batch: the newest base, and the batches after it; only some buckets if given."""
    empty = spark.createDataFrame([], TABLES[name])
    if upto is None:
        return empty
    base = max((n for n in _numbers(spark, f"{root}/bases", "version") if n <= upto), default=None)
    wanted = F.lit(True) if buckets is None else F.col("bucket").isin(buckets)
    rows, columns = empty, empty.columns
    if base is not None and _exists(spark, f"{root}/base/{name}"):
        kept = spark.read.schema(f"{TABLES[name]}, version int, bucket int").parquet(f"{root}/base/{name}")
        rows = kept.where((F.col("version") == base) & wanted).select(*columns)
    if _exists(spark, f"{root}/changes/{name}"):
        later = spark.read.schema(f"{TABLES[name]}, batch int, bucket int").parquet(f"{root}/changes/{name}")
        rows = rows.unionByName(later.where((F.col("batch") > (-1 if base is None else base)) & (F.col("batch") <= upto) & wanted).select(*columns))
    return rows


def _write(rows: DataFrame, path: str, name: str) -> None:
    bucketed = rows.select(*[c.split()[0] for c in TABLES[name].split(", ")]).withColumn("bucket", _bucket(_BUCKETED[name]))
    # A bucket in few files, not in one per task; one that is too large is dealt to several tasks.
    bucketed.hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(path)


def _buckets_of(rows: DataFrame, name: str) -> list[int]:
    """At most ``BUCKETS`` numbers."""
    return sorted(r[0] for r in rows.select(_bucket(name)).distinct().collect())


def said_before(spark: SparkSession, root: str, upto: int | None, notes: DataFrame) -> DataFrame:
    """What notes (``source_file``) said by the last batch that replaced them."""
    if upto is None:
        return read_log(spark, root, "said", None)
    buckets = _buckets_of(notes, "source_file")
    marks = read_log(spark, root, "replaced", upto, buckets).join(notes, "source_file", "left_semi")
    last = marks.groupBy("source_file").agg(F.max("made").alias("made"))
    return read_log(spark, root, "said", upto, buckets).join(last, ["source_file", "made"])


def canonical_facts(said: DataFrame) -> DataFrame:
    """Facts in canonical order, once per note."""
    known = triples.keep_known_categories(said).select(*FACT, "source_file")
    return triples.canonical_ends(triples.orient(known)).select(*FACT, "source_file").distinct()


def _name_ends() -> list[Column]:
    return [
        F.struct(F.col(f"{end}_category").alias("category"), F.lower(py_strip(F.col(f"{end}_label"))).alias("key"), F.col(f"{end}_label").alias("id"))
        for end in ("source", "target")
    ]


def by_end(facts: DataFrame) -> DataFrame:
    """``category, key`` of each end with the fact and ``n``; a fact between two spellings of a name once."""
    ends = F.array_distinct(F.array(*[F.struct(e["category"].alias("category"), e["key"].alias("key")) for e in _name_ends()]))
    return facts.select(F.inline(ends), *FACT, "n")


def _standing(ends: DataFrame) -> DataFrame:
    """``category, key`` and fact of those with a count above zero."""
    return ends.groupBy("category", "key", *FACT).agg(F.sum("n").alias("n")).where("n > 0").drop("n")


def _names(standing: DataFrame) -> DataFrame:
    """Valid entities (``category, key, id``) at the keys of such rows."""
    ends = standing.select(F.col("category").alias("_category"), F.col("key").alias("_key"), F.inline(F.array(*_name_ends())))
    here = ends.where((F.col("category") == F.col("_category")) & (F.col("key") == F.col("_key"))).select("category", "key", "id").distinct()
    return integrity.valid_rows(here, "id")


def _edges(facts: DataFrame, names: DataFrame) -> DataFrame:
    rows = integrity.valid_rows(triples.edges(facts), "src", "dst")
    return integrity.valid_edges(integrity.resolve_ends(rows, names.select("category", "id")))


def _references(said: DataFrame) -> DataFrame:
    known = triples.keep_known_categories(said)
    ends = known.select(F.inline(F.array(*_name_ends()))).select("category", "id").distinct()
    notes = known.select(F.col("source_file").alias("id")).distinct()
    return notes_graph.reference_edges(known, integrity.valid_rows(ends, "id"), notes).withColumnRenamed("n_refs", "n")


def _difference(after: DataFrame, before: DataFrame) -> DataFrame:
    """Signed counts of the rows that are not the same in both; a column ``n`` counts, else each row counts one."""
    one = lambda rows, sign: rows.withColumn("n", (F.col("n") if "n" in rows.columns else F.lit(1).cast("long")) * sign)
    both = one(after, 1).unionByName(one(before, -1))
    keys = [c for c in both.columns if c != "n"]
    return both.groupBy(*keys).agg(F.sum("n").alias("n")).where("n != 0")


def apply_batch(spark: SparkSession, root: str, batch: int, replaced: DataFrame, said: DataFrame) -> None:
    """Replace what the notes ``replaced`` (``source_file``) said by ``said`` (facts, ``source_file, n_copies``), and publish the batch."""
    upto = published(spark, root, batch)
    target = lambda name: f"{root}/changes/{name}/batch={batch}"
    notes = checkpointed(replaced.select("source_file").distinct())
    now = checkpointed(said.join(notes, "source_file", "left_semi").select(*FACT, "source_file", "n_copies"))
    then = checkpointed(said_before(spark, root, upto, notes).select(*FACT, "source_file", "n_copies"))
    _write(now.withColumn("made", F.lit(batch)), target("said"), "said")
    _write(notes.withColumn("made", F.lit(batch)), target("replaced"), "replaced")
    _write(_difference(_references(now), _references(then)), target("references"), "references")

    per_note = lambda rows: canonical_facts(rows).drop("source_file")
    change = checkpointed(_difference(per_note(now), per_note(then)))
    changed_ends = checkpointed(by_end(change))
    _write(changed_ends, target("ends"), "ends")

    keys = checkpointed(changed_ends.select("category", "key").distinct())
    held = read_log(spark, root, "ends", upto, _buckets_of(keys, "key")) if upto is not None else read_log(spark, root, "ends", None)
    near = checkpointed(held.join(keys, ["category", "key"], "left_semi"))
    facts_before = checkpointed(_standing(near).select(*FACT).distinct())
    facts_after = checkpointed(_standing(near.unionByName(changed_ends)).select(*FACT).distinct())

    # Edges of these facts also end in names that did not change, whose spellings decide as well.
    around = facts_before.unionByName(facts_after).select(F.inline(F.array(*_name_ends()))).select("category", "key").distinct()
    around = checkpointed(around)
    held = read_log(spark, root, "ends", upto, _buckets_of(around, "key")) if upto is not None else held
    near = checkpointed(held.join(around, ["category", "key"], "left_semi"))
    names_before, names_after = checkpointed(_names(_standing(near))), checkpointed(_names(_standing(near.unionByName(changed_ends))))
    _write(_difference(_edges(facts_after, names_after), _edges(facts_before, names_before)), target("edges"), "edges")
    own = lambda names: names.join(keys, ["category", "key"], "left_semi").select("category", "id")
    _write(_difference(own(names_after), own(names_before)), target("entities"), "entities")
    spark.range(1).write.mode("overwrite").parquet(f"{root}/published/batch={batch}")
    bases = [n for n in _numbers(spark, f"{root}/bases", "version") if n <= batch]
    if len([n for n in _numbers(spark, f"{root}/published", "batch") if n > max(bases, default=-1)]) >= COMPACT_EVERY:
        compact(spark, root, batch)


def summed(spark: SparkSession, root: str, name: str, upto: int | None) -> DataFrame:
    rows = read_log(spark, root, name, upto)
    return rows.groupBy(*[c for c in rows.columns if c != "n"]).agg(F.sum("n").alias("n")).where("n > 0")


def entities_at(spark: SparkSession, root: str, upto: int | None) -> DataFrame:
    found = summed(spark, root, "entities", upto).where(F.col("category").isin(fixed.CATEGORIES))
    return found.select("category", "id", F.col("id").alias("label"), F.lit("").alias("metadata"))


def edges_at(spark: SparkSession, root: str, upto: int | None) -> DataFrame:
    """Edges; several facts that resolve to one edge are as many rows, as in a whole build."""
    found = summed(spark, root, "edges", upto)
    return found.select("edge_type", "src", "dst", "relationship", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_copy")).drop("_copy")


def references_at(spark: SparkSession, root: str, upto: int | None) -> DataFrame:
    return summed(spark, root, "references", upto).withColumnRenamed("n", "n_refs")


def compact(spark: SparkSession, root: str, upto: int) -> None:
    """Sum every log up into a base at a published batch; readers of later batches start from it."""
    for name in TABLES:
        if name in ("said", "replaced"):
            marks = read_log(spark, root, "replaced", upto).groupBy("source_file").agg(F.max("made").alias("made"))
            rows = marks if name == "replaced" else read_log(spark, root, "said", upto).join(marks, ["source_file", "made"])
        else:
            log = read_log(spark, root, name, upto)
            rows = log.groupBy(*[c for c in log.columns if c != "n"]).agg(F.sum("n").alias("n")).where("n != 0")
        _write(rows, f"{root}/base/{name}/version={upto}", name)
    spark.range(1).write.mode("overwrite").parquet(f"{root}/bases/version={upto}")


def expire(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """Remove batch folders that no reader of the newest ``keep`` published batches needs, and older bases."""
    batches, bases = _numbers(spark, f"{root}/published", "batch"), _numbers(spark, f"{root}/bases", "version")
    oldest = batches[-keep:][0] if batches else None
    base = max((n for n in bases if oldest is not None and n <= oldest), default=None)
    if base is None:
        return []
    gone = [n for n in batches if n <= base]
    folders = [f"{root}/changes/{name}/batch={n}" for name in TABLES for n in gone]
    folders += [f"{root}/base/{name}/version={n}" for name in TABLES for n in bases if n < base]
    folders += [f"{root}/published/batch={n}" for n in gone if n != base] + [f"{root}/bases/version={n}" for n in bases if n < base]
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone
