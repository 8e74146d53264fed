"""Running classification tasks over notes: work list, model, typed results, one rewrite per note."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from noteskein.functions.frontmatter import ENTRIES, last_per_key, note_entries, no_entries, write_note
from noteskein.functions.responses import parse_typed, read_results, results_error
from noteskein.functions.text import body_text, is_blank, py_strip
from noteskein.operators import classify as C
from noteskein.operators.extraction import ModelFunction, ask_model, cached_responses
from noteskein.scale import checkpointed, lookup

EMPTY_NOTE = "Note content is empty"


def classify(
    notes: DataFrame,
    tasks: DataFrame,
    ask: ModelFunction,
    cache_path: str | None = None,
    folder: str | None = None,
    force: bool = False,
    parallel: int | None = None,
) -> DataFrame:
    """One row per note and task that had to run: ``note_path, task_id, tag, status, error, entries``.

    A task with several tags asks once per note. Equal prompts, of equal bodies and tasks that word them alike, are asked
    once. ``entries`` are the tags to write, as JSON texts. Without a cache folder the responses are kept in a checkpoint.

    Pairs of note and task carry a hash of the body; a body is shuffled once, to its list of tasks, and
    its prompts are made where they are sent.
    """
    body = py_strip(body_text(F.col("content")))
    key = F.base64(F.unhex(F.sha2(body, 256))).alias("_body")
    read = notes.select("id", note_entries(F.col("content")).alias("entries"), key, is_blank(body).alias("_blank"))
    work = checkpointed(C.worklist(read, tasks, folder, force).select("id", "task", "_body", "_blank"))
    asks = F.struct(*[F.col(f"task.{c}").alias(c) for c in C.PROMPT_FIELDS])
    request = F.base64(F.unhex(F.sha2(F.concat("_body", F.to_json(asks)), 256)))
    places = work.select("id", "task", F.when(~F.col("_blank"), request).alias("chunk_key"), "_blank")
    # Pairs of one body lie in few partitions and merge there.
    asked = work.where(~F.col("_blank")).groupBy("_body").agg(F.collect_set(asks).alias("_asks"))
    different = asked.select("_body", F.explode("_asks").alias("task"))
    different = different.select(request.alias("chunk_key"), "_body", "task")

    def texts(keys: DataFrame) -> DataFrame:
        lists = keys.groupBy("_body").agg(F.collect_list(F.struct("chunk_key", "task")).alias("_asks"))
        bodies = notes.where(~is_blank(body)).select(key, body.alias("body")).dropDuplicates(["_body"])
        met = bodies.join(lists, "_body").select("body", F.explode("_asks").alias("_ask")).select("body", "_ask.*")
        system, user = C.messages()
        return met.select("chunk_key", F.concat(system, F.lit("\n\n"), user).alias("text"))

    if cache_path:
        responses = cached_responses(different, ask, cache_path, parallel, texts)
    else:
        responses = checkpointed(ask_model(different, ask, None, parallel, texts))
    answered = lookup(places, responses, F.col("chunk_key"), "chunk_key", ["id"])
    many = (F.col("task.task_type") == "multi") & (F.size("task.tag_schema") > 0)
    expected = F.transform("task.tag_schema", lambda t: t["tag"])
    read_back = answered.withColumn("_results", F.when(many, read_results(F.col("raw"))))
    error = (
        F.when(F.col("_blank"), EMPTY_NOTE)
        .when(many, results_error(F.col("raw"), F.col("_results"), expected))
        .when(F.col("raw").isNull(), "Empty response")
    )
    single = F.array(F.struct(
        F.col("task.tag").alias("key"), C.typed_json(parse_typed(F.col("raw"), F.col("task.output_type"))).alias("value")
    ))
    several = F.transform(
        "task.tag_schema",
        lambda t: F.struct(
            t["tag"].alias("key"),
            C.typed_json(parse_typed(F.try_element_at(F.col("_results"), t["tag"]), t["output_type"])).alias("value"),
        ),
    )
    entries = F.when(F.col("error").isNull(), F.when(many, several).otherwise(single)).otherwise(no_entries())
    return read_back.withColumn("error", error).select(
        F.col("id").alias("note_path"), F.col("task.id").alias("task_id"), F.col("task.tag").alias("tag"),
        F.when(F.col("error").isNull(), "completed").otherwise("failed").alias("status"), "error", entries.alias("entries"),
    )


def store_results(notes: DataFrame, results: DataFrame) -> DataFrame:
    """Notes with all results written into their frontmatter, one rewrite per note.

    A note has at most one row per task, so the list per note is as short as the task list.
    """
    listed = F.array_sort(F.collect_list(F.struct("task_id", "entries")))
    tags = results.where(F.col("status") == "completed").groupBy(F.col("note_path").alias("id")).agg(
        F.flatten(F.transform(listed, lambda r: r["entries"])).alias("_tags")
    )
    joined = lookup(notes, tags.withColumnRenamed("id", "_id"), F.col("id"), "_id", ["id"]).withColumn("_entries", note_entries(F.col("content")))
    merged = last_per_key(F.concat("_entries", F.coalesce("_tags", F.array().cast(ENTRIES))))
    ready = joined.withColumn("_entries", F.explode(F.array(merged)))
    written = F.when(F.col("_tags").isNotNull(), write_note(F.col("_entries"), body_text(F.col("content")))).otherwise(F.col("content"))
    return ready.withColumn("content", written).select(notes.columns)
