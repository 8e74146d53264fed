"""Cutting note bodies into chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from noteskein.functions import fixed
from noteskein.functions.prompts import estimated_tokens
from noteskein.functions.text import is_blank
from noteskein.scale import BLOCK, checkpointed, running_total, with_previous

CHARS_PER_TOKEN = 4


def chunk_texts(text: Column, max_tokens: int = 512) -> Column:
    """Cut a text into consecutive pieces of bounded size; together they are the whole text.

    A piece is as long as it may be and ends, in order of preference, before a heading or after a
    blank line, after a sentence, after a blank, or at the bound. One pass of a native pattern; text never leaves the row.
    """
    size = max_tokens * CHARS_PER_TOKEN
    ends = [r"(?=\n#{1,6}\s)|(?<=\n\n)|\z", r"(?<=[.!?\n])(?=\s|\z)", r"(?<=\s)", ""]
    pattern = "|".join(rf".{{1,{size}}}(?:{end})" if end else rf".{{1,{size}}}" for end in ends)
    return F.regexp_extract_all(text, F.lit(f"(?s)(?:{pattern})"), F.lit(0))


def chunk_notes(notes: DataFrame, max_tokens: int = 512, text: str = "body") -> DataFrame:
    """``note_id, chunk_index, text, token_count`` of every note; blank pieces are kept out."""
    pieces = F.posexplode_outer(chunk_texts(F.col(text), max_tokens)).alias("chunk_index", "text")
    rows = notes.select(F.col("id").alias("note_id"), pieces)
    return rows.where(F.col("text").isNotNull() & ~is_blank(F.col("text"))).withColumns({
        "token_count": estimated_tokens(F.length("text") + (CHARS_PER_TOKEN - 1)),
        "chunk_type": F.lit("recursive"),
    })


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def semantic_chunks(
    sentences: DataFrame,
    threshold: float = fixed.SIMILARITY_THRESHOLD,
    max_tokens: int = fixed.CHUNK_TOKENS,
    width: int = BLOCK,
) -> DataFrame:
    """Chunks of ``note_id, pos, embedding, token_count`` with dense positions from 0, one row per chunk.

    A sentence opens a segment when it is less similar to the one before than the threshold, and within a segment it opens a chunk
    when it would take the chunk at hand beyond the bound; so only a chunk of one sentence can be above it. Running sums are
    blocked, and chunks are found by jumps of doubling length, so one very long note is spread over many tasks.
    """
    near = with_previous(sentences, ["note_id"], "pos", {"embedding": "_previous"}, width)
    likeness = cosine(F.col("embedding"), F.col("_previous"))
    opens = F.coalesce(likeness < threshold, F.lit(True)).cast("int")
    flagged = near.select("note_id", "pos", "token_count", opens.alias("_opens"))
    segments = running_total(flagged, ["note_id"], "pos", F.col("_opens"), "_segment", width)
    sized = checkpointed(running_total(segments, ["note_id", "_segment"], "pos", F.col("token_count"), "_tokens", width))
    starts = chunk_starts(sized, max_tokens, width)
    marked = sized.join(starts.withColumn("_starts", F.lit(1)), ["note_id", "pos"], "left").withColumn("_starts", F.coalesce("_starts", F.lit(0)))
    chunks = running_total(marked, ["note_id"], "pos", F.col("_starts"), "_chunk", width)
    return chunks.groupBy("note_id", (F.col("_chunk") - 1).alias("chunk_index")).agg(
        F.count(F.lit(1)).alias("n_sentences"), F.min("pos").alias("first_pos"), F.sum("token_count").alias("token_count")
    )


def chunk_starts(sized: DataFrame, max_tokens: int, width: int = BLOCK) -> DataFrame:
    """``note_id, pos`` of the sentences that open a chunk: segment starts, and from each start the first sentence that does not fit."""
    jumps = checkpointed(first_beyond(sized, max_tokens, width))
    starts = checkpointed(sized.where("_opens = 1").select("note_id", "pos"))
    while not jumps.isEmpty():
        step = jumps.select("note_id", "pos", F.col("next").alias("_next"))
        reached = starts.join(step, ["note_id", "pos"]).select("note_id", F.col("_next").alias("pos"))
        starts = checkpointed(starts.unionByName(reached).distinct())
        far = jumps.select("note_id", F.col("pos").alias("next"), F.col("next").alias("_next"))
        jumps = checkpointed(jumps.join(far, ["note_id", "next"]).select("note_id", "pos", F.col("_next").alias("next")))
    return starts


def first_beyond(sized: DataFrame, max_tokens: int, width: int) -> DataFrame:
    """``note_id, pos, next``: the first later sentence of the segment at which the tokens since ``pos`` pass the bound.

    Sums of a segment never fall, so this is the next sum above a limit: it is looked for within a block of sums, else it is
    the first of the next block that has any.
    """
    key = ["note_id", "_segment"]
    limit = F.greatest(F.col("_tokens") - F.col("token_count") + max_tokens, F.col("_tokens"))
    sums = sized.select(*key, F.col("_tokens").alias("_value"), F.lit(1).alias("_is_sum"), F.col("pos").alias("_sum_pos"), F.lit(None).cast("bigint").alias("_asks"))
    asked = sized.select(*key, limit.alias("_value"), F.lit(0).alias("_is_sum"), F.lit(None).cast("bigint").alias("_sum_pos"), F.col("pos").alias("_asks"))
    # A sentence without tokens ends no chunk, so at a limit that the sums already have, later ones of that sum are passed over too.
    both = sums.withColumn("_sum_pos", F.col("_sum_pos").cast("bigint")).unionByName(asked).withColumn("_block", F.floor(F.col("_value") / width))
    order = Window.partitionBy(*key, "_block").orderBy(F.desc("_value"), F.asc("_is_sum"), F.desc("_sum_pos")).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_here", F.last("_sum_pos", ignorenulls=True).over(order))
    lowest = both.groupBy(*key, "_block").agg(F.min(F.when(F.col("_is_sum") == 1, F.struct("_value", "_sum_pos"))).alias("_low"))
    later = Window.partitionBy(*key).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    after = lowest.select(*key, "_block", F.last("_low", ignorenulls=True).over(later)["_sum_pos"].alias("_after"))
    found = both.where(F.col("_asks").isNotNull()).join(after, [*key, "_block"])
    return found.select("note_id", F.col("_asks").alias("pos"), F.coalesce("_here", "_after").alias("next")).where(F.col("next").isNotNull())


def dense_positions(rows: DataFrame, key: str, order: str, name: str = "pos", width: int = BLOCK) -> DataFrame:
    """Positions from 0 by a unique whole-number column within a key."""
    numbered = running_total(rows, [key], order, F.lit(1), "_number", width)
    return numbered.withColumn(name, F.col("_number") - 1).drop("_number")
