"""The main text of web pages, by wrappers induced from all pages of a host.

Every page is read into a tree of block elements, whose shape has runs of equal siblings as one node. The commonest shape of a
host is its reference; every other shape of the host is aligned with it by simple tree matching. What stands at a node of the
reference is then compared over all different pages of the host: a text that nearly all of them have there is template,
what varies fills a slot, and a slot that is mostly links is navigation. A page's text is that of its slots. Within
an article, paragraphs, headings and list items are slots in any case, and where a page has an article, slots outside
of it are not text. Elements and names that HTML or habit set aside for menus, headers, footers, sidebars, notices, adverts, forms and reader comments are never text.

Pages with the same longest text count as one page, so that copies do not make a template of their text. Counts are taken per
(host, shape, node, digest) with map-side sums, so a host may hold any share of the rows; what is learnt of a host is one row, no
longer than its pages' own blocks, which meets the host's pages in a join that Spark broadcasts or splits where a host is hot. The result does not depend on how
rows are dealt out: references are commonest shapes, ties go to the smaller digest.

Defined results: null html is empty and has the text ""; a null url is a host of its own, ""; repeated rows are rows each; a
page that breaks off gives what was read; an empty table gives no rows; other columns are not looked at. White space is what
``str.split`` splits at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from noteskein.llm.common import decode, stored
from noteskein.llm.html_tree import TEXT_TAGS, Block, Page, align, collapsed, read_page

#: A node is template if so large a part of a host's different pages has one text there, of so many pages at least.
CONSTANT = 0.8
LEAST_PAGES = 3
#: A slot is navigation if so large a part of its characters is links.
LINKED = 0.6
HOST = r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)"
#: Characters of output held before they are handed on.
HELD = 8 << 20


def hosts(pages: DataFrame) -> DataFrame:
    """``page_id, url, host, html``."""
    url = F.lower(F.coalesce(F.col("url").cast("string"), F.lit("")))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.regexp_extract(url, HOST, 1).alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    )


def html_of(column: pa.Array) -> Iterator[str]:
    """One text after the other, so that no batch of long pages is held twice."""
    for value in column.cast(pa.large_binary()):
        yield decode(value.as_py())


def digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def slots_of(page: Page, place: list[int]) -> dict[int, list[Block]]:
    """The blocks of each node of the shape."""
    found: dict[int, list[Block]] = {}
    for block in page.blocks:
        found.setdefault(place[block.node], []).append(block)
    return found


def is_body(page: Page, node: int) -> bool:
    """Running text of an article, which is no template even if all pages of a host have it."""
    return page.inside[node] and page.tags[node] in TEXT_TAGS and not page.beside[node]


def fillings(page: Page, slots: dict[int, list[Block]]) -> list[tuple[int, int | None, int, int]]:
    """(node, digest of a text, its characters, those in links); without a digest for the node itself."""
    rows: list[tuple[int, int | None, int, int]] = []
    for node, found in sorted(slots.items()):
        rows.append((node, None, sum(len(b.text) for b in found), sum(b.linked for b in found)))
        rows += [(node, text, 0, 0) for text in sorted({digest(b.text) for b in found if not is_body(page, b.node)})]
    return rows


def facts(rows: DataFrame) -> DataFrame:
    """``host, shape, shape_id, main, slots``: what the wrapper of a host is learnt from, for each page."""
    slot = pa.struct([("node", pa.int32()), ("text", pa.int64()), ("chars", pa.int64()), ("linked", pa.int64())])
    schema = pa.schema([("host", pa.string()), ("shape", pa.string()), ("shape_id", pa.int64()), ("main", pa.int64()), ("slots", pa.list_(slot))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, held = [], 0
            for host, html in zip(batch.column(0).to_pylist(), html_of(batch.column(1))):
                page = read_page(html)
                shape, place = collapsed(page)
                slots = slots_of(page, place)
                runs = ["\n".join(b.text for b in blocks if not page.beside[b.node]) for blocks in slots.values()]
                longest = max(runs, key=lambda text: (len(text), text), default="")
                listed = fillings(page, slots)
                found.append((host, shape, digest(shape), digest(longest), listed))
                held += len(shape) + 64 * len(listed)
                if held > HELD:
                    yield to_rows(found)
                    found, held = [], 0
            yield to_rows(found)

    def to_rows(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found)) if found else [()] * len(schema)
        *plain, slots = columns
        named = [[dict(zip(("node", "text", "chars", "linked"), s)) for s in of] for of in slots]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([*plain, named], schema)], schema=schema)

    ddl = "host string, shape string, shape_id long, main long, slots array<struct<node: int, text: long, chars: long, linked: long>>"
    return rows.select("host", "html").mapInArrow(run, ddl)


def aligned(shapes: DataFrame) -> DataFrame:
    """``host, shape_id, node, at``: the reference's node for each node of a shape that has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for host, shape_id, shape, reference in zip(*(c.to_pylist() for c in batch.columns)):
                match = align(shape, reference)
                nodes = [n for n, at in enumerate(match) if at >= 0]
                columns = [[host] * len(nodes), [shape_id] * len(nodes), nodes, [match[n] for n in nodes]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.int32()))],
                    ["host", "shape_id", "node", "at"],
                )

    return shapes.select("host", "shape_id", "shape", "reference").mapInArrow(run, "host string, shape_id long, node int, at int")


def induced(rows: DataFrame) -> DataFrame:
    """``host, reference, constants, links``: one wrapper per host. ``constants`` are nodes with digests of template texts."""
    seen = stored(facts(rows))
    shapes = seen.groupBy("host", "shape_id").agg(F.min("shape").alias("shape"), F.count("*").alias("n"))
    common = F.struct("n", (-F.col("shape_id").cast("decimal(20,0)")).alias("smaller"))
    references = shapes.groupBy("host").agg(F.max_by("shape", common).alias("reference"))
    met = stored(shapes.join(references, "host"))
    nodes = aligned(met)

    different = seen.groupBy("host", "main").agg(F.min(F.struct("shape_id", "slots")).alias("page"))
    slots = different.select("host", "page.shape_id", F.explode("page.slots").alias("s")).select("host", "shape_id", "s.*")
    counts = slots.groupBy("host", "shape_id", "node", "text").agg(
        F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked")
    )
    known = stored(counts.join(nodes, ["host", "shape_id", "node"]).groupBy("host", "at", "text").agg(
        *[F.sum(c).alias(c) for c in ("n", "chars", "linked")]
    ))
    of_node = known.where("text is null")
    pages = of_node.select("host", "at", F.col("n").alias("pages"))
    frequent = known.where(F.col("text").isNotNull() & (F.col("n") >= LEAST_PAGES)).join(pages, ["host", "at"])
    constant = frequent.where(F.col("n") >= CONSTANT * F.col("pages")).groupBy("host").agg(
        F.sort_array(F.collect_list(F.struct("at", "text"))).alias("constants")
    )
    linked = of_node.where(F.col("linked") >= LINKED * F.col("chars")).groupBy("host").agg(
        F.sort_array(F.collect_list("at")).alias("links")
    )
    return references.join(constant, "host", "left").join(linked, "host", "left")


def text_of(page: Page, place: list[int], status: list[str], constants: list[set[int]]) -> str:
    """The blocks of a page that are text; ``status`` and ``constants`` are by node of the shape.

    What has no match in the reference may be any of its template texts.
    """
    slots = slots_of(page, place)
    linked = {n for n, found in slots.items() if sum(b.linked for b in found) >= LINKED * sum(len(b.text) for b in found)}

    def is_text(block: Block) -> bool:
        if page.beside[block.node] or is_body(page, block.node):
            return not page.beside[block.node]
        at = place[block.node]
        if constants[at] and digest(block.text) in constants[at]:
            return False
        return status[at] == "slot" or (status[at] == "unmatched" and at not in linked)

    found = [block for block in page.blocks if is_text(block)]
    article = any(page.inside[block.node] for block in found)
    return "\n\n".join(block.text for block in found if page.inside[block.node] or not article)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars``; see the module."""
    rows = hosts(pages)
    wrappers = stored(induced(rows))
    met = rows.join(wrappers.withColumnRenamed("host", "of"), rows["host"] == F.col("of"), "left")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches: dict[tuple[str, str], list[int]] = {}
        for batch in batches:
            found, held = [], 0
            columns = [batch.column(n).to_pylist() for n in range(4)]
            for page_id, url, host, reference, html, constants, links in zip(
                *columns, html_of(batch.column(4)), batch.column(5).to_pylist(), batch.column(6).to_pylist()
            ):
                page = read_page(html)
                shape, place = collapsed(page)
                if len(matches) > 4096:
                    matches.clear()
                key = host, shape
                if key not in matches:
                    matches[key] = align(shape, reference) if reference is not None else [-1] * (max(place) + 1)
                match = matches[key]
                navigation = set(links or ())
                status = ["unmatched" if at < 0 else "links" if at in navigation else "slot" for at in match]
                fixed: dict[int, set[int]] = {}
                for c in constants or ():
                    fixed.setdefault(c["at"], set()).add(c["text"])
                anywhere = set().union(*fixed.values())
                text = text_of(page, place, status, [fixed.get(at, set()) if at >= 0 else anywhere for at in match])
                found.append((page_id, url, text, len(text)))
                held += len(text)
                if held > HELD:
                    yield to_rows(found)
                    found, held = [], 0
            yield to_rows(found)

    def to_rows(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found)) if found else [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    ordered = met.select("page_id", "url", "host", "reference", "html", "constants", "links")
    return ordered.mapInArrow(run, "page_id long, url string, text string, n_chars long")
