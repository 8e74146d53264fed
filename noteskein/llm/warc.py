"""WARC archives with a two-level capture index.

Pages become gzipped records, one gzip member each, in archive files of a shared folder. A payload is written
once: of the rows with equal payloads the one with the largest id is the response, the others are revisits that refer to it.
The capture index sorts all captures by URL key with the host reversed, in range partitions; each shard is a
file of compressed blocks of ``BLOCK_LINES`` captures, with a sparse directory beside it that holds the first key
of each block. A lookup finds its shards by their key ranges, binary-searches the directory, reads the blocks
that can hold the key as byte ranges, and then the records as byte ranges of the archives.

Files are named by attempt and only the rows of successful attempts name them, so a repeated task does no harm.
The files go through ``pyarrow.fs``, which takes local and cluster file systems by their URI.

Defined results: a null html is an empty payload; a null url has the key ``-``; a null ``page_id`` stays null and
is a response only where no row of its payload has an id; rows that repeat id and payload are written each;
an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from noteskein.llm.common import text_bytes, to_batch, written
from noteskein.session import ensure_checkpoint_dir

BLOCK_LINES = 1024
#: Bytes after which a task begins another archive file.
ARCHIVE_BYTES = 1 << 30
#: Compressed bytes of records that a task reads, and bytes of payloads that it holds.
READ_BYTES = 8 << 20
HELD = 8 << 20
#: Pages have no time of capture; records need one.
CAPTURED = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SAFE = "".join(map(chr, range(33, 127)))


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; a bare path is local."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """URL with the labels of its host reversed; without scheme, user, usual port and fragment, and without blanks."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return quote(url, safe=_SAFE)
    if not host:
        return quote(url, safe=_SAFE)
    place = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "")
    return quote(f"{place}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else ""), safe=_SAFE)


def roles(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, digest, refers_to`` of every page; ``refers_to`` is null for responses.

    Ids and digests decide alone; payloads meet the decision by id and digest, so equal payloads do not meet in one task.
    """
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("digest", pa.array([digest(t) for t in text_bytes(batch.column(2))], pa.string()))

    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).mapInArrow(hashed, "page_id long, url string, html string, digest string")
    keep = rows.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    revisits = rows.select("page_id", "digest").distinct().join(keep.select("digest", "refers_to"), "digest")
    revisits = revisits.where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    revisits = revisits.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to")
    same = (F.col("digest") == F.col("_digest")) & F.col("page_id").eqNullSafe(F.col("_id"))
    return rows.join(revisits, same, "left").drop("_id", "_digest")


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None) -> bytes:
    """One WARC record, not yet compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {urn(page_id)}",
        f"WARC-Date: {CAPTURED}", f"WARC-Payload-Digest: sha1:{sha1}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url:
        head.insert(4, f"WARC-Target-URI: {quote(url, safe=_SAFE)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {urn(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def from_urn(value: str) -> int | None:
    own = value.removeprefix("<urn:page:").removesuffix(">")
    return None if own == "null" else int(own)


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def _task_name() -> str:
    context = TaskContext.get()
    return f"{context.partitionId():06d}-{context.taskAttemptId()}"


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write all pages; returns ``key, page_id, file, offset, length`` of each record."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = store(folder)
        schema = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
        out, name, at, number = None, "", 0, 0
        for batch in batches:
            rows = []
            ids, urls, digests, refers = (batch.column(k).to_pylist() for k in (0, 1, 3, 4))
            for page_id, url, payload, sha1, refers_to in zip(ids, urls, text_bytes(batch.column(2)), digests, refers):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at, number = f"archive-{_task_name()}-{number:04d}.warc.gz", 0, number + 1
                    out = files.open_output_stream(f"{base}/{name}", compression=None)
                    info = b"software: noteskein\r\nformat: WARC File Format 1.1\r\n"
                    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {CAPTURED}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
                    member = gzip.compress(head.encode() + info + b"\r\n\r\n", 4, mtime=0)
                    out.write(member)
                    at = len(member)
                member = gzip.compress(record(page_id, url, payload, sha1, refers_to), 4, mtime=0)
                out.write(member)
                rows.append((url_key(url), page_id, name, at, len(member)))
                at += len(member)
            if rows:
                yield to_batch(rows, schema)
        if out is not None:
            out.close()

    files, base = store(folder)
    files.create_dir(base, recursive=True)
    named = roles(pages).select("page_id", "url", "html", "digest", "refers_to")
    return written(named.mapInArrow(run, "key string, page_id long, file string, offset long, length long"))


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write the sorted index; returns ``shard, first, last`` (keys) of each of its files, one row per task at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = store(folder)
        shard = f"index-{_task_name()}"
        out, at, lines, directory, first, last = None, 0, [], [], None, ""

        def flush() -> None:
            nonlocal at
            member = gzip.compress("".join(line for _, line in lines).encode(), 6, mtime=0)
            out.write(member)
            directory.append((lines[0][0], at, len(member)))
            at += len(member)
            lines.clear()

        for batch in batches:
            for key, page_id, file, offset, length in zip(*[c.to_pylist() for c in batch.columns]):
                if out is None:
                    out, first = files.open_output_stream(f"{base}/{shard}.blocks", compression=None), key
                lines.append((key, f"{key} {json.dumps([page_id, file, offset, length])}\n"))
                last = key
                if len(lines) >= block_lines:
                    flush()
        if out is not None:
            if lines:
                flush()
            out.close()
            with files.open_output_stream(f"{base}/{shard}.directory", compression=None) as sparse:
                sparse.write("".join(f"{key} {start} {size}\n" for key, start, size in directory).encode())
            yield to_batch([(shard, first, last)], pa.schema([("shard", pa.string()), ("first", pa.string()), ("last", pa.string())]))

    ordered = captures.select("key", "page_id", "file", "offset", "length")
    ordered = ordered.repartitionByRange("key", "file", "offset").sortWithinPartitions("key", "file", "offset")
    return written(ordered.mapInArrow(run, "shard string, first string, last string"))


def lookup(keys: DataFrame, shards: DataFrame, folder: str) -> DataFrame:
    """Captures (``page_id, file, offset, length``) of each distinct ``key``."""
    ranges = sorted((r["first"].encode(), r["last"].encode(), r["shard"]) for r in shards.collect())
    firsts, lasts = [r[0] for r in ranges], [r[1] for r in ranges]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key in batch.column(0).to_pylist():
                data = key.encode()
                rows += [(ranges[k][2], key) for k in range(bisect_left(lasts, data), bisect_right(firsts, data))]
            if rows:
                yield to_batch(rows, pa.schema([("shard", pa.string()), ("key", pa.string())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = store(folder)
        schema = pa.schema([("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
        current, blocks, source, number, lines = None, [], None, -1, []
        for batch in batches:
            rows = []
            for shard, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if shard != current:
                    if source is not None:
                        source.close()
                    with files.open_input_stream(f"{base}/{shard}.directory", compression=None) as sparse:
                        blocks = [(k, int(a), int(n)) for k, a, n in (line.split(b" ") for line in sparse.read().splitlines())]
                    source, current, number = files.open_input_file(f"{base}/{shard}.blocks"), shard, -1
                data = key.encode()
                # Captures of a key may begin in the block before the first one that begins with it.
                k = max(0, bisect_left(blocks, data, key=lambda b: b[0]) - 1)
                while k < len(blocks) and blocks[k][0] <= data:
                    if k != number:
                        source.seek(blocks[k][1])
                        lines = [line.split(b" ", 1) for line in gzip.decompress(source.read(blocks[k][2])).splitlines()]
                        number = k
                    at = bisect_left(lines, data, key=lambda line: line[0])
                    while at < len(lines) and lines[at][0] == data:
                        rows.append(tuple(json.loads(lines[at][1])))
                        at += 1
                    if at < len(lines):
                        break
                    k += 1
            if rows:
                yield to_batch(rows, schema)
        if source is not None:
            source.close()

    dealt = keys.select("key").distinct().mapInArrow(assign, "shard string, key string")
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "key")
    return dealt.mapInArrow(search, "page_id long, file string, offset long, length long")


def read_records(captures: DataFrame, folder: str) -> DataFrame:
    """What the archives hold at the captures' byte ranges; a payload that differs from its digest is an error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = store(folder)
        schema = pa.schema([
            ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
            ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary()),
        ])
        name, source, held = None, None, 0
        for batch in batches:
            rows = []
            for file, offset, length in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                if held > HELD:
                    yield to_batch(rows, schema)
                    rows, held = [], 0
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, files.open_input_file(f"{base}/{file}")
                source.seek(offset)
                fields, http, payload = parse(gzip.decompress(source.read(length)))
                kind, sha1 = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                refers = None
                if kind == "revisit":
                    refers, payload = from_urn(fields["WARC-Refers-To"]), None
                elif digest(payload) != sha1:
                    raise ValueError(f"{file} at {offset}: the payload does not have its digest")
                rows.append((from_urn(fields["WARC-Record-ID"]), int(http["Content-Length"]), sha1, kind, refers, fields.get("WARC-Target-URI"), payload))
                held += len(payload or b"")
            if rows:
                yield to_batch(rows, schema)
                held = 0
        if source is not None:
            source.close()

    # Places are a few bytes that stand for whole records, so the number of tasks follows from the bytes to read.
    places = written(captures.select("file", "offset", "length"))
    parts = max(1, -(-(places.agg(F.sum("length")).first()[0] or 0) // READ_BYTES))
    dealt = places.repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
    )


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write archives and index, then read every record back through the index by the keys of all pages."""
    folder = folder or f"{ensure_checkpoint_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    captures = write_archives(pages, folder)
    shards = write_index(captures, folder)
    return read_records(lookup(captures, shards, folder), folder)
