"""Operator 1: WARC archives with a two-level capture index.

``write_archives`` turns pages into WARC records (a gzip member each) in archive files of the shared
folder and returns the captures: where each record lies. ``build_index`` sorts the captures by
reversed-host URL key and writes them as compressed blocks, with a sparse directory (the first key and
place of each block) beside each shard of blocks; the list of shards, one row for each range of the
sort, is the upper level. ``find_captures`` looks keys up: a binary search in the shard list and in the
shard's directory gives the blocks that can hold the key, a range read gives the block, a binary search
in it the captures. ``read_records`` reads records by ranges of the archives.

Writers name their files by attempt, and only what a finished task returns is referred to, so a task
that runs again after a lost executor leaves at most files that nothing points to. Folders are
addressed by URI (``pyarrow.fs``), so they may lie in any store that the executors reach. A task holds
one block, one directory and one stretch of ``READ_BYTES`` (or one record) at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuspack.session import materialize, scratch_dir

#: Payloads of fewer bytes are always stored, never revisits.
LEAST_REVISIT = 1000
BLOCK_CAPTURES = 512
ARCHIVE_BYTES = 1 << 30
READ_BYTES = 8 << 20
GAP_BYTES = 64 << 10
DATE = "1970-01-01T00:00:00Z"


def _store(uri: str):
    """The file system of a URI or plain path, and the path in it."""
    from pyarrow import fs

    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:", uri):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def _printable(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def url_key(url: str | None) -> str:
    """The reversed-host key of a URL: ``com,example,www)/path?query`` (null: empty).

    Scheme, user, fragment, default port and the host's case play no part. What has no host is its
    own key.
    """
    if url is None:
        return ""
    bare = _printable(url.strip())
    try:
        parts = urllib.parse.urlsplit(bare)
        host, port = parts.hostname, parts.port
    except ValueError:
        return bare
    if not host:
        return bare
    tail = "" if port in (None, 80, 443) else f":{port}"
    return ",".join(reversed(host.split("."))) + tail + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record, not yet compressed. A revisit keeps the HTTP header, with the payload's length, alone."""
    ident = "" if page_id is None else page_id
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{ident}>", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_printable(url)}")
    if kind == "revisit":
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>",
        ]
        payload = b""
    head.append(f"Content-Length: {len(http) + len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def parse(member: bytes) -> dict:
    """A gzip member that holds one record, as a dictionary; a broken record is an error."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?im)^content-length: *(\d+)", http)[1])
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:"))
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).digest() != digest):
        raise ValueError(f"record {fields['warc-record-id']}: the payload differs from its digest")
    number = lambda v: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", v or "")) else None
    return {
        "page_id": number(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": kind,
        "refers_to": number(fields.get("warc-refers-to")), "payload_bytes": length, "payload_digest": digest.hex(),
        "payload": payload if kind == "response" else None,
    }


def with_revisits(pages: DataFrame) -> DataFrame:
    """``page_id, url, html binary, record_type, refers_to`` of each page.

    Of the pages with equal payloads of ``LEAST_REVISIT`` bytes or more those with the largest ``page_id``
    are responses, and the others revisit that ``page_id``. Pages without a ``page_id`` can only revisit;
    where none of equal pages has one, all are responses. A null ``html`` is an empty payload.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    df = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("html"))
    key = F.when(F.octet_length("html") >= LEAST_REVISIT, F.sha1("html"))
    equal = df.select("page_id", key.alias("_digest")).filter("_digest is not null").groupBy("_digest")
    equal = materialize(equal.agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n"), "warc-equal")
    # a small payload meets no other: a key of its own, so that they do not all go to one task
    own = F.concat(F.lit("-"), F.xxhash64("page_id", "url", "html").cast("string"))
    df = df.withColumn("_digest", F.coalesce(key, own)).join(equal, "_digest", "left")
    again = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return df.select(
        "page_id", "url", "html", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("_first")).alias("refers_to")
    )


CAPTURES = "url_key string, page_id long, archive string, offset long, length long"


def write_archives(pages: DataFrame, folder: str, date: str = DATE) -> DataFrame:
    """Write a record for each page under ``folder`` and return the written table of captures.

    Each task writes archives of its own, of ``ARCHIVE_BYTES`` at most (or one record).
    """
    names = [f.split()[0] for f in CAPTURES.split(", ")]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(folder)
        sink, at, name = None, 0, ""
        try:
            for batch in batches:
                rows: list[tuple] = []
                for i in range(batch.num_rows):
                    page_id, url, html, kind, refers = (batch.column(j)[i].as_py() for j in range(5))
                    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = squeeze.compress(record(page_id, url, html, kind, refers, date)) + squeeze.flush()
                    if sink is None or at + len(member) > ARCHIVE_BYTES:
                        if sink is not None:
                            sink.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        store.create_dir(top, recursive=True)
                        sink = store.open_output_stream(f"{top}/{name}", compression=None)
                    sink.write(member)
                    rows.append((url_key(url), page_id, f"{folder}/{name}", at, len(member)))
                    at += len(member)
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names=names)
        finally:
            if sink is not None:
                sink.close()

    return materialize(with_revisits(pages).mapInArrow(write, CAPTURES), "warc-captures")


@dataclass(frozen=True)
class Index:
    """The upper level: for each shard its first key, its last key and its URI, ascending; at most one for
    each shuffle partition of the build."""

    shards: list[tuple[str, str, str]]


def build_index(captures: DataFrame, folder: str) -> Index:
    """Write the sorted blocks and their directories under ``folder``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(folder)
        name, sink, at = f"{folder}/{uuid.uuid4().hex}", None, 0
        directory: list[str] = []
        block: list[str] = []
        first = last = None

        def flush():
            nonlocal at, block
            squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = squeeze.compress("\n".join(block).encode()) + squeeze.flush()
            sink.write(member)
            directory.append(f"{block[0].split('\t', 1)[0]}\t{at}\t{len(member)}")
            at, block = at + len(member), []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if sink is None:
                    store.create_dir(top, recursive=True)
                    sink, first = store.open_output_stream(_store(f"{name}.cdx.gz")[1], compression=None), row[0]
                last = row[0]
                block.append("\t".join("" if v is None else str(v) for v in row))
                if len(block) == BLOCK_CAPTURES:
                    flush()
        if sink is not None:
            if block:
                flush()
            sink.close()
            with store.open_output_stream(_store(f"{name}.dir")[1], compression=None) as out:
                out.write("\n".join(directory).encode())
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (first, last, name)], names=["first_key", "last_key", "shard"])

    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["url_key", "archive", "offset"]
    ranged = captures.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    shards = materialize(ranged.mapInArrow(write, "first_key string, last_key string, shard string"), "warc-shards")
    return Index(sorted((r["first_key"], r["last_key"], r["shard"]) for r in shards.collect()))


def _directory(shard: str) -> tuple[list[str], list[tuple[int, int]]]:
    store, path = _store(f"{shard}.dir")
    with store.open_input_stream(path, compression=None) as source:
        rows = [line.split("\t") for line in source.read().decode().split("\n")]
    return [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]


def blocks_of(key: str, index: Index, directory) -> Iterator[tuple[str, int, int]]:
    """The blocks that can hold ``key``: ``shard, offset, length``."""
    lasts = [s[1] for s in index.shards]
    for first, _, shard in index.shards[bisect_left(lasts, key) :]:
        if first > key:
            return
        keys, places = directory(shard)
        for k in range(max(0, bisect_left(keys, key) - 1), bisect_right(keys, key)):
            yield shard, *places[k]


def find_captures(urls: DataFrame, index: Index) -> DataFrame:
    """The captures of every distinct key of ``urls`` (a column ``url``): the columns of ``CAPTURES``.

    A key without captures gives no row. A key's blocks are read apart, so one with very many captures
    spreads over tasks.
    """
    spark = urls.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    @F.pandas_udf("string")
    def keys(values):
        import pandas as pd

        return pd.Series([url_key(None if v is None or v != v else v) for v in values], dtype=object)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}

        def directory(shard):
            if shard not in kept:
                if len(kept) > 1:
                    kept.pop(next(iter(kept)))
                kept[shard] = _directory(shard)
            return kept[shard]

        for batch in batches:
            found = [(key, *place) for key in batch.column(0).to_pylist() for place in blocks_of(key, index, directory)]
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in found], k) for j, k in enumerate(kinds)], names=["url_key", "shard", "offset", "length"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, lines, own, source, opened = None, [], [], None, None
        for batch in batches:
            rows: list[list[str]] = []
            for key, shard, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                if at != (shard, offset):
                    if opened != shard:
                        store, path = _store(f"{shard}.cdx.gz")
                        source, opened = store.open_input_file(path), shard
                    lines = zlib.decompress(source.read_at(length, offset), 31).decode().split("\n")
                    own, at = [line.split("\t", 1)[0] for line in lines], (shard, offset)
                rows += [lines[k].split("\t") for k in range(bisect_left(own, key), bisect_right(own, key))]
            numbers = lambda j: pa.array([int(r[j]) if r[j] else None for r in rows], pa.int64())
            texts = lambda j: pa.array([r[j] for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays([texts(0), numbers(1), texts(2), numbers(3), numbers(4)], names=[f.split()[0] for f in CAPTURES.split(", ")])

    wanted = urls.select("url").distinct().select(keys(F.col("url").cast("string")).alias("url_key")).distinct()
    wanted = wanted.repartitionByRange(parts, "url_key").sortWithinPartitions("url_key")
    places = materialize(wanted.mapInArrow(search, "url_key string, shard string, offset long, length long"), "warc-blocks")
    order = ["shard", "offset", "url_key"]
    return places.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(read, CAPTURES)


def stretches(rows: list[tuple[str, int, int]]) -> Iterator[list[tuple[str, int, int]]]:
    """Neighbours in one archive, nearer than ``GAP_BYTES`` and ``READ_BYTES`` together at most."""
    run: list[tuple[str, int, int]] = []
    for row in rows:
        if run and (row[0] != run[0][0] or row[1] > run[-1][1] + run[-1][2] + GAP_BYTES or row[1] + row[2] - run[0][1] > READ_BYTES):
            yield run
            run = []
        run.append(row)
    if run:
        yield run


def read_records(captures: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of ``captures``: ``page_id, url, record_type, refers_to, payload_bytes, payload_digest[, payload]``.

    A response's payload is held against its digest; a mismatch is an error. A revisit's length and
    digest are those of the payload that it stands for, its own payload is null.
    """
    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + (", payload binary" if with_payload else "")
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, opened = None, None
        for batch in batches:
            for run in stretches(list(zip(*(c.to_pylist() for c in batch.columns)))):
                if opened != run[0][0]:
                    store, path = _store(run[0][0])
                    source, opened = store.open_input_file(path), run[0][0]
                start = run[0][1]
                raw = source.read_at(run[-1][1] + run[-1][2] - start, start)
                found = [parse(raw[o - start : o - start + n]) for _, o, n in run]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], kinds.get(k, pa.string())) for k in names], names=names)

    order = ["archive", "offset"]
    ranged = captures.select("archive", "offset", "length").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return ranged.mapInArrow(read, schema)


def round_trip(pages: DataFrame, folder: str | None = None, with_payload: bool = False) -> DataFrame:
    """Write ``pages`` to archives, index them, look every URL up and read the records back.

    Repeated pages are records of their own; a null ``url`` is indexed under the empty key; columns of
    ``pages`` other than ``page_id``, ``url`` and ``html`` are ignored; no pages give no records.
    """
    folder = folder or f"{scratch_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex[:12]}"
    captures = write_archives(pages, f"{folder}/archives")
    index = build_index(captures, f"{folder}/index")
    return read_records(materialize(find_captures(pages, index), "warc-found"), with_payload)


#: The same rows in DuckDB.
ROUND_TRIP_SQL = f"""
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), firsts AS (
  SELECT *, CASE WHEN payload_bytes >= {LEAST_REVISIT} THEN max(page_id) OVER (PARTITION BY payload_digest) END AS first FROM payloads
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM firsts
"""
