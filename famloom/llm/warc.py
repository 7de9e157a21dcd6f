"""WARC archives of pages with a two-level capture index.

:func:`write_archives` writes one record per page, each a gzip member of its own, as files
``archives/part-*``.  Spark's text writer does the writing, so any file system that Spark
knows will do and lost or repeated tasks leave no half files: a member's last byte is the
high byte of its length, zero below 16 MiB, and is left to the writer's line separator;
a longer member is followed by an empty one.

Of records with equal payloads (of at least ``min_bytes``) the one with the smallest
page_id is a response, the others are revisits of it, without the payload.

:func:`build_index` scans the archives and sorts one line per capture by its reversed-host
URL key and page_id.  Lines go in compressed blocks; shards of blocks are ranges of keys.
The sparse directory is the first key of every shard, and of every block in its shard.
:func:`lookup` finds a key's shard by binary search in the first (one entry per shard,
broadcast), its block by binary search in the second, inside the task that holds the
shard, and opens only the blocks asked for.  :func:`fetch` reads just the byte ranges of
the records, file by file in ascending order.

Null html is an empty payload, a null url an empty one; white space and control
characters in a url are percent-encoded.  A null page_id sorts before all others, is never
the response of a group that has another, and comes back null.  Repeated rows are records
of their own, of the same type.  An empty table gives no archives, an empty index and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from famloom.llm.common import release_memory, shuffle_partitions, slices
from famloom.session import discard, durable

#: Lines of a block, and captures of a shard (what one task of a look-up holds).
BLOCK_LINES = 1000
SHARD_LINES = 50_000
LEVEL = 4

_CHUNK = 1 << 16
_DATE = "2020-01-01T00:00:00Z"
_LINE = "key string, page_id bigint, file string, offset bigint, length bigint"
_RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def url_key(url: str) -> str:
    """The host's labels in reverse, then port, path and query: ``com,example)/a?b``."""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url
    labels = ",".join(reversed(host.lower().removeprefix("www.").split(".")))
    place = f":{port}" if port and port not in (80, 443) else ""
    query = f"?{parts.query}" if parts.query else ""
    return f"{labels}{place}){parts.path or '/'}{query}"


def capture_key(url: str | None, page_id: int | None) -> str:
    """Sorts by URL key, then by page_id, nulls first."""
    number = "-" if page_id is None else f"{page_id + (1 << 63):020d}"
    return f"{url_key(_header_url(url))} {number}"


def _header_url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f-\x9f\s]", lambda m: quote(m[0]), url or "")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id, url, payload: bytes, refers_to, revisit: bool) -> bytes:
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
    head += f"Content-Length: {len(payload)}\r\n\r\n"
    block = head.encode() + (b"" if revisit else payload)
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{i}')}>"
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", name(page_id)),
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", _header_url(url)),
        ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
        ("X-Page-Id", "" if page_id is None else str(page_id)),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        fields[4:4] = [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", name(refers_to)),
            ("X-Refers-To-Page", str(refers_to)),
        ]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    machine = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    member = machine.compress(data) + machine.flush()
    return member if member[-1] == 0 else member + _gzip(b"")


def parse_record(data: bytes) -> dict:
    """Fields of one uncompressed record, with ``payload`` for responses."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    fields["payload"] = block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else None
    return fields


def _row_of(data: bytes) -> tuple:
    """What a record says; a response's length and digest are taken from its payload anew."""
    fields = parse_record(data)
    payload = fields["payload"]
    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if payload is not None and payload_digest(payload) != said:
        raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")
    number = lambda k: int(fields[k]) if fields.get(k) else None
    size = len(payload) if payload is not None else number("X-Payload-Length")
    return (
        number("X-Page-Id"), fields["WARC-Target-URI"], size, said, fields["WARC-Type"], number("X-Refers-To-Page"),
    )


def _members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of the gzip members of an archive."""
    at, view = 0, memoryview(data)
    while at < len(view):
        machine, parts, end = zlib.decompressobj(31), [], at
        while not machine.eof:
            parts.append(machine.decompress(view[end : end + _CHUNK]))
            end += min(_CHUNK, len(view) - end)
        end -= len(machine.unused_data)
        content = b"".join(parts)
        if content:  # else the empty member after a long one
            yield at, end - at, content
        at = end


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "payload"):
        members = [
            _gzip(_record(page, url, payload, refers, refers is not None))[:-1]
            for page, url, payload, refers in zip(
                *(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to"))
            )
        ]
        yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], ["member"])


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write the records of all pages to ``path/archives``.

    Digests decide which rows are revisits with partial minima before the shuffle; only
    page_ids and digests take part, then the few columns of revisits join the pages.
    """
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"),
    )
    marked = rows.withColumn("digest", F.sha2("payload", 256))
    groups = durable(
        marked.filter(F.octet_length("payload") >= min_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("digest", "refers_to")
    )
    (
        marked.join(groups, "digest", "left")
        .withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("refers_to")), F.col("refers_to")))
        .select("page_id", "url", "payload", "refers_to")
        .mapInArrow(_write, "member binary")
        .select(F.col("member").cast("string").alias("value"))
        .write.option("lineSep", "\0")
        .text(f"{path}/archives")
    )
    discard(groups)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, content in zip(batch.column("path"), batch.column("content")):
            rows = [
                (capture_key(row[1], row[0]), row[0], file.as_py(), at, length)
                for at, length, data in _members(content.as_py())
                for row in [_row_of(data)]
            ]
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "page_id", "file", "offset", "length"]
            )
        release_memory()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of one shard, in order, as compressed blocks."""
    held: list[tuple] = []
    number = shard = 0

    def block() -> pa.RecordBatch:
        text = "\n".join("\t".join("" if v is None else str(v) for v in line) for line in held)
        return pa.RecordBatch.from_pydict(
            {
                "shard": pa.array([shard], pa.int32()),
                "block": pa.array([number], pa.int32()),
                "first_key": [held[0][0]],
                "lines": pa.array([len(held)], pa.int64()),
                "data": [zlib.compress(text.encode())],
            }
        )

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("shard", "key", "page_id", "file", "offset", "length")]
        for shard, *line in zip(*columns):
            if len(held) == BLOCK_LINES:
                yield block()
                held, number = [], number + 1
            held.append(tuple(line))
    if held:
        yield block()


def build_index(spark: SparkSession, path: str) -> None:
    """Scan ``path/archives`` and write ``path/index``: shard, block, first_key, lines, data."""
    archives = spark.read.format("binaryFile").load(f"{path}/archives").select("path", "content")
    lines = archives.mapInArrow(_scan, _LINE)
    lines.write.parquet(f"{path}/captures")
    captures = spark.read.schema(_LINE).parquet(f"{path}/captures")
    shards = max(1, -(-captures.count() // SHARD_LINES))
    (
        captures.repartitionByRange(shards, "key")
        .sortWithinPartitions("key", "file", "offset")
        .withColumn("shard", F.spark_partition_id())
        .mapInArrow(_blocks, "shard int, block int, first_key string, lines bigint, data binary")
        .write.parquet(f"{path}/index")
    )


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [
            capture_key(url, page)
            for url, page in zip(batch.column("url").to_pylist(), batch.column("page_id").to_pylist())
        ]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string())], ["key"])


def _shard_of(firsts: list[tuple[str, int]]):
    bounds, numbers = [f for f, _ in firsts], [n for _, n in firsts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_pylist()
            shard = [numbers[max(0, bisect_right(bounds, key) - 1)] for key in keys]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(shard, pa.int32())], ["key", "shard"]
            )

    return run


def _find(asked: pa.Table, blocks: pa.Table) -> pa.Table:
    """Lines of the asked keys of one shard, from the blocks that can hold them."""
    directory = sorted(zip(blocks["first_key"].to_pylist(), range(blocks.num_rows)))
    bounds, rows = [first for first, _ in directory], [row for _, row in directory]
    wanted: dict[int, set[str]] = {}
    for key in asked["key"].to_pylist():
        at = bisect_right(bounds, key) - 1
        # Equal keys may run over the end of a block.
        while at >= 0:
            wanted.setdefault(at, set()).add(key)
            if bounds[at] != key:
                break
            at -= 1
    found: list[list[str]] = []
    for at, keys in wanted.items():
        text = zlib.decompress(blocks["data"][rows[at]].as_py()).decode()
        found += [line for line in (x.split("\t") for x in text.split("\n")) if line[0] in keys]
    whole = lambda i: pa.array([int(x[i]) if x[i] else None for x in found], pa.int64())
    return pa.table(
        {
            "key": pa.array([x[0] for x in found], pa.string()),
            "page_id": whole(1),
            "file": pa.array([x[2] for x in found], pa.string()),
            "offset": whole(3),
            "length": whole(4),
        }
    )


def lookup(spark: SparkSession, path: str, captures: DataFrame) -> DataFrame:
    """Index lines (key, page_id, file, offset, length) of captures given by url and page_id.

    Repeated questions are asked once.  The shards' first keys are one row per shard.
    """
    index = spark.read.parquet(f"{path}/index")
    firsts = [
        (r.first_key, r.shard)
        for r in index.filter("block = 0").select("first_key", "shard").orderBy("first_key", "shard").collect()
    ]
    if not firsts:
        return spark.createDataFrame([], _LINE)
    asked = (
        captures.select("url", "page_id")
        .mapInArrow(_keys, "key string")
        .distinct()
        .mapInArrow(_shard_of(firsts), "key string, shard int")
    )
    blocks = index.select("shard", "first_key", "data")
    return asked.groupBy("shard").cogroup(blocks.groupBy("shard")).applyInArrow(_find, _LINE)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records at (file, offset, length); rows come sorted, so a file is opened once."""
    opened: tuple[str, pa.NativeFile] | None = None
    for batch in batches:
        rows = []
        for file, at, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
            if opened is None or opened[0] != file:
                system, place = fs.FileSystem.from_uri(_uri(file))
                opened = file, system.open_input_file(place)
            rows.append(_row_of(zlib.decompress(opened[1].read_at(length, at), 31)))
        yield _records(rows)


def _uri(file: str) -> str:
    return re.sub(r"^file:/+", "file:///", file)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    columns = list(zip(*rows)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _cut_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for content, ranges in zip(batch.column("content"), batch.column("ranges").to_pylist()):
            data = memoryview(content.as_buffer())
            rows += [_row_of(zlib.decompress(data[r["offset"] : r["offset"] + r["length"]], 31)) for r in ranges]
        yield _records(rows)


def _arrow_reads(path: str) -> bool:
    try:
        fs.FileSystem.from_uri(_uri(path))
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def fetch(spark: SparkSession, path: str, lines: DataFrame) -> DataFrame:
    """The records at index lines: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    Tasks read the ranges themselves where Arrow knows the file system; elsewhere Spark
    reads the archives named and the ranges are cut from them.
    """
    places = lines.select("file", "offset", "length")
    if _arrow_reads(path):
        # Rows are small but stand for whole records, so their number of tasks is fixed.
        dealt = places.repartition(shuffle_partitions(spark), "file")
        return dealt.sortWithinPartitions("file", "offset").mapInArrow(_ranges, _RECORD)
    archives = spark.read.format("binaryFile").load(f"{path}/archives").select("path", "content")
    ranges = places.groupBy("file").agg(F.collect_list(F.struct("offset", "length")).alias("ranges"))
    return archives.join(ranges, F.col("path") == F.col("file")).select("content", "ranges").mapInArrow(
        _cut_ranges, _RECORD
    )
