"""WARC archives with a two-level capture index.

Tasks write records, each a gzip member, into archive files in the shared folder and return
where each one lies. These captures are sorted by URL key, host labels reversed, and written
as compressed blocks of lines; every index file ends with its sparse directory: first key and
place of each block. A look-up finds the index file and the block by binary search in first
keys, and reads the block and then the record by their byte ranges.

Files are named by task attempt, so a repeated task never writes into a file that is referred to.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import re
import struct
import zlib
from base64 import b32encode
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.urls import host_of
from tidemark.session import scratch_path, stored

BLOCK_LINES = 1000
FILE_BYTES = 1 << 30
# Records with smaller gaps between them are read as one range of at most so many bytes.
GAP_BYTES, READ_BYTES = 1 << 16, 8 << 20
_FOOTER = "<Q"
_FOOTER_BYTES = 8
_SAFE = "".join(chr(c) for c in range(0x21, 0x7F))


def url_key(url: Column) -> Column:
    """Reversed host labels, then `)` and the rest of the URL up to `#`; empty for a null URL."""
    host = F.array_join(F.reverse(F.split(host_of(url), r"\.")), ",")
    rest = F.regexp_extract(url, r"(?s)^(?:.*?://[^/?#]*)?([^#]*)", 1)
    return F.coalesce(F.concat(host, F.lit(")"), rest), F.lit(""))


def payload_digest(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string's UTF-8 bytes."""
    sha = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(sha, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(
        F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    )


@lru_cache(maxsize=8)
def _filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


def _name_of(page_id) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _page_of(name: str):
    text = name.removeprefix("<urn:x-page:").removesuffix(">")
    return None if text == "none" else int(text)


def record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool, date: str) -> bytes:
    """One WARC record. A revisit has the HTTP head only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_name_of(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url or '', safe=_SAFE)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {_name_of(refers_to)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """What a record says, its payload checked against its digest."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (
        len(payload) != length or b32encode(hashlib.sha1(payload).digest()).decode() != digest
    ):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {
        "page_id": _page_of(fields["WARC-Record-ID"]),
        "payload_bytes": length,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": _page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None,
        "url": fields["WARC-Target-URI"],
        "payload": payload,
    }


@dataclass(frozen=True)
class Capture:
    """A written archive: its folder and the two tables that say where things lie."""

    folder: str
    captures: DataFrame  # key, page_id, file, position, length
    directory: DataFrame  # first_key, file, position, length: one row per index block

    def read(self) -> DataFrame:
        """All records, through the index: every block is a unit of work."""
        return read_blocks(self.directory, self.folder)


def _attempt() -> str:
    from pyspark import TaskContext

    task = TaskContext.get()
    return f"{task.partitionId():06d}-{task.taskAttemptId()}"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages with payload, digest, length, and the page whose record holds the payload."""
    rows = pages.select(
        F.col("page_id").cast("long"), F.col("url"), F.coalesce("html", F.lit("")).alias("payload")
    ).withColumn("digest", payload_digest(F.col("payload")))
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("long"))
    keepers = rows.groupBy(F.col("digest").alias("_d")).agg(F.max("page_id").alias("keeper"))
    joined = rows.join(keepers, rows["digest"] == keepers["_d"]).drop("_d")
    alone = (F.col("bytes") < least_bytes) | F.col("page_id").eqNullSafe(F.col("keeper"))
    return joined.withColumn("refers_to", F.when(~alone, F.col("keeper")))


def write(
    pages: DataFrame, least_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", level: int = 1
) -> Capture:
    """Write one record per page and index them.

    Of pages with equal payloads of at least `least_bytes` bytes, that with the largest
    page_id holds the payload, the others refer to it.

    Defined cases: a null html is an empty payload, a null URL an empty one; rows that repeat
    the largest page_id each hold the payload; a null page_id is smaller than all others and
    refers like them; an empty table gives an archive without records; other columns are ignored.
    """
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    schema = pa.schema(
        [("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("position", pa.int64()), ("length", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]):
        store, root = _filesystem(folder)
        store.create_dir(root, recursive=True)
        number, out, at, rows = 0, None, 0, []
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("key", "page_id", "url", "digest", "refers_to", "revisit")]
            for key, page_id, url, digest, refers_to, revisit, payload in zip(*columns, batch["payload"]):
                if out is None:
                    name = f"{_attempt()}-{number}.warc.gz"
                    out, at, number = store.open_output_stream(f"{root}/{name}", compression=None), 0, number + 1
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                body = b"" if payload.as_py() is None else payload.as_buffer().to_pybytes()
                data = packer.compress(record(page_id, url, body, digest, refers_to, revisit, date)) + packer.flush()
                out.write(data)
                rows.append((key, page_id, name, at, len(data)))
                at += len(data)
                if at >= FILE_BYTES:
                    out.close()
                    out = None
            if len(rows) > 10_000:
                yield _batch(rows, schema)
                rows = []
        if out is not None:
            out.close()
        if rows:
            yield _batch(rows, schema)

    rows = roles(pages, least_bytes).select(
        url_key(F.col("url")).alias("key"), "page_id", "url", "payload", "digest", "refers_to",
        F.col("refers_to").isNotNull().alias("revisit"),
    )
    captures = stored(
        rows.mapInArrow(run, "key string, page_id long, file string, position long, length long"), "captures"
    )
    return Capture(folder, captures, stored(_write_index(captures, folder), "directory"))


def _write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Sorted captures as files of compressed blocks, each with a directory at its end."""
    schema = pa.schema([("first_key", pa.string()), ("file", pa.string()), ("position", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]):
        store, root = _filesystem(folder)
        name, out, at, directory, lines, first = "", None, 0, [], [], None

        def flush():
            nonlocal out, name, at, lines
            if out is None:
                name = f"{_attempt()}.index.gz"
                out = store.open_output_stream(f"{root}/{name}", compression=None)
            data = gzip.compress("\n".join(lines).encode(), 6, mtime=0)
            out.write(data)
            directory.append((first, name, at, len(data)))
            at, lines = at + len(data), []

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("key", "page_id", "file", "position", "length"))):
                if not lines:
                    first = row[0]
                lines.append(json.dumps(row))
                if len(lines) == BLOCK_LINES:
                    flush()
        if lines:
            flush()
        if out is not None:
            data = gzip.compress(json.dumps([[d[0], d[2], d[3]] for d in directory]).encode(), 6, mtime=0)
            out.write(data + struct.pack(_FOOTER, len(data)))
            out.close()
            yield _batch(directory, schema)

    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = captures.repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", "page_id")
    return ordered.mapInArrow(run, "first_key string, file string, position long, length long")


class _Ranges:
    """Byte ranges of files in a folder; files stay open."""

    def __init__(self, folder: str):
        self.store, self.root = _filesystem(folder)
        self.files: dict[str, object] = {}

    def file(self, name: str):
        if name not in self.files:
            if len(self.files) >= 256:
                self.files.pop(next(iter(self.files))).close()
            self.files[name] = self.store.open_input_file(f"{self.root}/{name}")
        return self.files[name]

    def get(self, name: str, position: int, length: int) -> bytes:
        return self.file(name).read_at(length, position)

    def lines(self, name: str, position: int, length: int) -> list[list]:
        return [json.loads(x) for x in gzip.decompress(self.get(name, position, length)).decode().split("\n")]

    def near(self, records: list[tuple]) -> Iterator[tuple[tuple, bytes]]:
        """Records (key, file, position, length) with their bytes; close ones are one read."""
        group: list[tuple] = []
        for r in [*sorted(records, key=lambda r: r[1:3]), None]:
            if group:
                _, name, first, _ = group[0]
                end = group[-1][2] + group[-1][3]
                if r is None or r[1] != name or r[2] - end > GAP_BYTES or r[2] + r[3] - first > READ_BYTES:
                    data = self.get(name, first, end - first)
                    for done in group:
                        yield done, data[done[2] - first : done[2] - first + done[3]]
                    group = []
            if r is not None:
                group.append(r)

    def directory(self, name: str) -> list[list]:
        end = self.file(name).size()
        (length,) = struct.unpack(_FOOTER, self.get(name, end - _FOOTER_BYTES, _FOOTER_BYTES))
        return json.loads(gzip.decompress(self.get(name, end - _FOOTER_BYTES - length, length)))


_RECORD = pa.schema(
    [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
     ("refers_to", pa.int64()), ("url", pa.string())]
)
_RECORD_DDL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def _parsed(ranges: _Ranges, name: str, position: int, length: int) -> tuple:
    said = parse(gzip.decompress(ranges.get(name, position, length)))
    return tuple(said[c] for c in _RECORD.names)


def read_blocks(directory: DataFrame, folder: str) -> DataFrame:
    """Records of all index blocks, in order of place within a block."""

    def run(batches):
        ranges = _Ranges(folder)
        for batch in batches:
            for name, position, length in zip(*(batch[c].to_pylist() for c in ("file", "position", "length"))):
                captures = sorted(ranges.lines(name, position, length), key=lambda c: (c[2], c[3]))
                yield _batch([_parsed(ranges, *c[2:]) for c in captures], _RECORD)

    parts = int(directory.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return directory.repartition(parts, "file", "position").mapInArrow(run, _RECORD_DDL)


_PLACE = pa.schema([("asked_key", pa.string()), ("file", pa.string()), ("position", pa.int64()), ("length", pa.int64())])


def look_up(capture: Capture, urls: DataFrame) -> DataFrame:
    """Records of the given URLs (column `url`): asked_key and the record's columns.

    Keys are sorted over tasks. A task finds each one's blocks by binary search, in the first keys
    of the index files and then in the directory at the end of a file. Blocks then go to tasks of
    their own, so a URL with very many captures is read by many; a block is read once, and
    records that lie close together in an archive file are read as one range.

    The first keys of index files, one per file, come to the driver: as many as partitions.
    """
    heads = sorted(
        (r["k"], r["file"]) for r in capture.directory.groupBy("file").agg(F.min("first_key").alias("k")).collect()
    )
    folder = capture.folder
    keys = [k for k, _ in heads]

    def search(batches):
        ranges, held = _Ranges(folder), (None, None, None)
        for batch in batches:
            rows = []
            for asked in batch["asked_key"].to_pylist():
                for _, name in heads[max(0, bisect.bisect_left(keys, asked) - 1) : bisect.bisect_right(keys, asked)]:
                    if held[0] != name:
                        blocks = ranges.directory(name)
                        held = (name, blocks, [b[0] for b in blocks])
                    _, blocks, firsts = held
                    for _, at, length in blocks[max(0, bisect.bisect_left(firsts, asked) - 1) : bisect.bisect_right(firsts, asked)]:
                        rows.append((asked, name, at, length))
            if rows:
                yield _batch(rows, _PLACE)

    def fetch(batches):
        ranges, block, by_key, wanted = _Ranges(folder), None, {}, []

        def records():
            for (_, file, position, length), data in ranges.near(wanted):
                said = parse(gzip.decompress(data))
                yield (file, position, *(said[c] for c in _RECORD.names))

        def finished():
            key_of = {(file, position): key for key, file, position, _ in wanted}
            rows = [(key_of[file, position], *said) for file, position, *said in records()]
            return _batch(rows, pa.schema([("asked_key", pa.string()), *_RECORD]))

        for batch in batches:
            for asked, *place in zip(*(batch[c].to_pylist() for c in _PLACE.names)):
                if place != block:
                    if wanted:
                        yield finished()
                    block, by_key, wanted = place, {}, []
                    for key, _, *at in ranges.lines(*place):
                        by_key.setdefault(key, []).append(at)
                wanted += [(asked, *at) for at in by_key.get(asked, ())]
        if wanted:
            yield finished()

    asked = urls.select(url_key(F.col("url")).alias("asked_key")).distinct()
    places = asked.repartitionByRange("asked_key").sortWithinPartitions("asked_key").mapInArrow(
        search, "asked_key string, file string, position long, length long"
    )
    blocks = places.repartition("file", "position").sortWithinPartitions("file", "position", "asked_key")
    return blocks.mapInArrow(fetch, "asked_key string, " + _RECORD_DDL)
