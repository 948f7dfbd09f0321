"""Web archives with a two-level capture index.

Each task writes its records, each a gzip member of its own, into archive files of the shared folder; the rows
it returns say which files and places count, so a task that ran twice does no harm. The index sorts captures by
reversed-host URL key into compressed blocks; a sparse directory has the first key of each block, and a short
list has the first key of each shard. A lookup searches list, directory and block in turn, each by bisection,
and reads just the bytes of its block and record. Files are opened with ``pyarrow.fs`` by URI.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.texts import join_counted, save
from footfall.session import shared_dir

#: Captures in a block, and bytes after which an archive file is full.
BLOCK = 512
FILE_BYTES = 1 << 30
#: Captures in a shard, at most about.
SHARD = 1_000_000
#: Look-ups of a reading task.
LOOKUPS = 20_000
_CRLF = b"\r\n"


def url_key(url: str) -> str:
    """Host parts reversed, then path and query: ``http://www.Example.org/a?b#c`` is ``org,example,www)/a?b``."""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return f"){url}"
    default = {"http": 80, "https": 443}.get(parts.scheme.lower())
    named = ",".join(reversed(host.split("."))) + (f":{port}" if port and port != default else "")
    return f"{named}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def capture_key(url: str | None, page_id: int | None) -> bytes:
    """Sorts by URL key, then page."""
    number = "-" if page_id is None else f"{page_id + (1 << 63):020d}"
    return quote(url_key(url or ""), safe="!$&'()*+,/:;=?@~%").encode() + b" " + number.encode()


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(kind: str, url: str, page_id: int | None, payload: bytes, digest: str, size: int, refers_to=None) -> bytes:
    """One WARC/1.1 record as a gzip member; a revisit keeps the HTTP header, with the full length, alone."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {size}\r\n\r\n".encode()
    if kind == "response":
        block += payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {_name(page_id)}",
        f"WARC-Target-URI: {quote(url, safe=_URL_SAFE)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        lines += [
            f"WARC-Refers-To: {_name(refers_to)}",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    return _member("\r\n".join(lines).encode() + _CRLF * 2 + block + _CRLF * 2)


def _warcinfo() -> bytes:
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>"]
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", "Content-Length: 0"]
    return _member("\r\n".join(lines).encode() + _CRLF * 4)


_URL_SAFE = "!#$&'()*+,/:;=?@[]~%"


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes, dict[str, str], bytes]:
    """WARC header fields, then the block's HTTP header fields and payload."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(_CRLF * 2)
    fields = _fields(head)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(_CRLF * 2)
    return fields, block, _fields(http), payload


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _body(html: Column) -> Column:
    return F.coalesce(html.cast("string"), F.lit("")).cast("binary")


def write_archives(pages: DataFrame, root: str, min_bytes: int = 0) -> DataFrame:
    """Writes a record for each page and returns (key, page_id, file, offset, length), from a written table.

    Of pages with equal payloads of at least ``min_bytes`` bytes, that with the largest page_id is the response
    and the others revisit it; rows that repeat the response's page_id are responses as well. A missing payload
    is empty, a missing page_id the smallest.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        _body(F.col("html")).alias("body"),
    ).withColumn("payload", F.sha1("body"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"page_id": [], "url": [], "payload": [], "size": [], "digest": [], "member": []}
            for row in batch.to_pylist():
                body = row["body"]
                digest = base32_sha1(body)
                out["page_id"].append(row["page_id"])
                out["url"].append(row["url"])
                out["payload"].append(row["payload"])
                out["size"].append(len(body))
                out["digest"].append(digest)
                out["member"].append(record("response", row["url"], row["page_id"], body, digest, len(body)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(out["page_id"], pa.int64()), pa.array(out["url"], pa.string()),
                    pa.array(out["payload"], pa.string()), pa.array(out["size"], pa.int64()),
                    pa.array(out["digest"], pa.string()), pa.array(out["member"], pa.binary()),
                ],
                names=list(out),
            )

    ready = rows.mapInArrow(
        packed, "page_id long, url string, payload string, size long, digest string, member binary"
    )
    repeated = save(
        rows.where(F.octet_length("body") >= min_bytes)
        .groupBy("payload")
        .agg(F.max("page_id").alias("response_id"), F.count("*").alias("n"))
        .where("n > 1"),
        "payloads",
    )
    decided = join_counted(ready, repeated, "payload", "n", "left")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = _opened(root)
        stream, path, place = None, "", 0
        try:
            for batch in batches:
                out = {"key": [], "page_id": [], "file": [], "offset": [], "length": []}
                for row in batch.to_pylist():
                    member = row["member"]
                    if row["response_id"] is not None and row["response_id"] != row["page_id"]:
                        member = record(
                            "revisit", row["url"], row["page_id"], b"", row["digest"], row["size"], row["response_id"]
                        )
                    if stream is None or place >= FILE_BYTES:
                        if stream is not None:
                            stream.close()
                        path = f"pages-{uuid.uuid4().hex}.warc.gz"
                        filesystem.create_dir(base, recursive=True)
                        stream = filesystem.open_output_stream(f"{base}/{path}", compression=None)
                        place = stream.write(_warcinfo())
                    stream.write(member)
                    out["key"].append(capture_key(row["url"], row["page_id"]))
                    out["page_id"].append(row["page_id"])
                    out["file"].append(path)
                    out["offset"].append(place)
                    out["length"].append(len(member))
                    place += len(member)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(out["key"], pa.binary()), pa.array(out["page_id"], pa.int64()),
                        pa.array(out["file"], pa.string()), pa.array(out["offset"], pa.int64()),
                        pa.array(out["length"], pa.int64()),
                    ],
                    names=list(out),
                )
        finally:
            if stream is not None:
                stream.close()

    return save(
        decided.mapInArrow(written, "key binary, page_id long, file string, offset long, length long"), "captures"
    )


def build_index(captures: DataFrame, root: str) -> DataFrame:
    """Writes sorted blocks and their directories; returns (first_key, file, directory) per shard, written.

    A shard is one file: its blocks, then its directory (first key, offset, length of each block).
    """
    shards = max(captures.count() // SHARD + 1, int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = _opened(root)
        block, directory, place, stream, path = [], [], 0, None, ""

        def flush():
            nonlocal place, block
            data = zlib.compress("\n".join(json.dumps(entry) for entry in block).encode(), 6)
            directory.append((block[0][0], place, len(data)))
            stream.write(data)
            place += len(data)
            block = []

        try:
            for batch in batches:
                for row in batch.to_pylist():
                    if stream is None:
                        path = f"captures-{uuid.uuid4().hex}.idx"
                        filesystem.create_dir(base, recursive=True)
                        stream = filesystem.open_output_stream(f"{base}/{path}", compression=None)
                    block.append((row["key"].decode(), row["file"], row["offset"], row["length"]))
                    if len(block) == BLOCK:
                        flush()
            if block:
                flush()
            if stream is not None:
                listed = json.dumps(directory).encode()
                stream.write(listed)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([directory[0][0].encode()], pa.binary()), pa.array([path]),
                        pa.array([place], pa.int64()), pa.array([len(listed)], pa.int64()),
                    ],
                    names=["first_key", "file", "offset", "length"],
                )
        finally:
            if stream is not None:
                stream.close()

    ordered = captures.select("key", "file", "offset", "length").repartitionByRange(shards, "key")
    return save(
        ordered.sortWithinPartitions("key").mapInArrow(write, "first_key binary, file string, offset long, length long"),
        "shards",
    )


class _Reader:
    """Range reads from a few open files."""

    OPEN = 32

    def __init__(self, root: str):
        self.filesystem, self.base = _opened(root)
        self.files: OrderedDict[str, pa.NativeFile] = OrderedDict()

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.files:
            self.files[name] = self.filesystem.open_input_file(f"{self.base}/{name}")
            if len(self.files) > self.OPEN:
                self.files.popitem(last=False)[1].close()
        self.files.move_to_end(name)
        return self.files[name].read_at(length, offset)


class Index:
    """Lookups: the list of shards, a shard's directory and a block are each searched by bisection."""

    def __init__(self, root: str, shards: list[tuple[str, str, int, int]]):
        self.reader, self.shards = _Reader(root), shards
        self.firsts = [s[0] for s in shards]
        self.kept: tuple = (None, None, None)  # shard, directory, its first keys
        self.block: tuple = (None, None, None)  # shard and place, entries, their keys

    def _directory(self, shard: int):
        if self.kept[0] != shard:
            _, name, offset, length = self.shards[shard]
            directory = json.loads(self.reader.read(name, offset, length))
            self.kept = shard, directory, [d[0] for d in directory]
        return self.kept[1:]

    def _entries(self, shard: int, number: int):
        if self.block[0] != (shard, number):
            _, offset, length = self._directory(shard)[0][number]
            lines = zlib.decompress(self.reader.read(self.shards[shard][1], offset, length)).decode().split("\n")
            entries = [json.loads(line) for line in lines]
            self.block = (shard, number), entries, [e[0] for e in entries]
        return self.block[1:]

    def find(self, key: str) -> Iterator[tuple[str, int, int]]:
        """Places of all captures with the key, in order; the key's run may span blocks and shards."""
        shard = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while shard < len(self.shards) and self.firsts[shard] <= key:
            directory, firsts = self._directory(shard)
            number = max(0, bisect.bisect_left(firsts, key) - 1)
            while number < len(directory) and firsts[number] <= key:
                entries, keys = self._entries(shard, number)
                at = bisect.bisect_left(keys, key)
                while at < len(keys) and keys[at] == key:
                    yield tuple(entries[at][1:])
                    at += 1
                number += 1
            shard += 1


def read_captures(wanted: DataFrame, shards: DataFrame, root: str) -> DataFrame:
    """Records of the wanted captures (url, page_id), found through the index and read by byte range.

    The list of shards is one short row for SHARD captures; it is what a task gets beside its lookups.
    """
    listed = [(bytes(r.first_key).decode(), r.file, r.offset, r.length) for r in shards.collect()]
    listed.sort()

    @F.arrow_udf("binary")
    def keys(urls: pa.Array, pages: pa.Array) -> pa.Array:
        return pa.array([capture_key(u, p) for u, p in zip(urls.to_pylist(), pages.to_pylist(), strict=True)], pa.binary())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(root, listed)
        for batch in batches:
            out = [
                _described(index.reader.read(*place))
                for key in batch.column("key").to_pylist()
                for place in index.find(key.decode())
            ]
            yield pa.RecordBatch.from_pylist(out, _DESCRIBED)

    asked = wanted.select(
        keys(F.coalesce(F.col("url").cast("string"), F.lit("")), F.col("page_id").cast("long")).alias("key")
    ).distinct()
    # Keys are short and a look-up is a read, so tasks are cut by their number, not by bytes.
    tasks = wanted.count() // LOOKUPS + 1
    spread = asked.repartitionByRange(tasks, "key").sortWithinPartitions("key")
    return spread.mapInArrow(
        read,
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean",
    )


_DESCRIBED = pa.schema(
    [
        ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_()),
    ]
)


def _page(name: str | None) -> int | None:
    number = (name or "")[10:-1]
    return int(number) if number else None


def _described(member: bytes) -> dict:
    """What a record says, and whether a response's payload has the length and digest it says."""
    fields, _, http, payload = parse_record(member)
    size, digest = int(http["Content-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    response = fields["WARC-Type"] == "response"
    return {
        "page_id": _page(fields["WARC-Record-ID"]),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": _page(fields.get("WARC-Refers-To")),
        "intact": not response or (len(payload) == size and base32_sha1(payload) == digest),
    }


def archive_and_read(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the pages into archives, indexes them, and reads every capture back through the index.

    A null html is an empty payload, a null or odd url a key of its own kind; a page without id keeps none. Rows that
    repeat url and id are records of their own, all of them found by the one key; very long payloads are read whole, and a
    table without pages gives no rows. Other columns are left aside.
    """
    root = f"{shared_dir(pages.sparkSession)}/archive-{uuid.uuid4().hex}"
    shards = build_index(write_archives(pages, root, min_bytes), root)
    return read_captures(pages, shards, root)
