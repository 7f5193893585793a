"""Deterministic sharded WARC 1.1 writer and its reader.

Records are range-sorted by page_id into shards whose bounds hang on the rows alone; in a shard they are ordered by
page_id, payload digest and url. Each record is a gzip member of its own; a file is rolled once its compressed size
reaches ``roll_bytes``. Headers, digests and record ids are made anew from the row (ids are UUIDs of version 8 that
hold page_id), so equal tables give equal bytes. Of rows with equal payloads of at least ``least`` bytes, the one with
the largest page_id is the response and the others are revisits that refer to it; among repeated rows of that page_id
the first in order is. Tasks write under temporary names; the driver renames the winners and then publishes the
manifest.

Only (page_id, digest) pairs meet by digest, and the largest page_id is a partial aggregate; one row a digest is joined
back, so Spark splits the pairs of a digest that very many pages share. Payloads move once, to their shard, where the
decisions arrive as rows sorted just before them. A task streams its shard: beyond MOST_SHARDS shards hold more, files
do not.

Null html is the empty payload. Null page_ids sort first, in shard 0, and are the smallest; null urls become NO_URL.
An empty table gives a manifest without files. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHARD_BYTES, ROLL_BYTES, MOST_SHARDS, LEVEL = 32 << 20, 4 << 20, 20_000, 6
NO_URL = "urn:lexweave:no-url"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, digest: bytes, copy: int) -> str:
    """A UUID of version 8: 32 bits of the digest, the copy's number among equal rows, whether page_id is null, page_id."""
    page = (page_id or 0) & (1 << 64) - 1
    a = int.from_bytes(digest[:4], "big") << 16 | copy & 0xFFFF
    b = (page_id is None) << 11 | (copy >> 16 & 0x1FF) << 2 | page >> 62
    n = f"{a << 80 | 8 << 76 | b << 64 | 2 << 62 | page & (1 << 62) - 1:032x}"
    return f"<urn:uuid:{n[:8]}-{n[8:12]}-{n[12:16]}-{n[16:20]}-{n[20:]}>"


def page_of(name: str) -> int | None:
    """page_id of a record id."""
    n = int(name.strip("<>").rpartition(":")[2].replace("-", ""), 16)
    b = n >> 64 & 0xFFF
    page = (b & 3) << 62 | n & (1 << 62) - 1
    return None if b >> 11 else page - (1 << 64) if page >> 63 else page


def _b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _member(headers: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head.encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def _uri(url: str | None) -> str:
    return NO_URL if url is None else "".join(c if c > " " and c != "\x7f" else "".join(f"%{x:02X}" for x in c.encode()) for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, copy: int, refers: tuple[int | None] | None, date: str, level: int = LEVEL) -> bytes:
    """The gzip member of a response, or of a revisit that refers to the page in ``refers``."""
    digest = hashlib.sha1(payload).digest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers else http + payload
    headers = [("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", record_id(page_id, digest, copy)), ("WARC-Date", date), ("WARC-Target-URI", _uri(url))]
    if refers:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers[0], digest, 0))]
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{_b32(digest)}"), ("WARC-Block-Digest", f"sha1:{_b32(hashlib.sha1(block).digest())}")]
    return _member(headers, block, level)


def write(pages: DataFrame, folder: str, least: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, date: str = "1970-01-01T00:00:00Z") -> dict:
    """Writes the rows of pages (page_id, url, html) to a new folder; returns the manifest."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    bounds, _ = common.range_bounds(rows, "page_id", F.octet_length("html") + 300, shard_bytes, MOST_SHARDS)
    keyed = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    light = keyed.where(F.octet_length("html") >= least).select("page_id", "digest")
    first = light.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    revisits = light.join(first, "digest").where("page_id is null or page_id < first")
    both = keyed.select("page_id", "digest", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("bigint").alias("first")).unionByName(
        revisits.select("page_id", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "first")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, out, entry, done = None, None, {}, []
        key, decided, copy = None, None, 0

        def close() -> None:
            if out is not None:
                out.close()
                done.append(dict(entry))

        for batch in batches:
            for s, page_id, digest, kind, url, html, to in zip(*[batch.column(c).to_pylist() for c in ("shard", "page_id", "digest", "kind", "url", "html", "first")]):
                if (page_id, digest) != key:
                    key, decided, copy = (page_id, digest), None, 0
                if kind == 0:
                    decided = (to,)
                    continue
                payload = html.encode()
                refers = decided or ((page_id,) if copy and len(payload) >= least else None)
                member = record(page_id, url, payload, copy, refers, date)
                copy += 1
                if s != shard or entry["bytes"] >= roll_bytes:
                    close()
                    part = 0 if s != shard else entry["part"] + 1
                    shard, name = s, f"pages-{s:06d}-{part:04d}.warc.gz"
                    entry = {"name": name, "temporary": common.temporary_name(folder, name), "part": part, "records": 0, "bytes": 0, "first_page": page_id, "last_page": page_id}
                    files, path = common.opened(entry["temporary"])
                    out = files.open_output_stream(path, compression=None)
                    head = _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, hashlib.sha1(name.encode()).digest(), 0)), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", LEVEL)
                    out.write(head)
                    entry["bytes"] += len(head)
                out.write(member)
                entry |= {"bytes": entry["bytes"] + len(member), "records": entry["records"] + 1, "last_page": page_id}
        close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("name", pa.string()), ("temporary", pa.string()), ("part", pa.int64()), ("records", pa.int64()), ("bytes", pa.int64()), ("first_page", pa.int64()), ("last_page", pa.int64())]))

    common.start_commit(folder)
    done = (
        both.withColumn("shard", common.shard_of(F.col("page_id"), bounds))
        .repartitionById(len(bounds) + 1, F.col("shard"))
        .sortWithinPartitions("shard", F.asc_nulls_first("page_id"), "digest", "kind", F.asc_nulls_first("url"))
        .mapInArrow(run, "name string, temporary string, part bigint, records bigint, bytes bigint, first_page bigint, last_page bigint")
        .collect()
    )  # a row for each file
    common.commit_files(folder, [r.asDict() for r in done], {"format": "WARC/1.1", "least": least})
    return common.read_manifest(folder)


def members(source) -> Iterator[bytes]:  # noqa: ANN001
    """Decompressed gzip members of a stream, one in memory at a time."""
    data = b""
    while True:
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            data = data or source.read(1 << 20)
            if not data:
                if parts:
                    raise ValueError("a WARC file ends inside a record")
                return
            parts.append(z.decompress(data))
            data = z.unused_data if z.eof else b""
        yield b"".join(parts)


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, by lower-case name, and block of a record."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    if len(rest) != len(block) + 4:
        raise ValueError("a record's length is not that of its block")
    return headers, block


def read(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """A row for each response and revisit of the manifest's files; digests of responses are checked.

    payload is null for revisits, and for all rows without ``payloads``.
    """
    schema = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"
    files = [(f"{folder}/{f['name']}",) for f in common.read_manifest(folder)["files"]]
    if not files:
        return spark.createDataFrame([], schema)
    fields = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def rows(uri: str) -> Iterator[tuple]:
        source, path = common.opened(uri)
        with source.open_input_stream(path, compression=None) as src:
            for member in members(src):
                headers, block = parsed(member)
                if headers["warc-type"] == "warcinfo":
                    continue
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(http.rpartition(b"Content-Length: ")[2])
                digest = headers["warc-payload-digest"].removeprefix("sha1:")
                response = headers["warc-type"] == "response"
                if response and (len(payload) != size or _b32(hashlib.sha1(payload).digest()) != digest):
                    raise ValueError(f"{uri}: the payload of {headers['warc-record-id']} is not that of its digest")
                url = headers["warc-target-uri"]
                yield page_of(headers["warc-record-id"]), None if url == NO_URL else url, headers["warc-type"], None if response else page_of(headers["warc-refers-to"]), size, digest, payload if response and payloads else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                held, size = [], 0
                for row in rows(uri):
                    held.append(row)
                    size += 200 + len(row[-1] or b"")
                    if size >= 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), fields)], schema=fields)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), fields)], schema=fields)

    return spark.createDataFrame(files, "uri string").repartition(len(files)).mapInArrow(run, schema)
