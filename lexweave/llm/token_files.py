"""Token-id files: concatenated ids with Elias-Fano coded document boundaries.

write_token_files encodes every text, appends ``end_id`` and writes shards in ascending doc_id order; each file holds

    magic, counts, Elias-Fano(doc_id - least doc_id), Elias-Fano(ends of the documents), ids (2 or 4 bytes each)

and manifest.json names the files with the number of ids before each. Null doc_ids come first, in shard 0. Rows that
repeat a doc_id stay in a fixed order (by their ids). Null and empty texts are the end id alone. Empty tables give a
manifest without files. Files are written under temporary names and renamed once all tasks have ended.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .byte_pieces import BytePieces

#: Bytes of text behind one file.
SHARD_BYTES, MOST_SHARDS = 48 << 20, 50_000
MAGIC = b"LXWTOK01"
#: Ones between two kept positions of the select structure.
STRIDE = 256


class EliasFano:
    """A monotone sequence of n numbers up to u in about n * (2 + log2(u / n)) bits, with select."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, marks: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.marks = n, low_bits, low, high, marks

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        flags[ones] = 1
        rows = ((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        return cls(n, bits, np.packbits(rows.ravel(), bitorder="little"), np.packbits(flags, bitorder="little"), ones[::STRIDE].astype(np.uint64))

    def to_bytes(self) -> bytes:
        wide = self.marks.astype("<u8").view(np.uint8).reshape(len(self.marks), 8)[:, : _bytes_for(8 * len(self.high))]
        return struct.pack("<QBQQ", self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + wide.tobytes()

    @classmethod
    def from_buffer(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, bits, lows, highs = struct.unpack_from("<QBQQ", data, at)
        at += 25
        low = np.frombuffer(data, np.uint8, lows, at)
        high = np.frombuffer(data, np.uint8, highs, at + lows)
        each, count = _bytes_for(8 * highs), -(-n // STRIDE)
        marks = np.zeros((count, 8), dtype=np.uint8)
        marks[:, :each] = np.frombuffer(data, np.uint8, count * each, at + lows + highs).reshape(count, each)
        return cls(n, bits, low, high, marks.view("<u8").ravel()), at + lows + highs + count * each

    def select(self, i: int) -> int:
        """Number i, from the nearest mark and the bytes after it."""
        at = int(self.marks[i // STRIDE])
        left, byte = i % STRIDE, at // 8
        flags = int(self.high[byte]) >> (at % 8) << (at % 8)
        while left >= flags.bit_count():
            left -= flags.bit_count()
            byte += 1
            flags = int(self.high[byte])
        for _ in range(left):
            flags &= flags - 1
        one = byte * 8 + (flags & -flags).bit_length() - 1
        low = 0
        for b in range(self.low_bits):
            p = i * self.low_bits + b
            low |= (int(self.low[p // 8]) >> (p % 8) & 1) << b
        return (one - i) << self.low_bits | low

    def between(self, a: int, b: int) -> np.ndarray:
        """Numbers a to b - 1: the bits from the mark before a to the mark after b are looked at, no others."""
        if a >= b:
            return np.zeros(0, dtype=np.uint64)
        first, last = a // STRIDE, -(-b // STRIDE)
        begin = int(self.marks[first]) // 8
        end = int(self.marks[last]) // 8 + 1 if last < len(self.marks) else len(self.high)
        flags = np.unpackbits(self.high[begin:end], bitorder="little")
        flags[: int(self.marks[first]) - 8 * begin] = 0
        ones = np.flatnonzero(flags)[a - first * STRIDE : b - first * STRIDE] + 8 * begin
        low = np.zeros(b - a, dtype=np.uint64)
        if self.low_bits:
            at = a * self.low_bits
            flags = np.unpackbits(self.low[at // 8 : (b * self.low_bits + 7) // 8], bitorder="little")[at % 8 :][: (b - a) * self.low_bits].reshape(b - a, self.low_bits)
            for k in range(self.low_bits):
                low |= flags[:, k].astype(np.uint64) << np.uint64(k)
        return ((ones - np.arange(a, b)).astype(np.uint64) << np.uint64(self.low_bits)) | low


def _bytes_for(most: int) -> int:
    return max(1, (most.bit_length() + 7) // 8)


def file_bytes(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One file; doc_ids ascend, null first."""
    nulls = sum(d is None for d in doc_ids)
    known = np.array(doc_ids[nulls:], dtype=np.int64)
    least = int(known[0]) if len(known) else 0
    head = MAGIC + struct.pack("<QQQqB", len(doc_ids), len(ids), nulls, least, ids.dtype.itemsize)
    gaps = (known.astype(object) - least).astype(np.uint64) if len(known) else np.zeros(0, np.uint64)
    return head + EliasFano.of(gaps).to_bytes() + EliasFano.of(np.cumsum(lengths)).to_bytes() + ids.tobytes()


class TokenFile:
    """A file as written: doc_ids, bounds and slices of ids."""

    def __init__(self, data: bytes) -> None:
        assert data[:8] == MAGIC, "not a token file"
        self.docs, self.size, self.nulls, self.least, width = struct.unpack_from("<QQQqB", data, 8)
        self.names, at = EliasFano.from_buffer(memoryview(data), 8 + 33)
        self.ends, at = EliasFano.from_buffer(memoryview(data), at)
        self.ids = np.frombuffer(data, f"<u{width}", self.size, at)

    def doc_ids(self, a: int, b: int) -> list[int | None]:
        """Names of documents a to b - 1 of the file."""
        unknown = max(0, min(b, self.nulls) - a)
        return [None] * unknown + [self.least + int(g) for g in self.names.between(a + unknown - self.nulls, b - self.nulls)]

    def bounds(self, a: int, b: int) -> np.ndarray:
        """Begin of document a and ends of documents a to b - 1."""
        return np.append(self.ends.select(a - 1) if a else 0, self.ends.between(a, b)).astype(np.int64)

    def document(self, i: int) -> np.ndarray:
        """Ids of document i of the file, by two selects."""
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


_encoders: dict[tuple, BytePieces] = {}


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, shard_bytes: int = SHARD_BYTES) -> dict:
    """Writes all texts of docs (doc_id, text) to a new folder; returns the manifest."""
    rows = docs.select("doc_id", "text")
    bounds, _ = common.range_bounds(rows, "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)) + 8, shard_bytes, MOST_SHARDS)
    kind = "<u2" if _vocabulary_size(tokenizer) <= 1 << 16 else "<u4"
    end = np.array([end_id], dtype=kind).tobytes()

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        if (tokenizer, kind) not in _encoders:
            _encoders[tokenizer, kind] = BytePieces(tokenizer, kind)
        coded = [ids + end for ids in _encoders[tokenizer, kind].totals(common.texts_of(batch))]
        shards, names = np.array(batch.column("shard").to_pylist()), batch.column("doc_id").to_pylist()
        out_shard, out_blob = [], []
        for s in np.unique(shards):
            own = np.flatnonzero(shards == s)
            head = struct.pack("<I", len(own)) + np.array([names[i] is None for i in own], dtype=np.uint8).tobytes() + np.array([names[i] or 0 for i in own], dtype="<i8").tobytes() + np.array([len(coded[i]) for i in own], dtype="<u4").tobytes()
            out_shard.append(int(s))
            out_blob.append(zstandard.ZstdCompressor(level=1).compress(head + b"".join(coded[i] for i in own)))
        return pa.RecordBatch.from_pydict({"shard": pa.array(out_shard, pa.int32()), "block": pa.array(out_blob, pa.binary())})

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for s, block in zip(batch.column("shard").to_pylist(), batch.column("block").to_pylist()):
                held.setdefault(s, []).append(block)
        for s in sorted(held):
            entries = []
            for block in held.pop(s):
                data = zstandard.ZstdDecompressor().decompress(block)
                n = struct.unpack_from("<I", data)[0]
                gone, names, sizes = np.frombuffer(data, np.uint8, n, 4), np.frombuffer(data, "<i8", n, 4 + n), np.frombuffer(data, "<u4", n, 4 + 9 * n)
                at = 4 + 13 * n + np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
                view = memoryview(data)
                entries += [(not g, int(d), view[a:b]) for g, d, a, b in zip(gone, names, at, at[1:])]
            entries.sort(key=lambda e: e[:2])
            for i in range(1, len(entries)):  # rows that repeat a doc_id: a fixed order
                if entries[i][:2] == entries[i - 1][:2]:
                    entries.sort(key=lambda e: (*e[:2], bytes(e[2])))
                    break
            lengths = np.array([len(e[2]) for e in entries], dtype=np.int64) // np.dtype(kind).itemsize
            ids = np.frombuffer(b"".join(e[2] for e in entries), dtype=kind)
            name = f"tokens-{s:06d}.ef"
            temporary = common.temporary_name(folder, name)
            files, path = common.opened(temporary)
            with files.open_output_stream(path) as out:
                out.write(file_bytes([e[1] if e[0] else None for e in entries], lengths, ids))
            yield pa.RecordBatch.from_pylist([{"name": name, "temporary": temporary, "docs": len(entries), "ids": len(ids)}])

    common.start_commit(folder)
    shards = len(bounds) + 1
    done = (
        rows.withColumn("shard", common.shard_of(F.col("doc_id"), bounds))
        .mapInArrow(common.by_batch(encode, 4_000), "shard int, block binary")
        .repartitionById(shards, F.col("shard"))
        .mapInArrow(write, "name string, temporary string, docs bigint, ids bigint")
        .collect()
    )  # a row for each file
    entries, before = [], 0
    for e in sorted((r.asDict() for r in done), key=lambda e: e["name"]):
        entries.append(e | {"start": before})
        before += e["ids"]
    common.commit_files(folder, entries, {"format": MAGIC.decode(), "end_id": end_id, "ids": before})
    return common.read_manifest(folder)


def _vocabulary_size(tokenizer: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer).get_vocab_size()


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of each document, from the files."""
    manifest = common.read_manifest(folder)
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids binary"
    files = [(f"{folder}/{f['name']}", f["start"]) for f in manifest["files"]]
    if not files:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column("uri").to_pylist(), batch.column("start").to_pylist()):
                source, path = common.opened(uri)
                with source.open_input_stream(path) as src:
                    held = TokenFile(src.read())
                for at in range(0, held.docs, 1000):
                    to = min(at + 1000, held.docs)
                    cuts = held.bounds(at, to)
                    own, cut = held.ids[cuts[0] : cuts[-1]].astype("<u4").tobytes(), 4 * (cuts - cuts[0])
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(held.doc_ids(at, to), pa.int64()), "start": pa.array(start + cuts[:-1]), "n_tokens": pa.array(np.diff(cuts)),
                        "ids": pa.array([own[a:b] for a, b in zip(cut.tolist(), cut[1:].tolist())], pa.binary()),
                    })

    return spark.createDataFrame(files, "uri string, start bigint").repartition(len(files)).mapInArrow(read, schema)
