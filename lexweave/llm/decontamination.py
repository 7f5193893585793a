"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts and items are normalised to lower-case ASCII letters, digits and bytes above ASCII, words parted by one blank.
The CGK walk of a string copies a byte to each place and moves on or stays by a random bit of (place, byte), so strings
at a small edit distance agree on most places: after an edit the two walks fall into step again. WALKS walks with TABLES
samples of SAMPLE places each give the LSH keys. Samples lie in a walk's first DEPTH places, where few edits have been
met; and as an edit spoils some of an item's windows only, windows start at every word of an item and at every
STRIDE-th word of a document, without regard to what the words are. A key that two of them share sets the item against
the window of the document that has the item's size at the same offset. That is compared by edit distance
(bit-parallel, the window's surroundings free at both ends), unless the grams in common rule a hit out. A hit is a distance of at most RATE of the item's length.
Recall at each rate of edits up to RATE, and with a letter changed in every longer word, is measured in the tests.

The items are the only side that is broadcast, in blocks of at most ITEM_BYTES of text; documents never move.
An item of fewer than LEAST words or DEPTH // 2 bytes is found in documents that hold nothing else, as a common phrase
is no evidence; items without words, null ones too, match nothing. Null texts match nothing. Repeated items and
documents are reported each; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

RATE, LEAST = 0.15, 5
WALKS, TABLES, SAMPLE, DEPTH, STRIDE, SEED = 2, 4, 14, 48, 2, 20240229
ITEM_BYTES = 8 << 20
#: Windows that walk together.
TOGETHER = 4_096
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_FOLD).split()


def distance(pattern: bytes, text: bytes) -> tuple[int, int]:
    """Least edit distance of the pattern to a part of the text, and the end of the first such part."""
    m = len(pattern)
    masks: dict[int, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    full, last = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        zero = (((eq & up) + up) ^ up) | eq | down
        rise = down | (full & ~(zero | up))
        fall = up & zero
        if rise & last:
            score += 1
        elif fall & last:
            score -= 1
        rise = (rise << 1) & full
        fall = (fall << 1) & full
        up = fall | (full & ~(zero | rise))
        down = rise & zero
        if score < best:
            best, end = score, j + 1
    return best, end


#: Bytes of the grams that are counted before an edit distance is worked out.
GRAM = 4


def grams(text: bytes) -> np.ndarray:
    raw = np.frombuffer(text, dtype=np.uint8).astype(np.uint32)
    return raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised texts one after the other with room for a walk at the end, where each begins, and all word starts."""
    begins = np.cumsum([0, *[len(t) + 1 for t in texts]])
    raw = np.frombuffer(b"\0".join(texts) + bytes(DEPTH + 1), dtype=np.uint8)
    last = int(begins[-1]) - 1
    starts = np.append(0, np.flatnonzero((raw[:last] == 32) | (raw[:last] == 0)) + 1)
    return raw, begins, starts[raw[starts] != 0]


class Items:
    """LSH tables of a block of items."""

    def __init__(self, items: list[tuple[int, bytes]]) -> None:
        told = [(i, b" ".join(w), len(w)) for i, text in items if (w := words_of(text))]
        self.short: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for i, text, n in told:
            if n < LEAST or len(text) < DEPTH // 2:
                self.short[text].append((i, n))
        self.items = [x for x in told if x[2] >= LEAST and len(x[1]) >= DEPTH // 2]
        self.texts = [x[1] for x in self.items]
        self.grams = [grams(t) for t in self.texts]
        rng = np.random.default_rng(SEED)
        self.steps = rng.integers(0, 2, (WALKS, DEPTH, 256), dtype=np.uint8)
        self.weights = np.zeros((WALKS, TABLES, DEPTH))
        for w in range(WALKS):
            for t in range(TABLES):  # sums of whole numbers under 2^53 are exact in any order
                self.weights[w, t, rng.permutation(DEPTH)[:SAMPLE]] = rng.integers(1, 1 << 40, SAMPLE)
        raw, begins, starts = joined(self.texts)
        owner = np.searchsorted(begins, starts, side="right") - 1
        roomy = begins[owner + 1] - 1 - starts >= DEPTH // 2 if self.texts else np.zeros(len(starts), dtype=bool)
        starts, owner = starts[roomy], owner[roomy]
        self.tables = []
        keys = self.keys(raw, starts) if len(starts) else np.zeros((WALKS * TABLES, 0))
        self.bits = max(16, (16 * len(starts)).bit_length())
        for row in keys:
            order = np.argsort(row, kind="stable")
            seen = np.zeros(1 << self.bits, dtype=bool)
            seen[self._slot(row)] = True
            self.tables.append((seen, row[order], owner[order], (starts - begins[owner])[order]))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def keys(self, raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """LSH keys (tables x windows) of the windows that start there."""
        out = np.empty((WALKS, TABLES, len(starts)))
        for a in range(0, len(starts), TOGETHER):
            own = starts[a : a + TOGETHER]
            walked, step = np.empty((DEPTH, len(own)), dtype=np.uint8), np.empty(len(own), dtype=np.uint8)
            for w in range(WALKS):
                at = own.copy()
                for t in range(DEPTH):
                    c = np.take(raw, at, out=walked[t], mode="clip")
                    at += np.take(self.steps[w, t], c, out=step, mode="clip")
                np.matmul(self.weights[w], walked.astype(np.float64), out=out[w, :, a : a + len(own)])
        return out.reshape(WALKS * TABLES, len(starts))

    def candidates(self, raw: np.ndarray, begins: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, item, begin) where an item of a key in common would begin, counted from its text's first byte."""
        found = set()
        for (seen, keys, items, offsets), row in zip(self.tables, self.keys(raw, starts)):
            at = np.flatnonzero(seen[self._slot(row)])
            low, high = np.searchsorted(keys, row[at], side="left"), np.searchsorted(keys, row[at], side="right")
            at, low, high = at[high > low], low[high > low], high[high > low]
            if not len(at):
                continue
            each = np.repeat(low - np.cumsum(high - low) + (high - low), high - low) + np.arange(int((high - low).sum()))
            place = np.repeat(starts[at], high - low)
            text = np.searchsorted(begins, place, side="right") - 1
            found.update(zip(text.tolist(), items[each].tolist(), (place - begins[text] - offsets[each]).tolist()))
        return sorted(found)

    def hits(self, texts: list[bytes], rate: float) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item_id, distance, first word, words) of each item in each text: its nearest place."""
        plain = [b" ".join(words_of(t)) for t in texts]
        for d, text in enumerate(plain):
            for i, n in self.short.get(text, ()) if text else ():
                yield d, i, 0, 0, n
        if not self.texts or not any(plain):
            return
        raw, begins, starts = joined(plain)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        place = None  # (text, item, first begin, last begin) of candidates whose windows overlap
        for d, n, at in [*self.candidates(raw, begins, starts[::STRIDE]), (-1, -1, -1)]:
            if place and place[:2] == (d, n) and at - place[3] <= len(self.texts[n]) // 4:
                place = (d, n, place[2], at)
                continue
            if place:
                e, m, a, b = place
                item = self.texts[m]
                pad = int(rate * len(item)) + 1
                around = plain[e][max(0, a - pad) : b + len(item) + pad]
                # an edit spoils GRAM of the item's grams at most, so a hit has all but so many in common with its place
                held = np.sort(grams(around))
                found = np.minimum(np.searchsorted(held, self.grams[m]), len(held) - 1)
                if len(held) and (held[found] == self.grams[m]).sum() >= len(self.grams[m]) - GRAM * int(rate * len(item)):
                    apart, _ = distance(item, around)
                    if apart <= rate * len(item) and (apart, a) < best.get((e, m), (1 << 60, 0)):
                        best[e, m] = (apart, max(0, a))
            place = (d, n, at, at)
        for (d, n), (apart, a) in sorted(best.items()):
            yield d, self.items[n][0], apart, plain[d].count(b" ", 0, a), self.items[n][2]


def blocks(benchmark: DataFrame, most: int = ITEM_BYTES) -> Iterator[list[tuple[int, bytes]]]:
    """Items in blocks of at most ``most`` bytes of text."""
    held, size = [], 0
    for r in benchmark.select("item_id", "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        raw = r["text"].encode()
        if held and size + len(raw) > most:
            yield held
            held, size = [], 0
        held.append((r["item_id"], raw))
        size += len(raw)
    yield held


_HITS = "doc_id bigint, item_id bigint, distance int, first_word int, n_words int"
_HIT_FIELDS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("first_word", pa.int32()), ("n_words", pa.int32())])


_built: dict[str, Items] = common.remembered({}, "decontamination")


def _items(block: str, held) -> Items:  # noqa: ANN001
    """The tables of a broadcast block, built once in a worker."""
    if block not in _built:
        _built.clear()
        _built[block] = Items(held.value)
    return _built[block]


def hits(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, distance, first_word and n_words of the nearest place of each item that each row of docs holds."""
    spark, out = docs.sparkSession, None
    for block in blocks(benchmark):
        held = spark.sparkContext.broadcast(block)

        def kernel(batch: pa.RecordBatch, held=held, block=uuid.uuid4().hex) -> pa.RecordBatch:  # noqa: ANN001
            items = _items(block, held)
            names = batch.column("doc_id").to_pylist()
            rows = [(names[d], *rest) for d, *rest in items.hits(common.bytes_of(batch), rate)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, _HIT_FIELDS)], schema=_HIT_FIELDS)

        part = docs.select("doc_id", "text").mapInArrow(common.by_batch(kernel), _HITS)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """Rows of docs without a hit: one pass, nothing is joined."""
    spark = docs.sparkSession
    for block in blocks(benchmark):
        held = spark.sparkContext.broadcast(block)

        def kernel(batch: pa.RecordBatch, held=held, block=uuid.uuid4().hex) -> pa.RecordBatch:  # noqa: ANN001
            items = _items(block, held)
            kept = np.ones(batch.num_rows, dtype=bool)
            for d, *_ in items.hits(common.bytes_of(batch), rate):
                kept[d] = False
            return batch.filter(pa.array(kept))

        docs = docs.mapInArrow(common.by_batch(kernel), docs.schema)
    return docs
