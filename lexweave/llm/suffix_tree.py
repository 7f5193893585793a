r"""Language-model scores by a probabilistic suffix tree over words.

Tokens are words ``[^\x20\x09-\x0D]+`` with A-Z lower-cased, then one end. Symbols are all words that occur at least
OFTEN times in training, the end, and RARE classes that the other words fall in by their hash; a rare word's probability
is its class's times its smoothed share of the class. Contexts are the last none, one or two symbols. A context is
retained if it passes a divergence test: the leave-one-out log likelihood of its training continuations under its own
smoothed distribution exceeds that under its suffix's by GAIN nats. Its distribution is smoothed with the suffix's,
P(w|s) = (c(s, w) + k P(w|suffix)) / (c(s) + k), where k is the one of STRENGTHS that leaves one out best. A position is
scored by its longest retained suffix; the root is the smoothed unigram, so probabilities of the symbols add up to one
in each state.

Counts of words meet by the hash's class. There the symbols are numbered, in 32 bits, and each block of documents is
answered the numbers and counts of its own words; only the totals of the classes go to the driver and to every task, so
words and contexts grow with the corpus. Contexts with the same last symbol form one subtree, and positions go to their
subtree's task as packed, sorted blocks, their symbols as gaps and counts as steps: it counts, tests, smooths and scores
there, and returns sums for documents. A symbol that follows a large share of all words makes a large subtree, which is one task's work.

Training rows are those whose crc32(doc_id as text) mod 5 is not HELD_OUT; a null doc_id counts as the empty text.
Null texts are the end alone. Repeated rows count each. Without training rows all tokens are unknown.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .shingles import _words, mixed

OFTEN, RARE = 16, 4096
GAIN, STRENGTHS, HELD_OUT = 3.0, (4.0, 64.0), 1
END = 1  # the hash of the end token; BEGIN is a context only
#: Symbols below BEGIN are rare classes, those from FIRST on are words.
BEGIN, FIRST = RARE, RARE + 1
#: Documents in a block, whose numbers take 12 bits.
BLOCK = 4000
#: Positions that a task looks at together, unless one subtree has more.
AT_ONCE = 500_000
#: Bytes of text behind a part, which a task holds in memory.
PART_BYTES = 16 << 20


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == HELD_OUT


def hashes(raw: bytes) -> np.ndarray:
    """Hashes of a text's tokens, the end included."""
    words = raw.lower().split()
    out = np.empty(len(words) + 1, dtype=np.uint64)
    out[:-1] = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    out[-1] = END
    return out


def rare_class(h: np.ndarray) -> np.ndarray:
    return (mixed(h, 21) % np.uint64(RARE)).astype(np.int64)


def _pack(*columns: np.ndarray) -> bytes:
    head = struct.pack("<B", len(columns)) + b"".join(struct.pack("<3sQ", c.dtype.str[1:].encode().ljust(3), len(c)) for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(c.tobytes() for c in columns))


def _unpack(block: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(block)
    at, out = 1 + 11 * data[0], []
    for i in range(data[0]):
        kind, n = struct.unpack_from("<3sQ", data, 1 + 11 * i)
        kind = np.dtype("<" + kind.decode().strip())
        out.append(np.frombuffer(data, kind, n, at))
        at += n * kind.itemsize
    return out


def _summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    starts = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
    return h[starts], np.add.reduceat(n, starts) if len(h) else n


_SENT = "kind tinyint, part int, number bigint, block binary"
_SENT_FIELDS = pa.schema([("kind", pa.int8()), ("part", pa.int32()), ("number", pa.int64()), ("block", pa.binary())])


def _sent(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SENT_FIELDS)], schema=_SENT_FIELDS)


def _fit(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (x & 0xFFFF).astype("<u2"), (x >> 16).astype("<u2")


def _joined(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.uint32) | high.astype(np.uint32) << np.uint32(16)


def _planes(x: np.ndarray) -> np.ndarray:
    """Bytes of equal place side by side, which pack better."""
    return np.ascontiguousarray(x.view("u1").reshape(len(x), x.itemsize).T).reshape(-1)


def _whole(planes: np.ndarray, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).reshape(-1).view(kind)


def _gaps(x: np.ndarray, kind: str) -> np.ndarray:
    """Planes of the gaps between ascending numbers, the first one's gap from 0 included."""
    return _planes(np.diff(x.astype(kind), prepend=np.zeros(1, kind)))


def _sums(planes: np.ndarray, kind: str) -> np.ndarray:
    return np.cumsum(_whole(planes, kind), dtype=kind)


def _steps(x: np.ndarray) -> np.ndarray:
    """Planes of the steps, up or down, between numbers that differ little from the one before."""
    d = np.diff(x.astype(np.int64), prepend=np.zeros(1, np.int64))
    return _planes((d << 1 ^ d >> 63).astype("<u8"))


def _walked(planes: np.ndarray) -> np.ndarray:
    d = _whole(planes, "<u8")
    return np.cumsum((d >> np.uint64(1)).astype(np.int64) ^ -(d & np.uint64(1)).astype(np.int64))


def _coded(docs: DataFrame, parts: int) -> DataFrame:
    """Kind 0: a block's documents, their tokens as places among its distinct ones; 1: those of a part, with training counts."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = batch.column("doc_id").to_pylist()
        texts = [hashes(b) for b in common.bytes_of(batch)]
        size = np.array([len(t) for t in texts])
        train = np.array([not held_out(d) for d in names])
        h, to = np.unique(np.concatenate(texts), return_inverse=True)
        part = rare_class(h) % parts
        order = np.argsort(part, kind="stable")
        place = np.empty(len(h), np.int64)
        place[order] = np.arange(len(h))
        h, to = h[order], place[to]
        n = np.bincount(to, np.repeat(train, size), len(h)).astype("<u4")
        number = uuid.uuid4().int >> 65
        out = [(0, number % parts, number, _pack(np.array([d is None for d in names], dtype="<u1"), np.array([d or 0 for d in names], dtype="<i8"), train.astype("<u1"), size.astype("<i8"), _planes(to.astype("<u4"))))]
        edges = np.searchsorted(part[order], np.arange(parts + 1))
        out += [(1, p, number, _pack(_gaps(h[edges[p] : edges[p + 1]], "<u8"), _planes(n[edges[p] : edges[p + 1]]))) for p in range(parts) if edges[p] < edges[p + 1]]
        return _sent(out)

    return docs.mapInArrow(common.by_batch(kernel, BLOCK), _SENT)


def _answered(coded: DataFrame, parts: int) -> DataFrame:
    """Kind 1: symbols and training counts of a block's distinct tokens in a part; 2: totals of the part's rare classes and of all its tokens."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = ((p, number, *_unpack(b)) for batch in batches for p, number, b in zip(*[batch.column(c).to_pylist() for c in ("part", "number", "block")]))
        held, fresh, size, h, n = [], [], 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        _words.clear()  # this worker hashes no more words
        for p, number, own, count in got:
            own, count = _sums(own, "<u8"), _whole(count, "<u4")
            held.append((p, number, own))
            fresh.append((own, count))
            size += len(own)
            if size > max(len(h), AT_ONCE):  # merged as they come: what is sorted stays near what is distinct
                h, n = _summed(np.concatenate([h, *[x for x, _ in fresh]]), np.concatenate([n, *[x for _, x in fresh]]))
                fresh, size = [], 0
        if not held:
            return
        part = held[0][0]
        h, n = _summed(np.concatenate([h, *[x for x, _ in fresh]]), np.concatenate([n, *[x for _, x in fresh]]))
        fresh = None
        symbol, often = rare_class(h), n >= OFTEN
        # a rare class holds what was seen in training; other tokens are of a class, but add nothing
        seen = ~often & (n > 0)
        which, at = np.unique(symbol[seen], return_inverse=True)
        yield _sent([(2, part, 0, _pack(which, np.bincount(at, n[seen], len(which)).astype(np.int64), np.bincount(at, minlength=len(which)), np.array([n.sum(), (n > 0).sum()])))])
        words = np.flatnonzero(often)
        words = words[np.argsort(-n[words], kind="stable")]
        symbol[words] = FIRST + np.arange(len(words)) * parts + part
        if len(words) and symbol[words[-1]] >> 32:
            raise OverflowError("more words than symbols of 32 bits")
        narrow = int(n.max(initial=0)) < 1 << 32
        for _, number, own in held:
            at = np.searchsorted(h, own)
            yield _sent([(1, part, number, _pack(*_halves(symbol[at]), _planes(n[at].astype("<u4" if narrow else "<u8"))))])

    return coded.where("kind = 1").repartitionById(parts, F.col("part")).mapInArrow(common.settled(total), _SENT)


class Totals:
    """The rare classes with their totals, and the masses of the root."""

    def __init__(self, blocks: list[bytes]) -> None:
        sums, kinds, both = np.zeros(RARE, np.int64), np.zeros(RARE, np.int64), np.zeros(2, np.int64)
        for which, s, k, own in map(_unpack, blocks):
            sums[which] += s
            kinds[which] += k
            both += own
        self.tokens, self.distinct = int(both[0]), int(both[1])
        self.rare_mass = sums + 0.5 * (kinds + 1)
        self.z = self.tokens + 0.5 * (self.distinct + RARE)
        self.base = self.tokens + 0.5 * (self.distinct + 1)

    def root(self, symbols: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """P of symbols with their training counts, which are not read for rare classes."""
        rare = symbols < RARE
        return np.where(rare, self.rare_mass[np.where(rare, symbols, 0)], counts + 0.5) / self.z


def _positions(coded: DataFrame, answered: DataFrame, held, parts: int) -> DataFrame:  # noqa: ANN001
    """Kind 0: a block's documents with the sums that need no context; 1: its positions by subtree."""

    def of(number: int, table: bytes, answers: list[tuple[int, bytes]]) -> pa.RecordBatch:
        totals: Totals = held.value
        gone, names, train, size, to = _unpack(table)
        to = _whole(to, "<u4")
        got = [_unpack(b) for _, b in sorted(answers)]
        symbol = np.concatenate([_joined(*x[:2]) for x in got])
        n = np.concatenate([_whole(x[2], f"<u{len(x[2]) // max(len(x[0]), 1) or 4}") for x in got]).astype(np.int64)
        doc = np.repeat(np.arange(len(size)), size)
        rare = symbol < RARE
        own = np.where(rare, np.log10((n + 0.5) / totals.rare_mass[np.where(rare, symbol, 0)]), 0.0)
        base = np.log10((n + 0.5) / totals.base)
        sums = [np.bincount(doc, x[to], len(size)) for x in (base, own)]
        out = [(0, number % parts, number, _pack(gone, names, 1 - train, size, np.bincount(doc, (n > 0)[to], len(size)).astype("<i8"), *sums))]
        # distinct symbols in the order of their subtrees' parts
        distinct, first = np.unique(np.append(symbol, np.uint32(BEGIN)), return_index=True)
        counts = np.where(distinct < RARE, 0, np.append(n, 0)[first])  # those of rare classes are not read
        part = (mixed(distinct.astype(np.uint64), 33) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        distinct, counts, part = distinct[order], counts[order], part[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        begin = place[np.searchsorted(distinct[place], BEGIN)]
        w = place[np.searchsorted(distinct[place], symbol)][to]
        starts = np.append(0, np.cumsum(size)[:-1])
        c1 = np.append(begin, w[:-1])
        c1[starts] = begin
        c2 = np.append(begin, c1[:-1])
        c2[starts] = begin
        tag = (doc | train[doc].astype(np.int64) << 15).astype("<u2")
        bits = len(distinct).bit_length()
        order = np.argsort(c1 << 2 * bits | c2 << bits | w, kind="stable") if 3 * bits < 64 else np.lexsort((w, c2, c1))
        edges = np.searchsorted(part[c1[order]], np.arange(parts + 1))
        used, local = np.zeros(len(distinct), bool), np.zeros(len(distinct), np.int64)
        for p in range(parts):
            at = order[edges[p] : edges[p + 1]]
            if len(at):
                used[:] = False
                for x in (c1, c2, w):
                    used[x[at]] = True
                own = np.flatnonzero(used)
                own = own[np.argsort(distinct[own])]
                local[own] = np.arange(len(own))
                out.append((1, p, number, _pack(_gaps(distinct[own], "<u4"), _steps(counts[own]), *[_fit(local[x[at]]) for x in (c1, c2, w)], tag[at])))
        return _sent(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, bytes] = {}
        answers: dict[int, list[tuple[int, bytes]]] = {}
        for batch in batches:
            for kind, part, number, block in zip(*[batch.column(c).to_pylist() for c in _SENT_FIELDS.names]):
                if kind == 0:
                    tables[number] = block
                else:
                    answers.setdefault(number, []).append((part, block))
        _words.clear()  # this worker hashes no more words
        for number, table in tables.items():
            yield of(number, table, answers.pop(number))

    both = coded.where("kind = 0").unionByName(answered.where("kind = 1"))
    return both.repartition(parts, "number").mapInArrow(common.settled(run), _SENT)


def _state(n: np.ndarray, group: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """P of continuations with training counts n in contexts ``group`` (0, 1, ..), given those of the suffix."""
    total = np.bincount(group, n)
    best, strength = np.full(len(total), GAIN), np.zeros(len(total))
    seen = n > 0
    ns, gs, ss = n[seen], group[seen], suffix[seen]
    for k in STRENGTHS:
        left = (ns - 1 + k * ss) / (total[gs] - 1 + k)
        gain = np.bincount(gs, ns * np.log(left / ss), len(total))
        better = gain > best
        best[better], strength[better] = gain[better], k
    k = strength[group]
    return np.where(k > 0, (n + k * suffix) / np.maximum(total[group] + k, 1e-9), suffix)


def subtree(c1: np.ndarray, c2: np.ndarray, w: np.ndarray, train: np.ndarray, root: np.ndarray) -> np.ndarray:
    """P of each position in its longest retained suffix; all positions of a last symbol are there. root: P by w."""
    bits = max(int(x.max(initial=0)) for x in (c1, c2, w)).bit_length()
    if 3 * bits <= 64:
        key = c1.astype(np.uint64) << np.uint64(2 * bits)
        key |= c2.astype(np.uint64) << np.uint64(bits)
        key |= w.astype(np.uint64)
        order = np.argsort(key, kind="stable")
        del key
    else:
        order = np.lexsort((w, c2, c1))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in (c1, c2, w):
        x = x[order]
        new[1:] |= x[1:] != x[:-1]
    starts = np.flatnonzero(new)
    n2 = np.add.reduceat(train[order].astype(np.int32), starts, dtype=np.int64)
    d1, d2, dw = (x[order[starts]].astype(np.uint64) for x in (c1, c2, w))
    u1, to1 = np.unique(d1 << np.uint64(32) | dw, return_inverse=True)
    n1 = np.bincount(to1, n2).astype(np.int64)
    _, g1 = np.unique(u1 >> np.uint64(32), return_inverse=True)
    p1 = _state(n1, g1, root[(u1 & np.uint64(0xFFFFFFFF)).astype(np.int64)])
    pair = d1 << np.uint64(32) | d2
    g2 = np.cumsum(np.append(False, pair[1:] != pair[:-1]))
    p2 = _state(n2, g2, p1[to1])
    out = np.empty(len(order))
    out[order] = np.repeat(p2, np.diff(np.append(starts, len(order))))
    return out


def _tallied(held):  # noqa: ANN001, ANN202
    """Sums of a part for the documents of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Totals = held.value
        trees = []
        for batch in batches:
            for kind, number, block in zip(*[batch.column(c).to_pylist() for c in ("kind", "number", "block")]):
                if kind == 0:
                    yield pa.RecordBatch.from_arrays([pa.array([0], pa.int8()), pa.array([number], pa.int64()), pa.array([block], pa.binary())], names=["kind", "number", "block"])
                else:
                    tree = _unpack(block)
                    trees.append((number, [_sums(tree[0], "<u4"), _fit(_walked(tree[1])), *tree[2:]]))
        if not trees:
            return
        _words.clear()  # this worker hashes no more words
        symbols, first = np.unique(np.concatenate([x[0] for _, x in trees]), return_index=True)
        root = totals.root(symbols, np.concatenate([x[1].astype(np.int64) for _, x in trees])[first])
        places = [np.searchsorted(symbols, x[0]).astype(np.uint32) for _, x in trees]
        # subtrees are taken one after another, as many at once as have AT_ONCE positions; a block's are sorted by c1
        total = np.zeros(len(symbols), np.int64)
        for at, (_, x) in zip(places, trees):
            total[at] += np.bincount(x[2], minlength=len(at))
        begins = np.cumsum(total) - total
        cuts = np.append(np.flatnonzero(np.diff(begins // AT_ONCE, prepend=-1)), len(symbols))
        sums: dict[int, np.ndarray] = {number: np.zeros(1 << 12) for number, _ in trees}
        for low, high in zip(cuts, cuts[1:]):
            edges = [np.searchsorted(x[2], np.searchsorted(at, (low, high))) for at, (_, x) in zip(places, trees)]
            own = [(number, at, [c[a:b] for c in x[2:]]) for at, (number, x), (a, b) in zip(places, trees, edges) if a < b]
            if not own:
                continue
            c1, c2, w = (np.concatenate([at[x[i]] for _, at, x in own]) for i in range(3))
            values, start = subtree(c1, c2, w, np.concatenate([x[3] for *_, x in own]) >> 15, root), 0
            np.log10(values, out=values)
            for number, _, x in own:
                sums[number] += np.bincount(x[3] & 0xFFF, values[start : start + len(x[3])], 1 << 12)
                start += len(x[3])
        for number, tally in sums.items():
            last = int(np.flatnonzero(tally).max(initial=0)) + 1
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int8()), pa.array([number], pa.int64()), pa.array([_pack(tally[:last])], pa.binary())], names=["kind", "number", "block"])

    return run


_SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs."""
    spark = docs.sparkSession
    parts = common.parts_of(docs, "text", PART_BYTES)
    coded = common.cut(_coded(docs.select("doc_id", "text"), parts), "coded")
    answered = common.cut(_answered(coded, parts), "symbols")
    totals = Totals([r["block"] for r in answered.where("kind = 2").select("block").collect()])  # RARE classes at most
    held = spark.sparkContext.broadcast(totals)
    tallied = _positions(coded, answered, held, parts).repartitionById(parts, F.col("part")).mapInArrow(common.settled(_tallied(held)), "kind tinyint, number bigint, block binary")

    tokens = totals.tokens

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, sums = {}, {}
        for batch in batches:
            for kind, number, block in zip(*[batch.column(c).to_pylist() for c in ("kind", "number", "block")]):
                if kind == 0:
                    tables[number] = block
                else:
                    (x,) = _unpack(block)
                    sums.setdefault(number, np.zeros(1 << 12))[: len(x)] += x
        for number, block in tables.items():
            gone, names, out, size, known, base, own = _unpack(block)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(names, pa.int64(), mask=gone.astype(bool)), "held_out": pa.array(out.astype(bool)), "n_tokens": pa.array(size), "n_known": pa.array(known),
                "train_tokens": pa.array(np.full(len(names), tokens)), "base_score": pa.array(base), "score": pa.array(own + sums[number][: len(names)]),
            })

    return tallied.repartition(parts, "number").mapInArrow(common.settled(gathered), _SCORES)
