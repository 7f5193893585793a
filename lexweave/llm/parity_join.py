"""Near-duplicate documents by a parity-sketch join: shingle sets with Jaccard of 0.8 and more, all of them.

A set's sketch is a row of P lanes of 64 bits; each token XORs its hash into one lane, so a token that two sets do
not share changes one lane of one of them, and the number of lanes that differ is at most the symmetric difference.
Sets that link have a symmetric difference of at most d = (|A| + |B|) / 9. With P > d lanes at least P - d lanes are
equal (pigeonhole), so sets meet on equal lanes:

  - Sizes fall in bands of ratio 1.25; linked sets are in one band or neighbours. Join k takes bands k and k + 1 and
    has d_k for its largest sizes and P_k = SLACK * (d_k + 1) lanes.
  - Empty lanes say nothing and are no keys. A set with at most d_k lanes in use also emits its prefix tokens (the
    n - ceil(0.8 n) + 1 least hashes) as keys; two such sets that link share one of those. Otherwise one of the two
    has more than d_k lanes in use, so an equal lane in use exists.
  - Equal sets are one node from the start, however many documents have them.

Keys travel as packed blocks, not as rows. Groups of nodes under a key are kept once for each distinct set of nodes, in
chunks of BLOCK nodes. A chunk is joined in place: nodes carry a parity sketch of 1.5 to 3 bits a token (small ones of 1,024 bits), whose
Hamming distance bounds the symmetric difference. Pairs that are well within the bound are taken as a spanning forest,
fewer than the chunk has nodes; pairs near the bound are taken all, where the forest does not join them. Pairs are
verified on the sets. A first round has each node in its largest group alone, the second all groups, given the
components by then. Where a pair fails and its nodes are in different components, the chunks that hold both go round
again without it, until no chunk has a pair to offer: then every link has both ends in one component.

Groups of more than LARGE nodes: a node with no more keys in such groups than it has lanes to spare (beyond d_k) meets
all that it links with in smaller groups. The others, hot ones, share hundreds of such groups with the same nodes, so
after the first round those that large groups connect are one family, whose nodes are compared once and not in each
group: in cells of about CELL nodes by CELL of the same or the next band of sizes. Smaller groups all of one family are left
out. So no cap drops a link.

Texts without words, null ones too, are linked with nothing. Repeated rows are equal sets. A null doc_id is never
the least of a component unless all are null. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, components, shingles

#: Lanes over those that the pigeonhole needs; nodes in a chunk of a group; rows that may be broadcast (24 bytes each).
SLACK, BLOCK, BROADCAST_ROWS = 1.3, 1024, 500_000
#: Nodes in a group from which on hot ones are compared by family; nodes in a side of a cell; ratio of a family's bands,
#: which is over 1.25 so that rounding sets no linked sizes two bands apart.
LARGE, CELL, STEP = 128, 2048, 1.26
#: Share of the bound up to which a suggested symmetric difference is taken for a link, until it is verified.
SURE = 0.85
#: Bytes of text behind a part of the keys.
PART_BYTES = 16 << 20
_K1, _K2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def links(a: int, b: int, both: int) -> bool:
    return 100 * both >= 80 * (a + b - both)


def band(n: int) -> int:
    k = int(math.log(n) / math.log(1.25))
    while 1.25 ** (k + 1) <= n:
        k += 1
    while 1.25**k > n:
        k -= 1
    return k


def lanes(k: int) -> tuple[int, int]:
    """d and P of join k."""
    most = math.ceil(1.25 ** (k + 1)) - 1
    d = (most + most * 5 // 4) // 9
    return d, math.ceil(SLACK * (d + 1))


def keys_of(tokens: np.ndarray) -> tuple[np.ndarray, int]:
    """Keys of a set in its two joins, and how many lanes in use each join can spare."""
    n, out = len(tokens), []
    own, spare = band(n), 1 << 30
    for k in (own, own - 1):
        d, p = lanes(k)
        spread = shingles.mixed(tokens * _K1, k + 1000)
        lane = ((spread >> np.uint64(32)) * np.uint64(p)) >> np.uint64(32)
        order = np.argsort(lane, kind="stable")
        sorted_lane = lane[order]
        starts = np.flatnonzero(np.append(True, sorted_lane[1:] != sorted_lane[:-1]))
        xor = np.bitwise_xor.reduceat(shingles.mixed(tokens[order] * _K2, 7), starts)
        out.append(shingles.mixed(xor ^ (sorted_lane[starts] * _K1), k + 5000))
        spare = min(spare, len(starts) - d - 1)
        if len(starts) <= d:
            prefix = tokens[: n - -(-80 * n // 100) + 1]
            out.append(shingles.mixed(prefix, k + 9000))
    return np.concatenate(out), spare


def width(n: int) -> int:
    """Bits of the parity sketch of a set of n tokens: a power of two of at least 1.5 n + 500."""
    return 1 << (3 * n // 2 + 499).bit_length()


def sketch(tokens: np.ndarray) -> bytes:
    """A bit for each residue of the tokens' hashes, flipped by each token; folding halves together gives fewer bits."""
    bits = np.bincount((shingles.mixed(tokens, 3) & np.uint64(width(len(tokens)) - 1)).astype(np.int64), minlength=width(len(tokens)))
    return np.packbits((bits & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, all folded to the least width among them."""
    least = min(map(len, sketches)) // 8
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(s, "<u8").reshape(-1, least), axis=0) for s in sketches])


def node_of(tokens: np.ndarray) -> int:
    return struct.unpack("<q", xxhash.xxh3_64_digest(tokens.tobytes()))[0]


def _hashed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of the text, which tell a row from all but its own repetitions."""
    return docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))


_POINT_FIELDS = pa.schema([("kind", pa.int8()), ("part", pa.int32()), ("doc_id", pa.int64()), ("th", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("spare", pa.int64()), ("block", pa.binary())])
_POINTS = "kind tinyint, part int, doc_id bigint, th bigint, node bigint, n bigint, spare bigint, block binary"


def _sketched(docs: DataFrame, parts: int) -> DataFrame:
    """kind 0: a row with its node, set size, spare lanes and sketch; kind 1: a part's block of 48-bit keys and nodes."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, nodes, sizes, held, seen, spares, sketches = batch.column("th"), [], [], [], {}, [], []
        for raw in common.bytes_of(batch):
            tokens = shingles.of(raw)
            sizes.append(len(tokens))
            nodes.append(node_of(tokens) if len(tokens) else None)
            spare = drawn = None
            if len(tokens) > 3 and nodes[-1] not in seen:  # smaller sets link only with their like
                seen[nodes[-1]] = len(seen)
                keys, spare = keys_of(tokens)
                held.append(keys)
                drawn = sketch(tokens)
            spares.append(spare)
            sketches.append(drawn)
        part_of = pa.array(np.array(hashes.to_numpy()) % parts, pa.int32())
        out = [pa.array(np.zeros(len(nodes), dtype=np.int8)), part_of, batch.column("doc_id"), hashes, pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(spares, pa.int64()), pa.array(sketches, pa.binary())]
        if held:
            keys = np.concatenate(held)
            of = np.repeat(np.arange(len(held), dtype=np.uint16), [len(h) for h in held])
            part = ((keys >> np.uint64(48)) * np.uint64(parts) >> np.uint64(16)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            keys, of, part = keys[order], of[order], part[order]
            every = np.array(list(seen), dtype="<i8")
            starts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
            blocks = []
            for a, b in zip(starts, starts[1:]):
                used, local = np.unique(of[a:b], return_inverse=True)
                low = keys[a:b]
                blocks.append(struct.pack("<II", len(used), b - a) + every[used].tobytes() + local.astype("<u2").tobytes() + low.astype("<u4").tobytes() + (low >> np.uint64(32)).astype("<u2").tobytes())
            m = len(blocks)
            more = [pa.array(np.ones(m, dtype=np.int8)), pa.array(part[starts[:-1]], pa.int32()), *[pa.nulls(m, pa.int64())] * 5, pa.array(blocks, pa.binary())]
            out = [pa.concat_arrays([x, y]) for x, y in zip(out, more)]
        return pa.RecordBatch.from_arrays(out, schema=_POINT_FIELDS)

    return _hashed(docs).mapInArrow(common.by_batch(kernel, 4000), _POINTS)


_MET_FIELDS = pa.schema([("kind", pa.int8()), ("doc_id", pa.int64()), ("th", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("spare", pa.int64()), ("sketch", pa.binary()), ("gid", pa.int64()), ("chunk", pa.int64()), ("size", pa.int64()), ("keys", pa.int64()), ("members", pa.list_(pa.int64()))])
_MET = "kind tinyint, doc_id bigint, th bigint, node bigint, n bigint, spare bigint, sketch binary, gid bigint, chunk bigint, size bigint, keys bigint, members array<bigint>"


#: Ranges of keys that a part is worked through by, one after another.
RANGES = 8


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passes rows on and turns the blocks of a part into its distinct groups of two nodes and more, in chunks.

    Blocks stay as they came, eight bytes a key; the sorting, which takes many times that, is done for a range of keys at
    a time. A group that comes of keys of several ranges comes from each, as it may from several parts.
    """
    blocks, base = [], 0
    for batch in batches:
        kind = batch.column("kind").to_numpy(zero_copy_only=False)
        rows = batch.filter(pa.array(kind == 0))
        if m := rows.num_rows:
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in ("kind", "doc_id", "th", "node", "n", "spare", "block")], *[pa.nulls(m, pa.int64())] * 4, pa.nulls(m, pa.list_(pa.int64()))], schema=_MET_FIELDS)
        for block in batch.filter(pa.array(kind == 1)).column("block").to_pylist():
            used, count = struct.unpack_from("<II", block)
            blocks.append((block, used, count, base))
            base += used
    if not blocks:
        return
    node = np.concatenate([np.frombuffer(block, "<i8", used, 8) for block, used, _, _ in blocks])
    for turn in range(RANGES):
        keys, owners = [], []
        for block, used, count, base in blocks:
            at = 8 + 8 * used
            high = np.frombuffer(block, "<u2", count, at + 6 * count)
            own = np.flatnonzero(high >> np.uint16(13) == turn)
            owners.append(np.frombuffer(block, "<u2", count, at)[own].astype(np.uint32) + np.uint32(base))
            keys.append(np.frombuffer(block, "<u4", count, at + 2 * count)[own].astype(np.uint64) | high[own].astype(np.uint64) << np.uint64(32))
        key, owner = np.concatenate(keys), np.concatenate(owners)
        keys = owners = None
        yield from _groups_of(key, owner, node)


def _groups_of(key: np.ndarray, owner: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The distinct groups of two nodes and more that share a key; owner: a key's place in node."""
    order = np.argsort(key, kind="stable")
    key, owner = key[order], owner[order]
    again = key[1:] == key[:-1]
    met = (np.append(again, False) | np.append(False, again))[: len(key)]
    key, owner = key[met], node[owner[met]]
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    if not len(key):
        return
    new = np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]))
    key, owner = key[new], owner[new]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(starts, len(key)))
    gid = np.add.reduceat(shingles.mixed(owner.view(np.uint64), 31), starts) + size.astype(np.uint64)
    kept = np.flatnonzero(size > 1)
    gid, first, often = np.unique(gid[kept], return_index=True, return_counts=True)
    starts, size, gid = starts[kept][first], size[kept][first], gid.view(np.int64)
    for a in range(0, len(gid), 2000):
        out: tuple[list, ...] = ([], [], [], [], [])
        for g, s, n, k in zip(gid[a : a + 2000].tolist(), starts[a : a + 2000].tolist(), size[a : a + 2000].tolist(), often[a : a + 2000].tolist()):
            for c in range(0, n, BLOCK):
                for column, x in zip(out, (g, c // BLOCK, n, k, owner[s + c : s + min(n, c + BLOCK)])):
                    column.append(x)
        m = len(out[0])
        offsets = np.cumsum([0, *map(len, out[4])]).astype(np.int32)
        members = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(out[4])))
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, dtype=np.int8)), *[pa.nulls(m, pa.int64())] * 5, pa.nulls(m, pa.binary()), *[pa.array(x, pa.int64()) for x in out[:4]], members], schema=_MET_FIELDS)


def _sets(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """node, n and packed tokens (48 bits each) of the nodes picked (node, rep)."""
    wanted = picked.select("node", F.col("rep.doc_id").alias("rep_id"), F.col("rep.th").alias("rep_th"))
    if picked.count() <= BROADCAST_ROWS:  # beyond that both sides are shuffled
        wanted = F.broadcast(wanted)
    own = _hashed(docs).join(wanted, (F.col("th") == F.col("rep_th")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))).select("node", "text")

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles.of(b) for b in common.bytes_of(batch)]
        packed = [(s >> np.uint64(32)).astype("<u4").tobytes() + (s >> np.uint64(16)).astype("<u2").tobytes() for s in sets]
        return pa.RecordBatch.from_pydict({"node": batch.column("node"), "n": pa.array([len(s) for s in sets], pa.int64()), "tokens": pa.array(packed, pa.binary())})

    return own.mapInArrow(common.by_batch(kernel), "node bigint, n bigint, tokens binary").dropDuplicates(["node"])  # a row may be repeated


def _tokens(packed: bytes) -> np.ndarray:
    n = len(packed) // 6
    return np.frombuffer(packed, "<u4", n).astype(np.uint64) << np.uint64(16) | np.frombuffer(packed, "<u2", n, 4 * n).astype(np.uint64)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b and linked of each pair."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for x, y in zip(*[batch.column(c).to_pylist() for c in ("ta", "tb")]):
            p, q = _tokens(x), _tokens(y)
            out.append(links(len(p), len(q), len(p) + len(q) - len(np.union1d(p, q))))
        return pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b"), "linked": pa.array(out, pa.bool_())})

    left, right = (sets.select(F.col("node").alias(c), F.col("tokens").alias(f"t{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(common.by_batch(kernel), "a bigint, b bigint, linked boolean")


def forest(node: np.ndarray, comp: np.ndarray, n: np.ndarray, bits: np.ndarray, failed: list) -> list[tuple[int, int]]:
    """Pairs (i, j) to verify: if all link that seem to, what sketches allow to link is joined.

    Where the symmetric difference that a sketch suggests is well under the bound, a pair is taken to link: such pairs
    are found as a spanning forest. Pairs near the bound are all returned, but for those that the forest joins.
    failed: for each node the nodes that it is known not to link with, or None.
    """
    _, root = np.unique(comp, return_inverse=True)
    half = bits.shape[1] * 32.0
    if np.bincount(root).max() > 1:  # the largest component last: nothing is left to do once the others are through
        order = np.argsort(root == np.bincount(root).argmax(), kind="stable")
        return [(min(int(order[i]), int(order[j])), max(int(order[i]), int(order[j]))) for i, j in _forest(node[order], root[order], n[order], bits[order], [failed[k] for k in order], half)]
    return _forest(node, root, n, bits, failed, half)


def _forest(node: np.ndarray, root: np.ndarray, n: np.ndarray, bits: np.ndarray, failed: list, half: float) -> list[tuple[int, int]]:
    out, unsure = [], []
    root = root.copy()
    for i in range(len(node) - 1):
        j = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
        if not len(j):
            if i % 16 == 0 and (root[i:] == root[i]).all():
                break
            continue
        j = j[100 * np.minimum(n[j], n[i]) >= 80 * np.maximum(n[j], n[i])]
        apart = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1)
        near = 9 * apart <= n[j] + n[i]
        j, apart = j[near], apart[near]
        if failed[i] is not None and len(j):
            open_ = ~np.isin(node[j], failed[i])
            j, apart = j[open_], apart[open_]
        if not len(j):
            continue
        suggested = -half * np.log(np.maximum(1 - apart / half, 1e-9))
        sure = 9 * suggested <= SURE * (n[j] + n[i])
        if not sure.all():
            unsure.append(np.stack([np.full(int((~sure).sum()), i), j[~sure]], axis=1))
            j, apart = j[sure], apart[sure]
        if len(j):
            order = np.lexsort((j, apart))
            found, at = np.unique(root[j[order]], return_index=True)
            out += [(i, int(x)) for x in j[order[at]]]
            root[np.isin(root, found)] = root[i]
    if unsure:
        rest = np.concatenate(unsure)
        out += [(int(i), int(j)) for i, j in rest[root[rest[:, 0]] != root[rest[:, 1]]]]
    return out


def _near_within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forests of the chunks; rows (gid, chunk, node, comp, n, sketch, failed) sorted by gid, chunk and node."""

    def pairs(columns: list[list]) -> list[tuple[int, int]]:
        node, comp, n = (np.array(columns[i], dtype=np.int64) for i in (2, 3, 4))
        failed = [None if f is None else np.array(f, dtype=np.int64) for f in columns[6]]
        return [(min(a, b), max(a, b)) for a, b in ((int(node[i]), int(node[j])) for i, j in forest(node, comp, n, folded(columns[5]), failed))]

    told: set[tuple[int, int]] = set()
    held: list[list] = []

    def answer(found: list[tuple[int, int]]) -> pa.RecordBatch:
        fresh = [p for p in dict.fromkeys(found) if p not in told]
        if len(told) > 1_000_000:
            told.clear()
        told.update(fresh)
        return pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in fresh], pa.int64()), "b": pa.array([p[1] for p in fresh], pa.int64())})

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("gid", "chunk", "node", "comp", "n", "sketch", "failed")]
        key = np.array([columns[0], columns[1]], dtype=np.int64)
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        found = []
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            part = [c[a:b] for c in columns]
            if held and (held[0][0], held[1][0]) == (part[0][0], part[1][0]):
                held = [x + y for x, y in zip(held, part)]
            else:
                if held:
                    found += pairs(held)
                held = part
        yield answer(found)
    if held:
        yield answer(pairs(held))


def _candidates(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) from members (gid, chunk, node, comp, failed)."""
    rows = members.join(nodes.select("node", "n", "sketch"), "node").select("gid", "chunk", "node", "comp", "n", "sketch", "failed")
    return rows.repartition("gid", "chunk").sortWithinPartitions("gid", "chunk", "node").mapInArrow(common.settled(_near_within), "a bigint, b bigint").distinct()


def _placed(members: DataFrame, comps: DataFrame, failed: DataFrame) -> DataFrame:
    """members with their component and the nodes that they are known not to link with (null: none)."""
    both = failed.select(F.col("a").alias("node"), F.col("b").alias("other")).union(failed.select("b", "a"))
    missed = both.groupBy("node").agg(F.collect_list("other").alias("failed"))
    told = members.join(comps.select("node", "comp"), "node", "left").join(missed, "node", "left")
    return told.withColumn("comp", F.coalesce("comp", "node"))


def _compared(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """gid, chunk and node of groups and cells that hold each two nodes that may link together."""
    small = members.where(F.col("size") <= LARGE).select("gid", "chunk", "node")
    large = members.where(F.col("size") > LARGE)
    hot = common.cut(large.groupBy("node").agg(F.sum("keys").alias("hot")).join(nodes.select("node", "n", "spare"), "node").where("hot > spare").select("node", "n"), "hot")
    held = large.select("gid", "node").join(hot.select("node"), "node")
    families = components.components(held.join(held.groupBy("gid").agg(F.min("node").alias("b")), "gid").select(F.col("node").alias("a"), "b"))
    placed = families.join(hot, "node").select("node", F.col("comp").alias("family"), F.floor(F.log("n") / math.log(STEP)).alias("band"))
    count = placed.groupBy("family", "band").agg(F.ceil(F.count("*") / CELL).alias("own"))
    for name, step in (("above", 1), ("below", -1)):
        placed = placed.join(count.select("family", (F.col("band") - step).alias("band"), F.col("own").alias(name)), ["family", "band"], "left")
    placed = placed.join(count, ["family", "band"]).withColumn("at", F.pmod(F.xxhash64("node"), F.col("own")))

    def cells(sides: str, of) -> Column:  # noqa: ANN001
        return F.when(F.coalesce(sides, F.lit(0)) > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), F.col(sides) - 1), lambda j: F.xxhash64("family", *of(j)))).otherwise(F.array().cast("array<bigint>"))

    band, at = F.col("band"), F.col("at")
    every = F.concat(
        cells("own", lambda j: (band, F.least(at, j), band, F.greatest(at, j))),
        cells("above", lambda j: (band, at, band + 1, j)),
        cells("below", lambda j: (band - 1, j, band, at)),
    )
    told = small.join(families.withColumnRenamed("comp", "family"), "node", "left").withColumn("family", F.coalesce("family", "node"))
    mixed = told.groupBy("gid").agg(F.min("family").alias("low"), F.max("family").alias("high")).where("low != high").select("gid")
    cells_of = placed.select(F.explode(every).alias("gid"), F.lit(0).cast("bigint").alias("chunk"), "node")
    out = common.cut(small.join(mixed, "gid", "left_semi").unionByName(cells_of), "compared")
    common.drop(hot, families)
    return out


def _again(members: DataFrame, comps: DataFrame, failed: DataFrame, last: DataFrame) -> DataFrame:
    """Members of the groups and cells that have to go round again.

    failed: all pairs (a, b) that did not link; last: those of the last round, of which a forest may have made use.
    """
    small = members.select("gid", "chunk", "node")
    one = small.join(last, small["node"] == last["a"]).select(F.col("gid").alias("of"), "b")
    held = small.join(one, (small["gid"] == one["of"]) & (small["node"] == one["b"]), "left_semi").select(F.col("gid").alias("of")).distinct()
    return _placed(small.join(held, small["gid"] == held["of"], "left_semi"), comps, failed).select("gid", "chunk", "node", "comp", "failed")


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, th, node and n of each row, and node and least (known, doc_id and th of the first row) of its component."""
    parts = common.parts_of(docs, "text", PART_BYTES)
    met = common.cut(_sketched(docs, parts).repartitionById(parts, F.col("part")).mapInArrow(common.settled(_met), _MET), "met")
    rows = met.where("kind = 0").select("doc_id", "th", "node", "n")
    row = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "th")
    nodes = common.cut(met.where("kind = 0 and node is not null").groupBy("node").agg(F.min(row).alias("rep"), F.max("n").alias("n"), F.max("spare").alias("spare"), F.max("sketch").alias("sketch")), "nodes")
    groups = met.where("kind = 1").groupBy("gid", "chunk").agg(F.first("size").alias("size"), F.sum("keys").alias("keys"), F.first("members").alias("members"))
    members = common.cut(groups.select("gid", "chunk", "size", "keys", F.explode("members").alias("node")), "members")
    compared = _compared(members, nodes) if members.where(F.col("size") > LARGE).limit(1).count() else members
    none = F.lit(None).cast("array<bigint>")
    # first each node in its largest group alone: that joins most of what links, with no more pairs than nodes
    own = members.groupBy("node").agg(F.max(F.struct("size", "gid", "chunk")).alias("g")).select("g.gid", "g.chunk", "node", F.col("node").alias("comp"), none.alias("failed"))
    pairs = common.cut(_candidates(own, nodes), "pairs")
    checked, comps, whole = [], None, False
    while True:
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        sets = common.cut(_sets(docs, nodes.select("node", "rep").join(ends, "node")), "sets")
        checked.append(common.cut(_verified(pairs, sets), "checked"))
        common.drop(sets, pairs, *[] if comps is None else [comps])
        every = checked[0]
        for more in checked[1:]:
            every = every.union(more)
        comps = components.components(every.where("linked"))
        failed, last = (x.where("not linked").select("a", "b") for x in (every, checked[-1]))
        if not whole:
            whole = True
            pairs = common.cut(_candidates(_placed(compared, comps, failed).select("gid", "chunk", "node", "comp", "failed"), nodes), "pairs")
            if pairs.limit(1).count() == 0:
                break
            continue
        of = comps.select("node", "comp")
        last = last.join(of.withColumnsRenamed({"node": "a", "comp": "ca"}), "a", "left").join(of.withColumnsRenamed({"node": "b", "comp": "cb"}), "b", "left")
        last = common.cut(last.where("coalesce(ca, a) != coalesce(cb, b)").select("a", "b"), "apart")
        n = last.count()
        if n == 0:
            common.drop(last)
            break
        pairs = common.cut(_candidates(_again(compared, comps, failed, F.broadcast(last) if n <= BROADCAST_ROWS else last), nodes), "pairs")
        common.drop(last)
        if pairs.limit(1).count() == 0:
            break
    placed = nodes.select("node", "rep").join(comps.select("node", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    lowest = placed.groupBy("comp").agg(F.min("rep").alias("least"))
    rows = common.cut(rows, "rows")
    of_node = common.cut(placed.join(lowest, "comp").select("node", "least"), "components")
    common.drop(pairs, comps, members, compared, nodes, met, *checked)
    return rows, of_node


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id that links reach) of each row of docs."""
    rows, of_node = _grouped(docs)
    out = rows.join(of_node, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"))
    kept = common.cut(out, "grouped")
    common.drop(rows, of_node)
    return kept


def firsts(docs: DataFrame) -> DataFrame:
    """Rows of docs without near duplicates: of each group the row of the least doc_id (known ones first) and then of the
    least text hash; of rows that repeat it that whose other columns have the least hash. Rows without words all stay.
    """
    rows, of_node = _grouped(docs)
    own = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "th")
    placed = rows.where("node is not null").join(of_node, "node")
    repeated = placed.where(own == F.col("least")).groupBy("doc_id", "th").agg(F.count("*").alias("__times")).where("__times > 1")
    dropped = common.cut(placed.where(own != F.col("least")).select("doc_id", "th", F.lit(0).alias("__times")).distinct().unionByName(repeated.withColumn("__times", F.col("__times").cast("int"))), "dropped")
    common.drop(rows, of_node)
    names = dropped.select(F.col("doc_id").alias("__doc_id"), F.col("th").alias("__th"), "__times")
    if dropped.count() <= BROADCAST_ROWS:
        names = F.broadcast(names)
    told = docs.withColumn("__of", F.xxhash64(F.coalesce("text", F.lit(""))))
    told = told.join(names, (told["__of"] == names["__th"]) & told["doc_id"].eqNullSafe(names["__doc_id"]), "left").where("coalesce(__times, 1) > 0")
    if dropped.where("__times > 0").limit(1).count():
        once = Window.partitionBy("doc_id", "__th").orderBy(F.xxhash64(*docs.columns))
        twice = told.where("__times > 1").withColumn("__turn", F.row_number().over(once)).where("__turn = 1").drop("__turn")
        told = told.where("__times is null").unionByName(twice)
    return told.select(*docs.columns)
