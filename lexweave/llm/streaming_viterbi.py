"""SentencePiece encoding and decoding by a streaming Viterbi pass with bounded memory.

The model's pieces are merged by rank (a BPE model), so the best path is not the one of greatest summed score: it is
the one whose neighbouring pieces could not have merged otherwise. Call a pair (a, b) sound when merging the string
a + b gives just a, b. A segmentation is the model's own exactly when its first piece stands alone and each
neighbouring pair is sound, so each prefix has one last piece and the forward pass keeps one backpointer per
position, as Viterbi does. A piece has at most ``longest`` characters: later pieces start in the last ``longest``
positions, and whenever all backpointer paths from there meet in one boundary, the ids before it are committed and
forgotten. Ids equal the sentencepiece library's. Models of other kinds (unigram, words, characters) are refused.

Many stretches of text run side by side, a lane each, one character a step, and every lane holds a ring of WINDOW
positions. A trie with suffix links tells the pieces that end at a position; the soundness of pairs is worked out from
the merges that made them and held in a table of fixed size. Stretches begin before blanks, which no piece holds after
another character. Where a lane's paths do not meet within the window, its stretch takes the same pass with a window
that grows; so does a stretch of more than LONG characters without such a blank.

Null and empty texts have no ids. Decoding inverts encoding but for U+2581 in the text, which is the blank's own mark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

MARK = "▁"
#: Characters that a stretch has at least, where a text is that long, and at most to share a pass; a lane's ring.
STRETCH, LONG, WINDOW = 256, 4096, 64
#: Steps between two looks for a common boundary.
LOOK = 16
#: Characters, by the number of pieces that hold them, whose moves are in one dense table; bits of the pair table.
DENSE, PAIR_BITS = 128, 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.vocab_size()
        self.text = [model.id_to_piece(i) for i in range(self.size)]
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(self.size)]
        self.ids = {t: i for i, t in enumerate(self.text) if not special[i]}
        self.rank = {t: -model.get_score(i) for t, i in self.ids.items()}
        if any(r != int(r) for r in self.rank.values()) or len(set(self.rank.values())) < 0.9 * len(self.rank):
            raise ValueError(f"{path} does not merge by rank: only BPE models are encoded")
        self.bytes = {int(t[3:5], 16): i for i, t in enumerate(self.text) if model.is_byte(i)}
        raw = [bytes([int(t[3:5], 16)]) if model.is_byte(i) else b"" if special[i] else t.encode() for i, t in enumerate(self.text)]
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.raw_size = np.array([len(r) for r in raw], dtype=np.int64)
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        self.unknown = model.unk_id()
        self.longest = max(map(len, self.ids))
        #: No piece holds a blank's mark after another character, so a text may be cut before such a mark.
        self.cuts = not any(MARK in t.lstrip(MARK) for t in self.ids)
        self.scalar: dict[tuple[int, int], bool] = {}
        self._merges()
        self._trie()
        self.pair_key = np.full(1 << PAIR_BITS, -1, dtype=np.int64)
        self.pair_sound = np.zeros(1 << PAIR_BITS, dtype=bool)

    # ------------------------------------------------------------ merges and sound pairs

    def merged(self, s: str) -> tuple[list[str], int]:
        """The string's pieces by repeated merging, the best rank first, then the leftmost; and the last merge's cut."""
        parts, cut, none = list(s), 0, float("inf")
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (self.rank.get(parts[i] + parts[i + 1], none), i))
            if parts[best] + parts[best + 1] not in self.rank:
                break
            cut = sum(map(len, parts[: best + 1]))
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts, cut

    def _merges(self) -> None:
        """Of each piece: whether merging gives it, its last merge's two parts, its rank; and all pairs that can merge."""
        self.alone, self.left, self.right = np.zeros(self.size, dtype=bool), np.full(self.size, -1, dtype=np.int64), np.full(self.size, -1, dtype=np.int64)
        self.order = np.full(self.size, -1.0)
        joins = {}
        ties: dict[float, int] = {}
        for t in self.ids:
            if len(t) > 1:
                ties[self.rank[t]] = ties.get(self.rank[t], 0) + 1
        odd = np.zeros(self.size, dtype=bool)  # ranks say too little of the order of such merges: those strings are merged
        for t, i in self.ids.items():
            parts, cut = self.merged(t)
            self.alone[i] = parts == [t]
            for c in range(1, len(t)):
                if t[:c] in self.ids and t[c:] in self.ids:
                    joins[self.ids[t[:c]] * self.size + self.ids[t[c:]]] = self.rank[t]
            if len(t) > 1:
                self.order[i] = self.rank[t]
                odd[i] = ties[self.rank[t]] > 1 or not self.alone[i]
                if self.alone[i]:
                    self.left[i], self.right[i] = self.ids[t[:cut]], self.ids[t[cut:]]
        for i in np.argsort(self.order):  # parts come before what they make
            if self.left[i] >= 0:
                odd[i] |= any(odd[p] or self.order[p] >= self.order[i] for p in (self.left[i], self.right[i]))
        self.odd = odd
        self.join_key = np.array(sorted(joins), dtype=np.int64)
        self.join_rank = np.array([joins[k] for k in self.join_key.tolist()])

    def _joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank at which a and b merge; infinite where they don't."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.join_key, key), len(self.join_key) - 1)
        return np.where(self.join_key[at] == key, self.join_rank[at], np.inf)

    def _pair(self, a: int, b: int) -> bool:
        held = self.scalar.get((a, b))
        if held is None:
            if len(self.scalar) > 1_000_000:
                self.scalar.clear()
            x, y = self.text[a], self.text[b]
            self.scalar[a, b] = held = self.merged(x + y)[0] == [x, y]
        return held

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a (-1: none, or a character outside the vocabulary) and b can stand side by side.

        The merges inside a and b are undone from the last one on. Where the pieces that then touch could have merged
        before the merge just undone (a tie goes to the left one), a and b would never have come about.
        """
        out = self.alone[b].copy()
        known = out & (a >= 0)
        for i in np.flatnonzero(known & (self.odd[a] | self.odd[b])).tolist():
            out[i] = self._pair(int(a[i]), int(b[i]))
        at = np.flatnonzero(known & ~(self.odd[a] | self.odd[b]))
        x, y = a[at].astype(np.int64), b[at].astype(np.int64)
        bad = np.isfinite(self._joined(x, y))
        while True:
            out[at[bad]] = False
            x, y, at = x[~bad], y[~bad], at[~bad]
            ahead, behind = self.order[x], self.order[y]
            going = (ahead >= 0) | (behind >= 0)
            if not going.any():
                return out
            x, y, at, ahead, behind = x[going], y[going], at[going], ahead[going], behind[going]
            undo_left = ahead > behind
            x, y = np.where(undo_left, self.right[x], x), np.where(undo_left, y, self.left[y])
            crossing = self._joined(x, y)
            bad = np.where(undo_left, crossing < ahead, crossing <= behind)

    def _sound(self, key: np.ndarray) -> np.ndarray:
        """pairs() of keys (a + 1) * size + b, through the table."""
        slot = ((key.astype(np.uint64) * _SPREAD) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out = self.pair_sound[slot]
        missed = np.flatnonzero(self.pair_key[slot] != key)
        if len(missed):
            new, back = np.unique(key[missed], return_inverse=True)
            held = self.pairs(new // self.size - 1, new % self.size)
            out[missed] = held[back]
            own = ((new.astype(np.uint64) * _SPREAD) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
            own, first = np.unique(own, return_index=True)  # of new pairs in one slot one stays
            self.pair_key[own], self.pair_sound[own] = new[first], held[first]
        return out

    # ------------------------------------------------------------ pieces that end at a position

    def _trie(self) -> None:
        held: dict[str, int] = {}
        for t in self.ids:
            for c in t:
                held[c] = held.get(c, 0) + 1
        self.classes = np.zeros(0x110000, dtype=np.int16)
        for n, c in enumerate(sorted(held, key=lambda c: (-held[c], c)), 1):
            self.classes[ord(c)] = n
        self.width = len(held) + 1
        edges, nodes = {}, [(0, "")]  # node 0 is the root
        for t in sorted(self.ids, key=len):
            at = 0
            for k, c in enumerate(t, 1):
                key = at * self.width + int(self.classes[ord(c)])
                if key not in edges:
                    edges[key] = len(nodes)
                    nodes.append((at, t[:k]))
                at = edges[key]
        n = len(nodes)
        self.fail, self.piece, self.length = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int64), np.ones(n, dtype=np.int64)
        self.link, self.first = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
        self.dense = np.zeros((n, DENSE), dtype=np.int32)
        children: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for key, to in edges.items():
            children[key // self.width].append((key % self.width, to))
        for at in sorted(range(n), key=lambda i: len(nodes[i][1])):
            parent, string = nodes[at]
            if parent:
                c, up = int(self.classes[ord(string[-1])]), int(self.fail[parent])
                while up and up * self.width + c not in edges:
                    up = int(self.fail[up])
                self.fail[at] = edges.get(up * self.width + c, 0)
            self.dense[at] = self.dense[self.fail[at]]
            for c, to in children[at]:
                if c < DENSE:
                    self.dense[at, c] = to
            self.link[at] = self.first[self.fail[at]]
            if string in self.ids:
                self.piece[at], self.length[at], self.first[at] = self.ids[string], len(string), at
            else:
                self.first[at] = self.link[at]
        self.edge_key = np.array(sorted(edges), dtype=np.int64)
        self.edge_to = np.array([edges[k] for k in self.edge_key.tolist()], dtype=np.int32)

    def _moved(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        out = self.dense[state, np.where(c < DENSE, c, 0)]
        rare = np.flatnonzero(c >= DENSE)
        at = state[rare]
        while len(rare):
            key = at.astype(np.int64) * self.width + c[rare]
            near = np.minimum(np.searchsorted(self.edge_key, key), len(self.edge_key) - 1)
            hit = self.edge_key[near] == key
            out[rare[hit]] = self.edge_to[near[hit]]
            left = ~hit & (at > 0)
            rare, at = rare[left], self.fail[at[left]]
        return out

    # ------------------------------------------------------------ the pass

    def lanes(self, classes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, window: int = WINDOW, look: int = LOOK) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Ends and ids (-1: a character outside the vocabulary) of the pieces of stretches, in any order.

        Also the stretches whose paths did not meet within the window, which have none, and the ids that were committed
        before their stretch's end.
        """
        order = np.argsort(-lengths, kind="stable")
        start, length = starts[order], lengths[order]
        count = len(start)
        state = np.zeros(count, dtype=np.int32)
        last = np.zeros((window, count), dtype=np.int64)  # (piece + 1) * size of the piece that ends there
        back = np.zeros((window, count), dtype=np.int64)  # its length
        base = np.zeros(count, dtype=np.int64)
        late = np.zeros(count, dtype=bool)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        early = 0

        def commit(lane: np.ndarray, end: np.ndarray) -> None:
            """Pieces of lanes between what is committed and an end; paths are followed back."""
            stop = base[lane]
            base[lane] = end
            while len(lane):
                row = end % window
                found.append((start[lane] + end, last[row, lane] // self.size - 1))
                end = end - back[row, lane]
                more = end > stop
                lane, end, stop = lane[more], end[more], stop[more]

        k = count
        for i in range(1, int(length[0]) + 1 if count else 1):
            while length[k - 1] < i:
                k -= 1
            state[:k] = now = self._moved(state[:k], classes[start[:k] + (i - 1)])
            node, row = self.first[now], i % window
            todo, reach = None, i - base[:k]
            while True:
                b, size = self.piece[node], self.length[node]
                lane = np.arange(k) if todo is None else todo
                ok = self._sound(last[(i - size) % window, lane] + b)
                ok &= size <= (reach if todo is None else reach[todo])
                outside = node == 0
                ok |= outside
                own = lane[ok]
                last[row, own] = np.where(outside[ok], 0, (b[ok] + 1) * self.size)
                back[row, own] = size[ok]
                if len(own) == len(lane):
                    break
                todo, node = lane[~ok], self.link[node[~ok]]
            if i % look == 0:
                before = len(found)
                self._look(i, k, window, base, late, back, commit)
                early += sum(len(e) for e, _ in found[before:])
            ended = np.arange(np.searchsorted(-length[:k], -i), k)
            if len(ended):
                ended = ended[~late[ended]]
                commit(ended, np.full(len(ended), i))
        wrong = order[late]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), wrong, early
        ends, ids = (np.concatenate(x) for x in zip(*found))
        if len(wrong):  # what they had committed is told anew
            inside = np.zeros(len(classes) + 1, dtype=bool)
            for w in wrong.tolist():
                inside[starts[w] + 1 : starts[w] + lengths[w] + 1] = True
            ends, ids = ends[~inside[ends]], ids[~inside[ends]]
        return ends, ids, wrong, early

    def _look(self, i: int, k: int, window: int, base: np.ndarray, late: np.ndarray, back: np.ndarray, commit) -> None:  # noqa: ANN001
        """Commits the lanes whose live paths meet. A lane's live positions are bits, counted back from i."""
        lane = np.flatnonzero(~late[:k])
        room = i - base[lane]
        live = (np.uint64(1) << np.minimum(room + 1, self.longest).astype(np.uint64)) - np.uint64(1)
        met_lane, met_at = [], []
        while len(lane):
            one = live & (~live + np.uint64(1))
            alone = live == one
            if alone.any():
                met_lane.append(lane[alone])
                met_at.append(i - np.bitwise_count(one[alone] - np.uint64(1)).astype(np.int64))
                lane, live, one = lane[~alone], live[~alone], one[~alone]
                if not len(lane):
                    break
            far = np.bitwise_count(one - np.uint64(1)).astype(np.int64)
            to = far + back[(i - far) % window, lane]
            live = (live ^ one) | (np.uint64(1) << to.astype(np.uint64))
        if met_lane:
            lane, at = np.concatenate(met_lane), np.concatenate(met_at)
            new = at > base[lane]
            commit(lane[new], at[new])
        late[:k] |= i - base[:k] > window - self.longest - LOOK - 1

    def paths(self, s: str, look: int = 128) -> Iterator[list[int]]:
        """Ids of a string by the same pass with a window that grows, a list for each stretch whose end is certain."""
        ids, longest, n = self.ids, self.longest, len(s)
        piece, back, base = [-1], [0], 0  # of positions base, base + 1, ...
        for i in range(1, n + 1):
            for j in range(max(base, i - longest), i):
                b = ids.get(s[j:i], -1)
                if b < 0 and j < i - 1:
                    continue
                a = piece[j - base]
                if b < 0 or (self.alone[b] and (a < 0 or self._pair(a, b))):
                    piece.append(b)
                    back.append(j)
                    break
            if i % look == 0 and i < n:
                live = set(range(max(base, i + 1 - longest), i + 1))
                while len(live) > 1:
                    far = max(live)
                    live.remove(far)
                    live.add(back[far - base])
                if (sure := live.pop()) > base:
                    yield self._walk(s, piece, back, base, sure)
                    piece, back, base = piece[sure - base :], back[sure - base :], sure
        yield self._walk(s, piece, back, base, n)

    def _walk(self, s: str, piece: list[int], back: list[int], base: int, end: int) -> list[int]:
        out: list[list[int]] = []
        while end > base:
            b, start = piece[end - base], back[end - base]
            out.append([b] if b >= 0 else [self.bytes.get(x, self.unknown) for x in s[start:end].encode()])
            end = start
        return [i for ids in reversed(out) for i in ids]

    # ------------------------------------------------------------ texts

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        whole = [MARK + t if t else "" for t in texts]
        joined = "".join(whole).replace(" ", MARK)
        codes = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        if not len(codes):
            return [b""] * len(texts)
        sizes = np.array([len(t) for t in whole], dtype=np.int64)
        begins = np.cumsum(sizes) - sizes
        mark = codes == ord(MARK)
        at = np.flatnonzero(mark & ~np.append(False, mark[:-1])) if self.cuts else np.zeros(0, np.int64)
        owner = np.searchsorted(begins, at, side="right") - 1
        at_block = owner * (1 << 40) + (at - begins[owner]) // STRETCH
        starts = np.union1d(begins[sizes > 0], at[np.append(True, at_block[1:] != at_block[:-1])] if len(at) else at)
        lengths = np.diff(np.append(starts, len(codes)))
        classes = self.classes[codes]
        side = lengths <= LONG
        ends, ids, late, _ = self.lanes(classes, starts[side], lengths[side])
        alone = [(int(starts[side][w]), int(lengths[side][w])) for w in late] + list(zip(starts[~side].tolist(), lengths[~side].tolist()))
        order = np.argsort(ends)
        ends, ids = ends[order], ids[order]
        if len(outside := np.flatnonzero(ids < 0)):
            raws = [joined[e - 1].encode() for e in ends[outside].tolist()]
            times = np.ones(len(ids), dtype=np.int64)
            times[outside] = [len(r) for r in raws]
            ends, ids = np.repeat(ends, times), np.repeat(ids, times)
            ids[ids < 0] = [self.bytes.get(x, self.unknown) for r in raws for x in r]
        if alone:
            more = [(s, np.array([i for part in self.paths(joined[s : s + n]) for i in part], dtype=np.int64)) for s, n in alone]
            at_end = np.concatenate([ends, *[np.full(len(x), s + 1) for s, x in more]])
            order = np.argsort(at_end, kind="stable")
            ends, ids = at_end[order], np.concatenate([ids, *[x for _, x in more]])[order]
        cut = np.searchsorted(ends, np.append(begins, len(codes)), side="right")
        raw = ids.astype("<u4").tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(cut.tolist(), cut[1:].tolist())]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode_all(self, coded: list[bytes]) -> list[str]:
        ids = np.frombuffer(b"".join(coded), dtype="<u4").astype(np.int64)
        size = self.raw_size[ids]
        ends = np.cumsum(size)
        raw = self.raw[np.repeat(self.raw_at[ids] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
        at = np.append(0, ends)[np.cumsum([0, *[len(c) // 4 for c in coded]])].tolist()
        out = [raw[a:b].decode("utf-8", "replace").replace(MARK, " ") for a, b in zip(at, at[1:])]
        return [t[1:] if t[:1] == " " else t for t in out]

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_all([np.asarray(ids).astype("<u4").tobytes()])[0]


_models: dict[str, Pieces] = common.remembered({}, "streaming_viterbi")


def _model(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def encode(docs: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",), restored: bool = False) -> DataFrame:
    """The columns ``keep`` of each row of docs with ids (little-endian unsigned 32-bit) and n_tokens of its text.

    With restored also whether decoding gives the text back (a U+2581 as the blank that it stands for).
    """

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = common.texts_of(batch, "__text")
        ids = _model(model).encode_all(texts)
        out = [batch.column(f"__{k}") for k in keep] + [pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64())]
        if restored:
            out.append(pa.array([a == b.replace(MARK, " ") for a, b in zip(_model(model).decode_all(ids), texts)], pa.bool_()))
        return pa.RecordBatch.from_arrays(out, names=[*keep, "ids", "n_tokens", *["restored"] * restored])

    types = dict(docs.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in keep] + ["ids binary", "n_tokens bigint"] + ["restored boolean"] * restored)
    return docs.select(*[docs[k].alias(f"__{k}") for k in keep if k != "text"], docs["text"].alias("__text")).mapInArrow(common.by_batch(kernel), schema)


def decode(coded: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of coded with the text of its ids."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = _model(model).decode_all([i or b"" for i in batch.column("ids").to_pylist()])
        return pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(texts, pa.string())], names=[*keep, "text"])

    types = dict(coded.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in keep] + ["text string"])
    return coded.select(*dict.fromkeys([*keep, "ids"])).mapInArrow(common.by_batch(kernel), schema)
