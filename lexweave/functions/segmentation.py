"""Tails and structural paths of Hangul tokens as kernels over distinct tokens, and their Arrow wrappers.

A token is a core, a residual of catalog suffixes and a chain of particles. All readings of what follows a core are
listed and ranked, none is left out; a token keeps its best few paths.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from . import hangul as H
from . import morphology as M

# Fixed values.
LONGEST_TAIL, UNKNOWN_CORE, MOST_PATHS, LEAST_CORE = 12, 3, 4, 2
BASE = {"": 1.0, "SUFFIX": 0.9, "SUFFIX_WITH_MODIFIER": 0.75, "UNKNOWN": 0.3}
UNGRAMMATICAL, LATIN, A_CHARACTER, FLOOR = 0.7, 0.95, 0.04, 0.05
#: Particles that no name ends with.
SPLITTABLE = frozenset("은 는 이 가 을 를 과 와 의 에 에서 에게 에게서 한테 한테서 께 께서 에선 껜 으로 으로서 으로써 로서 로써 이랑 부터 까지 처럼 만큼 보다 마다 서".split())


class Tail(NamedTuple):
    residual: str
    kind: str  # of the residual: empty, SUFFIX, SUFFIX_WITH_MODIFIER, UNKNOWN
    particles: tuple[str, ...]
    grammatical: bool
    score: float
    governing: str = ""
    identity: str = "SAME"
    relation: str = "IDENTITY"
    latin: str = ""

    def shape(self) -> str:
        if self.latin:
            return "LATIN_TAIL"
        if self.kind == "UNKNOWN":
            return "UNKNOWN_TAIL"
        return {(True, True): "SUFFIX_PARTICLE", (True, False): "SUFFIX", (False, True): "PARTICLE", (False, False): "BARE"}[bool(self.residual), bool(self.particles)]


def _syllables(s: str) -> bool:
    return all("가" <= c <= "힣" for c in s)


def meaning(residual: str, before: str) -> tuple[str, str, str, str]:
    """Kind, governing class, identity and relation of a residual: the rightmost class that names something else governs."""
    if not residual:
        return "", "", "SAME", "IDENTITY"
    kind, _, classes = M.residual(residual, before)
    if kind == "UNKNOWN":
        return kind, "UNKNOWN", "UNKNOWN", "UNKNOWN"
    governing = next((c for c in reversed(classes) if M.READINGS[c][0] == "DISTINCT"), classes[-1])
    return kind, governing, *M.READINGS[governing]


@lru_cache(maxsize=100_000)
def tails(right: str, before: str) -> tuple[Tail, ...]:
    """Every reading of what follows a core, best first; ties: the reading whose particles cannot end a name."""
    right = right[:LONGEST_TAIL]
    if not right:
        return (Tail("", "", (), True, 1.0),)
    out = []
    cuts = [k for k in range(len(right) + 1) if _syllables(right[:k])]
    for k in cuts:
        residual = right[:k]
        told = meaning(residual, before)
        chains = [((), True)] if k == len(right) else H.full_chains(right[k:], residual[-1:] or before)
        out += [Tail(residual, told[0], chain, good, BASE[told[0]] * (1.0 if good else UNGRAMMATICAL), *told[1:]) for chain, good in chains]
    if not out:
        return (Tail(right, "UNKNOWN", (), True, BASE["UNKNOWN"], "UNKNOWN", "UNKNOWN", "UNKNOWN"),)
    return tuple(sorted(out, key=lambda t: (-t.score, not (t.particles and SPLITTABLE.issuperset(t.particles)), len(t.particles))))


@lru_cache(maxsize=100_000)
def paths(token: str, least: int = LEAST_CORE, most: int = MOST_PATHS) -> tuple[tuple[str, Tail, float], ...]:
    """(core, tail, score) of a token's readings, best first and longer cores before shorter ones; the bare one is among them."""
    found = [(token, Tail("", "", (), True, 1.0), 1.0)]
    if _syllables(token):
        for n in range(len(token) - 1, least - 1, -1):
            if len(token) - n > LONGEST_TAIL:
                break
            for t in tails(token[n:], token[n - 1]):
                if t.kind != "UNKNOWN" or (t.particles and n >= UNKNOWN_CORE):
                    found.append((token[:n], t, max(FLOOR, t.score * (1 - A_CHARACTER * (len(token) - n)))))
    elif (end := next((x for x in ("'s", "’s", "es", "s") if token.endswith(x) and len(token) - len(x) >= least), None)) and token not in M.LATIN_TAILS:
        found.append((token[: -len(end)], Tail("", "", (), True, LATIN, latin=end), LATIN))
    found.sort(key=lambda f: (-f[2], -len(f[0])))
    first = {(c, t.shape(), t.particles, t.residual): (c, t, s) for c, t, s in reversed(found)}
    return tuple(sorted(first.values(), key=lambda f: (-f[2], -len(f[0]))))[:most]


_S, _B, _D = StringType(), BooleanType(), DoubleType()
_TAIL = StructType([StructField(n, t) for n, t in zip(Tail._fields, (_S, _S, ArrayType(_S), _B, _D, _S, _S, _S, _S))])
_PATH = StructType([StructField("core", _S), StructField("shape", _S), StructField("tail", _TAIL), StructField("path_score", _D)])


def _row(t: Tail) -> dict:
    return {**t._asdict(), "particles": list(t.particles), "score": round(t.score, 6)}


def _tails(right: pd.Series, before: pd.Series) -> pd.Series:
    return pd.Series([[_row(t) for t in tails(r or "", b or "")] for r, b in zip(right, before)], dtype="object")


def _paths(token: pd.Series) -> pd.Series:
    return pd.Series([[{"core": c, "shape": t.shape(), "tail": _row(t), "path_score": round(s, 6)} for c, t, s in paths(x)] for x in token], dtype="object")


tails_udf, paths_udf = F.pandas_udf(_tails, ArrayType(_TAIL)), F.pandas_udf(_paths, ArrayType(_PATH))


def accepts_particle(run: str) -> bool:
    """Whether some particle is a prefix of a run of characters; what ends a word may not be followed by a syllable."""
    return any(run.startswith(p) and not (p in H.CLOSING and "가" <= run[len(p) : len(p) + 1] <= "힣") for p in H.PARTICLES)


#: Characters on both sides of a token that are kept with it.
AROUND = 40
_TOKEN = re.compile("[가-힣ㄱ-ㆎ0-9A-Za-z]+")


def tokens(text: str) -> list[str]:
    """Runs of letters and digits, in order."""
    return _TOKEN.findall(text)


def token_spans(text: str) -> Iterator[tuple[int, int, str, str]]:
    """start, end, token and around of each run of letters and digits."""
    for m in _TOKEN.finditer(text):
        yield m.start(), m.end(), m[0], text[max(0, m.start() - AROUND) : m.end() + AROUND]


#: Texts of a batch of tokens are read one by one; this many tokens are given on at once, but for single texts with more.
MOST_TOKENS = 1 << 14


def token_batches(batches: Iterator[pa.RecordBatch], most: int = MOST_TOKENS) -> Iterator[pa.RecordBatch]:
    """doc_id, start, end, token and around of the tokens of batches of doc_id and text."""

    def told(batch: pa.RecordBatch, rows: list[int], found: list[tuple]) -> pa.RecordBatch:
        starts, ends, tokens, around = zip(*found)
        own = batch.column("doc_id").take(pa.array(rows, pa.int32()))
        return pa.RecordBatch.from_arrays([own, pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(tokens, pa.string()), pa.array(around, pa.string())], names=["doc_id", "start", "end", "token", "around"])

    for batch in batches:
        texts, rows, found = batch.column("text"), [], []
        for at in range(batch.num_rows):
            for x in token_spans(texts[at].as_py() or ""):
                rows.append(at)
                found.append(x)
                if len(found) >= most:
                    yield told(batch, rows, found)
                    rows, found = [], []
        if found:
            yield told(batch, rows, found)


def distinct_batches(batches: Iterator[pa.RecordBatch], most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """token of batches of text: those of a stretch of texts, each once; a stretch ends with ``most`` different ones."""
    seen: set[str] = set()
    for batch in batches:
        texts = batch.column("text")
        for at in range(batch.num_rows):
            seen.update(_TOKEN.findall(texts[at].as_py() or ""))
            if len(seen) >= most:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string())], names=["token"])
                seen = set()
    if seen:
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string())], names=["token"])
