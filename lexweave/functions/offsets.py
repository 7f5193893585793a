"""Monotone maps between a text and what it is folded to, as runs, that compose and invert; offsets in three units.

A run says that ``n`` characters from ``out`` on stand for ``width`` characters of the raw text from ``raw`` on: one for
one, or, if it is a block, all of them for all of these. Raw characters in no run were dropped. Runs are in order and few:
a text that a step leaves as it is has one. Steps are kernels over the texts; maps are arrays, and what is done with them
is native. A null text has a null fold.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from . import text as T

RUN = StructType([StructField("out", IntegerType()), StructField("n", IntegerType()), StructField("raw", IntegerType()), StructField("width", IntegerType()), StructField("block", BooleanType())])
_RUNS = "array<struct<out:int,n:int,raw:int,width:int,block:boolean>>"
_FOLDED = StructType([StructField("text", StringType()), StructField("runs", ArrayType(RUN))])
_ASCII = {ord(w): n.lower() for w, n in zip(T.WIDE, T.NARROW)} | {ord(u): c for u, c in zip(T.UPPER, T.LOWER)}


def runs_of(pieces: Iterator[tuple[int, int, str, bool]]) -> tuple[str, list[tuple[int, int, int, int, bool]]]:
    """A folded text and its runs from pieces (raw start, raw end, text, block), in order; equal shifts are joined."""
    parts, runs, out = [], [], 0
    for a, b, s, block in pieces:
        if not s:
            continue
        block = block or len(s) != b - a
        last = runs[-1] if runs else None
        if last and not block and not last[4] and last[2] + last[3] == a and last[0] + last[1] == out:
            runs[-1] = (last[0], last[1] + len(s), last[2], last[3] + b - a, False)
        else:
            runs.append((out, len(s), a, b - a, block))
        parts.append(s)
        out += len(s)
    return "".join(parts), runs


def _combines(ch: str) -> bool:
    return unicodedata.combining(ch) != 0 or 0x1160 <= ord(ch) <= 0x11FF


#: Stretches of ASCII, which no fold joins with what stands before, without their last character, which a mark may follow.
_PLAIN = re.compile(r"[\x00-\x7f]+(?=[\x00-\x7f])")


def _by_stretch(pieces: Callable, fold: Callable[[str], str] = str) -> Callable[[str], Iterator[tuple[int, int, str, bool]]]:
    """The pieces of a text, where each stretch of ASCII is a single one; fold: what becomes of it, character by character."""

    def run(text: str) -> Iterator[tuple[int, int, str, bool]]:
        at = 0
        for m in _PLAIN.finditer(text):
            yield from ((at + a, at + b, s, block) for a, b, s, block in pieces(text[at : m.start()]))
            yield m.start(), m.end(), fold(m[0]), False
            at = m.end()
        yield from ((at + a, at + b, s, block) for a, b, s, block in pieces(text[at:]))

    return run


def composed(text: str) -> Iterator[tuple[int, int, str, bool]]:
    """NFC by segments: a character and the marks and jamo that join it."""
    start = 0
    for at in range(1, len(text) + 1):
        if at == len(text) or not _combines(text[at]):
            own = text[start:at]
            yield start, at, unicodedata.normalize("NFC", own), at - start > 1
            start = at


def _joins(left: str, nxt: str) -> bool:
    """Whether a character belongs to the cluster before it: a mark, or one that NFC composes with the cluster's end."""
    if nxt.isascii() or "가" <= nxt <= "힣":
        return False
    if unicodedata.category(nxt).startswith("M"):
        return True
    pair = unicodedata.normalize("NFC", left)[-1] + unicodedata.normalize("NFC", nxt)
    return unicodedata.normalize("NFC", pair) != pair


def clustered(text: str) -> Iterator[tuple[int, int, str, bool]]:
    """NFC, full width and ASCII case by clusters whose ends are the only places that map back."""
    start = 0
    for at in range(1, len(text) + 1):
        if at == len(text) or not _joins(text[start:at], text[at]):
            folded = unicodedata.normalize("NFC", text[start:at]).translate(_ASCII)
            yield start, at, folded, at - start > 1
            start = at


def by_character(fold: Callable[[str], str]) -> Callable[[str], Iterator[tuple[int, int, str, bool]]]:
    return lambda text: ((i, i + 1, fold(c), False) for i, c in enumerate(text))


def _step(pieces: Callable) -> Callable[[Column | str], Column]:
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if t is None else runs_of(pieces(t)) for t in texts]
        return pd.DataFrame({"text": [r[0] for r in rows], "runs": [r[1] for r in rows]}, dtype="object")

    return F.pandas_udf(run, _FOLDED)


#: Steps: (text, runs) of a column of texts.
nfc, cluster = _step(_by_stretch(composed)), _step(_by_stretch(clustered, lambda s: s.translate(_ASCII)))
width = _step(_by_stretch(by_character(lambda c: T.NARROW[T.WIDE.index(c)] if c in T.WIDE else c)))
nfkc = _step(_by_stretch(by_character(lambda c: unicodedata.normalize("NFKC", c))))
visible = _step(_by_stretch(by_character(lambda c: "" if c in T.ZERO_WIDTH else c)))


def raw_start(runs: Column, at: Column) -> Column:
    """Where the raw text of the character at a folded place starts; null beyond the folded text."""
    r = F.get(F.filter(runs, lambda x: (x["out"] <= at) & (at < x["out"] + x["n"])), F.lit(0))
    return F.when(r["block"], r["raw"]).otherwise(r["raw"] + at - r["out"])


def raw_end(runs: Column, at: Column) -> Column:
    """Where the raw text of the character before a folded place ends; null at the start and beyond the folded text."""
    r = F.get(F.filter(runs, lambda x: (x["out"] < at) & (at <= x["out"] + x["n"])), F.lit(0))
    return F.when(r["block"], r["raw"] + r["width"]).otherwise(r["raw"] + at - r["out"])


def folded_place(runs: Column, raw: Column) -> Column:
    """The inverse: the folded place of the character that a raw place lies in; null where it was dropped or lies beyond."""
    r = F.get(F.filter(runs, lambda x: (x["raw"] <= raw) & (raw < x["raw"] + x["width"])), F.lit(0))
    return F.when(r["block"], r["out"]).otherwise(r["out"] + raw - r["raw"])


def then(first: Column, second: Column) -> Column:
    """The map of two steps one after another: second's places of first's folded text become places of the raw text."""

    def through(b: Column) -> Column:
        low, high = b["raw"], b["raw"] + b["width"]
        near = F.filter(first, lambda a: (a["out"] < high) & (low < a["out"] + a["n"]))

        def part(a: Column) -> Column:
            x, y = F.greatest(a["out"], low), F.least(a["out"] + a["n"], high)
            own = F.when(a["block"], a["raw"]).otherwise(a["raw"] + x - a["out"])
            return F.struct((b["out"] + x - low).alias("out"), (y - x).alias("n"), own.alias("raw"), F.when(a["block"], a["width"]).otherwise(y - x).alias("width"), a["block"].alias("block"))

        start, end = raw_start(first, low), raw_end(first, high)
        whole = F.array(F.struct(b["out"].alias("out"), b["n"].alias("n"), start.alias("raw"), (end - start).alias("width"), F.lit(True).alias("block")))
        return F.when(b["block"], whole).otherwise(F.transform(near, part)).cast(_RUNS)

    return F.flatten(F.transform(second, through))


_UNITS = StructType([StructField("bytes", ArrayType(LongType())), StructField("utf16", ArrayType(LongType()))])


def _tables(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for t in texts:
        codes = np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), dtype="<u4")
        size = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
        rows.append((np.append(0, np.cumsum(size)).astype(np.int64), np.append(0, np.cumsum(1 + (codes > 0xFFFF))).astype(np.int64)))
    return pd.DataFrame({"bytes": [r[0] for r in rows], "utf16": [r[1] for r in rows]})


#: bytes and utf16: the offset of each code point of a text and of its end, in either unit, in one pass.
unit_tables = F.pandas_udf(_tables, _UNITS)
#: Offsets that a batch of unit_rows() holds in either unit, but for single texts that have more.
MOST_OFFSETS = 1 << 18


def unit_batches(batches: Iterator[pa.RecordBatch], most: int = MOST_OFFSETS) -> Iterator[pa.RecordBatch]:
    """key, bytes and utf16 of batches of key and text, which are read text by text and given on by ``most`` offsets."""

    def told(batch: pa.RecordBatch, first: int, sizes: list[int], tables: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ends = pa.array(np.cumsum([0, *sizes]), pa.int32())
        own = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([t[i] for t in tables]))) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([batch.column("key").slice(first, len(sizes)), *own], names=["key", "bytes", "utf16"])

    for batch in batches:
        texts, first, held, sizes, tables = batch.column("text"), 0, 0, [], []
        for at in range(batch.num_rows):
            codes = np.frombuffer((texts[at].as_py() or "").encode("utf-32-le", "surrogatepass"), dtype="<u4")
            table = np.zeros((2, len(codes) + 1), dtype=np.int64)
            np.cumsum(1 + (codes > 0x7F).astype(np.int8) + (codes > 0x7FF) + (codes > 0xFFFF), out=table[0, 1:])
            np.cumsum(1 + (codes > 0xFFFF).astype(np.int8), out=table[1, 1:])
            if sizes and held + len(codes) + 1 > most:
                yield told(batch, first, sizes, tables)
                first, held, sizes, tables = at, 0, [], []
            held += len(codes) + 1
            sizes.append(len(codes) + 1)
            tables.append((table[0], table[1]))
        if sizes:
            yield told(batch, first, sizes, tables)


def unit_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, bytes and utf16 of each row, as unit_tables has them, in batches whose size does not grow with the number of rows."""
    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(unit_batches, f"key {kind}, bytes array<bigint>, utf16 array<bigint>").withColumnRenamed("key", key)


def codepoint(table: Column, at: Column) -> Column:
    """The code point offset of an offset in a unit (unit_tables); null inside a character and beyond the text."""
    place = F.array_position(table, at.cast("bigint"))
    return F.when(place > 0, place - 1)
