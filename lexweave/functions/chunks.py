"""Kernels over whole texts: chunks of a byte budget, compatibility folding with places, hashed feature vectors."""

from __future__ import annotations

import hashlib
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StringType, StructField, StructType

from . import hangul as H

# Sentence breaks by preference, and how far back from a cut one is sought; quotation marks.
BREAKS, REACH = ("\n\n", "\n", ". ", "다. ", "요. ", "! ", "? "), 200
QUOTES = frozenset("\"'“”‘’「」『』")


def byte_chunks(text: str, budget: int) -> list[tuple[int, int]]:
    """[start, end) of contiguous chunks that reach the budget of bytes, each cut back to a sentence break near its end."""
    ends = np.cumsum([len(c.encode()) for c in text]) if not text.isascii() else np.arange(1, len(text) + 1)
    out, start = [], 0
    while start < len(text):
        spent = int(ends[start - 1]) if start else 0
        end = min(len(text), int(np.searchsorted(ends, spent + budget, side="left")) + 1)
        if end < len(text):
            low = max(start + 1, end - REACH)
            found = next(((at, b) for b in BREAKS if (at := text.rfind(b, low, end)) >= 0), None)
            end = found[0] + len(found[1]) if found else end
        out.append((start, end))
        start = end
    return out


def folded_with_places(text: str) -> tuple[str, list[int]]:
    """NFKC without quotation marks and with single blanks, and the place of the character that each one comes from."""
    each = [(c, i) for i, raw in enumerate(text) for c in unicodedata.normalize("NFKC", raw) if c not in QUOTES]
    kept = [(" " if c.isspace() else c, i) for k, (c, i) in enumerate(each) if not c.isspace() or (k and not each[k - 1][0].isspace())]
    if kept and kept[-1][0] == " ":
        kept.pop()
    return "".join(c for c, _ in kept), [i for _, i in kept]


def hashed_vector(text: str, dim: int = 256) -> np.ndarray:
    """Unit vector of hashed jamo 2-, 3- and 4-grams, shorter grams weighing more."""
    jamo, out = H.jamo_of(text.lower()), np.zeros(dim)
    for n in (2, 3, 4):
        for gram, times in Counter(jamo[i : i + n] for i in range(len(jamo) - n + 1)).items():
            out[int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=8).digest(), "little") % dim] += times / n
    return out / (np.linalg.norm(out) or 1.0)


def _chunks(text: pd.Series, budget: pd.Series) -> pd.Series:
    return pd.Series([[{"start": a, "end": b} for a, b in byte_chunks(t or "", int(n))] for t, n in zip(text, budget)], dtype="object")


def _vectors(text: pd.Series) -> pd.Series:
    return pd.Series([hashed_vector(t or "").astype(np.float32) for t in text], dtype="object")


chunks_udf = F.pandas_udf(_chunks, ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])))
vector_udf = F.pandas_udf(_vectors, ArrayType(FloatType()))


def folded_places(c):  # noqa: ANN001, ANN201
    """(folded, places) of a column, through Arrow."""
    return _folded_udf(c)


def _folded_frame(text: pd.Series) -> pd.DataFrame:
    pairs = [(f, np.array(p, dtype=np.int32)) for f, p in (folded_with_places(t or "") for t in text)]  # a list of numbers takes ten times as much
    return pd.DataFrame({"folded": [p[0] for p in pairs], "places": [p[1] for p in pairs]}, dtype="object")


_folded_udf = F.pandas_udf(_folded_frame, StructType([StructField("folded", StringType()), StructField("places", ArrayType(IntegerType()))]))
