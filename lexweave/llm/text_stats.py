r"""Statistics of whole texts, in one pass over Arrow batches.

Words are ``[^\x20\x09-\x0D]+``; lines are cut at \n. Null texts count as empty: all counts are 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

COUNTS = ("n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct", "n_upper", "n_lower", "n_digits", "n_marks", "n_bangs", "n_common", "longest", "n_top", "n_doubled")
SYMBOLS, MARKS, BLANKS = b"#*$%&|<>", b".,;:!?-'\"()", " \t\n\x0b\x0c\r"
#: Frequent function words of English, French, German and Spanish.
COMMON = frozenset("the of and to in a is that it for on was with as be by at are this de la le les et des en un une que qui dans est pour sur au par der die und den von zu das mit sich ist im nicht ein eine als auch el los las y del se por con para su no lo".encode().split())
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))


def _kept(raw: bytes, chars: bytes) -> int:
    return len(raw) - len(raw.translate(None, chars))


def repeated_words(first: np.ndarray) -> int:
    """Words inside 3-word windows that occur twice or more; first: for each word, where its like first stands."""
    n = len(first)
    if n < 4:
        return 0
    if n < 2_000_000:
        windows = (first[:-2] * n + first[1:-1]) * n + first[2:]
    else:
        _, pair = np.unique(first[:-2] * n + first[1:-1], return_inverse=True)
        windows = pair * n + first[2:]
    _, which, count = np.unique(windows, return_inverse=True, return_counts=True)
    again = count[which] > 1
    inside = np.zeros(n, dtype=bool)
    for k in range(3):
        inside[k : n - 2 + k] |= again
    return int(inside.sum())


def of(text: str, raw: bytes) -> tuple[int, ...]:
    """COUNTS of a text and its UTF-8."""
    words = raw.split()
    n = len(words)
    seen: dict[bytes, int] = {}
    first = np.array(list(map(seen.setdefault, words, range(n))), dtype=np.int64)
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    low = list(map(bytes.lower, words))
    return (
        len(text), n, len(text) - sum(map(text.count, BLANKS)), _kept(raw, SYMBOLS), len(lines), len(lines) - len(set(lines)), repeated_words(first),
        len(seen), _kept(raw, _UPPER), _kept(raw, _LOWER), _kept(raw, _DIGITS), _kept(raw, MARKS), raw.count(b"!"), sum(map(COMMON.__contains__, low)),
        max(map(len, words), default=0), int(np.bincount(first).max()) if n else 0, int((first[1:] == first[:-1]).sum()),
    )


def measured(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep`` of docs and COUNTS of its text, as bigint."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [of(t, b) for t, b in zip(common.texts_of(batch, "__text"), common.bytes_of(batch, "__text"))]
        columns = np.array(rows, dtype=np.int64).reshape(len(rows), len(COUNTS))
        return pa.RecordBatch.from_pydict({k: batch.column(f"__{k}") for k in keep} | {f"s_{c}": pa.array(columns[:, i]) for i, c in enumerate(COUNTS)})

    # positional names: a column of docs may be called as a statistic is
    types = dict(docs.dtypes)
    picked = docs.select(*[docs[k].alias(f"__{k}") for k in keep if k != "text"], docs["text"].alias("__text"))
    schema = ", ".join([f"`{k}` {types[k]}" for k in keep] + [f"s_{c} bigint" for c in COUNTS])
    return picked.mapInArrow(common.by_batch(kernel), schema)
