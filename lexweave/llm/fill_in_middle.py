r"""Fill-in-middle: texts cut at token bounds into prefix, middle and suffix, written in the order a model trains on.

Tokens are ``[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+``. Their ends are found without a scan by character:
bytes.translate turns the UTF-8 of a text into a string of 0 and 1, which int() reads as one big integer with a bit for
each byte; a bit of a word whose next bit is none is an end; bit_count() is the number of tokens; the k-th end is
found by halving the integer by the count of its lower half; counts of lead bytes below it are code points.

Cuts and forms hang on the seed and doc_id alone, so that a row gets the same ones in every run, and repeated rows of
a doc_id with equal texts get equal outputs. A null doc_id counts as the empty text in the hash; a null text is an
empty text, which has 0 tokens and stays plain, as do texts that hold one of the marks. Other columns of docs are not
looked at. A text is worked on as a whole, in about ten times its size.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
_WORD = bytes(48 if b in b" \t\n\v\f\r" else 49 for b in range(256))
_LEAD = bytes(48 if b & 0xC0 == 0x80 else 49 for b in range(256))


def mask(raw: bytes, classes: bytes) -> int:
    """Bit i is set where ``classes`` gives 1 for byte i."""
    return int(raw[::-1].translate(classes), 2) if raw else 0


def ends(raw: bytes) -> int:
    """Bit i is set where a token ends with byte i; blanks after the last word are a token."""
    if not raw:
        return 0
    words = mask(raw, _WORD)
    return words & ~(words >> 1) | 1 << len(raw) - 1


def select(bits: int, k: int) -> int:
    """The place of the k-th set bit, k from 1 to bit_count()."""
    at, width = 0, bits.bit_length()
    while width > 1:
        half = width >> 1
        low = bits & (1 << half) - 1
        below = low.bit_count()
        if k <= below:
            bits, width = low, half
        else:
            bits, k, at, width = bits >> half, k - below, at + half, width - half
    return at


def after(bits: int, k: int) -> int:
    """Bytes of the first k tokens."""
    return select(bits, k) + 1 if k else 0


def drawn(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers below 2**32 of a row."""
    told = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(told[i : i + 8], 16) for i in range(0, 32, 8)]


def transformed(raw: bytes, doc_id: int | None, seed: int, rate: int, spm_rate: int) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, code points of prefix and middle, and output."""
    bits = ends(raw)
    n = bits.bit_count()
    h = drawn(seed, doc_id)
    if not raw or h[2] % 100 >= rate or any(m in raw for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, raw
    a, b = (after(bits, k) for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    chars = [mask(part, _LEAD).bit_count() for part in (raw[:a], raw[a:b])]
    first, middle, last = raw[:a], raw[a:b], raw[b:]
    if h[3] % 100 < spm_rate:
        return n, "spm", *chars, SUFFIX + last + PREFIX + first + MIDDLE + middle
    return n, "psm", *chars, PREFIX + first + SUFFIX + last + MIDDLE + middle


def restored(output: bytes, form: str) -> bytes:
    """The text that an output was made of; no mark can stand in a part or begin in one and end in another."""
    if form == "plain":
        return output
    one, two = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    at, end = output.index(two), output.rindex(MIDDLE)
    parts = {one: output[len(one) : at], two: output[at + len(two) : end], MIDDLE: output[end + len(MIDDLE) :]}
    return parts[PREFIX] + parts[MIDDLE] + parts[SUFFIX]


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """doc_id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars and output, a row for each row of docs.

    rate: per cent of the texts that are cut; spm_rate: per cent of those that have the suffix first.
    """

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [transformed(t, d, seed, rate, spm_rate) for t, d in zip(common.bytes_of(batch), batch.column("doc_id").to_pylist())]
        n, form, first, middle, out = zip(*rows) if rows else ((), (), (), (), ())
        made = {"n": pa.array(n, pa.int64()), "form": pa.array(form, pa.string()), "prefix_chars": pa.array(first, pa.int64()), "middle_chars": pa.array(middle, pa.int64())}
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | made | {"output": pa.array(out, pa.binary()).cast(pa.string())})

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(common.by_batch(kernel), f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restore(rows: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of rows, which have output and form, and the text that each output was made of."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [restored(o, f) for o, f in zip(common.bytes_of(batch, "__output"), batch.column("__form").to_pylist())]
        return pa.RecordBatch.from_pydict({k: batch.column(f"__{k}") for k in names} | {"text": pa.array(texts, pa.binary()).cast(pa.string())})

    types, names = dict(rows.dtypes), [k for k in keep if k != "text"]
    picked = rows.select(*[rows[k].alias(f"__{k}") for k in dict.fromkeys([*names, "output", "form"])])
    return picked.mapInArrow(common.by_batch(kernel), ", ".join([*[f"`{k}` {types[k]}" for k in names], "text string"]))
