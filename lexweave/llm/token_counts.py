"""Token counts with overlap resynchronisation.

Every text of more than a chunk is encoded in chunks that overlap, with offsets; shorter ones are one chunk. Two
neighbours are spliced at a common token boundary in the overlap that is proven stable: a blank before a non-space, at
which every encoding of a chunk around it has a boundary (no pre-token of a byte-level model goes on there, and added
tokens hold no blank). Where the overlap has no such place it is widened: the left chunk, from its own start, takes in
as much again, at most to the end of the text, and meets the chunks that it reaches. So the counts are the library's for
any text, and what is encoded twice stays in proportion to the text, blanks or none. Chunks of many texts go to the
library in one call. Memory is bounded by a batch of chunks wherever words are bounded.

Null and empty texts: 0 bytes, 0 tokens. Repeated rows are counted each. Other columns are not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Characters of a chunk and of the overlap at first.
CHUNK, OVERLAP = 2048, 128
SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"


def stable(text: str, start: int, end: int) -> Iterator[int]:
    """Places after start and before end - 1 where a blank precedes a non-space."""
    at = text.find(" ", start + 1, end - 1)
    while at >= 0:
        if not text[at + 1].isspace():
            yield at
        at = text.find(" ", at + 1, end - 1)


def _boundary(encoding, at: int) -> int | None:  # noqa: ANN001
    """The number of tokens before a place of the chunk, if one starts just there."""
    token = encoding.char_to_token(at)
    return token if token is not None and encoding.token_to_chars(token)[0] == at else None


def spliced(library, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[list[list[int]]]:  # noqa: ANN001
    """For each text its ids, a list for each chunk."""
    spans = [(i, a, min(len(t), a + chunk + overlap)) for i, t in enumerate(texts) for a in range(0, max(1, len(t) - overlap), chunk)]
    coded = library.encode_batch([texts[i][a:b] for i, a, b in spans], add_special_tokens=False)
    out: list[list[list[int]]] = [[] for _ in texts]
    k = 0
    while k < len(spans):
        i, start, end = spans[k]
        left, first, text = coded[k], 0, texts[i]
        k += 1
        while k < len(spans) and spans[k][0] == i:
            j, met = k, None
            while met is None and j < len(spans) and spans[j][0] == i and spans[j][1] < end:
                right, cut = coded[j], spans[j][1]
                met = next(((a, b) for at in stable(text, cut, min(end, spans[j][2])) if (a := _boundary(left, at - start)) is not None and (b := _boundary(right, at - cut)) is not None and a >= first), None)
                j += 1
            if met is not None:
                out[i].append(left.ids[first : met[0]])
                left, first, start, end, k = right, met[1], cut, spans[j - 1][2], j
                continue
            while k < len(spans) and spans[k][0] == i and spans[k][2] <= end:  # the left chunk holds all of it
                k += 1
            if end < len(text):  # no proven place: the left chunk takes in as much again
                end = min(len(text), start + 2 * (end - start))
                left = library.encode(text[start:end], add_special_tokens=False)
        out[i].append(left.ids[first:] if first else left.ids)
    return out


def counted(library, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:  # noqa: ANN001
    return [sum(map(len, parts)) for parts in spliced(library, texts, chunk, overlap)]


_libraries: dict[str, object] = {}


def _library(path: str):  # noqa: ANN202
    if path not in _libraries:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        if any(" " in t.content for t in library.get_added_tokens_decoder().values()):
            raise ValueError(f"{path} has added tokens with blanks, at which no boundary is proven")
        _libraries[path] = library
    return _libraries[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row of docs, for a byte-level tokenizer."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = counted(_library(tokenizer), common.texts_of(batch), chunk, overlap)
        sizes = [len(b) for b in common.bytes_of(batch)]
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": pa.array(sizes, pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "over_limit": pa.array([c > limit for c in counts], pa.bool_())})

    return docs.select("doc_id", "text").mapInArrow(common.by_batch(kernel, 200), SCHEMA)
