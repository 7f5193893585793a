"""Parts of Arrow batches: what a kernel turns into Python objects or matrices at once does not grow with the batch."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Bytes that a part has at most, but for single rows.
PART_BYTES = 4 << 20


def parts(batches: Iterator[pa.RecordBatch], rows: int = 1024, size: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of batches in order, at most ``rows`` and ``size`` bytes at once; an empty batch gives nothing."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, rows)
            while part.num_rows > 1 and part.nbytes > size:
                part = part.slice(0, part.num_rows // 2)
            at += part.num_rows
            yield part
