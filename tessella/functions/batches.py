"""Arrow batches in slices, so that what a Python worker holds doesn't depend on how Spark cut its batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Rows that a worker turns into Python values at once, and bytes of a slice from which it is halved.
SLICE_ROWS, SLICE_BYTES = 2000, 8 << 20


def sliced(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in order; no slice is empty, and none of several rows is large."""
    for batch in batches:
        waiting = [batch.slice(i, rows) for i in range(0, batch.num_rows, rows)][::-1]
        while waiting:
            piece = waiting.pop()
            if piece.num_rows > 1 and piece.get_total_buffer_size() > size and _bytes(piece) > size:
                half = piece.num_rows // 2
                waiting += [piece.slice(half), piece.slice(0, half)]
            else:
                yield piece


def _bytes(batch: pa.RecordBatch) -> int:
    """Bytes that the rows of a slice take, not the buffers that it shares with its batch."""
    return sum(column.nbytes for column in batch.columns)
