"""Arrow batches in slices, so that what a task makes of a batch stays small however large the batch is."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Rows and bytes of a slice, at most; a slice has a row at least.
MOST_ROWS, MOST_BYTES = 1024, 4 << 20


def in_slices(batches: Iterable[pa.RecordBatch], rows: int = MOST_ROWS, size: int = MOST_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in their order, in slices that share their memory; by size as rows of like lengths would be."""
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
