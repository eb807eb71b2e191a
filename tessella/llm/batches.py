"""Arrow batches in slices of bounded size, so that a worker's memory follows bytes, not rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows that actions hand to Python workers at a time.
BATCH = 1000
ROWS, BYTES = 512, 4 << 20


def slices(batch: pa.RecordBatch, *texts: str, rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of at most ``rows`` rows whose text columns hold ``size`` bytes, or one row."""
    n = batch.num_rows
    ends = np.zeros(n + 1, dtype=np.int64)
    for name in texts:
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0)
        ends[1:] += np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(ends, ends[lo] + size, side="right")) - 1
        hi = min(n, lo + rows, max(lo + 1, hi))
        yield batch.slice(lo, hi - lo)
        lo = hi
