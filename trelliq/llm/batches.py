"""Arrow batches cut to bounded sizes, whatever the number of rows that the session puts into one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def by_size(batch: pa.RecordBatch, sizes: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose sizes sum to about ``most``, or of one row."""
    lot = (np.cumsum(sizes) - sizes) // most
    cuts = [*np.flatnonzero(np.r_[True, lot[1:] != lot[:-1]]), len(sizes)] if len(sizes) else []
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(int(a), int(b - a))


def by_text(batch: pa.RecordBatch, column: int, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts in a column have about ``most`` bytes."""
    return by_size(batch, pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64), most)
