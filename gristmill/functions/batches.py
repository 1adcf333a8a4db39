"""Arrow batches on the executors."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MOST_BYTES = 1 << 20


def parts(batches: Iterable[pa.RecordBatch], text: int, most: int = MOST_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in slices of about ``most`` bytes of the column number ``text``, or one row: what a worker holds of them follows neither the batch nor the table."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // most)) + 1
        for start, end in zip([0, *ends.tolist()], [*ends.tolist(), batch.num_rows], strict=True):
            yield batch.slice(start, end - start)
