"""Arrow batches in pieces of bounded size, so that a task holds the results of few rows whatever the texts' length."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text of a piece; a row with more is a piece of its own.
MOST_BYTES = 1 << 20


def pieces(batches: Iterable[pa.RecordBatch], text: str, size: int = 1) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, cut where MOST_BYTES of the column text are full, after multiples of `size` rows."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        held = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < n:
            full = int(np.searchsorted(held, (held[at - 1] if at else 0) + MOST_BYTES, "right"))
            end = min(n, at + max(size, (full - at) // size * size))
            yield batch.slice(at, end - at)
            at = end
