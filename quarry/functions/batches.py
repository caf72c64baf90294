"""Arrow batches in slices of bounded text, for functions that hold several forms of their rows."""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc

SLICE_CHARS = 250_000


def text_slices(batch, column: str, chars: int | None = None):
    """Runs of rows with about ``chars`` bytes of text; a longer text is a run of its own."""
    chars = chars or SLICE_CHARS
    end = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < batch.num_rows:
        z = max(a + 1, int(np.searchsorted(end, (end[a - 1] if a else 0) + chars, side="right")))
        yield batch.slice(a, z - a)
        a = z
