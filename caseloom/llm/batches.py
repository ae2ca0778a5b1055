"""Arrow batches cut into slices of bounded text, so that a worker's arrays stay small, and points hashed from keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text a slice may hold (one row may exceed it: rows are never cut).
SLICE_BYTES = 3_000_000


def slices(batch: pa.RecordBatch, columns: str | list[str], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch as slices of at most ``most`` bytes of the columns together, at least one row each."""
    n = batch.num_rows
    if n == 0:
        return
    size = np.zeros(n, np.int64)
    for column in [columns] if isinstance(columns, str) else columns:
        size += pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.concatenate(([0], np.cumsum(size)))
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(before, before[low] + most, side="right")) - 1)
        yield batch.slice(low, high - low)
        low = high


def hashed_point(seed: int, *key: Column | str) -> Column:
    """A point in [0, 1) hashed from a key and a seed: 52 bits of an md5, the same in every run and in SQL engines."""
    parts = [F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts, F.lit(str(seed)))), 1, 13), 16, 10).cast("double") / float(1 << 52)
