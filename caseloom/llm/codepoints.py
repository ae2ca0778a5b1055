"""Arrow string columns as flat numpy code-point arrays, and back.

A batch of rows is two arrays: ``cp`` (uint32 code points of all rows, end to
end) and ``off`` (int64 row offsets, one more than rows).  Conversion costs one
codec call a batch, never one a row.  Null rows are empty rows here; callers
keep the validity mask themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Code points; the size of every per-character lookup table.
TABLE = 0x110000


def from_arrow(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, row offsets) of a string column; nulls come out empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    buffers = column.buffers()
    ends = np.frombuffer(buffers[1], np.int64, n + 1, column.offset * 8)
    if ends[-1] == ends[0]:
        return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8, ends[-1] - ends[0], ends[0])
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(cp) == len(data):  # ASCII: bytes are code points
        return cp, ends - ends[0]
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    return cp, before[ends - ends[0]]


def to_arrow(cp: np.ndarray, off: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
    """The string column of a batch; rows where mask is true come out null."""
    data = np.ascontiguousarray(cp, np.uint32).tobytes().decode("utf-32-le").encode("utf-8")
    if len(data) == len(cp):
        ends = np.asarray(off, np.int64)
    else:
        size = np.ones(len(cp), np.int64)
        size += cp >= 0x80
        size += cp >= 0x800
        size += cp >= 0x10000
        before = np.zeros(len(cp) + 1, np.int64)
        np.cumsum(size, out=before[1:])
        ends = before[off]
    out = pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(ends.tobytes()), pa.py_buffer(data))
    if mask is not None and mask.any():
        out = pc.if_else(pa.array(~mask), out, pa.scalar(None, pa.large_string()))
    return out.cast(pa.string())


def rows_of(off: np.ndarray) -> np.ndarray:
    """The row number of every code point."""
    return np.repeat(np.arange(len(off) - 1, dtype=np.int64), np.diff(off))


def take_rows(cp: np.ndarray, off: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The batch of the given rows, in the given order."""
    size = (off[1:] - off[:-1])[rows]
    new = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(size, out=new[1:])
    at = np.arange(new[-1], dtype=np.int64) + np.repeat(off[:-1][rows] - new[:-1], size)
    return cp[at], new


def keep(cp: np.ndarray, off: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The batch with only the wanted code points."""
    before = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(wanted, out=before[1:])
    return cp[wanted], before[off]


def expand(values: np.ndarray, off: np.ndarray, size: np.ndarray, start: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Replaces each position by ``size`` entries of ``flat`` from ``start``.

    Returns the new values, the new row offsets and, for each new value, the
    position it came from.
    """
    before = np.zeros(len(values) + 1, np.int64)
    np.cumsum(size, out=before[1:])
    source = np.repeat(np.arange(len(values), dtype=np.int64), size)
    at = np.arange(before[-1], dtype=np.int64) - before[:-1][source] + start[source]
    return flat[at], before[off], source


def starts_and_ends(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-open bounds of the runs of true."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8) if mask.dtype == bool else mask.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
