"""Problem 1 on DataFrames: regular forms of text columns, and the values that differ from theirs.

Null, empty and blank text stays as it is and is never a case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from caseloom.session import spread

from . import codepoints as C
from . import regular as R
from .batches import slices


def _nonblank(cp: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows that hold anything but blanks."""
    ink = np.concatenate(([0], np.cumsum(~R.tables().blank[cp])))
    return np.diff(ink[off]) > 0


def regular_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """The frame with the given text columns in regular form; rows and other columns as they were."""
    names = df.columns
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name in columns else f.dataType, True) for f in df.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, columns):
                out = []
                for name in names:
                    column = batch.column(name)
                    if name in columns:
                        cp, off = C.from_arrow(column)
                        ink = _nonblank(cp, off)
                        a, b, changed = R.regular(cp, off)
                        made = C.to_arrow(a, b)
                        column = pc.if_else(pa.array(changed & ink), made, column.cast(pa.string()))
                    out.append(column)
                yield pa.RecordBatch.from_arrays(out, names=names)

    return df.mapInArrow(run, schema)


def irregular_values(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field) of every value that differs from its regular form.

    Null, empty and blank values are no cases; repeated keys count like any row.
    """
    schema = T.StructType([T.StructField(key, df.schema[key].dataType, True), T.StructField("field", T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, columns):
                for name in columns:
                    cp, off = C.from_arrow(batch.column(name))
                    _, _, changed = R.regular(cp, off)
                    hit = pa.array(changed & _nonblank(cp, off))
                    keys = batch.column(key).filter(hit)
                    yield pa.RecordBatch.from_arrays([keys, pa.array([name] * len(keys), pa.string())], names=[key, "field"])

    return spread(df.select(key, *columns)).mapInArrow(run, schema)
