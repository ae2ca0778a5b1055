"""Exact-copy classes of texts, fingerprints and verification shared by problems 2 and 6."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.session import fits_broadcast, join_unique, spread

from . import codepoints as C
from . import regular as R
from . import shingles as S
from .batches import slices

#: Characters in a run.
RUN = 5


def run_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points, offsets, run hashes, offsets) of texts in regular form without blanks."""
    cp, off = C.from_arrow(column)
    cp, off, _ = R.regular(cp, off)
    cp, off = R.without_blanks(cp, off)
    h, ho = S.runs(cp, off, RUN)
    return cp, off, h, ho


def text_keys(h: np.ndarray, ho: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit key of each row's runs in their order: two texts share it only if they are the same.

    (Two polynomial sums of the run hashes, each run weighted by its place.)
    """
    rows = len(ho) - 1
    out = np.zeros((2, rows), np.uint64)
    full = np.flatnonzero(np.diff(ho) > 0)
    if len(full):
        place = (np.arange(len(h)) - np.repeat(ho[:-1], np.diff(ho))).astype(np.uint64)
        for j, salt in enumerate((0x51ED270B, 0x2545F491)):
            weight = S.mix(place + np.uint64(salt)) | np.uint64(1)
            out[j, full] = np.add.reduceat(h * weight, ho[:-1][full])
    return out[0].view(np.int64), out[1].view(np.int64)


def fingerprints(df: DataFrame, key: str, text: str, schema: str, make: Callable[[np.ndarray, np.ndarray], list[pa.Array]], carry: list[str] | None = None) -> DataFrame:
    """One row for each text with at least one run: key, carried columns, ka, kb (text key) and what ``make`` gives.

    ``schema`` names the columns of ``make``.  Null, blank and too short texts are left out.
    """
    carry = carry or []
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [key, *carry])
    names = [key, *carry, "ka", "kb", *[part.strip().split(" ")[0] for part in schema.split(",")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text):
                _, _, h, ho = run_hashes(batch.column(text))
                full = np.diff(ho) > 0
                if not full.any():
                    continue
                some = pa.array(full)
                ka, kb = text_keys(h, ho)
                lean = np.concatenate(([0], ho[1:][full]))
                arrays = [batch.column(c).filter(some) for c in [key, *carry]]
                arrays += [pa.array(ka[full]), pa.array(kb[full])]
                yield pa.RecordBatch.from_arrays(arrays + make(h, lean), names=names)

    return spread(df.select(key, *carry, text)).mapInArrow(run, f"{kinds}, ka bigint, kb bigint, {schema}")


#: Texts of pairs whose keys may be broadcast (8 bytes each) so that no other text is shuffled.
MOST_BROADCAST = 1_000_000


def verified(pairs: DataFrame, texts: DataFrame, key: str, text: str, measure: str, least: float) -> DataFrame:
    """The pairs (a, b) whose run sets reach ``least``, with the measure.

    ``measure`` is 'jaccard' (shared of the union) or 'containment' (shared of
    the smaller set).  ``texts`` holds each text once under ``key``, ``pairs``
    is a written table.  Only texts of pairs travel as long as their keys are
    few enough to be broadcast; a text with very many pairs isn't shuffled with
    them.  Pairs are compared in Arrow batches.
    """
    side = texts.select(F.col(key).alias("__k"), F.col(text).alias("__t"))
    ids = pairs.select(F.col("a").alias("__k")).unionByName(pairs.select(F.col("b").alias("__k"))).distinct()
    if fits_broadcast(ids, MOST_BROADCAST):
        side = side.join(F.broadcast(ids), "__k", "left_semi")
    both = join_unique(pairs.select("a", "b"), side.select(F.col("__k").alias("a"), F.col("__t").alias("ta")), ["a"])
    both = join_unique(both, side.select(F.col("__k").alias("b"), F.col("__t").alias("tb")), ["b"], counts=pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, ["ta", "tb"], 2_000_000):
                sets = []
                for name in ("ta", "tb"):
                    _, _, h, ho = run_hashes(batch.column(name))
                    sets.append(S.distinct(h, ho))
                (da, oa), (db, ob) = sets
                na, nb = np.diff(oa), np.diff(ob)
                # Shared hashes of each row: those that stand twice in the row's union.
                row = np.concatenate((np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)))
                h = np.concatenate((da, db))
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                twice = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
                common = np.bincount(row[1:][twice], minlength=len(na)) if len(row) else np.zeros(len(na), np.int64)
                whole_set = na + nb - common if measure == "jaccard" else np.minimum(na, nb)
                good = (whole_set > 0) & (common >= least * whole_set - 1e-9)
                score = common / np.maximum(whole_set, 1)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(good)), batch.column("b").filter(pa.array(good)), pa.array(score[good])], names=["a", "b", "score"])

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint, score double")
