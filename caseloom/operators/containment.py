"""Candidate pairs of a containment join over all texts, by a prefix filter in packed postings.

A text A of n distinct runs is contained in B if at most m = n - ceil(threshold n)
of its runs are missing there.  All texts order their runs in one way, the rare
ones first (by counts in a table of slots; any order gives the same pairs, a good
one gives fewer candidates).  Of A's first s = 1.5 m + 1 runs, its head, at most m are
missing in B, so among the classes that run hashes are dealt to there is one in which
no more than its share of m is missing: a pair is a candidate if some class shows that
many of A's head runs in B.  Runs of a head that is at place i in A and j in B leave
i + n_B - j runs in common at most; for each slot the least that a head there asks for
is kept, and B posts only runs that can answer it.  No pair is lost by any of this.

Postings travel in blobs of 8 bytes each, and a class is joined in numpy.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.session import cut

#: Characters in a run, and bits of a run's hash.
RUN, BITS = 5, 47
#: Rows and bytes of a slice; rows must fit the bits above a level and a hash.
SLICE_ROWS, SLICE_BYTES = 4096, 3_000_000
#: Runs of a head, as a multiple of those that may be missing.
HEAD = 1.5
#: Fewest classes; runs of all texts that one more class is for (about a third of them are posted).
CLASSES, CLASS_RUNS = 4, 60_000_000
#: Slots of a part of the tables; the most slots.
PART, MOST_SLOTS = 1 << 16, 1 << 25
#: Posting pairs of a class that are held at once (the pairs of one text stay together).
CHUNK = 3_000_000
#: Unit in which the runs that a slot's heads ask for are kept, rounded down.
UNIT = 8


def run_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit hash) of every run of a column of texts, repeats included; texts shorter than a run have none."""
    texts = column.to_pylist()
    size = np.array([len(x) for x in texts], np.int64)
    v = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(texts), dtype=np.uint64), size)
    k = max(0, len(v) - (RUN - 1))
    h = v[:k].copy()
    for j in range(1, RUN):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += v[j : j + k]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    h ^= h >> np.uint64(31)
    inside = row[:k] == row[len(v) - k :]
    return row[:k][inside], h[inside]


def slices(batch: pa.RecordBatch, columns: list[str], rows: int = SLICE_ROWS, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of bounded rows and text, at least one row each."""
    before = np.concatenate(([0], np.cumsum(sum(pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns))))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, min(low + rows, int(np.searchsorted(before, before[low] + most, side="right")) - 1))
        yield batch.slice(low, high - low)
        low = high


def ordered(column: pa.Array, levels: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(row, hash, level, place in the row's order) of the distinct runs of a slice, and the number of each row's."""
    row, h = run_hashes(column)
    h >>= np.uint64(64 - BITS)
    row <<= np.uint64(BITS + 5)
    row |= h
    if levels is not None:
        row |= levels[(h & np.uint64(len(levels) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(BITS)
    row.sort()
    x = row[np.concatenate((np.ones(min(1, len(row)), bool), row[1:] != row[:-1]))]
    row = (x >> np.uint64(BITS + 5)).astype(np.int64)
    n = np.bincount(row, minlength=len(column))
    place = np.arange(len(x)) - (np.cumsum(n) - n)[row]
    return row, x & np.uint64((1 << BITS) - 1), ((x >> np.uint64(BITS)) & np.uint64(31)).astype(np.uint8), place, n


def asked(n: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(runs that must be shared, runs that may be missing, runs of the head) of texts with n runs."""
    t = np.maximum(1, np.ceil(threshold * n - 1e-9).astype(np.int64))
    return t, n - t, np.minimum(n, (HEAD * (n - t)).astype(np.int64) + 1)


def _table(rows: DataFrame, kind: type, make, merge) -> np.ndarray:
    """A table of slots from one sparse table a task: parts are merged apart and put together on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, part in enumerate(make(batches).reshape(-1, PART)):
            yield pa.RecordBatch.from_pydict({"part": pa.array([r], pa.int32()), "blob": pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())})

    def merged(group: pa.Table) -> pa.Table:
        out = None
        for blob in group.column("blob"):
            part = np.frombuffer(zlib.decompress(blob.as_py()), kind)
            out = part if out is None else merge(out, part)
        return pa.table({"part": group.column("part").slice(0, 1), "blob": pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())})

    found = rows.mapInArrow(run, "part int, blob binary").groupBy("part").applyInArrow(merged, "part int, blob binary").collect()
    return np.concatenate([np.frombuffer(zlib.decompress(r.blob), kind) for r in sorted(found, key=lambda r: r.part)]) if found else np.zeros(PART, kind)


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(65535, a.astype(np.uint32) + b).astype(np.uint16)


def class_pairs(h: np.ndarray, doc: np.ndarray, place: np.ndarray, n: np.ndarray, own: np.ndarray, side: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates (contained text, containing text) of a class, by number of text.

    Postings are (hash, text, place); texts have n runs, ``own`` of their head's
    in this class, and a side if only texts of different sides are to meet.
    """
    t, m, s = asked(n, threshold)
    key = (h.astype(np.uint64) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    key.sort()
    at = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    h = (key >> np.uint64(32)).astype(np.uint32)
    del key
    doc, place = doc[at], place[at]
    start = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), h[1:] != h[:-1])))
    size = np.diff(np.append(start, len(h)))
    first, many = np.repeat(start, size).astype(np.int32), np.repeat(size, size).astype(np.int32)
    head = np.flatnonzero((place < s[doc]) & (many > 1))
    head = head[np.argsort(doc[head], kind="stable")]
    ends = np.cumsum(many[head], dtype=np.int64)
    last = np.flatnonzero(np.concatenate((doc[head][1:] != doc[head][:-1], np.ones(min(1, len(head)), bool)))) + 1  # behind each text's last head posting
    low = 0
    while low < len(head):
        before = ends[low - 1] if low else 0
        high = last[max(int(np.searchsorted(last, np.searchsorted(ends, before + CHUNK, side="right"), side="right")) - 1, int(np.searchsorted(last, low, side="right")))]
        x = head[low:high]
        low = high
        k = many[x].astype(np.int64)
        a = np.repeat(doc[x], k)
        with_ = np.arange(len(a)) + np.repeat(first[x] - (np.cumsum(k) - k), k)
        b = doc[with_]
        good = (np.repeat(n[doc[x]], k) <= n[b]) & (a != b) & (n[b] - place[with_] >= np.repeat(t[doc[x]] - place[x], k))
        if side is not None:
            good &= (side[a] | side[b]) == 3
        met = (a[good].astype(np.uint64) << np.uint64(32)) | b[good].astype(np.uint64)
        met.sort()
        new = np.flatnonzero(np.concatenate((np.ones(min(1, len(met)), bool), met[1:] != met[:-1])))
        shared = np.diff(np.append(new, len(met)))
        a, b = (met[new] >> np.uint64(32)).astype(np.int64), (met[new] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        enough = shared >= own[a] - m[a] * own[a] // s[a]
        yield a[enough], b[enough]


def candidates(texts: DataFrame, threshold: float, least: int) -> DataFrame:
    """(a, b) of texts (id, form and, if only different sides are to meet, side: bits 1 and 2) of which one may hold ``threshold`` of the other's runs.

    Every text stands once; texts with fewer than ``least`` runs take no part.
    """
    spark = texts.sparkSession
    sided = "side" in texts.columns
    rows = texts.where(F.char_length("form") >= least + RUN - 1)
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("form")).alias("chars")).first()
    slots = min(MOST_SLOTS, max(PART, 1 << math.ceil(math.log2(64 * max(1, sizes.n)))))
    classes = max(CLASSES, math.ceil((sizes.chars or 0) / CLASS_RUNS))
    forms = rows.select("form")

    def counts(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(slots, np.uint32)
        for batch in batches:
            for part in slices(batch, ["form"]):
                row, h, _, _, n = ordered(part.column("form"))
                np.add.at(out, (h[n[row] >= least] & np.uint64(slots - 1)).astype(np.int64), 1)
        return np.minimum(out, 65535).astype(np.uint16)

    counted = _table(forms, np.uint16, counts, _added)
    # A slot may count several runs, never too few texts: what is alone in its slot (level 0) meets nothing.
    by_count = np.ceil(1.5 * np.log2(np.maximum(np.arange(65536), 1))).astype(np.uint8)
    level = spark.sparkContext.broadcast(zlib.compress(by_count[counted].tobytes(), 1))

    def heads(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out, levels = np.full(slots, 255, np.uint8), np.frombuffer(zlib.decompress(level.value), np.uint8)
        for batch in batches:
            for part in slices(batch, ["form"]):
                row, h, lv, place, n = ordered(part.column("form"), levels)
                t, _, s = asked(n, threshold)
                x = (place < s[row]) & (lv > 0) & (n[row] >= least)
                np.minimum.at(out, (h[x] & np.uint64(slots - 1)).astype(np.int64), np.minimum(255, np.maximum(0, (t[row] - place)[x]) // UNIT).astype(np.uint8))
        return out

    wanted = spark.sparkContext.broadcast(zlib.compress(_table(forms, np.uint8, heads, np.minimum).tobytes(), 1))
    id_type = texts.schema["id"].dataType.simpleString()

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, want = (np.frombuffer(zlib.decompress(x.value), np.uint8) for x in (level, wanted))
        for batch in batches:
            for part in slices(batch, ["form"]):
                row, h, lv, place, n = ordered(part.column("form"), levels)
                _, _, s = asked(n, threshold)
                group = (h >> np.uint64(32)).astype(np.int64) % classes
                in_head, there = place < s[row], (n[row] >= least) & (lv > 0)
                there &= want[(h & np.uint64(slots - 1)).astype(np.int64)].astype(np.int64) * UNIT <= n[row] - place
                for c in np.unique(group[there]):
                    x = there & (group == c)
                    docs, local = np.unique(row[x], return_inverse=True)
                    own = np.bincount(row[in_head & (group == c)], minlength=len(n))[docs]
                    narrow = np.uint16 if n.max() < 1 << 16 else np.uint32
                    side = part.column("side").to_numpy()[docs] if sided else np.zeros(len(docs), np.int8)
                    blobs = [(h[x] & np.uint64(0xFFFFFFFF)).astype(np.uint32), local.astype(np.uint16), place[x].astype(narrow), n[docs].astype(np.uint32), own.astype(np.uint32), side.astype(np.uint8)]
                    ids = part.column("id").take(pa.array(docs))
                    yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), ids), *[pa.array([x.tobytes()], pa.binary()) for x in blobs]], names=["class", "ids", "h", "doc", "place", "n", "own", "side"])

    def met(group: pa.Table) -> pa.Table:
        rows = group.select(["h", "doc", "place", "n", "own", "side"]).to_pylist()
        of = lambda name, kind: np.concatenate([np.frombuffer(r[name], kind) for r in rows])
        base = np.cumsum([0, *[len(r["n"]) // 4 for r in rows]])
        doc = np.concatenate([np.frombuffer(r["doc"], np.uint16).astype(np.int32) + np.int32(low) for r, low in zip(rows, base)])
        place = np.concatenate([np.frombuffer(r["place"], np.uint16 if len(r["place"]) == len(r["doc"]) else np.uint32).astype(np.int32) for r in rows])
        h, n, own, side = of("h", np.uint32), of("n", np.uint32).astype(np.int64), of("own", np.uint32).astype(np.int64), of("side", np.uint8)
        del rows
        found = list(class_pairs(h, doc, place, n, own, side if sided else None, threshold))
        ids = pc.list_flatten(group.column("ids"))
        take = lambda k: ids.take(pa.array(np.concatenate([np.zeros(0, np.int64), *[x[k] for x in found]])))
        return pa.table({"a": take(0), "b": take(1)})

    schema = f"class int, ids array<{id_type}>, h binary, doc binary, place binary, n binary, own binary, side binary"
    pairs = rows.select("id", "form", *["side"] * sided).mapInArrow(posted, schema).groupBy("class").applyInArrow(met, f"a {id_type}, b {id_type}")
    return cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")


def shared_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, n_shared, n_least) of pairs with both their texts."""
    for batch in batches:
        for part in slices(batch, ["fa", "fb"], most=2 * SLICE_BYTES):
            keys, sizes = [], []
            for name in ("fa", "fb"):
                row, h = run_hashes(part.column(name))
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                once = np.concatenate((np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (row[1:] != row[:-1])))
                keys.append((row[once], h[once]))
                sizes.append(np.bincount(row[once].astype(np.int64), minlength=part.num_rows))
            row, h = (np.concatenate(x) for x in zip(*keys))
            order = np.lexsort((h, row))
            row, h = row[order], h[order]
            twice = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
            common = np.bincount(row[1:][twice].astype(np.int64), minlength=part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(common.astype(np.int64)), pa.array(np.minimum(*sizes).astype(np.int32))], names=["a", "b", "n_shared", "n_least"])
