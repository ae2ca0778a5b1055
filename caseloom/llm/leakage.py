"""Problem 7: passages of held-out items inside corpus documents.

Method: training suffix arrays.  Each shard (a slice of documents) sorts the
suffixes of its letters, marks and digits; the suffixes of all test items are
sorted once a process.  Equal suffixes are found by bisection between the two
sorted arrays, the shorter one in the longer; every place met is extended to
both sides to its longest verbatim match and located.

The shard's array is sparse: a shared run of ``LEAST`` characters covers a whole
step of ``STEP`` characters followed by ``DEPTH`` more, wherever it starts, so
suffixes at every STEP-th place, sorted by their first DEPTH characters, miss
none.  Shards share nothing; only items go to all of them, in blocks of checked
size, each a pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from caseloom.session import spread

from . import codepoints as C
from . import regular as R
from .batches import slices

#: Characters of a shared run.
LEAST = 60
DEPTH = 30
STEP = LEAST - DEPTH + 1
#: Characters of the items that one pass sends to every worker (60 bytes each, sorted).
BLOCK = 4_000_000
#: Places of documents and items that are compared at once.
PAIRS = 4_000_000

_KINDS: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Which code points are letters, marks or digits."""
    if "alnum" not in _KINDS:
        import unicodedata

        table = np.zeros(C.TABLE, bool)
        for low, high in ((0, 0x3400), (0x4DC0, 0x4E00), (0xA000, 0xAC00), (0xD7A4, 0x2_0000), (0xE_0000, 0xE_0200)):
            table[low:high] = [unicodedata.category(chr(c))[0] in "LMN" for c in range(low, high)]
        for low, high in ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xAC00, 0xD7A4), (0x2_0000, 0x3_2000)):
            table[low:high] = True
        lower = np.arange(C.TABLE, dtype=np.uint32)
        for c in [*range(0x41, 0x5B), *range(0xC0, 0x588), *range(0x10A0, 0x1100), *range(0x13A0, 0x1400), *range(0x1E00, 0x2000), *range(0x2C00, 0x2E00), *range(0xA640, 0xAB70), *range(0x1_0400, 0x1_0580)]:
            one = chr(c).lower()
            if len(one) == 1:
                lower[c] = ord(one)
        _KINDS["alnum"], _KINDS["lower"] = table, lower
    return _KINDS["alnum"]


def plain(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Texts in regular form, only letters, marks and digits, in lower case."""
    wanted = _letters()
    cp, off = C.from_arrow(column)
    cp, off, _ = R.regular(cp, off)
    cp, off = C.keep(cp, off, wanted[cp])
    return _KINDS["lower"][cp], off


class Items:
    """The test items as one text, with all their suffixes in order.

    Characters are numbered by the items' own alphabet, two bytes each (none
    zero: numpy strings end there); a document's suffix with any other
    character meets no item.
    """

    def __init__(self, keys: list, texts: list[str | None]) -> None:
        self.keys = keys
        self.cp, self.off = plain(pa.array(texts, pa.string()))
        n = np.maximum(np.diff(self.off) - LEAST + 1, 0)
        # Suffixes that still have LEAST characters, and those up to STEP later: every place a match may be met at.
        size = np.where(n > 0, np.diff(self.off) - DEPTH + 1, 0)
        start = np.concatenate(([0], np.cumsum(size)))
        at = np.arange(start[-1]) + np.repeat(self.off[:-1] - start[:-1], size)
        letters = np.unique(self.cp)
        if len(letters) > 64_000:
            raise ValueError("items use more than 64,000 characters")
        self.number = np.zeros(C.TABLE, ">u2")
        r = np.arange(len(letters))
        self.number[letters] = (r // 255 + 1) * 256 + r % 255 + 1
        rank = self.ranks(self.cp, at)
        order = np.argsort(rank, kind="stable")
        self.rank, self.at = rank[order], at[order]
        self.item = np.repeat(np.arange(len(size)), size)[order]

    def ranks(self, cp: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The DEPTH characters from each place as byte strings that sort alike."""
        window = self.number[cp[at[:, None] + np.arange(DEPTH)]] if len(at) else np.zeros((0, DEPTH), ">u2")
        return np.ascontiguousarray(window).view(f"S{2 * DEPTH}")[:, 0]


def _extend(a: np.ndarray, i: np.ndarray, low_a: np.ndarray, high_a: np.ndarray, b: np.ndarray, j: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each match reaches to the left of (i, j) and to the right, within the bounds of its texts."""
    out = []
    for sign in (-1, 1):
        room = np.minimum(i - low_a, j - low_b) if sign < 0 else np.minimum(high_a - i, high_b - j)
        reach = np.zeros(len(i), np.int64)
        live = np.flatnonzero(room > 0)
        while len(live):
            x = i[live] + sign * reach[live] - (sign < 0)
            y = j[live] + sign * reach[live] - (sign < 0)
            same = a[x] == b[y]
            live = live[same]
            reach[live] += 1
            live = live[reach[live] < room[live]]
        out.append(reach)
    return out[0], out[1]


def search(items: Items, cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document row, item row, match length, place of the match in the plain document), longest match of each pair."""
    none = np.zeros(0, np.int64)
    n = np.where(np.diff(off) >= LEAST, (np.diff(off) - DEPTH) // STEP + 1, 0)
    if n.sum() == 0 or not len(items.at):
        return none, none, none, none
    start = np.concatenate(([0], np.cumsum(n)))
    at = (np.arange(start[-1]) - np.repeat(start[:-1], n)) * STEP + np.repeat(off[:-1], n)
    foreign = np.concatenate(([0], np.cumsum(items.number[cp] == 0)))
    at = at[foreign[at + DEPTH] == foreign[at]]
    key = items.ranks(cp, at)
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    if len(key) <= len(items.rank):
        low, high = (np.searchsorted(items.rank, key, side) for side in ("left", "right"))
    else:
        # The other way round: each item suffix among the shard's, turned into bounds of item suffixes for each of those.
        left, right = (np.searchsorted(key, items.rank, side) for side in ("left", "right"))
        low, high = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        met = np.flatnonzero(right > left)
        new = np.concatenate(([True], left[met][1:] != left[met][:-1])) if len(met) else np.zeros(0, bool)
        begin, end = met[new], met[np.concatenate((new[1:], [True]))] + 1 if len(met) else met
        size = (right - left)[begin]
        where = np.arange(size.sum()) + np.repeat(left[begin] - np.concatenate(([0], np.cumsum(size)))[:-1], size)
        low[where], high[where] = np.repeat(begin, size), np.repeat(end, size)
    hit = np.flatnonzero(high > low)
    at, low, count = at[hit], low[hit], (high - low)[hit]
    best: list[tuple[np.ndarray, ...]] = []
    bounds = np.concatenate(([0], np.cumsum(count)))
    done = 0
    while done < len(hit):
        # As many places as give PAIRS pairs; repetitive texts can give more than fit at once.
        stop = max(done + 1, int(np.searchsorted(bounds, bounds[done] + PAIRS, side="right")) - 1)
        part = slice(done, stop)
        which = np.arange(bounds[stop] - bounds[done]) - np.repeat(bounds[part] - bounds[done], count[part]) + np.repeat(low[part], count[part])
        best.append(_longest(items, cp, off, np.repeat(at[part], count[part]), items.at[which], items.item[which]))
        done = stop
    if not best:
        return none, none, none, none
    return _first_of_each(*(np.concatenate(x) for x in zip(*best)))


def _first_of_each(doc: np.ndarray, item: np.ndarray, length: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The longest match of each document and item, the earliest among equals."""
    order = np.lexsort((begin, -length, item, doc))
    doc, item, length, begin = doc[order], item[order], length[order], begin[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
    return doc[first], item[first], length[first], begin[first]


def _longest(items: Items, cp: np.ndarray, off: np.ndarray, i: np.ndarray, j: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The longest match of LEAST or more of each document and item among places that are met (i in the documents, j in the items)."""
    doc = np.searchsorted(off, i, side="right") - 1
    # Neighbours on a diagonal extend to the same match if the one character between them agrees too: one of them is enough.
    order = np.lexsort((i, i - j, item, doc))
    doc, item, i, j = doc[order], item[order], i[order], j[order]
    needed = np.ones(len(i), bool)
    needed[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (np.diff(i - j) != 0) | (np.diff(i) != STEP) | (cp[i[1:] - 1] != items.cp[j[1:] - 1])
    doc, item, i, j = doc[needed], item[needed], i[needed], j[needed]
    left, right = _extend(cp, i, off[:-1][doc], off[1:][doc], items.cp, j, items.off[:-1][item], items.off[1:][item])
    length = left + right
    good = length >= LEAST
    return _first_of_each(doc[good], item[good], length[good], (i - left - off[:-1][doc])[good])


def leaks(documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """(key, item_key, match_length, match_start) of every document and item that share a run of LEAST characters.

    Runs are of letters, marks and digits in regular form and lower case;
    match_start counts such characters.  Null, empty and short texts share none.
    Items of more than BLOCK characters in all take a pass over the documents
    for each such block.
    """
    sized = items.select(item_key, F.coalesce(F.char_length(item_text), F.lit(0)).alias("__n"))
    total = sized.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    blocks = max(1, -(-total // (BLOCK // 2)))
    out = None
    for block in range(blocks):
        part = items.select(item_key, item_text)
        one = _leaks_of(documents, key, text, part.where(F.pmod(F.xxhash64(item_key), F.lit(blocks)) == block) if blocks > 1 else part, item_key, item_text)
        out = one if out is None else out.unionByName(one)
    return out


def _leaks_of(documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """``leaks`` of one block of items, which is sent to every worker."""
    rows = items.collect()  # some BLOCK characters
    sent = documents.sparkSession.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))
    kept: list[Items] = []
    kind = items.schema[item_key].dataType
    out_schema = f"`{key}` {documents.schema[key].dataType.simpleString()}, `{item_key}` {kind.simpleString()}, match_length bigint, match_start bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Items(*sent.value) if not kept else kept[0]
        kept[:] = [found]
        item_keys = pa.array(found.keys, to_arrow_type(kind))
        for whole in batches:
            for batch in slices(whole, text, 12_000_000):
                cp, off = plain(batch.column(text))
                doc, item, length, begin = search(found, cp, off)
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(doc)), item_keys.take(pa.array(item)), pa.array(length), pa.array(begin)], names=[key, item_key, "match_length", "match_start"])

    return spread(documents.select(key, text)).mapInArrow(run, out_schema)


def clean_documents(documents: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The documents that share no run with any item."""
    return documents.join(found.select(key).distinct(), key, "left_anti")


def leaked_items(items: DataFrame, found: DataFrame, item_key: str) -> DataFrame:
    """(item_key, n_documents, longest) of every item, zero where it did not leak."""
    n = found.groupBy(item_key).agg(F.count(F.lit(1)).alias("n_documents"), F.max("match_length").alias("longest"))
    return items.select(item_key).join(n, item_key, "left").select(item_key, F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("longest", F.lit(0)).alias("longest"))
