"""Problem 6: groups of records that are reworkings of one another.

Method: deletion-variant signatures.  A text's signature is a row of symbols
(minima of its run hashes under 28 hash functions, 32 bits each), cut into
seven segments of four symbols so that similar texts have a segment that
differs in at most one symbol.  Each segment is indexed under its one-wildcard
variants (one symbol left out); equal variants are joined and every candidate
that has enough symbols in common is verified on its whole text.  Symbols stand where a bit would in a plain
similarity hash: at a similarity of 0.70 a 64-bit hash differs in some 12 to 18
bits, too many for segments that differ in one.  Two texts of similarity s meet
in a segment with s^4 + 4 s^3 (1 - s), so a pair at 0.70 is missed with
probability 0.0007, one at 0.80 with 0.000003.

Scale: copies are collapsed first and stand as one text.  Variants are counted
before any pairing (map-side combined), only those that hold two texts or more
are joined, and only variants of up to ``MOST`` texts give pairs.  A variant
held by more texts is dealt out in blocks: each text is linked to its nearest
block mates, which joins a dense group in linear time, and only texts left
outside the variant's main component then meet all of its texts.  So no link
between components is lost, and a family of versions of one text, however
large, isn't compared pair by pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.operators.components import connected_components
from caseloom.session import cut, fits_broadcast, join_unique

from . import shingles as S
from .classes import fingerprints, verified

SEGMENTS, SYMBOLS = 7, 4
#: Texts under one variant that are paired directly.
MOST = 48
#: Texts in one block of a fuller variant, and nearest texts of its block that each is compared with first.
BLOCK = 1024
MATES = 3

#: Symbols of 28 that two texts must have in common to be verified.  At a similarity
#: of 0.70 the number is 19.6 on average and below this once in 5,000 pairs.
AGREE = 11
WORDS = [f"w{i}" for i in range((SEGMENTS * SYMBOLS + 7) // 8)]


def _signature(h: np.ndarray, ho: np.ndarray) -> list[pa.Array]:
    """The symbols, and their lowest bytes packed in words for a quick count of those in common."""
    m = (S.minhash(h, ho, SEGMENTS * SYMBOLS) & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32)), pa.array(m.ravel()))
    bytes_ = np.zeros((len(m), 8 * len(WORDS)), np.uint8)
    bytes_[:, : m.shape[1]] = m & 0xFF
    packed = bytes_.view(np.int64)
    return [lists, *[pa.array(np.ascontiguousarray(packed[:, i])) for i in range(len(WORDS))]]


def _in_common(a: str, b: str):
    """Number of equal symbols of two structs of packed words (the bits of each byte of the difference are folded into one)."""
    differ = F.lit(0)
    for w in WORDS:
        x = F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}"))
        for shift, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift)).bitwiseAND(mask)
        differ = differ + F.bit_count(x)
    return SEGMENTS * SYMBOLS - differ


def _variants(sig: str = "sig"):
    """The one-wildcard variants of all segments as an array of hashes."""
    out = []
    for s in range(SEGMENTS):
        for left_out in range(SYMBOLS):
            rest = [F.col(sig)[s * SYMBOLS + i] for i in range(SYMBOLS) if i != left_out]
            out.append(F.xxhash64(F.lit(s * SYMBOLS + left_out), *rest))
    return F.array(*out)


#: Fuller variants that may be broadcast (8 bytes each).
MOST_BROADCAST = 200_000


def _postings(reps: DataFrame) -> DataFrame:
    """(id, v): each text under its variants."""
    return reps.select("id", F.explode(_variants()).alias("v"))


def _pairs_under(postings: DataFrame, reps: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(pairs of texts under a variant of at most MOST texts that have enough symbols in common, postings of fuller variants).

    Most variants hold one text, so postings travel bare to their counts; the
    packed symbols join the few that are left.
    """
    counts = cut(postings.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "variants")
    left = cut(postings.select("id", "v").join(counts.where(f"n <= {MOST}").select("v"), "v"), "shared")
    some = left.join(reps.select("id", *WORDS), "id").groupBy("v").agg(F.collect_list(F.struct("id", *WORDS)).alias("ts"))
    pairs = some.select(F.posexplode("ts").alias("i", "a"), "ts").select("a", F.explode(F.expr("slice(ts, i + 2, size(ts))")).alias("b"))
    pairs = pairs.where(_in_common("a", "b") >= AGREE).select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).where("a < b")
    crowded = counts.where(f"n > {MOST}")
    if not crowded.limit(1).count():
        return pairs, None
    if fits_broadcast(crowded, MOST_BROADCAST):
        return pairs, postings.join(F.broadcast(crowded.select("v")), "v", "left_semi")
    return pairs, join_unique(postings, crowded.select("v"), ["v"], counts=crowded)


def _common(group: pa.Table, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Symbols that each row of x has in common with each row of y."""
    symbols = np.stack([group.column(w).to_numpy() for w in WORDS], axis=1).view(np.uint8)[:, : SEGMENTS * SYMBOLS].T.copy()
    same = np.zeros((len(x), len(y)), np.uint8)
    for row in symbols:
        same += row[x][:, None] == row[y][None, :]
    return same


def _ordered(a: np.ndarray, b: np.ndarray) -> pa.Table:
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _mates(hot: DataFrame, marks: DataFrame, sizes: DataFrame, salt: int) -> DataFrame:
    """Pairs (a, b) of each text under a hot variant (v, id) with the ``MATES`` that have most in common with it among the texts dealt into one block with it."""
    dealt = join_unique(hot, sizes.select("v", F.ceil(F.col("n") / BLOCK).alias("parts")), ["v"], counts=sizes)
    dealt = dealt.select("v", "id", F.pmod(F.xxhash64(F.lit(salt), "id"), "parts").alias("p")).join(marks, "id")

    def run(group: pa.Table) -> pa.Table:
        ids, every = group.column("id").to_numpy(), np.arange(group.num_rows)
        same = _common(group, every, every)
        same[every, every] = 0
        k = min(MATES, len(ids))
        best = np.argpartition(-same.astype(np.int16), k - 1, axis=1)[:, :k]
        row = np.repeat(every, k)
        good = same[row, best.ravel()] >= AGREE
        return _ordered(ids[row[good]], ids[best.ravel()[good]])

    return dealt.select("v", "p", "id", *WORDS).groupBy("v", "p").applyInArrow(run, "a bigint, b bigint").where("a < b").distinct()


def _across(hot: DataFrame, marks: DataFrame, sizes: DataFrame, labels: DataFrame) -> DataFrame:
    """All pairs (a, b) under a hot variant that have enough in common and aren't in one component (node, component) yet.

    The texts outside a variant's main component meet all texts of the variant,
    both dealt out in blocks; those inside it needn't meet each other.
    """
    named = hot.join(labels.withColumnRenamed("node", "id"), "id", "left").select("v", "id", F.coalesce("component", "id").alias("of"))
    named = cut(named, "named")
    main = named.groupBy("v", "of").agg(F.count(F.lit(1)).alias("c")).groupBy("v").agg(F.max(F.struct("c", "of")).alias("m"))
    plan = sizes.join(main, "v").select("v", "n", F.col("m.of").alias("main"), F.ceil(F.col("n") / BLOCK).alias("parts"), F.ceil((F.col("n") - F.col("m.c")) / BLOCK).alias("outer")).where("outer > 0")
    open_ = join_unique(named, cut(plan, "plan"), ["v"], counts=sizes)
    own = lambda n: F.pmod(F.xxhash64("id"), n)
    spread_over = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    every = open_.select("v", "id", "of", own("parts").alias("p"), spread_over("outer").alias("q"), F.lit(0).alias("side"))
    outside = open_.where("of <> main").select("v", "id", "of", own("outer").alias("q"), spread_over("parts").alias("p"), F.lit(1).alias("side")).select("v", "id", "of", "p", "q", "side")
    dealt = every.unionByName(outside).join(marks, "id")

    def run(group: pa.Table) -> pa.Table:
        ids, of, side = (group.column(c).to_numpy() for c in ("id", "of", "side"))
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = _common(group, x, y)
        a, b = np.nonzero((same >= AGREE) & (of[x][:, None] != of[y][None, :]))
        return _ordered(ids[x[a]], ids[y[b]])

    return dealt.select("v", "p", "q", "side", "id", "of", *WORDS).groupBy("v", "p", "q").applyInArrow(run, "a bigint, b bigint").where("a < b").distinct()


def _linked_in_blocks(hot: DataFrame, found: DataFrame, reps: DataFrame, texts: DataFrame, key: str, text: str, least: float) -> DataFrame:
    """``found`` and what else connects the texts of hot variants.

    First each text's nearest block mates, twice dealt out, which joins what is
    dense in linear time; then whatever stands outside a variant's main
    component meets all of it, so that no link between components is missed.
    """
    sizes = cut(hot.groupBy("v").agg(F.count(F.lit(1)).alias("n")), "sizes")
    marks = reps.select("id", *WORDS)
    found = cut(found, "links")

    def checked(pairs: DataFrame) -> DataFrame:
        return verified(cut(pairs.join(found, ["a", "b"], "left_anti"), "pairs"), texts, key, text, "jaccard", least)

    near = _mates(hot, marks, sizes, 0).unionByName(_mates(hot, marks, sizes, 1)).distinct()
    found = cut(found.unionByName(checked(near)), "links")
    labels = cut(connected_components(found.select(F.col("a").alias("u"), F.col("b").alias("v"))), "labels")
    return found.unionByName(checked(_across(hot, marks, sizes, labels)))


def links(df: DataFrame, key: str, text: str, least: float = 0.70) -> tuple[DataFrame, DataFrame]:
    """(members, links): each row's text class, and the verified links between class representatives.

    A class is all rows with the same text in regular form without blanks, its
    representative the smallest key.  Null, blank and texts of fewer than five
    characters belong to no class.  Links are (a, b, score) with a < b; between
    texts of hot variants there are as many as connect what belongs together.
    """
    marks = cut(fingerprints(df, key, text, "sig array<int>, " + ", ".join(f"{w} bigint" for w in WORDS), _signature), "signatures")
    classes = cut(marks.groupBy("ka", "kb").agg(F.min(key).alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    reps = cut(marks.join(classes.select(F.col("rep").alias(key)), key, "left_semi").select(F.col(key).alias("id"), "sig", *WORDS), "texts")
    pairs, hot = _pairs_under(_postings(reps), reps)
    lean = df.select(key, text)
    found = verified(cut(pairs.distinct(), "pairs"), lean, key, text, "jaccard", least)
    if hot is not None:
        found = _linked_in_blocks(cut(hot.select("v", "id"), "hot"), found, reps, lean, key, text, least)
    members = join_unique(marks.select(key, "ka", "kb"), classes, ["ka", "kb"], counts=classes.withColumnRenamed("copies", "n")).select(key, "rep", "copies")
    return members, found


def groups(df: DataFrame, key: str, text: str, least: float = 0.70) -> DataFrame:
    """(key, group_no) of every row in a group of two or more linked rows; group_no is the smallest key of it."""
    members, found = links(df, key, text, least)
    members = cut(members, "members")
    found = cut(found, "found")
    parts = connected_components(found.select(F.col("a").alias("u"), F.col("b").alias("v")))
    crowded = members.where("copies > 1").groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    linked = join_unique(members, parts.withColumnRenamed("node", "rep"), ["rep"], "left", crowded)
    return linked.where("component IS NOT NULL OR copies > 1").select(key, F.coalesce("component", "rep").alias("group_no"))
