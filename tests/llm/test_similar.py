"""Problems 2 and 6 against brute force on small fixtures."""

import random

import numpy as np
import pyarrow as pa
import pytest

from caseloom.llm import codepoints as C
from caseloom.llm import neardup, overlap
from caseloom.llm import regular as R
from caseloom.llm import shingles as S

SCHEMA = "ref_no bigint, facts string, split string, dataset string, source_id string, a string, t string, v bigint"


def runs(text):
    cp, off = C.from_arrow(pa.array([text], pa.string()))
    cp, off, _ = R.regular(cp, off)
    x = C.to_arrow(*R.without_blanks(cp, off)).to_pylist()[0] or ""
    return {x[i : i + 5] for i in range(len(x) - 4)}


def edit(rng, text, n):
    x = list(text)
    for _ in range(n):
        i = rng.randrange(len(x))
        x[i] = rng.choice(["", chr(rng.randrange(0x4E00, 0x5E00)), x[i] + "某"])
    return "".join(x)


def fixture():
    rng = random.Random(5)
    fresh = lambda n: "".join(chr(rng.randrange(0x4E00, 0x5E00)) for _ in range(n))
    texts = [None, "", "  ", "abc", "短"]
    for _ in range(25):
        base = fresh(rng.randrange(120, 500))
        texts += [base, base, edit(rng, base, rng.randrange(1, len(base) // 40 + 2)), edit(rng, base, len(base) // 25)]
        texts.append(base[: len(base) // 2] if rng.random() < 0.5 else base + fresh(len(base) * 2))
        texts.append(" ".join(base[i : i + 9] for i in range(0, len(base), 9)))
    texts += [fresh(rng.randrange(5, 300)) for _ in range(60)]
    texts.append(fresh(40_000))
    texts.append(texts[-1] + "尾")
    splits = ["train", "dev", "test", None]
    rows = [(i, x, splits[rng.choice((0, 0, 1, 2))] if i % 29 else None, "d", f"s{i % 7}", "x", "y", 1) for i, x in enumerate(texts)]
    rng.shuffle(rows)
    return rows


ROWS = fixture()


def test_overlap(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    got = {tuple(r) for r in overlap.overlapping_pairs(df, "ref_no", "facts", "split").collect()}
    sets = {r[0]: runs(r[1]) for r in ROWS if r[1]}
    part = {r[0]: r[2] for r in ROWS}
    keys = sorted(k for k in sets if sets[k])
    want = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if {part[a], part[b]} in ({"train", "dev"}, {"train", "test"}) and len(sets[a] & sets[b]) >= 0.85 * min(len(sets[a]), len(sets[b])) - 1e-9}
    assert got <= want and len(got) >= 0.97 * len(want)
    links = {r.ref_no: r.n_links for r in overlap.linked_rows(df, "ref_no", "facts", "split").collect()}
    assert {k: n for k, n in links.items() if n} == {k: sum(k in p for p in got) for k in {k for p in got for k in p}} and set(links) == {k for k in keys if part[k]}
    n = {tuple(r)[:3]: r for r in overlap.overlap_counts(df, "ref_no", "facts", "split", ["dataset", "source_id"]).collect()}
    assert sum(r.n_pairs for r in n.values()) == len(got)
    assert sum(r.n_overlapping for r in n.values()) == len({k for p in got for k in p if part[k] != "train"})


def components(keys, linked):
    parent = {k: k for k in keys}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in linked:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    groups = {}
    for k in keys:
        groups.setdefault(root(k), []).append(k)
    return {k: g for g, ks in groups.items() if len(ks) > 1 for k in ks}


def brute_groups(rows, least=0.7):
    sets = {r[0]: runs(r[1]) for r in rows if r[1]}
    keys = sorted(k for k in sets if sets[k])
    linked = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9]
    return components(keys, linked)


def test_groups(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    got = {r.ref_no: r.group_no for r in neardup.groups(df, "ref_no", "facts").collect()}
    assert got == brute_groups(ROWS)


def test_crowded_variants(spark, monkeypatch):
    # Far more near copies than a variant may pair directly: refinement and leaders must still find one group.
    monkeypatch.setattr(neardup, "MOST", 6)
    rng = random.Random(3)
    base = "".join(chr(rng.randrange(0x4E00, 0x5E00)) for _ in range(400))
    rows = [(i, edit(rng, base, 1) if i else base, "train", "d", "s", "", "", 0) for i in range(60)] + [(100 + i, x[1], "train", "d", "s", "", "", 0) for i, x in enumerate(ROWS) if x[1]]
    got = {r.ref_no: r.group_no for r in neardup.groups(spark.createDataFrame(rows, SCHEMA), "ref_no", "facts").collect()}
    assert got == brute_groups(rows)


def test_star_in_a_crowded_variant(spark, monkeypatch):
    # Versions that are linked to the hub alone, whose key is in the middle: a text that matched a leader must still meet the others.
    monkeypatch.setattr(neardup, "MOST", 6)
    monkeypatch.setattr(neardup, "BLOCK", 25, raising=False)
    rng = random.Random(11)
    hub = "".join(chr(rng.randrange(0x4E00, 0x5E00)) for _ in range(400))

    def version():
        x = list(hub)
        for i in rng.sample(range(len(x)), 12):
            x[i] = chr(rng.randrange(0x5E00, 0x6E00))
        return "".join(x)

    rows = [(i, hub if i == 80 else version(), "train", "d", "s", "", "", 0) for i in range(160)]
    want = brute_groups(rows)
    assert len(want) > 150
    got = {r.ref_no: r.group_no for r in neardup.groups(spark.createDataFrame(rows, SCHEMA), "ref_no", "facts").collect()}
    assert got == want


def test_hot_variants_of_one_segment(spark, monkeypatch):
    # Texts that share hot variants of a single segment are compared all the same.
    monkeypatch.setattr(neardup, "MOST", 3)
    rng = random.Random(4)
    hub = [chr(rng.randrange(0x4E00, 0x5E00)) for _ in range(400)]

    def signature(x):
        cp, off = C.from_arrow(pa.array(["".join(x)], pa.string()))
        return S.minhash(*S.runs(cp, off, 5), 28)[0].reshape(7, 4)

    h, ho = S.runs(*(np.array([ord(c) for c in hub], np.uint32), np.array([0, 400])), 5)
    least = [int(np.flatnonzero(S.minhash(h, np.arange(len(h) + 1), 28)[:, j] == S.minhash(h, ho, 28)[0, j])[0]) for j in range(4)]
    free = [i for i in range(400) if not any(at <= i < at + 5 for at in least)]
    of_hub, texts = signature(hub), []
    while len(texts) < 5:
        x = list(hub)
        for i in rng.sample(free, 12):
            x[i] = chr(rng.randrange(0x5E00, 0x6E00))
        same = (signature(x) == of_hub).sum(1)
        if same[0] == 4 and (same[1:] < 3).all() and len(runs("".join(x)) & runs("".join(hub))) >= 0.7 * len(runs("".join(x)) | runs("".join(hub))):
            texts.append(x)
    rows = [(i, "".join(x), "train", "d", "s", "", "", 0) for i, x in enumerate([hub, *texts])]
    want = brute_groups(rows)
    assert len(want) == 6
    got = {r.ref_no: r.group_no for r in neardup.groups(spark.createDataFrame(rows, SCHEMA), "ref_no", "facts").collect()}
    assert got == want


@pytest.mark.parametrize("n", [0, 3])
def test_nothing_to_link(spark, n):
    df = spark.createDataFrame(ROWS[:0] if n == 0 else [(1, None, "train", "d", "s", "", "", 0), (2, "x", "dev", "d", "s", "", "", 0), (3, "ganz anderer Text", None, "d", "s", "", "", 0)], SCHEMA)
    assert neardup.groups(df, "ref_no", "facts").count() == 0
    assert overlap.overlapping_pairs(df, "ref_no", "facts", "split").count() == 0


def test_hot_blocks_are_made_longer(spark, monkeypatch):
    monkeypatch.setattr(overlap, "MOST", 3)
    rng = random.Random(9)
    phrase = "".join(chr(rng.randrange(0x4E00, 0x5E00)) for _ in range(120))
    fresh = lambda n: "".join(chr(rng.randrange(0x4E00, 0x5E00)) for _ in range(n))
    rows = [(i, fresh(200) + phrase + fresh(200), "train" if i % 2 else "dev", "d", "s", "", "", 0) for i in range(40)]
    rows += [(100, rows[1][1] + "甲", "test", "d", "s", "", "", 0)]
    got = {tuple(r) for r in overlap.overlapping_pairs(spark.createDataFrame(rows, SCHEMA), "ref_no", "facts", "split").collect()}
    assert got == {(1, 100)}


def brute_overlaps(rows, least=0.85):
    sets = {r[0]: runs(r[1]) for r in rows}
    train, held = [r[0] for r in rows if r[2] == "train"], [r[0] for r in rows if r[2] in ("dev", "test")]
    return {(min(a, b), max(a, b)) for a in held for b in train if len(sets[a] & sets[b]) >= least * min(len(sets[a]), len(sets[b])) - 1e-9}


def test_hot_blocks_stay_whole(spark, monkeypatch):
    # All blocks hot, and edits between their passages: nothing that follows a passage is the same.
    monkeypatch.setattr(overlap, "MOST", 3)
    monkeypatch.setattr(overlap, "SIDE", 5, raising=False)
    rng = random.Random(21)
    base = "".join(chr(rng.randrange(0x4E00, 0x5E00)) for _ in range(400))
    rows = [(i, edit(rng, base, 5), "train" if i % 2 else "dev", "d", "s", "", "", 0) for i in range(40)]
    want = brute_overlaps(rows)
    assert len(want) > 200
    got = {tuple(r) for r in overlap.overlapping_pairs(spark.createDataFrame(rows, SCHEMA), "ref_no", "facts", "split").collect()}
    assert got == want


def test_evenly_spread_edits(spark):
    # One character in 34 changed: hardly a passage stays whole, though 0.85 of the runs do.
    rng = random.Random(8)
    rows = []
    for i in range(30):
        base = [chr(rng.randrange(0x4E00, 0x5E00)) for _ in range(800)]
        rows.append((2 * i, "".join(base), "train", "d", "s", "", "", 0))
        for at in range(17, 800, 34):
            base[at] = chr(rng.randrange(0x5E00, 0x6E00))
        rows.append((2 * i + 1, "".join(base), "test", "d", "s", "", "", 0))
    want = brute_overlaps(rows)
    assert len(want) == 30
    got = {tuple(r) for r in overlap.overlapping_pairs(spark.createDataFrame(rows, SCHEMA), "ref_no", "facts", "split").collect()}
    assert got <= want and len(got) >= 28, len(got)


def test_run_hashes_and_passages():
    cp, off = C.from_arrow(pa.array(["abcdefg", "", "abcd", "xabcdefg"], pa.string()))
    h, ho = S.runs(cp, off, 5)
    assert ho.tolist() == [0, 3, 3, 3, 7] and h[:3].tolist() == h[4:].tolist()
    d, do = S.distinct(np.array([3, 3, 1, 5, 5], np.uint64), np.array([0, 3, 5]))
    assert d.tolist() == [1, 3, 5] and do.tolist() == [0, 2, 3]
    marks, mo = overlap.passages(h, ho)
    assert (np.diff(mo) > 0).tolist() == [True, False, False, True]
