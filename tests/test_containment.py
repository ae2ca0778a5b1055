import os
import random

import numpy as np
import pyarrow as pa

from caseloom.functions import text as X
from caseloom.operators import containment as C
from caseloom.operators import similarity as M


def reworked(seed, n=60):
    """Texts of a few set phrases with reworkings, extracts, copies, shuffled pieces and odd ones."""
    rng = random.Random(seed)
    word = lambda k: "".join(chr(rng.randrange(0x4E00, 0x4F00)) for _ in range(k))
    phrases = [word(30) for _ in range(8)]
    out = []
    for _ in range(n):
        x = "".join(rng.choice(phrases) + word(rng.randrange(3, 40)) for _ in range(rng.randrange(1, 7)))
        y = list(x)
        for _ in range(rng.randrange(1, 6)):
            y[rng.randrange(len(y))] = rng.choice("某𠮷é")
        half = len(x) // 2
        out += [x, "".join(y), x[rng.randrange(10) : len(x) - rng.randrange(10)], x[:half] + word(rng.randrange(200)), x[half:] + x[:half], x + " \n"]
    return list(enumerate([*out, None, "", " ", "短", "甲" * 40, "甲乙丙丁戊" * 20, word(24), word(23)]))


def expected(rows, share=0.85):
    sets, first = {}, {}
    for i, x in rows:
        if f := "".join((x or "").split()):
            first.setdefault(f, i)
    for f, i in first.items():
        sets[i] = {f[k : k + 5] for k in range(max(1, len(f) - 4))}
    out = set()
    for a in sets:
        for b in sets:
            n, least = len(sets[a] & sets[b]), min(len(sets[a]), len(sets[b]))
            if a < b and least >= 20 and 100 * n >= round(100 * share) * least:
                out.add((a, b, n, least))
    return out


def test_pairs_without_run_tables(spark, monkeypatch):
    """All pairs come out though far less is written than the 8 bytes a run that tables of runs take."""
    wrote = []

    def seen(df, *a, **k):
        out = cut(df, *a, **k)
        wrote.append(sum(os.path.getsize(p.removeprefix("file://")) for p in out.inputFiles()))
        return out

    cut = M.cut
    for module in (M, C):
        monkeypatch.setattr(module, "cut", seen)
    rows = reworked(1)
    grams = M.gram_table(spark.createDataFrame(rows, "i bigint, t string").repartition(3), "i", X.without_space("t"))
    want = expected(rows)
    assert {tuple(r) for r in M.containment_pairs(grams).collect()} == want and len(want) > 50
    runs = sum(len(x) for _, x in rows if x)
    assert sum(wrote) < 6 * runs


def test_pairs_whatever_the_classes(spark, monkeypatch):
    rows = reworked(2, 25)
    grams = M.gram_table(spark.createDataFrame(rows, "i bigint, t string"), "i", X.without_space("t")).cache()
    for classes, chunk, share in ((1, 10, 0.85), (13, 500, 0.85), (4, 10**6, 0.6)):
        monkeypatch.setattr(C, "CLASSES", classes)
        monkeypatch.setattr(C, "CHUNK", chunk)
        assert {tuple(r) for r in M.containment_pairs(grams, share).collect()} == expected(rows, share)
    assert M.containment_pairs(grams.where("id < 0")).count() == 0


def test_a_text_of_many_runs():
    rng = random.Random(3)
    long = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(70_000))
    row, h, level, place, n = C.ordered(pa.array([long, "abc", long[:500]]))
    assert list(n) == [len({x[i : i + 5] for i in range(len(x) - 4)}) for x in (long, "abc", long[:500])]
    assert place.max() == n[0] - 1 and set(h[row == 2]) <= set(h[row == 0]) and not level.any()
    t, m, s = C.asked(np.array([20, 60, 140, 1, 70_000]), 0.85)
    assert list(t) == [17, 51, 119, 1, 59_500] and (s > m).all()


def test_large_guard_without_its_runs(spark, monkeypatch):
    """Beyond what may be broadcast no row's runs are exploded; copies and texts on both sides are told by their rows."""
    monkeypatch.setattr(M, "MOST_BROADCAST", 10)
    rows = reworked(4, 30)
    grams = M.gram_table(spark.createDataFrame(rows, "i bigint, t string"), "i", X.without_space("t"))
    found = M.guard_matches(grams.where("id % 3 <> 0"), grams.where("id % 3 = 0"))
    forms = {i: f for i, x in rows if (f := "".join((x or "").split()))}
    runs = {i: {f[k : k + 5] for k in range(max(1, len(f) - 4))} for i, f in forms.items()}
    want = set()
    for a, x in runs.items():
        for b, y in runs.items():
            if a % 3 and b % 3 == 0:
                n, least = len(x & y), min(len(x), len(y))
                if forms[a] == forms[b] or least >= 20 and 100 * n >= 85 * least:
                    want.add((a, b, n, least))
    assert {tuple(r) for r in found.collect()} == want and any(forms[a] == forms[b] for a, b, _, _ in want)
    assert "explode" not in found._jdf.queryExecution().executedPlan().toString()


def bytes_written(monkeypatch, *modules):
    """A list that gets the size of every table that ``cut`` writes for these modules."""
    wrote, cut = [], M.cut

    def seen(df, *a, **k):
        out = cut(df, *a, **k)
        wrote.append(sum(os.path.getsize(p.removeprefix("file://")) for p in out.inputFiles()))
        return out

    for module in modules:
        monkeypatch.setattr(module, "cut", seen)
    return wrote


def test_input_audit_without_run_tables(spark, tmp_path, monkeypatch):
    from caseloom.plans import audits

    wrote = bytes_written(monkeypatch, M, C)
    rows = reworked(5, 40)
    spark.createDataFrame(rows, "ref_no bigint, facts string").write.parquet(f"{tmp_path}/train_references.parquet")
    got = {r.ref_no: (r.copies, r.near_texts, r.review) for r in audits.QUERIES["input_audit"](spark, str(tmp_path)).collect()}
    forms = {i: "".join((x or "").split()) for i, x in rows}
    first = {f: min(i for i, g in forms.items() if g == f) for f in forms.values()}
    near = [x for p in expected(rows) for x in p[:2]]
    want = {}
    for i, f in forms.items():
        copies, n = (list(forms.values()).count(f), near.count(first[f])) if f else (0, 0)
        want[i] = (copies, n, copies > 1 or n > 0)
    assert got == want and sum(wrote) < 6 * sum(len(x) for _, x in rows if x)


def test_greedy_without_run_tables(spark, monkeypatch):
    from pyspark.sql import functions as F

    wrote = bytes_written(monkeypatch, M, C)
    rows = reworked(6, 40)
    near = {frozenset(p[:2]) for p in expected(rows)}
    forms = {i: "".join((x or "").split()) for i, x in rows}
    last = {f: max(i for i, g in forms.items() if g == f) for f in forms.values()}
    first = {f: min(i for i, g in forms.items() if g == f) for f in forms.values()}
    kept = []
    for i, _ in reversed(rows):
        f = forms[i]
        if not f or (i == last[f] and not any(frozenset((first[f], first[forms[k]])) in near for k in kept if forms[k])):
            kept.append(i)
    got = M.greedy_distinct(spark.createDataFrame(rows, "i bigint, t string"), "i", X.without_space("t"), -F.col("i"))
    assert sorted(r.i for r in got.collect()) == sorted(kept)
    assert sum(wrote) < 6 * sum(len(x) for _, x in rows if x)
