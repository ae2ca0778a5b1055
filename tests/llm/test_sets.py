"""Problems 4, 5, 7, 8 and 9."""

import collections
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from caseloom.llm import leakage, mixing, pieces, sampling, splits, tokens
from caseloom.llm import sentences as S
from caseloom.operators import components


def test_splits(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, "D", f"./S{rng.randrange(40)} " if i % 3 else f"s{rng.randrange(40)}", f"id{i // 2}", rng.choice(["train", "dev", None])) for i in range(400)] + [(1000, None, None, None, "dev"), (1001, "d", None, None, "train")]
    df = spark.createDataFrame(rows, "ref_no bigint, dataset string, source_id string, id string, split string").repartition(6)
    targets = spark.createDataFrame([("train", 0.8), ("dev", 0.1), ("test", 0.1)], "split string, share double")
    got = splits.assign_splits(df, "ref_no", [splits.source_entity(), "id"], targets).collect()
    assert len(got) == len(rows) and {r.new_split for r in got} <= {"train", "dev", "test"}
    by = {r.ref_no: r for r in got}
    form = lambda r: (r[1].lower(), r[2].strip().lower().removeprefix("./")) if r[2] is not None and r[1] else None
    for field in (form, lambda r: r[3]):
        seen = collections.defaultdict(set)
        for r in rows:
            if field(r) is not None:
                seen[field(r)].add((by[r[0]].first_key, by[r[0]].new_split))
        assert all(len(x) == 1 for x in seen.values())
    assert by[1000].first_key != by[1001].first_key
    rounds = []
    monkeypatch.setattr(components, "_large_star", lambda edges, n, f=components._large_star: rounds.append(n) or f(edges, n))
    mixed = {tuple(r)[0] for r in splits.straddling_rows(df, "ref_no", [splits.source_entity()], "split").collect()}
    assert rounds  # through the star steps, though one entity alone would do with a group by
    parts = collections.defaultdict(set)
    for r in rows:
        if form(r) and r[4]:
            parts[form(r)].add(r[4])
    assert mixed == {r[0] for r in rows if form(r) and r[4] and len(parts[form(r)]) > 1}
    report = {r.split: r for r in splits.split_report(spark.createDataFrame(got), targets).collect()}
    assert sum(r.n_rows for r in report.values()) == len(rows)
    assert splits.assign_splits(df.limit(0), "ref_no", ["id"], targets).count() == 0


def test_shares_of_many_sources(spark):
    df = spark.range(20_000).select(F.col("id").alias("ref_no"), F.concat(F.lit("s"), F.col("id") % 4000).alias("s"))
    targets = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "split string, share double")
    share = splits.assign_splits(df, "ref_no", ["s"], targets).where("new_split = 'a'").count() / 20_000
    assert abs(share - 0.75) < 0.03


def test_sample(spark):
    rng = random.Random(4)
    names = ["甲罪", "乙罪", "丙罪", "丁罪"]
    rows = [(i, f"id{i}" if i % 10 else None, rng.choice(["甲", " [甲罪] ", "甲、罪", "甲罪"]) if i % 4 else rng.choice(["乙", "【乙】", "丙罪" if i % 100 == 0 else "乙罪", None, "别的罪"])) for i in range(4000)]
    rows += [(10_000 + i, f"id{i}", rows[i][2]) for i in range(200)]
    df = spark.createDataFrame(rows, "ref_no bigint, id string, charge string")
    targets = spark.createDataFrame([(names[0], 0.5, 5), (names[1], 0.4, 5), (names[2], 0.1, 3), (names[3], 0.0, 2), (None, 0.1, 1)], "charge string, target_share double, min_rows bigint")
    found = sampling.candidates(df, targets, "id", "charge", "ref_no")
    quota = {r.charge: r for r in sampling.quotas(found, targets).collect()}
    n = sum(r.n_rows for r in quota.values())
    assert n == found.count() and quota["甲罪"].wanted == -(-int(0.1 * n) // 2) and quota["丁罪"].deficit == 2
    plan = sampling.quotas(found, targets)
    drawn = sampling.proportional_sample(found, plan, "ref_no")
    assert {r.charge for r in sampling.short_categories(drawn, plan).collect()} == {c for c, r in quota.items() if r.n_rows < r.wanted}
    # The deficits are those of the sample, not of the counts: with a category taken out of the sample it is short.
    assert {r.charge for r in sampling.short_categories(drawn.where("category <> '甲罪'"), plan).collect()} >= {"甲罪"}
    report = {r.charge: r for r in sampling.sample_report(drawn, plan).collect()}
    assert all(report[c].n_drawn == min(q.wanted, q.n_rows) and report[c].deficit == q.deficit for c, q in quota.items())
    for extra in (4.0, -1e9):  # with hopeless oversampling the whole category is taken into the correction
        got = collections.Counter(r.category for r in sampling.proportional_sample(found, plan, "ref_no", extra=extra if extra > 0 else 4.0).collect())
        assert got == {c: min(r.wanted, r.n_rows) for c, r in quota.items() if min(r.wanted, r.n_rows)}
    again = {r.ref_no for r in sampling.proportional_sample(found.repartition(9), plan, "ref_no").collect()}
    assert again == {r.ref_no for r in sampling.proportional_sample(found, plan, "ref_no").collect()}
    assert sampling.proportional_sample(found.limit(0), sampling.quotas(found.limit(0), targets), "ref_no").count() == 0


def longest(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            if x == y:
                new[j] = row[j - 1] + 1
                best = max(best, new[j])
        row = new
    return best


def test_leaks(spark, monkeypatch):
    rng = random.Random(8)
    fresh = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    items = [(i, fresh(rng.randrange(50, 300))) for i in range(20)] + [(50, None), (51, "")]
    docs = [(0, None), (1, ""), (2, "x")]
    for k in range(40):
        _, x = items[rng.randrange(20)]
        size = min(len(x), rng.choice([55, 58, 59, 60, 61, 62, 90, 200]))
        at = rng.randrange(len(x) - size + 1)
        cut = x[at : at + size]
        docs.append((10 + k, fresh(rng.randrange(200)) + ("".join(c.upper() + rng.choice([" ", "", ",\n", "​"]) for c in cut)) + fresh(rng.randrange(200))))
    docs.append((99, fresh(50_000) + items[3][1] + items[4][1]))
    D = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    I = spark.createDataFrame(items, "item_id bigint, text string")
    found = leakage.leaks(D, "doc_id", "text", I, "item_id", "text")
    got = {(r.doc_id, r.item_id): r.match_length for r in found.collect()}
    plain = lambda t: "".join(c for c in (t or "").lower() if c.isalnum())
    want = {}
    for d, x in docs:
        for i, y in items:
            if d != 99 and longest(plain(x), plain(y)) >= 60:
                want[(d, i)] = longest(plain(x), plain(y))
    assert {k: v for k, v in got.items() if k[0] != 99} == want
    assert {i for d, i in got if d == 99} >= {i for i in (3, 4) if len(items[i][1]) >= 60}
    # Several passes over blocks of items, and few places at a time, find the same.
    monkeypatch.setattr(leakage, "BLOCK", 2000)
    again = leakage.leaks(D, "doc_id", "text", I, "item_id", "text")
    assert {(r.doc_id, r.item_id): r.match_length for r in again.collect()} == got
    clean = {r.doc_id for r in leakage.clean_documents(D, found, "doc_id").collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in got}
    assert leakage.leaked_items(I, found, "item_id").count() == len(items)
    assert leakage.leaks(D.limit(0), "doc_id", "text", I, "item_id", "text").count() == 0 and leakage.leaks(D, "doc_id", "text", I.limit(0), "item_id", "text").count() == 0


@pytest.mark.parametrize("pairs", [7, 4_000_000])
def test_repetitive_texts(monkeypatch, pairs):
    # Periodic runs meet at every place; differing characters right between two places part a diagonal.
    monkeypatch.setattr(leakage, "PAIRS", pairs)
    rng = random.Random(6)
    items = ["0" * 150, "ab" * 70, "x" * 59, "".join(rng.choice("ab") for _ in range(200)), "0" * 70 + "q" + "0" * 90]
    docs = ["0" * 400 + "z" + "ab" * 45, "k" + "ab" * 200, items[3][:95] + "Q" + items[3][96:], "0" * 61 + "1" + "0" * 100, "y" + items[3][20:90] + "a" * 40, "0" * 65 + "q" + "0" * 65] * 3
    found = leakage.Items(list(range(len(items))), items)
    for small in (True, False):  # either side may be the shorter one
        some = docs if small else docs * 40
        doc, item, length, _ = leakage.search(found, *leakage.plain(pa.array(some)))
        got = {(int(d), int(i)): int(n) for d, i, n in zip(doc, item, length) if d < len(docs)}
        want = {(d, i): longest(x.lower(), y.lower()) for d, x in enumerate(docs) for i, y in enumerate(items)}
        assert got == {k: n for k, n in want.items() if n >= 60}


def test_mixture(spark):
    rows = [(i, "big" if i % 3 else "mid", 100 + i % 50) for i in range(6000)] + [(10_000 + i, "small", 10) for i in range(50)] + [(20_000, None, 500), (20_001, "other", 500)]
    counted = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.5, 3), ("small", 0.1, 4), ("none", 0.1, 2)], "source string, target_share double, max_repeats bigint")
    plan = mixing.source_plan(counted, targets)
    got = {r.source: r for r in plan.collect()}
    total = sum(r[2] for r in rows)
    assert {s for s, r in got.items() if r.short} == {"small", "none"} and abs(got["big"].wanted - 0.4 * total) < 1e-6
    mix = mixing.replicate(counted, plan, "doc_id")
    shares = {r.source: r for r in mixing.reached_shares(mix, plan).collect()}
    for s in ("big", "mid"):
        assert abs(shares[s].mixed_tokens - got[s].wanted) < 0.06 * got[s].wanted
    assert all(shares[s].most_copies <= got[s].max_repeats for s in shares) and shares["small"].mixed_tokens == 4 * 500 and shares["none"].n_rows == 0
    assert {r.source for r in mixing.short_sources(mix, plan).collect()} == {"small", "none"}
    # Read off the mixture itself: with a copy of "small" left out it isn't used up.
    assert {r.source for r in mixing.short_sources(mix.where("doc_id <> 10000 OR copy < 4"), plan).collect()} == {"none"}
    keys = [tuple(r) for r in mixing.shuffled(mix, "doc_id").select("doc_id", "copy").collect()]
    assert len(set(keys)) == len(keys) and keys != sorted(keys)
    assert mixing.source_plan(counted.limit(0), targets).count() == 4


@pytest.mark.parametrize("mean, cap", [(0.1, 1), (0.9, 1), (1.3, 2), (2.9, 3), (5.0, 6), (900.0, 1000)])
def test_cut_poisson_keeps_its_mean(mean, cap):
    steps = mixing.thresholds(mean, cap)
    assert len(steps) == cap and abs(sum(max(0.0, 1 - x) for x in steps) - mean) < 1e-6
    assert mixing.thresholds(float(cap), cap) == [-1.0] * cap


TEXTS = [
    "Kurz.", "", None,
    "\n\n".join("Absatz %d. " % i + "Ein Satz mit Wörtern, der etwas länger ist. " * 6 for i in range(30)),
    "。".join("经查，第%d号过磅单显示数量为%d千克" % (i, i * 7) for i in range(400)) + "。",
    "x1Y" * 4000, "wort " * 3000, "| A | 1 |\n" * 900, "字" * 5000,
]


def test_cuts_at_headings_and_words():
    model = S.listed_model()
    text = "# A\n" + "Wort " * 150 + "\n# B\n" + "Wort " * 150 + "\n第二章 C\n" + "Wort " * 150
    made = pieces.pieces(text, 200, 0, tokens.path_of(), model)
    assert [text[a : a + 3] for a, *_ in made] == ["# A", "# B", "第二章"] and [m[4] for m in made] == ["section", "section", "end"]
    text = "倉庫の鍵は証人の机に在り" * 200
    made = pieces.pieces(text, 200, 0, tokens.path_of(), model)
    assert {m[4] for m in made} == {"word", "end"} and all(text[a] in "鍵証机在倉" for a, *_ in made)


@pytest.mark.parametrize("limit, overlap", [(200, 0), (200, 30), (1500, 100)])
def test_pieces(spark, limit, overlap):
    rows = [(i, x, "t") for i, x in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, piece string")
    got = collections.defaultdict(list)
    for r in pieces.split_oversized(df, "doc_id", "text", limit, overlap).collect():
        got[r.doc_id].append(r)
    sizes = tokens.count(TEXTS, tokens.path_of())
    assert set(got) == {i for i, n in enumerate(sizes) if n > limit} == {r.doc_id for r in pieces.oversized(df, "doc_id", "text", limit).collect()}
    for i, parts in got.items():
        parts.sort(key=lambda r: r.piece_no)
        assert parts[0].start_pos == 0 and parts[-1].end_pos == len(TEXTS[i]) and [p.piece_no for p in parts] == list(range(1, len(parts) + 1))
        exact = tokens.count([p.piece for p in parts], tokens.path_of())
        assert exact == [p.n_tokens for p in parts] and max(exact) <= limit
        for a, b in zip(parts, parts[1:]):
            assert b.start_pos <= a.end_pos and b.start_pos > a.start_pos and b.end_pos > a.end_pos and b.overlap_chars == a.end_pos - b.start_pos
            if overlap:
                assert b.overlap_chars > 0 and tokens.count([TEXTS[i][b.start_pos : a.end_pos]], tokens.path_of())[0] <= overlap + 2
            else:
                assert b.overlap_chars == 0
        assert "".join(TEXTS[i][max(p.start_pos, q.end_pos if q else 0) : p.end_pos] for p, q in zip(parts, [None, *parts[:-1]])) == TEXTS[i]
    assert {p.cut_at for p in got[3]} <= {"section", "end", "paragraph", "sentence"} and {p.cut_at for p in got[4]} <= {"sentence", "end"}
