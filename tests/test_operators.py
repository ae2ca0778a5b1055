import random

import pytest
from pyspark.sql import functions as F

from caseloom.functions import text as X
from caseloom.operators import annotations as A
from caseloom.operators import cases as K
from caseloom.operators import ledger as L
from caseloom.operators import metrics as E
from caseloom.operators import packaging as G
from caseloom.operators import rules as R
from caseloom.operators import sampling as D
from caseloom.operators import similarity as M
from caseloom.operators.components import connected_components, entity_components, record_components
from caseloom.session import join_unique


def union_find(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("kind", ["random", "path", "star", "copies", "empty"])
def test_components(spark, kind):
    rng = random.Random(1)
    edges = {"random": [(rng.randrange(300), rng.randrange(300)) for _ in range(220)], "path": [(i, i + 1) for i in range(60)], "star": [(0, i) for i in range(1, 200)], "copies": [(1, 2), (2, 1), (1, 2), (3, 3), (None, 4), (5, None)], "empty": []}[kind]
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == union_find([(a, b) for a, b in edges if a is not None and b is not None and a != b])


def test_entity_components(spark):
    rows = [(1, "s1", None), (2, "s1", "f1"), (3, "s2", "f1"), (4, "s3", None), (5, None, None), (6, None, None), (7, None, "f9"), (8, "s3", "f9")]
    df = spark.createDataFrame(rows, "k bigint, s string, f string")
    got = {r.k: r.component for r in entity_components(df, "k", ["s", "f"]).collect()}
    assert got[1] == got[2] == got[3] and got[4] == got[7] == got[8] and len({got[1], got[4], got[5], got[6]}) == 4 and len(got) == 8


def test_join_unique_with_hot_keys(spark, monkeypatch):
    import caseloom.session as S

    monkeypatch.setattr(S, "HOT_ROWS", 10)
    left = spark.createDataFrame([(i, 7 if i % 3 else i) for i in range(90)] + [(100, None)], "i bigint, k bigint")
    right = spark.createDataFrame([(7, "hot"), (9, "nine"), (500, "no")], "k bigint, v string")
    for how in ("inner", "left"):
        got = sorted(map(tuple, join_unique(left, right, ["k"], how).select("i", "v").collect()))
        assert got == sorted(map(tuple, left.join(right, ["k"], how).select("i", "v").collect()))


def test_canonicalize(spark):
    rows = [("f1", "fact", " 甲罪 ", " 未知", 12.0), ("f2", "fact", "甲罪", "op", 1.5), ("f3", " ", "甲罪", None, 3.0), ("f4", "x", "", None, 3.0), ("f5", "x", "乙", "UNKNOWN", None), ("f6", "x", "乙", "", float("nan")), ("f7", "x", "乙", "o", -1.0)]
    df = spark.createDataFrame(rows, "filename string, justice string, caseCause string, opinion string, judge double")
    out = {r.source_id: r for r in K.canonicalize(df, "d", "dev").collect()}
    assert {k: r.error for k, r in out.items()} == {"f1": None, "f2": "invalid_months", "f3": "missing_facts", "f4": "missing_charge", "f5": "invalid_months", "f6": "invalid_months", "f7": "invalid_months"}
    assert (out["f1"].charge, out["f1"].opinion, out["f1"].sentence_months) == ("甲罪", None, 12) and out["f2"].opinion == "op" and out["f1"].id.startswith("d:dev:")
    text = spark.createDataFrame([("a", "f", "c", "12")], "id string, facts string, charge string, judge string")
    assert K.canonicalize(text, "d", "train").first().error == "invalid_months"
    with pytest.raises(ValueError):
        K.canonicalize(df, "d", "valid")


def brute_pairs(rows):
    form = {i: "".join((x or "").split()) for i, x in rows}
    g = {i: {x[k : k + 5] for k in range(max(1, len(x) - 4))} for i, x in form.items() if x}
    out = set()
    for a in g:
        for b in g:
            if a < b:
                n, m = len(g[a] & g[b]), min(len(g[a]), len(g[b]))
                if form[a] == form[b] or (m >= 20 and n >= 0.85 * m):
                    out.add((a, b, n, m))
    return out


def texts(seed=3):
    rng = random.Random(seed)
    base = ["".join(chr(rng.randrange(0x4E00, 0x4E80)) for _ in range(rng.randrange(10, 120))) for _ in range(30)]
    rows = []
    for x in base:
        y = list(x)
        y[rng.randrange(len(y))] = "某"
        rows += [x, "".join(y), x[: len(x) * 2 // 3], x + " \n"]
    rows += [None, "", "  ", "短", "短"]
    return list(enumerate(rows))


def test_containment_pairs_and_guard(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "i bigint, t string").repartition(3)
    grams = M.gram_table(df, "i", X.without_space("t"))
    first = {}
    for i, x in rows:
        first.setdefault("".join((x or "").split()), i)
    assert {tuple(r) for r in M.containment_pairs(grams).collect()} == {p for p in brute_pairs(rows) if {p[0], p[1]} <= set(first.values())}
    members = {r.id: (r.rep, r.copies) for r in M.text_classes(grams).collect()}
    forms = {i: "".join((x or "").split()) for i, x in rows}
    assert members == {i: (first[f], list(forms.values()).count(f)) for i, f in forms.items() if f}
    guard = grams.where("id % 4 = 0")
    got = {(r.id, r.guard_id) for r in M.guard_matches(grams, guard).collect()}
    want = {(a, b) for p in brute_pairs(rows) for a, b in ((p[0], p[1]), (p[1], p[0])) if b % 4 == 0} | {(i, i) for i, x in rows if x and x.strip() and i % 4 == 0}
    assert got == want


def test_greedy_keep(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(50)]
    edges = [(a, b) for a, b in edges if a != b]
    nodes = spark.createDataFrame([(i,) for i in range(45)], "i bigint")
    kept, near = [], {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for i in range(44, -1, -1):
        if not near.get(i, set()) & set(kept):
            kept.append(i)
    got = M.greedy_keep(nodes, spark.createDataFrame(edges, "a bigint, b bigint"), "i", -F.col("i"))
    assert sorted(r.i for r in got.collect()) == sorted(kept)
    assert M.greedy_keep(nodes, spark.createDataFrame([], "a bigint, b bigint"), "i", F.col("i")).count() == 45


def test_greedy_distinct(spark):
    rows = texts()
    near = {}
    for a, b, _, _ in brute_pairs(rows):
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    kept = []
    for i, _ in reversed(rows):
        if not near.get(i, set()) & set(kept):
            kept.append(i)
    df = spark.createDataFrame(rows, "i bigint, t string").repartition(3)
    assert sorted(r.i for r in M.greedy_distinct(df, "i", X.without_space("t"), -F.col("i")).collect()) == sorted(kept)


def test_record_components(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None]) and f"s{rng.randrange(30)}", rng.choice([f"e{rng.randrange(60)}", None])) for i in range(120)]
    df = spark.createDataFrame(rows, "k bigint, s string, e string").repartition(4)
    a = {r.k: r.component for r in record_components(df, "k", ["s", "e"]).collect()}
    b = {r.k: r.component for r in entity_components(df, "k", ["s", "e"]).collect()}
    same = lambda x: {frozenset(k for k in x if x[k] == c) for c in set(x.values())}
    assert len(a) == 120 and same(a) == same(b)
    assert record_components(df.limit(0), "k", ["s"]).count() == 0


def test_group_split(spark):
    rows = [(i, f"s{i // 2}", f"f{i // 3}", f"c{i // 30}") for i in range(120)] + [(500, "alone", "alone", "rare")]
    df = spark.createDataFrame(rows, "k bigint, s string, f string, charge string")
    a = {r.k: (r.component, r.new_split) for r in D.group_split(df, "k", ["s", "f"], "charge").collect()}
    b = {r.k: (r.component, r.new_split) for r in D.group_split(df.orderBy(F.desc("k")).repartition(7), "k", ["s", "f"], "charge").collect()}
    assert a == b and len(a) == 121 and a[500][1] == "train"
    for field in (1, 2):
        seen = {}
        for r in rows:
            seen.setdefault(r[field], set()).add(a[r[0]][1])
        assert all(len(x) == 1 for x in seen.values())
    assert {x for _, x in a.values()} == {"train", "dev"}


def test_samples(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3] if i < 90 else "d") for i in range(93)], "k bigint, c string")
    assert {r.c: r["count"] for r in D.per_class(df, "c", "k", 5).groupBy("c").count().collect()} == {"a": 5, "b": 5, "c": 5, "d": 3}
    got = {r.c: r["count"] for r in D.round_robin(df, "c", "k", 18).groupBy("c").count().collect()}
    assert got == {"a": 5, "b": 5, "c": 5, "d": 3}


def test_bootstrap_and_comparison(spark):
    rng = random.Random(5)
    rows = [(f"c{i}", True, rng.gauss(0, 5), rng.gauss(0, 5) - 1) for i in range(300)]
    a = spark.createDataFrame([(i, v, abs(x)) for i, v, x, _ in rows], "id string, valid boolean, absolute_error double")
    b = spark.createDataFrame([(i, v, abs(y)) for i, v, _, y in rows], "id string, valid boolean, absolute_error double").repartition(5)
    d = [abs(y) - abs(x) for _, _, x, y in rows]
    mean = sum(d) / len(d)
    spread = (sum((x - mean) ** 2 for x in d) / len(d)) ** 0.5 / len(d) ** 0.5
    r = E.compare(a, b).first()
    assert (r.status, r.n, r.n_valid) == ("compared", 300, 300) and abs(r.mean_delta - mean) < 1e-9
    assert abs((r.ci_high - r.ci_low) / (2 * 1.96 * spread) - 1) < 0.15 and r.ci_low < mean < r.ci_high
    refused = E.compare(a, b.where("id <> 'c7'")).first()
    assert (refused.status, refused.n, refused.n_valid, refused.mean_delta, refused.ci_low) == ("partial_coverage", 300, 299, None, None)
    assert E.compare(a.limit(0), b.limit(0)).first().n == 0
    with pytest.raises(ValueError):
        E.bootstrap(a, samples=50)


def test_metrics(spark):
    gold = spark.createDataFrame([("1", "x", "abc", 10), ("2", "x", None, 20), ("3", "y", "abc", 30)], "id string, charge string, opinion string, sentence_months bigint")
    ok = lambda m: f'{{"reasoning": "abd", "sentence_months": {m}}}'
    first = spark.createDataFrame([("1", ok(12), "stop"), ("2", ok(20), "length"), ("9", ok(1), "stop")], "id string, text string, finish_reason string")
    full = spark.createDataFrame([(str(i), ok(10 * i + 1), None) for i in (1, 2, 3)], "id string, text string, finish_reason string")
    a, b = E.errors(gold, first), E.errors(gold, full)
    s, t = E.summarize(a).first(), E.summarize(b).first()
    assert (s.n, s.n_valid, s.mae_valid, s.mae_full) == (3, 1, 2.0, None) and (t.n_valid, t.mae_full, t.rmse_full, t.coverage) == (3, 1.0, 1.0, 1.0)
    assert [r.id for r in E.unknown_keys(gold, first).collect()] == ["9"]
    assert [tuple(r) for r in E.paired(a, b).collect()] == [("1", -1)]
    assert abs(b.where("id = '1'").first().char_rouge_l - 2 / 3) < 1e-9
    assert E.summarize(a.limit(0)).first().n == 0
    deltas = spark.createDataFrame([(str(i), float(i % 5) - 3) for i in range(200)], "id string, delta double")
    r = E.bootstrap(deltas, samples=400).first()
    assert r.n == 200 and r.ci_low < r.mean_delta < r.ci_high < 0 and r.ci_high - r.ci_low < 0.6
    with pytest.raises(ValueError):
        E.bootstrap(deltas, samples=10)
    w = spark.createDataFrame([("a", 1, 0.2), ("a", 5, 0.3), ("a", 9, 0.5), ("b", 2, 1.0), ("b", None, 5.0)], "g string, v bigint, m double")
    assert {r.g: r.median_value for r in E.weighted_median(w, "g", "v", "m").collect()} == {"a": 5, "b": 2}


def test_ledger(spark):
    rows = [(1, "r1", 1, "rejected", 5), (2, "r1", 1, "rejected", 9), (3, "r1", 2, "accepted", 6), (4, "r1", 3, "api_error", 7), (5, "r2", 1, "pending", 1), (6, "r3", 1, "api_error", 2), (7, "r4", 3, "rejected", 3), (8, "r4", 1, "rejected", 1), (9, "r4", 2, "rejected", 2)]
    df = spark.createDataFrame(rows, "entry_no bigint, request string, attempt bigint, status string, at bigint")
    once = L.deliveries_once(df, "request", "attempt", "at", "entry_no")
    assert once.count() == 8
    state = L.fold(once, "request", "attempt", "status", "entry_no")
    assert {r.request: (r.state, r.attempts) for r in state.collect()} == {"r1": ("accepted", 3), "r2": ("pending", 1), "r3": ("api_error", 1), "r4": ("rejected", 3)}
    assert [r.request for r in L.open_requests(state, 10, "request").collect()] == ["r3"]
    rng = random.Random(4)
    calls = [("xy"[i % 2], i // 3, i, rng.random() < 0.7) for i in range(200)]
    want = []
    for m in "xy":
        seen = [f for k, _, _, f in calls if k == m]
        starts = [i for i, f in enumerate(seen) if f and (i == 0 or not seen[i - 1])]
        for no, i in enumerate(starts, 1):
            n = next((j for j in range(i, len(seen)) if not seen[j]), len(seen)) - i
            want.append((m, no, n, i + 1, i + n))
    calls = spark.createDataFrame(calls, "m string, at bigint, no bigint, f boolean").repartition(3)
    for bucket in (F.lit(0), F.floor(F.col("at") / 4), F.col("at")):  # one range, several, and runs that span many
        assert sorted(map(tuple, L.streaks(calls, "m", ["at", "no"], F.col("f"), bucket).collect())) == sorted(want)


BUNDLE = {
    "schema_version": 1, "conditions": [{"id": c, "text": c} for c in "abc"],
    "rules": [
        {"id": "r2", "charges": ["x"], "when": "b", "requires": ["r1"], "blocked_by": ["r3"], "effect": {"k": 1}, "source": "s", "version": "1", "review_status": "approved", "reviewer": "n"},
        {"id": "r1", "charges": ["y"], "when": {"not": "a"}, "effect": {"k": 1}, "source": "s", "version": "1", "review_status": "approved", "reviewer": "n"},
        {"id": "r3", "charges": ["z"], "when": "c", "effect": {"k": 1}, "source": "s", "version": "1", "review_status": "draft"},
    ],
}


def test_rules(spark):
    with pytest.raises(ValueError):
        R.ordered(BUNDLE)
    assert [r["id"] for r in R.ordered(BUNDLE, drafts=True)][-1] == "r2"
    charges = spark.createDataFrame([(c,) for c in "xyzw"], "charge string")
    covered = {}
    for r in R.covering(*R.rule_tables(spark, BUNDLE), charges).collect():
        covered.setdefault(r.charge, {})[r.rule] = r.conditions
    assert covered == {"x": {"r1": ["a"], "r2": ["b"], "r3": ["c"]}, "y": {"r1": ["a"]}, "z": {"r3": ["c"]}}
    assert R.bundle_problems(BUNDLE) == [("r3", "not_reviewed")] and R.bundle_problems(BUNDLE, True) == []
    broken = {"schema_version": 2, "conditions": [{"id": "a", "text": " "}], "rules": [{"id": "r", "charges": [], "when": "b", "requires": ["q"]}, {"id": "r", "charges": ["*"], "when": "a", "source": "s", "version": "1", "effect": {"k": 1}, "requires": ["r"]}]}
    assert set(map(tuple, R.problem_table(spark, broken, True).collect())) == {("bundle", "schema_version"), ("a", "no_text"), ("r", "repeated"), ("r", "no_charges"), ("r", "unknown_condition"), ("r", "unknown_rule"), ("r", "no_source"), ("r", "no_version"), ("r", "no_effect"), ("r", "cycle")}
    df = spark.createDataFrame([({"a": False, "b": True, "c": False},), ({"a": False, "b": True},), ({"a": True},)], "s map<string,boolean>")
    assert [r.rule_r2 for r in R.compose(df, BUNDLE, "s", True).collect()] == [True, None, False]
    trace = R.traced(df, BUNDLE, "s", True).collect()
    assert [{s.rule: s.state for s in r.trace}["r2"] for r in trace] == ["supported", "unknown", "refuted"] and [r.unknown for r in trace] == [[], ["c"], ["b", "c"]]
    loop = {**BUNDLE, "rules": [{**BUNDLE["rules"][1], "requires": ["r1"]}]}
    for bad in (loop, {**BUNDLE, "schema_version": 2}, {**BUNDLE, "conditions": []}):
        with pytest.raises(ValueError):
            R.ordered(bad, True)
    got = {tuple(r) for r in R.closure(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "src string, dst string")).collect()}
    assert got == {(x, y) for x in "abcd" for y in "abc"}
    chains = R.parse_chains(spark.createDataFrame([("p -> s -> e",), (" ",), ("p -> s",)], "l string"), "l", "c", "s", "1").collect()
    assert [(r.ok, r.effect) for r in chains] == [(True, "e"), (False, None)]


def test_annotations(spark):
    df = spark.createDataFrame([("1", "abcd", [(0, 2, "ab"), (1, 3, "xx"), (2, 9, "cd"), (2, 2, "")])], "id string, t string, spans array<struct<start_pos:int,end_pos:int,quote:string>>")
    assert [(r.i, r.problem) for r in A.span_problems(df, "id", "t", "spans").collect()] == [(1, "differs"), (2, "outside"), (3, "outside")]
    c = "array<struct<condition_id:string,status:string,evidence:array<string>>>"
    df = spark.createDataFrame([("1", [("a", "supported", []), ("a", "unknown", []), ("z", "maybe", [])])], f"id string, c {c}")
    assert {(r.condition_id, r.problem) for r in A.coverage_problems(df, "id", "c", ["a", "b"]).collect()} == {("b", "missing"), ("z", "not_asked"), ("a", "repeated"), ("z", "bad_status"), ("a", "no_evidence")}
    obs = spark.createDataFrame([("1", "a", True, True), ("1", "a", True, True), ("1", "b", True, True), ("1", "b", False, True), ("1", "c", True, False), ("1", "d", None, True)], "id string, c string, p boolean, e boolean")
    assert {r.c: (r.state, r.reason) for r in A.reduce_observations(obs, "id", "c", "p", "e").collect()} == {"a": (True, "none"), "b": (None, "conflicting_evidence"), "c": (None, "binding_gate"), "d": (None, "insufficient_evidence")}
    body = "struct<decision:string,issues:array<string>,evidence:array<struct<quote:string,subject:string,relation:string,kind:string>>,summary:string>"
    rows = [("1", "abcd", ("keep", [], [("bc", "x", "target", "action")], "s")), ("2", "abcd", ("keep", ["i"], [("zz", " ", "no", None)], "")), ("3", "abcd", ("review", [], None, None))]
    got = {}
    for r in A.structure_problems(spark.createDataFrame(rows, f"id string, t string, b {body}"), "id", "b", "t").collect():
        got.setdefault(r.id, set()).add((r.path, r.problem))
    assert set(got) == {"2", "3"} and ("evidence[0].quote", "quote_not_in_source") in got["2"] and ("issues", "review_requires_explanation") in got["3"] and len(got["2"]) == 6


def test_packaging(spark):
    schema = "ref_no bigint, id string, split string, dataset string, source_id string, facts string, charge string, target_person string, opinion string, sentence_months bigint"
    rows = [(1, "a", "train", "d", "s", "f", "c", "p", "o", 3), (2, "b", "test", "d", "s", "f", "c", None, "o", 3), (3, "c", "dev", "d", "s", "f", "c", "", "none", 3), (4, "d", "train", "d", "s", None, "c", "", "o", 3)]
    df = spark.createDataFrame(rows, schema)
    jobs = G.jobs(df, "ref_no", "sys").collect()
    assert len(jobs) == 3 and not any("sentence_months" in str(j) or '"o"' in str(j) for j in jobs)
    G.check_job_fields(G.jobs(df, "ref_no", "sys"), ("ref_no",))
    with pytest.raises(ValueError):
        G.check_job_fields(df)
    assert [r.ref_no for r in G.training_pairs(df, "ref_no", "sys").collect()] == [1]
    part = K.partition_reviewed(df, "ref_no", df.where("ref_no = 1"), df.where("ref_no IN (1, 2)")).groupBy("part").count().collect()
    assert {r.part: r["count"] for r in part} == {"quarantine": 1, "pending": 1, "retained": 2}


def test_responder_and_differences(spark):
    tasks = spark.createDataFrame([("r1", "1"), ("r2", "x"), ("r3", "5"), (None, "7")], "request string, body string")
    ledger = spark.createDataFrame([("r3", "pending"), (None, "accepted")], "request string, status string")
    todo = L.pending_tasks(tasks, ledger, "request").where("request IS NOT NULL")
    got = {r.request: (r.status, r.result, r.reason) for r in L.respond(todo, "request", "body", lambda x: str(int(x) + 1)).collect()}
    assert got == {"r1": ("accepted", "2", None), "r2": ("rejected", None, "ValueError")}
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "i int, s string")
    b = spark.createDataFrame([("x", 1), (None, 2), (None, 3)], "s string, i int")
    assert sorted(tuple(r) for r in E.frame_differences(a, b).select("i", "side").collect()) == [(1, "left"), (3, "right")]
    assert E.frame_differences(a, a.orderBy("i")).count() == 0
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.5, 0.0]), (3, [1.0]), (4, None)], "i int, v array<double>")
    assert [(r.max_abs, r.same) for r in E.vector_differences(v, v.where("i = 1"), "i", "v").orderBy("i").collect()] == [(0.0, True), (2.0, False), (None, False), (None, None)]
