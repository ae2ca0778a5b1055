import pytest
from pyspark.sql import functions as F

from caseloom.functions import text as X
from caseloom.operators import annotations as A
from caseloom.operators import events as V
from caseloom.operators import metrics as E
from caseloom.operators import packaging as G
from caseloom.operators import review as W
from caseloom.operators import screens as Q
from caseloom.plans.protocols import BODY


def by_id(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], set()).add(tuple(r[1:]) if len(r) > 2 else r[1])
    return out


def test_structure_problems(spark):
    good = ("keep", [], [("bc", "b", "target", "action")], "s")
    rows = [
        ("good", "abcd", good), ("null", "abcd", None), ("empty", "", ("review", ["x"], [], "")), ("twice", "abcbc", ("keep", [], [("bc", None, "target", "action"), ("bc", "z", "uncertain", None)], "s")),
        ("long", "a" * 400, ("keep", [], [("a" * 161, " ", "other", "context")] * 7, "s" * 201)), ("bare", None, ("keep", None, None, None)),
    ]
    df = spark.createDataFrame(rows, f"id string, t string, b {BODY}")
    loose, strict = (by_id(A.structure_problems(df, "id", "b", "t", x).collect()) for x in (A.LOOSE, A.STRICT))
    assert "good" not in loose and "good" not in strict and loose["null"] == strict["null"] == {("$", "expected_JSON_object")} and "empty" not in strict
    assert ("evidence[0].subject", "null_subject_but_definite_relation") in strict["twice"] and ("evidence[1].quote", "duplicate_evidence_item") in strict["twice"]
    assert ("evidence[1].subject", "subject_mention_absent_from_this_quote") in strict["twice"] and ("evidence[0].quote", "must_match_source_exactly_once") in strict["twice"] and loose["twice"] == {("evidence[1].kind", "invalid_enum")}
    assert {("summary", "too_long"), ("evidence", "too_many"), ("evidence[3].quote", "too_long"), ("evidence[6].subject", "expected_nonempty_string_or_null")} <= strict["long"]
    assert loose["bare"] == {("issues", "expected_list_of_nonempty_strings"), ("summary", "expected_string"), ("evidence", "expected_list"), ("evidence", "keep_requires_at_least_one_item"), ("summary", "keep_requires_nonempty_summary")}
    assert A.structure_problems(df.limit(0), "id", "b", "t").count() == 0


def test_responses(spark):
    rows = [("a", '{"x": 1, "y": null}', "stop"), ("b", '{"x": 1}', None), ("c", '{"x": 1, "y": 2} more', "stop"), ("d", None, "stop"), ("e", '{"x": 1, "y": 2}', "length"), ("f", "[1]", "stop"), ("g", ' {"y": {"z": 1}, "w": 2}\n', "stop")]
    got = {r[0]: tuple(r[1:]) for r in A.response_problems(spark.createDataFrame(rows, "id string, t string, f string"), "id", "t", "f", ("x", "y")).collect()}
    assert got == {"b": ("wrong_fields", "y", ""), "c": ("invalid_JSON", None, None), "d": ("invalid_JSON", None, None), "e": ("incomplete_response", None, None), "f": ("invalid_JSON", None, None), "g": ("wrong_fields", "x", "w")}


def test_bindings_flags_votes(spark):
    a = spark.createDataFrame([("1", "p"), ("2", "q"), ("9", "r"), ("4", None)], "id string, p string")
    r = spark.createDataFrame([("1", "p"), ("2", "x"), ("3", "y"), ("4", None)], "id string, p string")
    assert {tuple(x) for x in A.binding_problems(a, r, "id", "p").collect()} == {("2", "changed_input"), ("9", "foreign"), ("3", "unannotated")}
    states = spark.createDataFrame([("1", "c", "unknown", "fact", None), ("1", "d", "unknown", None, "q"), ("2", "c", "refuted", "fact", "")], "id string, c string, s string, t string, q string")
    flags = [A.Flag("cue", "unknown", "c", "fa"), A.Flag("any", "unknown", needs_quote=True), A.Flag("ref", "refuted", "c", "x", "quote")]
    assert {tuple(x) for x in A.state_flags(states, "id", "c", "s", "t", "q", flags).collect()} == {("1", "cue"), ("1", "any")}
    quotes = spark.createDataFrame([("1", "abcdef", "ab", "target"), ("1", "abcdef", "bc", "other"), ("1", "abcdef", "de", "target"), ("1", "abcdef", "cd", "other"), ("1", "abcdef", "zz", "other"), ("1", "abcdef", None, "other")], "id string, t string, quote string, relation string")
    spans = spark.createDataFrame([("1", 0, 0, 3), ("1", 1, 3, 6), ("1", 2, 6, 6), ("2", 0, 0, 9)], "id string, i int, start_pos int, end_pos int")
    assert {tuple(x) for x in A.span_votes(quotes, spans, "id", "t").collect()} == {("1", 0, None, "conflict"), ("1", 1, "target", "labelled"), ("1", 2, None, "unlabelled"), ("2", 0, None, "unlabelled")}


def test_events(spark):
    events = spark.createDataFrame([("yes", "c", True), ("no", "c", False), ("mere", "c", None), ("paid", "p", True), ("done", "w", True)], "kind string, condition_id string, effect boolean")
    conditions = spark.createDataFrame([("c", False, "current_case", False), ("p", True, "current_case", False), ("w", False, "current_case", True)], "condition_id string, takes_proxy boolean, scope string, case_wide boolean")
    units = [("s1", 0, 2, "ab"), ("s2", 2, 4, "cd")]
    ob = lambda k, no, kind, actor="defendant", scope="current_case", cover="case_wide", ids=("s1",): (k, no, kind, actor, scope, cover, list(ids), units)
    rows = [
        ob("a", 2, "yes", ids=("s2", "s1")), ob("a", 1, "yes", ids=("s2",)), ob("a", 3, "paid", "proxy"), ob("a", 4, "done", cover="single_event"), ob("b", 1, "yes"), ob("b", 2, "no"), ob("b", 3, "paid", "other"), ob("d", 1, "mere"), ob("d", 2, "paid", cover="unclear"),
        ob("e", 1, "yes", ids=("s1", "s9")), ob("e", 2, "odd"), ob("e", 3, "yes", "ghost"), ob("e", 4, "yes", ids=()), ob("e", 5, "yes", ids=("s1", "s1")),
    ]
    kind = "id string, no int, kind string, actor string, scope string, coverage string, unit_ids array<string>, units array<struct<id:string,start_pos:int,end_pos:int,text:string>>"
    df = spark.createDataFrame(rows, kind).repartition(3)
    found = by_id(V.event_problems(df, "id", events).select("no", "problem", "id").where("id = 'e'").select("no", "problem").collect())
    assert found == {1: {"invalid_units", "over_budget"}, 2: {"unknown_kind"}, 3: {"invalid_binding", "over_budget"}, 4: {"invalid_units", "over_budget"}, 5: {"invalid_units", "over_budget"}}
    records = spark.createDataFrame([(x,) for x in "abdx"], "id string")
    got = {(r.id, r.condition_id): r for r in V.reduce_events(records, df.where("id <> 'e'"), "id", events, conditions).collect()}
    assert len(got) == 12 and all(got["x", c].reason == "not_mentioned" and got["x", c].state == "unknown" and got["x", c].context == [] for c in "cpw")
    assert got["a", "c"].state == "supported" and [s.quote for s in got["a", "c"].evidence] == ["cd", "ab"] and got["a", "c"].kinds == ["yes", "yes"]
    assert got["a", "p"].state == "supported" and got["a", "w"].reason == "partial_case_outcome" and [s.quote for s in got["a", "w"].context] == ["ab"]
    assert got["b", "c"].reason == "conflicting_evidence" and got["b", "p"].reason == "insufficient_evidence" and got["d", "c"].reason == "insufficient_evidence" and got["d", "p"].reason == "binding_unclear"
    empty = V.reduce_events(records, df.limit(0), "id", events, conditions).collect()
    assert len(empty) == 12 and {r.reason for r in empty} == {"not_mentioned"}


def test_screens(spark):
    df = spark.createDataFrame([("1", "train", "x", "bad"), ("2", "train", "x", "ok"), ("3", "train", "y", "bad"), ("4", "dev", "x", "bad"), (None, "dev", "x", "bad"), ("2", "train", None, "ok")], "id string, split string, charge string, t string")
    held = Q.quarantined(df.where("id IS NOT NULL"), "id", F.filter(F.array("t"), lambda x: x == "bad"))
    assert {r.id for r in held.collect()} == {"1", "3", "4"}
    after = Q.withhold({"r": df, "p": df.select("id")}, "id", held)
    assert after["p"].count() == 3
    got = {r.split: (r.n_before, r.n_after, r.lost_classes, r.problem) for r in Q.screen_guards(df, after["r"], "split", "charge").collect()}
    assert got == {"train": (4, 2, 1, "class_lost"), "dev": (2, 1, 0, None)}
    assert Q.screen_guards(df, df.limit(0), "split", "charge").where("problem = 'emptied'").count() == 2
    arms = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "a"), ("2", "a"), ("3", "z")], "id string, arm string")
    assert {tuple(r) for r in Q.arm_pairing(arms, "id", "arm", ["a", "b"]).collect()} == {("2", "a", "repeated"), ("2", "b", "missing")}
    pool = spark.createDataFrame([("1", "d", "s"), ("5", "d", "t"), ("6", None, None), (None, "d", "u")], "id string, dataset string, source_id string")
    seen = spark.createDataFrame([("1", "d", "q"), (None, "d", "t"), (None, None, None)], "id string, dataset string, source_id string")
    assert sorted((r.id or "-") for r in Q.unexposed(pool, seen, "id", ["dataset", "source_id"]).collect()) == ["-", "6"]


def test_reviews(spark):
    records = spark.createDataFrame([(str(i), "x" if i < 5 else "y") for i in range(1, 8)], "id string, charge string")
    flags = spark.createDataFrame([("1", "k"), ("2", "k"), ("2", "m"), ("6", "k")], "id string, kind string")
    pairs = spark.createDataFrame([("3", "4"), ("5", "1")], "left_id string, right_id string")
    plan = lambda q, d, li: (spark.createDataFrame(q, "id string, reason string"), spark.createDataFrame(d, "id string, kind string"), spark.createDataFrame(li, "excluded string, representative string"))
    good = plan([("3", W.DUPLICATE), ("6", "scope")], [("2", "m")], [("3", "4")])
    assert W.plan_problems(records, flags, pairs, *good, ["charge"]).count() == 0
    out = {r.id: (r.part, r.representative, r.remaining_flags, r.unresolved_overlap) for r in W.apply_plan(records, flags, pairs, *good).collect()}
    assert out == {"1": ("pending", None, ["k"], True), "2": ("pending", None, ["k"], False), "3": ("quarantine", "4", None, None), "4": ("retained", None, None, False), "5": ("pending", None, None, True), "6": ("quarantine", None, None, None), "7": ("retained", None, None, False)}
    bad = plan([("9", "x"), ("7", " "), ("2", "a"), ("2", "b"), ("5", W.DUPLICATE), ("4", W.DUPLICATE)], [("2", "m"), ("1", "z")], [("5", "1"), ("6", "6"), ("1", "2")])
    assert {tuple(r) for r in W.plan_problems(records, flags, pairs, *bad, ["charge"]).collect()} == {
        ("9", "unknown_id"), ("7", "no_reason"), ("2", "decided_twice"), ("2", "dismissed_and_quarantined"), ("1", "flag_not_audited"), ("6", "not_quarantined_as_duplicate"), ("1", "not_quarantined_as_duplicate"),
        ("4", "no_representative"), ("6", "own_representative"), ("6", "pair_not_audited"), ("1", "pair_not_audited"), ("5", "labels_differ"),
    }


def test_packages(spark):
    rows = [(1, "a", "dev", "P did it", "c", "P"), (2, "b", "dev", "f", "c", "P"), (3, "d", "dev", None, "c", ""), (4, "e", "dev", "", "c", None)]
    df = spark.createDataFrame(rows, "ref_no bigint, id string, split string, facts string, charge string, target_person string")
    pairs = G.masked_pair(df, "ref_no", "sys")
    assert {(r.ref_no, r.arm): "target_person" in r.messages[1].content for r in pairs.collect()} == {(1, "original"): False, (1, "target"): True, (2, "original"): False, (2, "target"): False, (4, "original"): False, (4, "target"): False}
    assert G.pair_problems(pairs, "ref_no", "sys").count() == 0
    odd = pairs.where("NOT (ref_no = 2 AND arm = 'target')").withColumn("messages", F.when(F.col("ref_no") == 4, G.messages("other", F.lit('{"facts": "g", "label": 3}'))).otherwise(F.col("messages")))
    got = by_id(G.pair_problems(odd, "ref_no", "sys").collect())
    assert got == {2: {"missing_arm", "inputs_differ"}, 4: {"wrong_system", "hash_differs", "unexpected_fields"}}
    v = G.variant_jobs(df, "ref_no", "sys", F.lit("R"), F.lit("E"), F.lit("T")).where("ref_no = 2").collect()
    shown = {r.variant: r.messages[1].content for r in v}
    assert [("R" in shown[k], "E" in shown[k], "T" in shown[k]) for k in G.VARIANTS] == [(False,) * 3, (True, False, False), (True, True, False), (True,) * 3] and len({r.prompt_hash for r in v}) == 4
    with pytest.raises(ValueError):
        G.variant_body(df, "other", *[F.lit("")] * 3)
    jobs = spark.createDataFrame([("1", "h"), ("2", "h"), ("3", "h"), ("4", "h")], "id string, prompt_hash string")
    out = spark.createDataFrame([("1", "h"), ("2", "x"), ("3", "h"), ("3", "h"), ("9", "h")], "id string, prompt_hash string")
    assert {tuple(r) for r in G.prediction_problems(jobs, out, "id").collect()} == {("2", "other_prompt"), ("3", "repeated"), ("4", "missing"), ("9", "foreign")}
    side = lambda ids: spark.createDataFrame([("g", i) for i in ids], "g string, id string")
    assert [tuple(r) for r in G.order_differences(side("ab"), side("acd"), "g", ["id"], "id").orderBy("position").collect()] == [("g", 2, "b", "c"), ("g", 3, None, "d")]


def test_numbers_and_names(spark):
    df = spark.createDataFrame([("a", 1, 0.5, 7), ("a", 9, 0.4999, 3), ("a", 5, 0.0001, 1), ("b", None, 1.0, 1), ("c", 2, 0.0, 1)], "g string, v int, m double, w int")
    (r,) = E.number_summary(df, "g", "v", "m", "w").collect()
    assert (r.g, r.median_value, r.top_values, r.greedy_value) == ("a", 1, [1, 9], 7) and abs(r.pruned_mass - 0.0001) < 1e-9
    df = spark.createDataFrame([(6.9e9, "x"), (7e9, "y"), (None, None)], "p double, k string")
    assert [tuple(r) for r in df.select(X.training_mode("p"), X.dispatched("k", {"x": "1"}), G.listed_order("k", ["y", "x"])).collect()] == [("full", "1", 2), ("lora", None, 1), (None, None, 3)]
