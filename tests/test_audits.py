import pytest
from pyspark.sql import functions as F

from caseloom.operators import audits as B
from caseloom.operators import cases as K


def test_candidates(spark):
    term = lambda m, d=False: (d, False, m)
    rows = [(1, "f", (["[甲罪]"], ["P"], term(3))), (2, "f", (["甲罪", "乙罪"], ["P"], term(3))), (3, "f", (["丙罪"], ["P"], term(3))), (4, "f", (["甲罪"], [" "], term(3))), (5, "f", (["甲罪"], ["P"], term(0))), (6, "f" * 9, (["甲罪"], ["P"], term(3))), (7, None, (["甲罪"], ["P"], term(3))), (8, "f", (["甲罪"], ["P"], term(3, True))), (9, "f", None)]
    df = spark.createDataFrame(rows, "raw_no int, fact string, meta struct<accusation:array<string>,criminals:array<string>,term_of_imprisonment:struct<death_penalty:boolean,life_imprisonment:boolean,imprisonment:bigint>>")
    charges = spark.createDataFrame([("甲罪",), (None,)], "charge string")
    got = {r.raw_no: (r.reason, r.target_person) for r in K.candidates(df, charges, 8).collect()}
    assert got == {1: (None, "P"), 2: ("charge_scope", "P"), 3: ("outside_charges", "P"), 4: ("target_scope", None), 5: ("non_fixed_positive_term", "P"), 6: ("empty_or_overlength_facts", "P"), 7: ("empty_or_overlength_facts", "P"), 8: ("non_fixed_positive_term", "P"), 9: ("charge_scope", None)}


def test_protocols_and_expectations(spark):
    facts = spark.createDataFrame([("n", 3), ("extra", 1)], "name string, actual int")
    assert {tuple(r) for r in B.protocol_differences(facts, {"n": "3", "gone": "x"}).collect()} == {("n", "3", "3", True), ("extra", None, "1", False), ("gone", "x", None, False)}
    expected = spark.createDataFrame([("1", "s"), ("2", "s"), ("3", "r")], "id string, state string")
    states = spark.createDataFrame([("1", "m", "s"), ("2", "m", "r"), ("1", "k", "s"), ("2", "k", "s"), ("3", "k", "r")], "id string, mode string, state string")
    assert {tuple(r) for r in B.agreement(expected, states, ["id"], "mode").collect()} == {("m", 3, 1, 1), ("k", 3, 3, 0)}
    assert B.agreement(expected, states.limit(0), ["id"], "mode").count() == 0


def test_distilled(spark):
    c = "array<struct<claim:string,quote:string>>"
    rows = [("ok", "abcd", [(" x ", "ab"), ("y", "cd")]), ("none", "abcd", []), ("null", "abcd", None), ("blank", "abcd", [(" ", "ab")]), ("far", "abcd", [("x", "zz")]), ("two", "abab", [("x", "ab")]), ("long", "abcd", [("x" * 1801, "ab")]), ("many", "abcd", [("x", "ab")] * 13), ("bare", None, [("x", "ab")])]
    got = {r.id: (r.opinion, r.problem) for r in B.distilled(spark.createDataFrame(rows, f"id string, t string, c {c}"), "id", "t", "c").collect()}
    assert got["ok"] == ("x\ny", None) and {k: v[1] for k, v in got.items() if k != "ok"} == {"none": "claim_count", "null": "claim_count", "blank": "empty_claim", "far": "quote_not_grounded", "two": "quote_not_grounded", "long": "too_long", "many": "claim_count", "bare": "quote_not_grounded"}
    assert all(v[0] is None for k, v in got.items() if k != "ok")


def test_packages_and_sidecars(spark):
    refs = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    members = spark.createDataFrame([("x", 1, "a"), ("x", 2, None), ("x", 3, "z"), ("y", 1, "a"), ("y", 1, "a"), ("y", 9, "q")], "arm string, k int, v string")
    assert {tuple(r) for r in B.package_differences(refs, members, "k", ["x", "y"], ["v"]).collect()} == {("x", 3, "differs"), ("y", 1, "repeated"), ("y", 2, "missing"), ("y", 3, "missing"), ("y", 9, "foreign")}
    df = spark.createDataFrame([(1, "abc", "p"), (2, None, "q"), (3, "abc", None), (4, "abc", "s")], "k int, t string, person string")
    frame, side = B.without_column(df, "k", "person", F.when(F.col("k") != 2, F.array(F.struct(F.lit(1).alias("start_pos"), (F.col("k") + 1).alias("end_pos")))))
    assert frame.columns == ["k", "t"]
    odd = side.where("k <> 4").unionByName(side.where("k = 4").withColumn("k", F.lit(8)))
    assert {tuple(r) for r in B.sidecar_problems(frame, odd, "k", "t").collect()} == {(3, "outside"), (4, "missing"), (8, "foreign")}
    assert spark.range(1).select(B.sorted_distinct(F.array(F.array(F.lit(3), F.lit(1)), F.array(F.lit(1)))).alias("x")).first().x == [1, 3]


def test_chosen():
    assert B.chosen(["a", "b", "c"], ["c", "a"], "a") == ["a", "c"]
    for bad in ([], ["a", "a"], ["z"], ["b"]):
        with pytest.raises(ValueError):
            B.chosen(["a", "b", "c"], bad, "a")
