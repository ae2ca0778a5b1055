"""Audits over several tables: protocols against what is there, claims against their texts, expectations against states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.text import quote_status

# ---- fixed values: how many claims a distilled opinion has, and how long it may be ----
CLAIMS, OPINION_CHARS = (1, 12), 1800
# ---------------------------------------------------------------------------------------


def protocol_differences(facts: DataFrame, protocol: dict[str, str]) -> DataFrame:
    """(name, expected, actual, same) of every setting that a frozen protocol names or that ``facts`` (name, actual) holds."""
    wanted = facts.sparkSession.createDataFrame(list(protocol.items()), "name string, expected string")
    both = facts.select("name", F.col("actual").cast("string").alias("actual")).join(wanted, "name", "full")
    return both.select("name", "expected", "actual", F.col("expected").eqNullSafe(F.col("actual")).alias("same"))


def distilled(claims: DataFrame, key: str, text: str, items: str) -> DataFrame:
    """(key, opinion, problem) of distilled opinions: an array of claims (claim, quote) each, joined by line breaks.

    Problems, first that applies: claim_count, empty_claim, quote_not_grounded
    (no single place in the text), too_long; the opinion is null with one.
    """
    x, source = F.col(items), F.col(text)
    n = F.coalesce(F.size(x), F.lit(0))
    joined = F.array_join(F.transform(x, lambda c: F.trim(c["claim"])), "\n")
    grounded = F.forall(x, lambda c: quote_status(source, c["quote"])["status"] == "found")
    problem = (
        F.when((n < CLAIMS[0]) | (n > CLAIMS[1]), "claim_count").when(F.exists(x, lambda c: F.coalesce(F.trim(c["claim"]), F.lit("")) == ""), "empty_claim")
        .when(~F.coalesce(grounded, F.lit(False)), "quote_not_grounded").when(F.char_length(joined) > OPINION_CHARS, "too_long")
    )
    return claims.select(key, F.when(problem.isNull(), joined).alias("opinion"), problem.alias("problem"))


def agreement(expected: DataFrame, states: DataFrame, key: list[str], by: str) -> DataFrame:
    """(by, total, matched, absent) of expected states (key, state) against found ones (key, by, state).

    Every expectation counts under every value of ``by``; a state that is
    missing is a mismatch, never left out.
    """
    groups = states.select(by).distinct()
    cells = expected.crossJoin(F.broadcast(groups)).join(states.withColumnRenamed("state", "__found"), [*key, by], "left")
    return cells.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("state") == F.col("__found")).alias("matched"), F.count_if(F.col("__found").isNull()).alias("absent"))


def package_differences(references: DataFrame, members: DataFrame, key: str, arms: list[str], same: list[str]) -> DataFrame:
    """(arm, key, problem) where a member table (arm, key, ``same`` columns) doesn't carry what the references do: missing, foreign, repeated, differs."""
    told = members.groupBy("arm", key).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(*same)).alias("__m"))
    wanted = references.select(key, F.struct(*same).alias("__r"), F.explode(F.array(*[F.lit(a) for a in arms])).alias("arm"))
    both = wanted.join(told, ["arm", key], "full")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("__r").isNull(), "foreign").when(F.col("n") > 1, "repeated").when(~F.col("__r").eqNullSafe(F.col("__m")), "differs")
    return both.select("arm", key, problem.alias("problem")).where("problem IS NOT NULL")


def without_column(df: DataFrame, key: str, column: str, sidecar: Column) -> tuple[DataFrame, DataFrame]:
    """(the frame without a column, what stands for it beside the frame as (key, spans)); all other columns as they were."""
    return df.drop(column), df.select(key, sidecar.alias("spans"))


def sidecar_problems(df: DataFrame, sidecar: DataFrame, key: str, text: str) -> DataFrame:
    """(key, problem) of a sidecar (key, spans of start_pos and end_pos) that doesn't fit its frame: missing, foreign or outside."""
    f, s = df.select(key, F.coalesce(F.char_length(text), F.lit(0)).alias("__n")), sidecar.select(key, "spans", F.lit(True).alias("__s"))
    inside = F.forall("spans", lambda x: (x["start_pos"] >= 0) & (x["start_pos"] < x["end_pos"]) & (x["end_pos"] <= F.col("__n")))
    problem = F.when(F.col("__s").isNull(), "missing").when(F.col("__n").isNull(), "foreign").when(~F.coalesce(inside, F.lit(True)), "outside")
    return f.join(s, key, "full").select(key, problem.alias("problem")).where("problem IS NOT NULL")


def sorted_distinct(arrays: Column) -> Column:
    """The distinct elements of an array of arrays, in order."""
    return F.array_sort(F.array_distinct(F.flatten(arrays)))


def chosen(names: list[str], wanted: list[str], needed: str | None = None) -> list[str]:
    """The wanted names in the order of ``names``; unknown or repeated ones, none, or a missing needed one are refused."""
    if not wanted or len(set(wanted)) != len(wanted) or not set(wanted) <= set(names) or (needed is not None and needed not in wanted):
        raise ValueError(f"choose distinct names among {names}" + (f", {needed} included" if needed else ""))
    return [n for n in names if n in wanted]
