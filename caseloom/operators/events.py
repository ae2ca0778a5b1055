"""Typed events of a text, reduced to one state a condition.

What a kind of event says, and what a condition asks of the actor, the scope
and the coverage of its events, are tables (small, fixed and broadcast after a
check of their size), not code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.kleene import state_name
from caseloom.session import fits_broadcast

# ---- fixed values: what an event may be bound to, and how many of a kind a text may have ----
ACTORS, SCOPES, COVERAGES = ("defendant", "proxy", "other", "unclear"), ("current_case", "prior_case", "unclear"), ("case_wide", "single_event", "unclear")
PER_KIND = 3
# ---------------------------------------------------------------------------------------------
MOST_ROWS = 10_000


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if fits_broadcast(table, MOST_ROWS) else table


def unit_spans(ids: Column, units: Column) -> Column:
    """The spans (start_pos, end_pos, quote) of unit ids, in their order; null if an id is unknown or stands twice."""
    found = F.transform(ids, lambda i: F.get(F.filter(units, lambda u: u["id"] == i), F.lit(0)))
    good = F.forall(found, lambda u: u.isNotNull()) & (F.size(F.array_distinct(ids)) == F.size(ids))
    return F.when(good, F.transform(found, lambda u: F.struct(u["start_pos"], u["end_pos"], u["text"].alias("quote"))))


def event_problems(observations: DataFrame, key: str, events: DataFrame, units: str = "units") -> DataFrame:
    """(key, no, problem) of observations (key, no, kind, actor, scope, coverage, unit_ids, units) that can't be used.

    unknown_kind, over_budget (more than PER_KIND of a kind), invalid_binding,
    invalid_units (none, unknown or repeated).
    """
    known = _small(events.select("kind", F.lit(True).alias("__k")))
    n = observations.groupBy(key, "kind").agg(F.count(F.lit(1)).alias("__n"))
    spans = unit_spans(F.col("unit_ids"), F.col(units))
    bound = F.col("actor").isin(*ACTORS) & F.col("scope").isin(*SCOPES) & F.col("coverage").isin(*COVERAGES)
    tests = [
        ("unknown_kind", F.col("__k").isNull()), ("over_budget", F.col("__n") > PER_KIND), ("invalid_binding", ~F.coalesce(bound, F.lit(False))),
        ("invalid_units", spans.isNull() | (F.size(spans) == 0)),
    ]
    rows = observations.join(known, "kind", "left").join(n, [key, "kind"], "left")
    return rows.select(key, "no", F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in tests]))).alias("problem"))


def reduce_events(records: DataFrame, observations: DataFrame, key: str, events: DataFrame, conditions: DataFrame, unmentioned: str = "not_mentioned") -> DataFrame:
    """(key, condition_id, state, reason, kinds, evidence, context) for every record and condition.

    ``events``: (kind, condition_id, effect: true, false or null for kinds that
    decide nothing).  ``conditions``: (condition_id, takes_proxy, scope,
    case_wide).  An event counts if its actor is the defendant (or a proxy where
    that is taken), its scope the condition's, and its coverage clear (and
    case-wide where asked).  Reasons, first that applies: not mentioned,
    partial_case_outcome (a case-wide condition met by part of a case),
    binding_unclear, conflicting_evidence, insufficient_evidence, none.
    Evidence are the distinct spans of what counted, in order; where the state
    is unknown all spans are context instead, which supports nothing.
    Observations of a record are few (PER_KIND of a kind), so no group is large.
    """
    rule = _small(events.join(conditions.withColumnRenamed("scope", "wanted_scope"), "condition_id"))
    o = observations.join(rule, "kind")
    actor = (F.col("actor") == "defendant") | ((F.col("actor") == "proxy") & F.col("takes_proxy"))
    eligible = actor & (F.col("scope") == F.col("wanted_scope")) & (F.col("coverage") != "unclear") & (~F.col("case_wide") | (F.col("coverage") == "case_wide"))
    usable = eligible & F.col("effect").isNotNull()
    partial = F.col("case_wide") & (F.col("actor") == "defendant") & (F.col("scope") == F.col("wanted_scope")) & (F.col("coverage") != "case_wide")
    unclear = (F.col("actor") == "unclear") | (F.col("scope") == "unclear") | (F.col("coverage") == "unclear")
    spans = unit_spans(F.col("unit_ids"), F.col("units"))
    in_order = lambda c: F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["s"])))
    per = o.groupBy(key, "condition_id").agg(
        F.max(partial).alias("partial"), F.max(unclear).alias("unclear"), F.count_if(usable & F.col("effect")).alias("yes"), F.count_if(usable & ~F.col("effect")).alias("no"),
        F.transform(F.sort_array(F.collect_list(F.struct("no", "kind"))), lambda x: x["kind"]).alias("kinds"), in_order(F.when(usable, F.struct("no", spans.alias("s")))).alias("used"), in_order(F.struct("no", spans.alias("s"))).alias("all"),
    )
    every = records.select(key).distinct().crossJoin(F.broadcast(conditions.select("condition_id")))
    out = every.join(per, [key, "condition_id"], "left")
    reason = (
        F.when(F.col("yes").isNull(), unmentioned).when(F.col("partial"), "partial_case_outcome").when(F.col("unclear"), "binding_unclear")
        .when((F.col("yes") > 0) & (F.col("no") > 0), "conflicting_evidence").when(F.col("yes") + F.col("no") == 0, "insufficient_evidence").otherwise("none")
    )
    known = reason == "none"
    nothing = F.array().cast(per.schema["all"].dataType)
    return out.select(
        key, "condition_id", state_name(F.when(known, F.col("yes") > 0)).alias("state"), reason.alias("reason"), F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"),
        F.when(known, F.col("used")).otherwise(nothing).alias("evidence"), F.when(known, nothing).otherwise(F.coalesce("all", nothing)).alias("context"),
    )
