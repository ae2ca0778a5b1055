"""Reviewed decisions on records: checks of a plan against what was audited, and its application.

A plan is three tables: quarantine (id, reason), dismissals (id, kind) and
links (excluded, representative); an audit is two: flags (id, kind) and pairs
(left_id, right_id).  Nothing is applied while the plan has problems.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the reason that asks for a representative.
DUPLICATE = "reviewed_near_duplicate"


def _pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("left_id", "right_id").alias("__a"), F.greatest("left_id", "right_id").alias("__b")).distinct()


def plan_problems(records: DataFrame, flags: DataFrame, pairs: DataFrame, quarantine: DataFrame, dismissals: DataFrame, links: DataFrame, labels: list[str]) -> DataFrame:
    """(id, problem) of everything in a plan that its audit doesn't bear out.

    unknown_id, decided_twice, no_reason; dismissed_and_quarantined,
    flag_not_audited; not_quarantined_as_duplicate, pair_not_audited,
    own_representative, labels_differ (``labels`` of both, split included), and
    no_representative for duplicates without a link.
    """
    known = records.select("id")
    tell = lambda df, problem, col="id": df.select(F.col(col).alias("id"), F.lit(problem).alias("problem"))
    decided = quarantine.unionByName(dismissals.select("id", F.lit("-").alias("reason")))
    checks = [
        tell(decided.select("id").distinct().join(known, "id", "left_anti"), "unknown_id"),
        tell(quarantine.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "decided_twice"),
        tell(quarantine.where("coalesce(trim(reason), '') = ''"), "no_reason"),
        tell(dismissals.select("id").distinct().join(quarantine, "id", "left_semi"), "dismissed_and_quarantined"),
        tell(dismissals.join(flags, ["id", "kind"], "left_anti").select("id").distinct(), "flag_not_audited"),
    ]
    duplicates = quarantine.where(F.col("reason") == DUPLICATE).select(F.col("id").alias("excluded"))
    checks.append(tell(links.join(duplicates, "excluded", "left_anti"), "not_quarantined_as_duplicate", "excluded"))
    checks.append(tell(duplicates.join(links, "excluded", "left_anti"), "no_representative", "excluded"))
    checks.append(tell(links.where("excluded = representative"), "own_representative", "excluded"))
    keyed = links.withColumn("__a", F.least("excluded", "representative")).withColumn("__b", F.greatest("excluded", "representative"))
    checks.append(tell(keyed.join(_pairs(pairs), ["__a", "__b"], "left_anti"), "pair_not_audited", "excluded"))
    side = lambda name: records.select(F.col("id").alias(name), F.struct(*labels).alias("__" + name))
    both = links.join(side("excluded"), "excluded").join(side("representative"), "representative")
    checks.append(tell(both.where(~F.col("__excluded").eqNullSafe(F.col("__representative"))), "labels_differ", "excluded"))
    out = checks[0]
    for one in checks[1:]:
        out = out.unionByName(one)
    return out


def apply_plan(records: DataFrame, flags: DataFrame, pairs: DataFrame, quarantine: DataFrame, dismissals: DataFrame, links: DataFrame) -> DataFrame:
    """Every record once with ``part`` (quarantine, pending, retained), reason, representative, remaining_flags and unresolved_overlap.

    Pending are retained records with flags that weren't dismissed, or in an
    audited pair of which neither side is quarantined.
    """
    held = quarantine.groupBy("id").agg(F.min("reason").alias("reason"))
    left = flags.join(dismissals, ["id", "kind"], "left_anti").groupBy("id").agg(F.sort_array(F.collect_set("kind")).alias("remaining_flags"))
    gone = held.select("id")
    open_pairs = pairs.join(gone.withColumnRenamed("id", "left_id"), "left_id", "left_anti").join(gone.withColumnRenamed("id", "right_id"), "right_id", "left_anti")
    overlap = open_pairs.select(F.explode(F.array("left_id", "right_id")).alias("id")).distinct().withColumn("__overlap", F.lit(True))
    told = links.groupBy(F.col("excluded").alias("id")).agg(F.min("representative").alias("representative"))
    out = records.join(held, "id", "left").join(told, "id", "left").join(left, "id", "left").join(overlap, "id", "left")
    unresolved = F.coalesce("__overlap", F.lit(False))
    part = F.when(F.col("reason").isNotNull(), "quarantine").when(F.col("remaining_flags").isNotNull() | unresolved, "pending").otherwise("retained")
    free = part != "quarantine"
    return out.withColumn("part", part).withColumn("remaining_flags", F.when(free, F.col("remaining_flags"))).withColumn("unresolved_overlap", F.when(free, unresolved)).drop("__overlap")
