"""Screens: records withheld from every table that carries them, and guards on what a screen may remove."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quarantined(records: DataFrame, key: str, hits: Column) -> DataFrame:
    """(key, hits) of the records with any hit (an array); each record once however often it stands."""
    return records.select(key, hits.alias("hits")).where(F.size("hits") > 0).groupBy(key).agg(F.min("hits").alias("hits"))


def withhold(tables: dict[str, DataFrame], key: str, held: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of quarantined records."""
    ids = held.select(key).where(F.col(key).isNotNull()).distinct()
    return {name: table.join(ids, key, "left_anti") for name, table in tables.items()}


def screen_guards(before: DataFrame, after: DataFrame, split: str, classes: str, least: float = 0.5) -> DataFrame:
    """(split, n_before, n_after, lost_classes, problem) of each split of a screened table.

    Problems: emptied, too_many_removed (fewer than ``least`` kept), class_lost;
    null where the screen may stand.
    """
    b = before.groupBy(split, classes).agg(F.count(F.lit(1)).alias("b"))
    a = after.groupBy(split, classes).agg(F.count(F.lit(1)).alias("a"))
    both = b.join(a, b[split].eqNullSafe(a[split]) & b[classes].eqNullSafe(a[classes]), "left").select(b[split], "b", F.coalesce("a", F.lit(0)).alias("a"))
    out = both.groupBy(split).agg(F.sum("b").alias("n_before"), F.sum("a").alias("n_after"), F.count_if(F.col("a") == 0).alias("lost_classes"))
    problem = F.when(F.col("n_after") == 0, "emptied").when(F.col("n_after") < F.col("n_before") * least, "too_many_removed").when(F.col("lost_classes") > 0, "class_lost")
    return out.withColumn("problem", problem)


def arm_pairing(arms: DataFrame, key: str, arm: str, wanted: list[str]) -> DataFrame:
    """(key, arm, problem) where arms don't hold the same records: missing or repeated."""
    n = arms.where(F.col(arm).isin(*wanted)).groupBy(key, arm).agg(F.count(F.lit(1)).alias("n"))
    cells = n.select(key).distinct().select(key, F.explode(F.array(*[F.lit(x) for x in wanted])).alias(arm)).join(n, [key, arm], "left")
    return cells.select(key, arm, F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").alias("problem")).where("problem IS NOT NULL")


def unexposed(pool: DataFrame, seen: DataFrame, key: str, source: list[str]) -> DataFrame:
    """The rows of a pool that share neither their key nor their source with anything seen; nulls match nothing."""
    out = pool.join(seen.select(key).distinct(), key, "left_anti")
    return out.join(seen.select(*source).distinct(), source, "left_anti")
