"""Group-safe splits and balanced samples.

Draws order rows by a hash of key and seed, so they are the same in every run
and on any number of executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.operators.components import entity_components
from caseloom.session import cut, join_unique


def draw_order(key: Column | str, seed: int = 42) -> Column:
    """md5 of ``key|seed``: a fixed random order that SQL engines share."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))


def per_class(df: DataFrame, classes: str, key: str, most: int, seed: int = 42) -> DataFrame:
    """At most ``most`` rows of each class, in draw order (a top-k per class, combined map-side by Spark's rank limit)."""
    rank = F.row_number().over(Window.partitionBy(classes).orderBy(draw_order(key, seed), key))
    return df.withColumn("rank_in_class", rank).where(F.col("rank_in_class") <= most)


def round_robin(df: DataFrame, classes: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows, one of each class in turn until classes run out."""
    return per_class(df, classes, key, n, seed).orderBy("rank_in_class", classes, key).limit(n)


def group_split(df: DataFrame, key: str, entities: list, stratum: str, dev_ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """(key, component, first_key, new_split): whole components go to dev or train, drawn per stratum.

    A component's stratum is the set of its rows' classes.  Of ``c`` components
    in a stratum min(c - 1, max(1, round half even of c x ratio)) go to dev, none
    if it is alone: those that come first by the draw order of their least key.
    No stratum is sorted in one task: orders are counted in 4,096 bins (their
    first three digits), and only the bin in which the number is reached is ranked.
    """
    if not 0 < dev_ratio < 1:
        raise ValueError("dev_ratio must lie between 0 and 1")
    parts = cut(entity_components(df, key, entities, [stratum]), "parts")
    groups = parts.groupBy("component").agg(F.array_join(F.sort_array(F.collect_set(stratum)), "|").alias("stratum"), F.min(key).alias("first_key"), F.count(F.lit(1)).alias("n"))
    groups = cut(groups.withColumn("o", draw_order("first_key", seed)).withColumn("bin", F.substring("o", 1, 3)), "groups")
    bins = groups.groupBy("stratum", "bin").agg(F.count(F.lit(1)).alias("in_bin"))
    counts = bins.groupBy("stratum").agg(F.sum("in_bin").alias("c"))
    n_dev = F.when(F.col("c") > 1, F.least(F.col("c") - 1, F.greatest(F.lit(1), F.bround(F.col("c") * dev_ratio, 0).cast("bigint")))).otherwise(0)
    before = F.sum("in_bin").over(Window.partitionBy("stratum").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    taken = bins.withColumn("before", F.coalesce(before, F.lit(0))).join(counts, "stratum").select("stratum", "bin", (n_dev - F.col("before")).alias("take")).where("take > 0")
    rank = F.row_number().over(Window.partitionBy("stratum", "bin").orderBy("o", "first_key"))
    dev = groups.join(taken, ["stratum", "bin"]).withColumn("r", rank).where("r <= take").select("component", F.lit("dev").alias("dev"))
    chosen = groups.join(dev, "component", "left").select("component", "first_key", F.coalesce("dev", F.lit("train")).alias("new_split"))
    return join_unique(parts, chosen, ["component"], counts=groups.select("component", "n")).select(key, "component", "first_key", "new_split")
