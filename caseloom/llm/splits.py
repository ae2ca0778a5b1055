"""Problem 4: splits in given shares that keep all records of an entity together.

Method: connected components over records that share any entity (alternating
large-star and small-star steps over record-entity edges, in the core), then
each component's hash falls into one of consecutive ranges as wide as the
shares.  Rows whose components straddle today's splits come from the same
components.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.operators.components import record_components
from caseloom.session import cut, join_unique

from .batches import hashed_point


def source_entity(dataset: str = "dataset", source_id: str = "source_id") -> Column:
    """One spelling of a source: dataset and source_id without regard to letter case, outer blanks and a leading ./ of source_id.

    Null where either is null.
    """
    path = F.regexp_replace(F.lower(F.trim(F.col(source_id))), r"^\./", "")
    return F.when(F.col(dataset).isNotNull() & F.col(source_id).isNotNull(), F.concat_ws("\u0001", F.lower(F.trim(F.col(dataset))), F.trim(path)))


def assign_splits(df: DataFrame, key: str, entities: list[Column | str], targets: DataFrame, seed: int = 42) -> DataFrame:
    """(key, first_key, new_split) of every row; first_key is the least key of its component.

    ``targets`` holds (split, share); shares are scaled to a sum of one and the
    splits ordered by name, so the ranges are the same in every run.  Rows of
    one component share a split; rows without any entity are drawn alone, by
    their key.  Shares are met in expectation over components: one component
    that holds a third of all rows moves the shares by as much.
    """
    shares = sorted((r["split"], r["share"]) for r in targets.select("split", "share").where("split IS NOT NULL AND share > 0").collect())
    if not shares:
        raise ValueError("no split has a positive share")
    whole, reached, pick = sum(x for _, x in shares), 0.0, None
    for name, share in shares[:-1]:
        reached += share / whole
        pick = F.when(F.col("__point") < reached, name) if pick is None else pick.when(F.col("__point") < reached, name)
    last = F.lit(shares[-1][0])
    split = last if pick is None else pick.otherwise(last)
    parts = cut(record_components(df, key, entities), "parts")
    first = parts.groupBy("component").agg(F.min(key).alias("first_key"), F.count(F.lit(1)).alias("n"))
    placed = first.withColumn("__point", hashed_point(seed, "first_key")).select("component", "first_key", split.alias("new_split"))
    return join_unique(parts, placed, ["component"], counts=first.select("component", "n")).select(key, "first_key", "new_split")


def split_report(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """(split, target_share, n_rows, share) of an assignment; splits without rows come with zero."""
    n = assigned.groupBy(F.col("new_split").alias("split")).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    whole = targets.where("share > 0").agg(F.sum("share").alias("whole"))
    return targets.where("split IS NOT NULL").join(n, "split", "left").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(whole)).select(
        "split", (F.col("share") / F.col("whole")).alias("target_share"), F.coalesce("n", F.lit(0)).alias("n_rows"), (F.coalesce("n", F.lit(0)) / F.col("total")).alias("share")
    )


def straddling_rows(df: DataFrame, key: str, entities: list[Column | str], split: str) -> DataFrame:
    """Keys of all rows whose component carries more than one split value today.

    Rows with a null split or without any entity are left out.
    """
    some = None
    for e in entities:
        there = F.col(e).isNotNull() if isinstance(e, str) else e.isNotNull()
        some = there if some is None else some | there
    rows = df.where(F.col(split).isNotNull() & some)
    parts = cut(record_components(rows, key, entities, [split]), "parts")
    mixed = parts.groupBy("component").agg(F.min(split).alias("low"), F.max(split).alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high")
    return join_unique(parts, mixed.select("component"), ["component"], counts=mixed).select(key)
