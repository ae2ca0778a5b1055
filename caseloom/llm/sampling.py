"""Problem 5: a sample whose categories have given shares.

Method: each category's acceptance probability is its quota over its number of
rows; rows are drawn independently (by hash, so reruns agree) with slight
oversampling, then the counts are corrected exactly and deficits reported.

The exact correction needs the quota-th smallest hash of each category.  It is
found without sorting a category in one task: hashes are counted in 4096 bins a
category (pre-aggregated), which leaves one bin a category to rank; the rows
of that bin are ranked on their own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import hashed_point

BINS = 4096


def charge_form(charge: Column | str) -> Column:
    """A charge without brackets, blanks, commas and a final 罪; null for null and for what leaves nothing."""
    c = F.col(charge) if isinstance(charge, str) else charge
    plain = F.regexp_replace(c, r"[\[\]【】［］()（）,，、\p{IsWhite_Space}\x{200B}\x{FEFF}]", "")
    plain = F.regexp_replace(plain, "罪$", "")
    return F.when(F.length(plain) > 0, plain)


def candidates(rows: DataFrame, targets: DataFrame, identifier: str, charge: str, order: str) -> DataFrame:
    """The rows whose category is listed, each identifier once (its row of least ``order``), with ``category`` as listed.

    Rows with a null identifier stand for themselves.
    """
    listed = targets.where("charge IS NOT NULL").groupBy(charge_form("charge").alias("__c")).agg(F.min("charge").alias("category"))
    keyed = rows.withColumn("__c", charge_form(charge)).join(F.broadcast(listed), "__c").drop("__c")
    same = F.coalesce(F.col(identifier), F.concat(F.lit("\u0001"), F.col(order).cast("string")))
    first = keyed.groupBy(same.alias("__id")).agg(F.min(order).alias("__first"))
    return keyed.join(first.select(F.col("__first").alias(order)), order, "left_semi")


def quotas(found: DataFrame, targets: DataFrame, fraction: float = 0.1) -> DataFrame:
    """(charge, target_share, min_rows, n_rows, wanted, deficit) of every listed category.

    ``wanted`` is the greater of min_rows and ceil(target_share x S) with
    S = floor(fraction x all candidate rows); the listed categories are few.
    """
    n = found.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    size = F.floor(F.round(F.col("total") * fraction, 6))
    least = F.coalesce("min_rows", F.lit(0))
    wanted = F.greatest(least, F.ceil(F.round(F.coalesce("target_share", F.lit(0.0)) * size, 6)))
    return (
        targets.where("charge IS NOT NULL").join(n, F.col("charge") == F.col("category"), "left").crossJoin(F.broadcast(total))
        .select("charge", "target_share", "min_rows", F.coalesce("n", F.lit(0)).alias("n_rows"), wanted.cast("bigint").alias("wanted"))
        .withColumn("deficit", F.greatest(F.col("wanted") - F.col("n_rows"), F.lit(0)))
    )


def proportional_sample(found: DataFrame, wanted: DataFrame, key: str, seed: int = 42, extra: float = 4.0) -> DataFrame:
    """Exactly min(wanted, n_rows) rows of each category.

    ``wanted`` is what ``quotas`` gives.  A category is accepted with
    probability (wanted + extra x sqrt(wanted) + 8) / n_rows; should chance
    leave fewer than wanted (odds below one in ten thousand), the whole category
    is taken into the correction instead.  Ties of hashes are broken by key.
    """
    plan = [r for r in wanted.collect() if r["n_rows"] and r["wanted"]]  # as many rows as listed categories
    spark = found.sparkSession
    if not plan:
        return found.where(F.lit(False))
    rate = [(r["charge"], min(r["wanted"], r["n_rows"]), min(1.0, (r["wanted"] + extra * math.sqrt(r["wanted"]) + 8) / r["n_rows"])) for r in plan]
    point = hashed_point(seed, key)
    drawn = found.join(F.broadcast(spark.createDataFrame(rate, "category string, __wanted bigint, __rate double")), "category").withColumn("__at", point)
    some = drawn.where("__at < __rate").withColumn("__bin", F.floor(F.col("__at") / F.col("__rate") * BINS))
    counts = some.groupBy("category", "__bin").agg(F.count(F.lit(1)).alias("n"), F.first("__wanted").alias("w"))
    reached = {r["category"]: r["n"] for r in counts.groupBy("category").agg(F.sum("n").alias("n")).collect()}
    missed = [c for c, w, _ in rate if reached.get(c, 0) < w]
    if missed:
        some = drawn.where((F.col("__at") < F.col("__rate")) | F.col("category").isin(missed)).withColumn("__bin", F.floor(F.col("__at") * BINS))
        counts = some.groupBy("category", "__bin").agg(F.count(F.lit(1)).alias("n"), F.first("__wanted").alias("w"))
    # At most BINS rows a category stand in this window.
    before = F.sum("n").over(Window.partitionBy("category").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1))
    edges = counts.withColumn("b", F.coalesce(before, F.lit(0))).where("b < w AND b + n >= w").select("category", F.col("__bin").alias("__edge"), (F.col("w") - F.col("b")).alias("__take"))
    placed = some.join(F.broadcast(edges), "category")
    rank = F.row_number().over(Window.partitionBy("category").orderBy("__at", key))
    edge = placed.where("__bin = __edge").withColumn("__rank", rank).where("__rank <= __take").drop("__rank")
    return placed.where("__bin < __edge").unionByName(edge).drop("__wanted", "__rate", "__at", "__bin", "__edge", "__take")


def sample_report(drawn: DataFrame, wanted: DataFrame) -> DataFrame:
    """(charge, target_share, min_rows, n_rows, wanted, n_drawn, reached_share, deficit) of a drawn sample.

    ``drawn`` is what ``proportional_sample`` gives for ``wanted``.  The deficit
    is what the sample lacks after its correction, not what a count foretells;
    the list of categories is fixed and small.
    """
    n = drawn.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    got = F.coalesce("n", F.lit(0))
    return wanted.drop("deficit").join(n, F.col("charge") == F.col("category"), "left").crossJoin(F.broadcast(total)).select(
        "charge", "target_share", "min_rows", "n_rows", "wanted", got.alias("n_drawn"), F.try_divide(got, "total").alias("reached_share"), F.greatest(F.col("wanted") - got, F.lit(0)).alias("deficit")
    )


def short_categories(drawn: DataFrame, wanted: DataFrame) -> DataFrame:
    """(charge) of the categories of which the drawn sample holds fewer rows than wanted."""
    return sample_report(drawn, wanted).where("deficit > 0").select("charge")
