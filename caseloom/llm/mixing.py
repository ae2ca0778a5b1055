"""Problem 8: a mixture in which each source makes up a target share of all tokens.

Method: Poisson replication.  Each source has a mean repetition rate; each
document draws its count by inverting the Poisson distribution at a point
hashed from its key, is exploded by that count and shuffled globally by hash.
Counts are cut at the source's cap, and the rate is raised so that the mean
after the cut is still the one wanted; a source whose rate would pass its cap
is taken cap times whole and falls short, which the report shows.

The plan per source is as long as the list of targets; nothing else is
gathered.  Everything after it is a broadcast join, a filter and an explode.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _chance(rate: float, k: int) -> float:
    """Probability of k, by logarithms so that great rates and caps neither vanish nor overflow."""
    return math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) if rate > 0 else float(k == 0)


def _cut_mean(rate: float, cap: int) -> float:
    """Mean of a Poisson count cut at cap."""
    total, below = 0.0, 0.0
    for k in range(cap):
        p = _chance(rate, k)
        total += k * p
        below += p
    return total + cap * max(0.0, 1 - below)


def rate_for(mean: float, cap: int) -> float | None:
    """The Poisson rate whose count, cut at cap, has the given mean; None where the cap itself is the mean or less."""
    if mean >= cap:
        return None
    low, high = 0.0, 1.0
    while _cut_mean(high, cap) < mean:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if _cut_mean(middle, cap) < mean else (low, middle)
    return high


def thresholds(mean: float, cap: int) -> list[float]:
    """Points of the inverse distribution: the count of a document is the number of them at or below its point."""
    rate = rate_for(mean, cap)
    if rate is None:
        return [-1.0] * cap
    out, below = [], 0.0
    for k in range(cap):
        below += _chance(rate, k)
        out.append(below)
    return out


def source_plan(counted: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, tokens, wanted, mean_repeats, short) of every target source.

    ``counted`` holds (source, n_tokens) of all documents, other and null
    sources included; ``total`` is the size of the mixture, by default the
    tokens of all documents.  ``short`` tells that the source can't reach its
    share within its cap.
    """
    sums = counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    whole = F.lit(total).cast("bigint") if total is not None else F.col("__all")
    everything = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("__all"))
    rows = targets.where("source IS NOT NULL").join(sums, "source", "left").crossJoin(F.broadcast(everything))
    tokens = F.coalesce("tokens", F.lit(0))
    wanted = F.coalesce("target_share", F.lit(0.0)) * whole
    cap = F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))
    return rows.select(
        "source", "target_share", cap.alias("max_repeats"), tokens.alias("tokens"), wanted.alias("wanted"),
        F.when(tokens > 0, F.least(wanted / tokens, cap.cast("double"))).otherwise(0.0).alias("mean_repeats"),
        (tokens * cap < wanted).alias("short"),
    )


def replicate(counted: DataFrame, plan: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """The mixture: every row of ``counted`` as often as it was drawn, with ``copy`` from 1 and ``place`` for the global order.

    The plan has one row a target source and is collected (it is as long as the
    list of targets).  Rows of other or null sources aren't used.
    """
    rows = [(r["source"], thresholds(r["mean_repeats"], int(r["max_repeats"]))) for r in plan.collect() if r["mean_repeats"] > 0 and r["max_repeats"] > 0]
    known = counted.sparkSession.createDataFrame(rows, "source string, __steps array<double>")
    point = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("count"), F.col(key)), 11).cast("double") / float(1 << 53)
    drawn = counted.join(F.broadcast(known), "source").withColumn("__u", point)
    n = F.size(F.filter("__steps", lambda x: x <= F.col("__u")))
    copies = drawn.withColumn("__n", n).where("__n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__steps", "__u", "__n")
    return copies.withColumn("place", F.xxhash64(F.lit(seed), F.lit("place"), F.col(key), F.col("copy")))


def shuffled(mixture: DataFrame, key: str) -> DataFrame:
    """The mixture in its global random order."""
    return mixture.orderBy("place", key, "copy")


def reached_shares(mixture: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, tokens, wanted, short, n_rows, mixed_tokens, reached_share, most_copies) of every target source."""
    got = mixture.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_tokens").alias("mixed_tokens"), F.max("copy").alias("most_copies"))
    whole = got.agg(F.sum("mixed_tokens").alias("__all"))
    return plan.join(got, "source", "left").crossJoin(F.broadcast(whole)).select(
        "source", "target_share", "max_repeats", "tokens", "wanted", "short", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"),
        F.try_divide(F.coalesce("mixed_tokens", F.lit(0)), "__all").alias("reached_share"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
    )


def short_sources(mixture: DataFrame, plan: DataFrame) -> DataFrame:
    """(source) of the target sources that fall short in the mixture itself although nothing of them is left to add.

    A source is used up if the mixture holds max_repeats times its tokens; one
    that is used up and still lacks tokens can't reach its share.  A source
    that chance left below its share has documents to spare and isn't short.
    """
    used_up = F.col("mixed_tokens") >= F.col("tokens") * F.col("max_repeats")
    return reached_shares(mixture, plan).where(used_up & (F.col("mixed_tokens") < F.col("wanted"))).select("source")
