"""Evaluation: strict answers against gold, coverage-gated summaries, paired comparisons, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions.text import char_rouge_l, parse_answer


def errors(gold: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """One row for each gold case: (key, charge, target, valid, prediction, absolute_error, char_rouge_l).

    Gold and predictions hold each key once.  A missing, cut-off (finish_reason
    length) or unparsable prediction is invalid; nothing is guessed.
    """
    got = predictions.select(key, parse_answer(F.col("text")).alias("__a"), "finish_reason")
    answer = F.when(F.coalesce(F.col("finish_reason"), F.lit("")) != "length", F.col("__a"))
    rows = gold.select(key, "charge", "opinion", F.col("sentence_months").alias("target")).join(got, key, "left")
    value = answer["sentence_months"]
    return rows.select(
        key, "charge", "target", value.isNotNull().alias("valid"), value.alias("prediction"), F.abs(value - F.col("target")).alias("absolute_error"),
        F.when(value.isNotNull() & F.col("opinion").isNotNull(), char_rouge_l(F.col("opinion"), answer["reasoning"])).alias("char_rouge_l"),
    )


def unknown_keys(gold: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """Predictions whose key no gold case has."""
    return predictions.join(gold.select(key), key, "left_anti")


def summary_columns() -> list[Column]:
    """n, valid, coverage, errors over valid rows, and over all rows (null unless all are valid)."""
    n, valid = F.count(F.lit(1)), F.coalesce(F.sum(F.col("valid").cast("bigint")), F.lit(0))
    mae = F.avg(F.when(F.col("valid"), F.col("absolute_error")))
    rmse = F.sqrt(F.avg(F.when(F.col("valid"), F.col("absolute_error").cast("double") * F.col("absolute_error"))))
    return [n.alias("n"), valid.alias("n_valid"), F.try_divide(valid, n).alias("coverage"), mae.alias("mae_valid"), rmse.alias("rmse_valid"), F.when(valid == n, mae).alias("mae_full"), F.when(valid == n, rmse).alias("rmse_full")]


def rouge_columns() -> list[Column]:
    """Mean character similarity of reasoning and opinion, and the number of valid answers that have an opinion."""
    return [F.avg("char_rouge_l").alias("mean_rouge"), F.count("char_rouge_l").alias("n_rouge")]


def summarize(detail: DataFrame, *by: str) -> DataFrame:
    return detail.groupBy(*by).agg(*summary_columns()) if by else detail.agg(*summary_columns())


def paired(first: DataFrame, second: DataFrame, key: str = "id") -> DataFrame:
    """(key, delta) of cases valid on both sides: second error minus first."""
    a = first.where("valid").select(key, F.col("absolute_error").alias("__a"))
    return a.join(second.where("valid").select(key, F.col("absolute_error").alias("__b")), key).select(key, (F.col("__b") - F.col("__a")).alias("delta"))


def _weights(key: Column, seed: int) -> tuple[Column, Column]:
    """Start and step of a key's points in the samples: 28-bit numbers of its md5, which SQL engines share."""
    h = F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(h, 1, 7), 16, 10).cast("bigint"), F.conv(F.substring(h, 8, 7), 16, 10).cast("bigint")


#: A prime (2^31 - 1); a key's point in sample b is (start + b x step) modulo it.
PRIME = 2_147_483_647
#: Points at or above which a Poisson(1) weight is at least 1, 2, ... (fixed values: the distribution in millionths).
POISSON = (367_879, 735_759, 919_699, 981_012, 996_340, 999_406, 999_917, 999_990, 999_999)


def bootstrap(deltas: DataFrame, key: str = "id", samples: int = 2000, seed: int = 42) -> DataFrame:
    """(n, mean_delta, ci_low, ci_high): percentile interval of the mean under resampling.

    Poisson bootstrap: each case enters each sample with a Poisson(1) weight
    hashed from its key and the sample's number, so samples need no positions.
    A partition makes the weights of all samples in one Arrow pass and hands on
    one sum a sample.  The ends are the means at places int(0.025 x samples) and
    int(0.975 x samples) of their order.
    """
    import numpy as np
    import pyarrow as pa

    if samples < 100:
        raise ValueError("use at least 100 samples")
    start, step = _weights(F.col(key), seed)

    def run(batches):
        total, weight = np.zeros(samples), np.zeros(samples)
        b = np.arange(samples, dtype=np.int64)
        for batch in batches:
            a, s, d = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "s", "d"))
            for low in range(0, len(a), 1000):
                point = (a[low : low + 1000, None] + b * s[low : low + 1000, None]) % PRIME * 1_000_000 // PRIME
                w = np.searchsorted(np.array(POISSON), point, side="right")
                total += d[low : low + 1000] @ w
                weight += w.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(total), pa.array(weight)], names=["b", "t", "w"])

    rows = deltas.where("delta IS NOT NULL").select(start.alias("a"), step.alias("s"), F.col("delta").cast("double").alias("d"))
    means = rows.mapInArrow(run, "b bigint, t double, w double").groupBy("b").agg(F.try_divide(F.sum("t"), F.sum("w")).alias("m"))
    sorted_means = F.sort_array(F.collect_list("m"))  # one number a sample
    at = [int(samples * p) for p in (0.025, 0.975)]
    ends = means.agg(*[F.get(sorted_means, F.lit(min(samples - 1, i))).alias(name) for i, name in zip(at, ("ci_low", "ci_high"))])
    return deltas.agg(F.count("delta").alias("n"), F.avg("delta").alias("mean_delta")).crossJoin(F.broadcast(ends))


def compare(first: DataFrame, second: DataFrame, key: str = "id", samples: int = 2000, seed: int = 42) -> DataFrame:
    """(status, n, n_valid, mean_delta, ci_low, ci_high) of two arms over the same cases.

    Refused (status partial_coverage, no figures) unless every case is valid on
    both sides: failures are neither left out nor counted as zero.
    """
    a = first.select(key, F.col("valid").alias("__x"))
    seen = a.join(second.select(key, F.col("valid").alias("__y")), key, "full").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("__x") & F.col("__y"), F.lit(False))).alias("n_valid"))
    figures = bootstrap(paired(first, second, key), key, samples, seed).drop("n")
    full = F.col("n") == F.col("n_valid")
    return seen.crossJoin(F.broadcast(figures)).select(F.when(full, "compared").otherwise("partial_coverage").alias("status"), "n", "n_valid", *[F.when(full, F.col(c)).alias(c) for c in ("mean_delta", "ci_low", "ci_high")])


def common_valid(details: DataFrame, arm: str, n_arms: int, key: str = "id") -> DataFrame:
    """Keys that are valid in every arm."""
    return details.where("valid").select(key, arm).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == n_arms).select(key)


def weighted_median(df: DataFrame, group: str, value: str, mass: str) -> DataFrame:
    """(group, median_value, mean_value, total_mass): the first value at which half the mass is reached."""
    w = Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = df.where(F.col(value).isNotNull() & (F.col(mass) > 0)).groupBy(group, value).agg(F.sum(mass).alias("m"))
    whole = per.groupBy(group).agg(F.sum("m").alias("total_mass"), (F.sum(F.col("m") * F.col(value)) / F.sum("m")).alias("mean_value"))
    run = per.withColumn("c", F.sum("m").over(w)).join(whole, group)
    return run.where(F.col("c") >= 0.5 * F.col("total_mass")).groupBy(group).agg(F.min(value).alias("median_value"), F.first("mean_value").alias("mean_value"), F.first("total_mass").alias("total_mass"))


def number_summary(df: DataFrame, group: str, value: str, mass: str, greedy: str | None = None, top: int = 8, least: float = 1e-3) -> DataFrame:
    """(group, median_value, mean_value, top_values, pruned_mass[, greedy_value]) of weighted numbers.

    Values of less than ``least`` of a group's mass are pruned before the rest
    is read; ``top_values`` are the heaviest, heaviest first, ties by value.
    """
    per = df.where(F.col(value).isNotNull() & (F.col(mass) > 0)).groupBy(group, value).agg(F.sum(mass).alias("m"), *([F.max(greedy).alias("greedy_value")] if greedy else []))
    whole = per.groupBy(group).agg(F.sum("m").alias("t"))
    shares = per.join(whole, group).withColumn("m", F.col("m") / F.col("t"))
    kept = shares.where(F.col("m") >= least)
    w = Window.partitionBy(group)
    run = kept.withColumn("c", F.sum("m").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("k", F.sum("m").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("m"), value)))
    tops = F.transform(F.sort_array(F.collect_list(F.when(F.col("r") <= top, F.struct("r", F.col(value).alias("v"))))), lambda x: x["v"])
    return run.groupBy(group).agg(
        F.min(F.when(F.col("c") >= F.col("k") * 0.5, F.col(value))).alias("median_value"), (F.sum(F.col("m") * F.col(value)) / F.sum("m")).alias("mean_value"), tops.alias("top_values"),
        (1 - F.sum("m")).alias("pruned_mass"), *([F.max("greedy_value").alias("greedy_value")] if greedy else []),
    )


def quantiles(df: DataFrame, value: str, *by: str) -> DataFrame:
    """mean, min, p10, p25, median, p75, p90 and max with linear interpolation."""
    q = F.percentile(value, F.array(*[F.lit(p) for p in (0.1, 0.25, 0.5, 0.75, 0.9)]))
    cols = [F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), q.alias("__q"), F.max(value).alias("max")]
    out = df.groupBy(*by).agg(*cols) if by else df.agg(*cols)
    return out.select(*by, "n", "mean", "min", *[F.col("__q")[i].alias(name) for i, name in enumerate(("p10", "p25", "median", "p75", "p90"))], "max")


def total_variation(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """(distance) half the sum of absolute differences of the two distributions of a value; null is a value of its own."""
    def shares(df: DataFrame, name: str) -> DataFrame:
        n = df.groupBy(F.coalesce(F.col(value).cast("string"), F.lit("\u0000null")).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("t")))).select("v", (F.col("n") / F.col("t")).alias(name))

    both = shares(left, "p").join(shares(right, "q"), "v", "full")
    return both.agg((F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))) / 2).alias("distance"))


def reweighted_mean(left: DataFrame, right: DataFrame, group: str, value: str) -> DataFrame:
    """(mean): the left means of each group under the right side's shares of those groups."""
    means = left.groupBy(group).agg(F.avg(value).alias("m"))
    n = right.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return n.join(means, group).where("m IS NOT NULL").agg(F.try_divide(F.sum(F.col("n") * F.col("m")), F.sum("n")).alias("mean"))


def frame_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either frame that the other lacks, repeated rows counted, with ``side``; empty if both hold the same."""
    cols = sorted(left.columns)
    if cols != sorted(right.columns):
        raise ValueError("the frames have different columns")
    a, b = left.select(*cols), right.select(*cols)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def vector_differences(vectors: DataFrame, reference: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, max_abs, same): the greatest absolute difference of each vector from the one reference row.

    Null for a vector of another length; ``reference`` is a single row and is broadcast.
    """
    one = F.broadcast(reference.limit(1).select(F.col(vector).alias("__r")))
    gap = F.array_max(F.zip_with(F.col(vector), F.col("__r"), lambda a, b: F.abs(a.cast("double") - b.cast("double"))))
    fits = F.size(vector) == F.size("__r")
    return vectors.crossJoin(one).select(key, F.when(fits, gap).alias("max_abs"), (F.col(vector) == F.col("__r")).alias("same"))
