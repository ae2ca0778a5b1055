"""Request ledgers as keyed state: the latest entry, attempts, streaks and what a budget allows next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def deliveries_once(ledger: DataFrame, request: str, attempt: str, arrived: str, tie: str) -> DataFrame:
    """Each attempt of each request once: its first recorded entry."""
    w = Window.partitionBy(request, attempt).orderBy(arrived, tie)
    return ledger.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def fold(ledger: DataFrame, request: str, attempt: str, status: str, tie: str, done: tuple[str, ...] = ("accepted",)) -> DataFrame:
    """(request, state, attempts, last_attempt): a request is done once any attempt is, else it has its last attempt's status.

    One aggregation with a map-side part; no window, so no request gathers its attempts.
    """
    last = F.max_by(status, F.struct(attempt, tie))
    finished = F.max(F.when(F.col(status).isin(*done), F.col(status)))
    return ledger.groupBy(request).agg(F.coalesce(finished, last).alias("state"), F.count_distinct(attempt).alias("attempts"), F.max(attempt).alias("last_attempt"))


def open_requests(state: DataFrame, limit: int, request: str, done: tuple[str, ...] = ("accepted",), most_attempts: int = 3, uncertain: tuple[str, ...] = ("pending",)) -> DataFrame:
    """The next ``limit`` requests to send: neither done, uncertain nor out of attempts, fewest attempts first (a top-k)."""
    left = state.where(~F.col("state").isin(*done, *uncertain) & (F.col("attempts") < most_attempts))
    return left.orderBy("attempts", request).limit(limit)


def streaks(ledger: DataFrame, by: str, order: list[str], failed: Column, bucket: Column) -> DataFrame:
    """Runs of failures: (by, streak_no, n_failures, first_row, last_row) in the given order, for each value of ``by``.

    ``bucket`` cuts the order into ranges (a day of the first column, say).
    Runs are found within each range, so no value of ``by`` is sorted in one
    task; only the runs at the ends of ranges, two a range at most, are joined
    to those of their neighbours, and numbers are carried over range by range.
    """
    inner = Window.partitionBy(by, "__b").orderBy(*order)
    to_now = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = ledger.withColumn("__f", failed.cast("int")).withColumn("__b", bucket)
    marked = marked.withColumn("__n", F.row_number().over(inner)).withColumn("__g", F.sum(1 - F.col("__f")).over(to_now))
    ranges = Window.partitionBy(by).orderBy("__b")
    earlier = ranges.rowsBetween(Window.unboundedPreceding, -1)
    sizes = marked.groupBy(by, "__b").agg(F.count(F.lit(1)).alias("__size")).withColumn("__at", F.coalesce(F.sum("__size").over(earlier), F.lit(0)))
    runs = marked.where("__f = 1").groupBy(by, "__b", "__g").agg(F.count(F.lit(1)).alias("n_failures"), F.min("__n").alias("first"), F.max("__n").alias("last")).join(sizes, [by, "__b"])
    runs = runs.select(by, "__b", "n_failures", (F.col("first") + F.col("__at")).alias("first_row"), (F.col("last") + F.col("__at")).alias("last_row"), ((F.col("first") == 1) | (F.col("last") == F.col("__size"))).alias("edge"))
    ends = Window.partitionBy(by).orderBy("first_row")
    new = F.when(F.lag("last_row").over(ends) == F.col("first_row") - 1, 0).otherwise(1)
    edges = runs.where("edge").withColumn("__new", new).withColumn("__k", F.sum("__new").over(ends.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    joined = edges.groupBy(by, "__k").agg(F.min("__b").alias("__b"), F.sum("n_failures").alias("n_failures"), F.min("first_row").alias("first_row"), F.max("last_row").alias("last_row"))
    whole = runs.where("NOT edge").select(by, "__b", "n_failures", "first_row", "last_row").unionByName(joined.drop("__k"))
    before = whole.groupBy(by, "__b").agg(F.count(F.lit(1)).alias("__runs")).withColumn("__done", F.coalesce(F.sum("__runs").over(earlier), F.lit(0)))
    number = F.row_number().over(Window.partitionBy(by, "__b").orderBy("first_row")) + F.col("__done")
    return whole.join(before, [by, "__b"]).select(by, number.alias("streak_no"), "n_failures", "first_row", "last_row")


def pending_tasks(tasks: DataFrame, ledger: DataFrame, request: str) -> DataFrame:
    """Tasks whose request the ledger doesn't hold in any state (a pending entry counts: its outcome is uncertain)."""
    return tasks.join(ledger.where(F.col(request).isNotNull()).select(request).distinct(), request, "left_anti")


def respond(tasks: DataFrame, request: str, payload: str, responder) -> DataFrame:
    """(request, status, result, reason) of every task, answered by ``responder(payload) -> str``.

    The responder is any picklable function; it runs on the executors, once a
    row, and its exceptions become rejected entries instead of failing the job.
    Budgets belong before this: cut the tasks with ``open_requests`` or a limit.
    """
    import pandas as pd

    def run(frames):
        for frame in frames:
            rows = []
            for key, text in zip(frame["k"], frame["p"]):
                try:
                    rows.append((key, "accepted", responder(text), None))
                except Exception as error:
                    rows.append((key, "rejected", None, type(error).__name__))
            yield pd.DataFrame(rows, columns=[request, "status", "result", "reason"])

    return tasks.select(F.col(request).alias("k"), F.col(payload).alias("p")).mapInPandas(run, f"`{request}` string, status string, result string, reason string")
