"""Streaming queries driven over the test tables to completion, and annotation checks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.functions import text as X
from caseloom.operators import annotations as A
from caseloom.session import shared_folder
from caseloom.streaming import ledger as SL
from caseloom.streaming import windows as SW

from .base import Plans, Tables
from .ledgers import _STATE

P = Plans()


def _with_batch(df: DataFrame) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField("batch", T.IntegerType())])


def _run(t: Tables, stream: DataFrame, mode: str, schema) -> DataFrame:
    """A stream run over all that is there, its output appended to a folder with the batch it came in."""
    base = f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"

    def put(df: DataFrame, batch: int) -> None:
        # One folder a batch, written over: a batch that is run again after a loss doesn't stand twice.
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{base}/out/run={batch}")

    q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.schema(schema).parquet(f"{base}/out/run=*")


@P.add(f"WITH {_STATE} SELECT * FROM state")
def streamed_ledger_state(t: Tables) -> DataFrame:
    """Request states kept by a stream over the ledger; equal to the batch fold."""
    rows = SW.read_table_stream(t.spark, f"{t.sf_dir}/request_ledger.parquet", t.request_ledger)
    stream = SL.request_states(rows)
    out = _run(t, stream, "update", _with_batch(stream))
    return out.groupBy("request_hash").agg(F.max_by(F.struct("state", "attempts", "last_attempt"), "batch").alias("s")).select("request_hash", "s.*")


@P.add("SELECT request_hash, state, attempts, last_attempt, 'left' AS side FROM (SELECT '' AS request_hash, '' AS state, 0::BIGINT AS attempts, 0::BIGINT AS last_attempt) WHERE false")
def ledger_rebuilt_differs(t: Tables) -> DataFrame:
    """The streamed ledger state against the batch fold, both ways; nothing is left over."""
    from caseloom.operators.metrics import frame_differences

    from .ledgers import state

    return frame_differences(streamed_ledger_state(t), state(t))


@P.add("SELECT event_type, time_bucket(INTERVAL 1 hour, ts) AS start, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def streamed_hourly_counts(t: Tables) -> DataFrame:
    """Hourly counts by a stream in complete state: the last version of each window."""
    rows = SW.read_table_stream(t.spark, f"{t.sf_dir}/events.parquet", t.events).withColumn("ts", F.col("ts").cast("timestamp"))
    stream = SW.windowed_counts(rows, "ts", "event_type", "value")
    out = _run(t, stream, "update", _with_batch(stream))
    return out.groupBy("event_type", "start").agg(F.max_by(F.struct("n", "total"), "batch").alias("s")).select("event_type", "start", "s.*")


@P.add("""
WITH u AS (SELECT ref_no, facts, regexp_extract_all(facts, '[^。！？；\n]*[。！？；\n]+|[^。！？；\n]+') AS p FROM train_references WHERE facts <> ''),
n AS (SELECT ref_no, facts, p, unnest(generate_series(1, len(p))) AS k FROM u),
s AS (SELECT ref_no, facts, (k - 1)::INT AS i, p[k] AS quote, coalesce(list_sum(list_transform(p[1:k - 1], lambda x: len(x))), 0)::INT + CASE WHEN (k - 1) % 7 = 3 THEN 1 ELSE 0 END AS a, list_sum(list_transform(p[1:k], lambda x: len(x)))::INT AS b FROM n)
SELECT ref_no, i, CASE WHEN a >= b THEN 'outside' ELSE 'differs' END AS problem FROM s WHERE a >= b OR substring(facts, a + 1, b - a) <> quote""")
def span_problems(t: Tables) -> DataFrame:
    """Spans of all units, some shifted on purpose: those that no longer match their text."""
    units = F.transform(X.source_units("facts"), lambda u, i: F.struct((u["start_pos"] + F.when(i % 7 == 3, 1).otherwise(0)).alias("start_pos"), u["end_pos"].alias("end_pos"), u["text"].alias("quote")))
    return A.span_problems(t.train_references.where("facts <> ''").select("ref_no", "facts", units.alias("spans")), "ref_no", "facts", "spans")


@P.add("""
WITH c AS (SELECT id, charge, arm, finish_reason FROM (SELECT ref_no, id, charge FROM train_references) JOIN predictions USING (id)), g AS (SELECT id, charge,
  count(*) FILTER (WHERE coalesce(finish_reason, '') <> 'length') AS n_used, count(*) FILTER (WHERE coalesce(finish_reason, '') = 'length') AS n_dropped,
  count(*) FILTER (WHERE coalesce(finish_reason, '') <> 'length' AND arm <> 'direct') AS y, count(*) FILTER (WHERE coalesce(finish_reason, '') <> 'length' AND arm = 'direct') AS x FROM c GROUP BY id, charge)
SELECT id, charge, CASE WHEN n_dropped = 0 AND NOT (y > 0 AND x > 0) AND y + x > 0 THEN y > 0 END AS state,
  CASE WHEN n_dropped > 0 THEN 'binding_gate' WHEN y > 0 AND x > 0 THEN 'conflicting_evidence' WHEN y + x = 0 THEN 'insufficient_evidence' ELSE 'none' END AS reason, n_used, n_dropped FROM g""")
def reduced_observations(t: Tables) -> DataFrame:
    """Outputs as observations of a case's charge: arms support or refute, cut-off outputs are ineligible."""
    rows = t.train_references.select("id", "charge").join(t.predictions.select("id", "arm", "finish_reason"), "id")
    rows = rows.withColumn("yes", F.col("arm") != "direct").withColumn("ok", F.coalesce("finish_reason", F.lit("")) != "length")
    return A.reduce_observations(rows, "id", "charge", "yes", "ok")


QUERIES, SQL = P.queries, P.sql
