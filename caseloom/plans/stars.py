"""Extras that the reference has no counterpart of: star-schema aggregates, event windows, as-of join, vector search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import Plans, Tables

P = Plans()


@P.add("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice * (1 - l_discount)) AS sum_disc_price, avg(l_discount) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2023-09-02' GROUP BY 1, 2""")
def pricing_summary(t: Tables) -> DataFrame:
    rows = t.lineitem.where("l_shipdate <= TIMESTAMP '2023-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("sum_disc_price"), F.avg("l_discount").alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@P.add("""SELECT r_name, n_name, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY CUBE (r_name, n_name)""")
def cube_revenue(t: Tables) -> DataFrame:
    nations = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.cube("r_name", "n_name").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))


@P.add("SELECT event_type, time_bucket(INTERVAL 1 hour, ts) AS hour, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(t: Tables) -> DataFrame:
    w = t.events.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select("event_type", F.col("w.start").alias("hour"), "n", "total")


@P.add("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 minute THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, s""")
def event_sessions(t: Tables) -> DataFrame:
    s = t.events.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))
    return s.select("user_id", "first_ts", "last_ts", "n")


@P.add("SELECT p.event_id, max(v.ts) AS view_ts FROM events p LEFT JOIN events v ON v.user_id = p.user_id AND v.event_type = 'view' AND v.ts <= p.ts WHERE p.event_type = 'purchase' GROUP BY p.event_id")
def asof_view(t: Tables) -> DataFrame:
    """Each purchase with the user's last view at or before it: one window over the user's events, no pairs."""
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = t.events.withColumn("view_ts", F.max(F.when(F.col("event_type") == "view", F.col("ts"))).over(w))
    return rows.where("event_type = 'purchase'").select("event_id", "view_ts")


@P.add()
def approx_customers(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(F.approx_count_distinct("o_custkey").alias("n_customers"))


@P.add("""
WITH q AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score FROM q JOIN embeddings e ON q.vec_id <> e.vec_id)
SELECT query_id, vec_id, rank FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def cosine_topk(t: Tables) -> DataFrame:
    """The five nearest vectors of every query (ids divisible by 50), by exact cosine.

    Queries are a stated set, sent in blocks of a few thousand; every partition
    scores its rows against a block at once and keeps five a query, so only
    partial top lists are shuffled.
    """
    import numpy as np
    import pyarrow as pa

    rows = t.embeddings.select("vec_id", "embedding").where("embedding IS NOT NULL")
    queries = rows.where("vec_id % 50 = 0")
    n_blocks = max(1, -(-queries.count() // 4096))
    out = None
    for block in range(n_blocks):
        part = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == block).collect() if n_blocks > 1 else queries.collect()
        ids = np.array([r[0] for r in part], np.int64)
        sent = t.spark.sparkContext.broadcast((ids, np.array([r[1] for r in part], np.float64)))

        def top(batches, sent=sent):
            ids, q = sent.value
            if not len(ids):
                return
            q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)  # a zero vector is like none
            for b in batches:
                if not b.num_rows:
                    continue
                v = np.stack(b.column("embedding").to_numpy(zero_copy_only=False)).astype(np.float64)
                k = b.column("vec_id").to_numpy()
                score = q @ (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)).T
                score[ids[:, None] == k[None, :]] = -2
                at = np.lexsort((np.broadcast_to(k, score.shape), -score), axis=1)[:, :5]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, at.shape[1])), pa.array(k[at].ravel()), pa.array(np.take_along_axis(score, at, 1).ravel())], names=["query_id", "vec_id", "score"])

        one = rows.mapInArrow(top, "query_id bigint, vec_id bigint, score double").where("score > -1.5")
        out = one if out is None else out.unionByName(one)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where("rank <= 5").select("query_id", "vec_id", "rank")


@P.add("SELECT e.vec_id, list_max(list_transform(list_zip(e.embedding, r.embedding), lambda x: abs(x[1]::DOUBLE - x[2]::DOUBLE))) AS max_abs, e.embedding = r.embedding AS same FROM embeddings e CROSS JOIN (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) r")
def vector_differences(t: Tables) -> DataFrame:
    """Each vector against that of the first id."""
    from caseloom.operators.metrics import vector_differences as differences

    return differences(t.embeddings, t.embeddings.orderBy("vec_id").limit(1), "vec_id", "embedding")


QUERIES, SQL = P.queries, P.sql
