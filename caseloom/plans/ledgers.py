"""Queries over the request ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.operators import ledger as L

from .base import Plans, Tables

P = Plans()
_ONCE = "once AS (SELECT * FROM request_ledger QUALIFY row_number() OVER (PARTITION BY request_hash, attempt ORDER BY recorded_at, entry_no) = 1)"
_STATE = f"""{_ONCE}, state AS (SELECT request_hash, CASE WHEN bool_or(status = 'accepted') THEN 'accepted' ELSE arg_max(status, (attempt, entry_no)) END AS state, count(DISTINCT attempt) AS attempts, max(attempt) AS last_attempt FROM once GROUP BY request_hash)"""


def once(t: Tables) -> DataFrame:
    return L.deliveries_once(t.request_ledger, "request_hash", "attempt", "recorded_at", "entry_no")


def state(t: Tables) -> DataFrame:
    return L.fold(once(t), "request_hash", "attempt", "status", "entry_no")


@P.add(f"WITH {_ONCE} SELECT entry_no, request_hash, attempt, status FROM once")
def ledger_once(t: Tables) -> DataFrame:
    return once(t).select("entry_no", "request_hash", "attempt", "status")


@P.add(f"WITH {_STATE} SELECT * FROM state")
def ledger_state(t: Tables) -> DataFrame:
    return state(t)


@P.add(f"WITH {_STATE} SELECT state, attempts, count(*) AS n FROM state GROUP BY 1, 2")
def ledger_status(t: Tables) -> DataFrame:
    return state(t).groupBy("state", "attempts").agg(F.count(F.lit(1)).alias("n"))


@P.add(f"WITH {_STATE.replace('FROM once GROUP', 'FROM once WHERE attempt = 1 GROUP')} SELECT request_hash, state, attempts, last_attempt FROM state WHERE state NOT IN ('accepted', 'pending') AND attempts < 3 ORDER BY attempts, request_hash LIMIT 20")
def budget_plan(t: Tables) -> DataFrame:
    """The 20 requests that a budget would send after the first wave of attempts."""
    first = L.fold(once(t).where("attempt = 1"), "request_hash", "attempt", "status", "entry_no")
    return L.open_requests(first, 20, "request_hash")


@P.add(f"""
WITH {_ONCE}, m AS (SELECT mode, (status IN ('rejected', 'api_error'))::INT AS f, row_number() OVER w AS n, sum(1 - (status IN ('rejected', 'api_error'))::INT) OVER (PARTITION BY mode ORDER BY requested_at, entry_no ROWS UNBOUNDED PRECEDING) AS g FROM once WINDOW w AS (PARTITION BY mode ORDER BY requested_at, entry_no)),
r AS (SELECT mode, g, count(*) AS n_failures, min(n) AS first_row, max(n) AS last_row FROM m WHERE f = 1 GROUP BY mode, g)
SELECT mode, row_number() OVER (PARTITION BY mode ORDER BY first_row) AS streak_no, n_failures, first_row, last_row FROM r""")
def failure_streaks(t: Tables) -> DataFrame:
    return L.streaks(once(t), "mode", ["requested_at", "entry_no"], F.col("status").isin("rejected", "api_error"), F.to_date("requested_at"))


@P.add(f"WITH {_ONCE} SELECT mode, status, count(*) AS n, sum(usage.prompt_tokens)::BIGINT AS prompt_tokens, sum(usage.completion_tokens)::BIGINT AS completion_tokens, sum(elapsed_seconds) AS seconds FROM once GROUP BY mode, status")
def ledger_usage(t: Tables) -> DataFrame:
    return once(t).groupBy("mode", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("usage.prompt_tokens").alias("prompt_tokens"), F.sum("usage.completion_tokens").alias("completion_tokens"), F.sum("elapsed_seconds").alias("seconds"))


@P.add(f"WITH {_ONCE} SELECT reason, count(DISTINCT request_hash) AS n_requests, count(*) AS n FROM once WHERE reason IS NOT NULL GROUP BY reason")
def rejection_reasons(t: Tables) -> DataFrame:
    return once(t).where("reason IS NOT NULL").groupBy("reason").agg(F.count_distinct("request_hash").alias("n_requests"), F.count(F.lit(1)).alias("n"))


_MODES = f"{_ONCE}, s AS (SELECT id, mode, bool_or(status = 'accepted') AS ok FROM once GROUP BY id, mode)"


@P.add(f"WITH {_MODES}, a AS (SELECT * FROM s WHERE mode = 'flat_v2'), b AS (SELECT * FROM s WHERE mode = 'bound_v2') SELECT coalesce(a.id, b.id) AS id, a.ok AS flat_ok, b.ok AS bound_ok FROM a FULL JOIN b ON a.id = b.id WHERE a.ok IS DISTINCT FROM b.ok")
def paired_state_changes(t: Tables) -> DataFrame:
    """Cases whose outcome differs between the two modes, or that only one mode has."""
    s = once(t).groupBy("id", "mode").agg(F.bool_or(F.col("status") == "accepted").alias("ok"))
    a, b = s.where("mode = 'flat_v2'").select("id", F.col("ok").alias("flat_ok")), s.where("mode = 'bound_v2'").select("id", F.col("ok").alias("bound_ok"))
    return a.join(b, "id", "full").where("NOT flat_ok <=> bound_ok")


@P.add(f"WITH {_MODES} SELECT t.id, m.mode, coalesce(s.ok, false) AS ok FROM (SELECT DISTINCT id FROM request_ledger) t CROSS JOIN (SELECT DISTINCT mode FROM request_ledger) m LEFT JOIN s ON s.id = t.id AND s.mode = m.mode WHERE s.ok IS NULL")
def missing_matrix_cells(t: Tables) -> DataFrame:
    """Cases without an entry under some mode (modes are few; each case is crossed with their list)."""
    modes = t.request_ledger.agg(F.collect_set("mode").alias("modes"))
    cells = t.request_ledger.select("id").distinct().crossJoin(F.broadcast(modes)).select("id", F.explode("modes").alias("mode"))
    return cells.join(t.request_ledger.select("id", "mode").distinct(), ["id", "mode"], "left_anti").select("id", "mode", F.lit(False).alias("ok"))


QUERIES, SQL = P.queries, P.sql
