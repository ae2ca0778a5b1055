"""Queries on three-valued logic, rule graphs and packaging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.functions.ids import snapshot_hash
from caseloom.functions.kleene import all_of, any_of, state_name, state_value
from caseloom.functions.text import opinion_or_null
from caseloom.operators import cases as K
from caseloom.operators import packaging as G
from caseloom.operators import rules as R

from .base import Plans, Tables
from .sqltext import json_text, trim

P = Plans()

#: A small invented bundle over conditions that the texts themselves decide.
BUNDLE = {
    "schema_version": 1,
    "conditions": [{"id": k, "text": k} for k in ("witness", "weighed", "returned", "long")],
    "rules": [
        {"id": "base", "charges": ["*"], "when": {"any": ["witness", "weighed"]}, "requires": [], "blocked_by": [], "effect": {"kind": "note", "text": "supported"}, "source": "invented", "version": "1", "review_status": "approved", "reviewer": "tests"},
        {"id": "open", "charges": ["*"], "when": {"not": "returned"}, "requires": ["base"], "blocked_by": [], "effect": {"kind": "note", "text": "open"}, "source": "invented", "version": "1", "review_status": "approved", "reviewer": "tests"},
        {"id": "brief", "charges": ["*"], "when": {"all": ["weighed", {"not": "long"}]}, "requires": [], "blocked_by": ["open"], "effect": {"kind": "note", "text": "brief"}, "source": "invented", "version": "1", "review_status": "approved", "reviewer": "tests"},
    ],
}
_STATES = """st AS (SELECT ref_no, CASE WHEN contains(facts, '称') THEN true END AS witness, CASE WHEN contains(facts, '经称量') THEN true WHEN contains(facts, '样本') THEN false END AS weighed,
  contains(facts, '退缴') AS returned, CASE WHEN facts IS NULL THEN NULL ELSE len(facts) > 300 END AS long FROM train_references)"""


def _states(t: Tables) -> DataFrame:
    f = F.col("facts")
    conditions = {"witness": F.when(F.contains(f, F.lit("称")), F.lit(True)), "weighed": F.when(F.contains(f, F.lit("经称量")), F.lit(True)).when(F.contains(f, F.lit("样本")), F.lit(False)), "returned": F.contains(f, F.lit("退缴")), "long": F.char_length(f) > 300}
    flat = [x for k, v in conditions.items() for x in (F.lit(k), v)]
    return t.train_references.select("ref_no", F.create_map(*flat).alias("states"))


@P.add(f"""WITH {_STATES}, r AS (SELECT ref_no, (witness OR weighed) AS base, returned, weighed, long FROM st), s AS (SELECT *, (NOT returned) AND base AS open FROM r), u AS (SELECT *, (weighed AND NOT long) AND NOT open AS brief FROM s)
SELECT ref_no, base AS rule_base, open AS rule_open, brief AS rule_brief FROM u""")
def rule_compose(t: Tables) -> DataFrame:
    return R.compose(_states(t), BUNDLE, "states").select("ref_no", "rule_base", "rule_open", "rule_brief")


@P.add(f"""WITH {_STATES}, r AS (SELECT (witness OR weighed) AS base FROM st) SELECT CASE WHEN base THEN 'supported' WHEN NOT base THEN 'refuted' ELSE 'unknown' END AS state, count(*) AS n FROM r GROUP BY 1""")
def rule_state_counts(t: Tables) -> DataFrame:
    return rule_compose(t).groupBy(state_name("rule_base").alias("state")).agg(F.count(F.lit(1)).alias("n"))


_V = "(VALUES ('supported', true), ('refuted', false), ('unknown', NULL)) v(name, x)"
_NAME = "CASE WHEN {0} THEN 'supported' WHEN NOT ({0}) THEN 'refuted' ELSE 'unknown' END"


@P.add(f"SELECT a.name AS left_state, b.name AS right_state, {_NAME.format('a.x AND b.x')} AS conjunction, {_NAME.format('a.x OR b.x')} AS disjunction, {_NAME.format('NOT a.x')} AS negation FROM {_V.replace('v(', 'a(')}, {_V.replace('v(', 'b(')}")
def kleene_truth_table(t: Tables) -> DataFrame:
    names = ["supported", "refuted", "unknown"]
    rows = t.spark.createDataFrame([(a, b) for a in names for b in names], "left_state string, right_state string")
    both = F.array(state_value("left_state"), state_value("right_state"))
    return rows.select("left_state", "right_state", state_name(all_of(both)).alias("conjunction"), state_name(any_of(both)).alias("disjunction"), state_name(~state_value("left_state")).alias("negation"))


@P.add("""
WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
c AS (SELECT src AS rule, dst AS reaches FROM e UNION SELECT c.rule, e.dst FROM c JOIN e ON c.reaches = e.src) SELECT rule, reaches FROM c""")
def edge_closure(t: Tables) -> DataFrame:
    """Transitive closure of an edge table (suppliers, nations, regions)."""
    n = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    s = t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst"))
    return R.closure(n.unionByName(s))


_CHAIN = "list_transform(str_split(line, ' -> '), lambda x: trim(x))"
_CHAIN_ID = "'chain_' || sha256('[\"any\",' || to_json(array_to_string(p, chr(1)))::VARCHAR || ']')[1:16]"


@P.add(f"""
WITH l AS (SELECT charge || ' -> situation -> outcome' AS line FROM charge_targets UNION ALL SELECT charge || ' -> outcome' FROM charge_targets), c AS (SELECT {_CHAIN} AS p FROM l)
SELECT CASE WHEN len(p) = 3 THEN {_CHAIN_ID} END AS rule_id, {_CHAIN_ID} || '_p' AS premise_id, {_CHAIN_ID} || '_s' AS situation_id, p[1] AS premise, p[2] AS situation, p[3] AS effect, 'any' AS charge, 'invented' AS source, '1' AS version, len(p) = 3 AS ok FROM c""")
def parsed_chains(t: Tables) -> DataFrame:
    """Chains ``a -> b -> c`` made of charges, read back."""
    whole, part = (F.concat_ws(" -> ", "charge", *map(F.lit, rest)) for rest in (("situation", "outcome"), ("outcome",)))
    lines = t.charge_targets.select(F.explode(F.array(whole, part)).alias("line"))
    return R.parse_chains(lines, "line", "any", "invented", "1")


@P.add(f"""
WITH q AS (SELECT DISTINCT ref_no FROM train_references WHERE sentence_months = 0), p AS (SELECT ref_no FROM train_references WHERE opinion IS NULL OR lower({trim('opinion')}) IN ('', '未知', 'unknown', 'null', 'none'))
SELECT CASE WHEN ref_no IN (SELECT ref_no FROM q) THEN 'quarantine' WHEN ref_no IN (SELECT ref_no FROM p) THEN 'pending' ELSE 'retained' END AS part, count(*) AS n FROM train_references GROUP BY 1""")
def review_partition(t: Tables) -> DataFrame:
    """Zero months quarantined, missing opinions pending, the rest retained."""
    rows = t.train_references
    return K.partition_reviewed(rows, "ref_no", rows.where("sentence_months = 0"), rows.where(opinion_or_null("opinion").isNull())).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


_VISIBLE = f"""'{{"charge":' || {json_text("charge")} || ',"facts":' || {json_text("facts")} || CASE WHEN target_person <> '' THEN ',"target_person":' || {json_text("target_person")} ELSE '' END || '}}'"""


def messages_sql(system: str, user: str) -> str:
    """SQL: two messages as JSON."""
    return f"""'[{{"role":"system","content":' || {json_text(system)} || '}},{{"role":"user","content":' || {json_text(user)} || '}}]'"""


_ANSWER = "'Answer in JSON.'"


@P.add(f"""SELECT ref_no, id, 'direct' AS variant, split, m AS messages, sha256(m) AS prompt_hash FROM (SELECT ref_no, id, split, {messages_sql(_ANSWER, _VISIBLE)} AS m
  FROM train_references WHERE split IN ('dev', 'test') AND facts IS NOT NULL AND charge IS NOT NULL)""")
def jobs(t: Tables) -> DataFrame:
    """Label-free jobs of the dev and test cases, messages as JSON."""
    return G.jobs(t.train_references.where("split IN ('dev', 'test')"), "ref_no", "Answer in JSON.").withColumn("messages", F.to_json("messages"))


@P.add(f"SELECT ref_no, id, split FROM train_references WHERE coalesce(split, '') <> 'test' AND facts IS NOT NULL AND charge IS NOT NULL AND sentence_months IS NOT NULL AND lower({trim('opinion')}) NOT IN ('', '未知', 'unknown', 'null', 'none')")
def sft_rows(t: Tables) -> DataFrame:
    return G.training_pairs(t.train_references, "ref_no", "Answer in JSON.").select("ref_no", "id", "split")


@P.add(f"""SELECT ref_no, id, split, 'direct' AS variant, dataset, source_id, {messages_sql(_ANSWER, _VISIBLE)} AS prompt,
  '[{{"role":"assistant","content":' || {json_text("'{" + '"reasoning":' + "' || " + json_text("opinion") + " || ',\"sentence_months\":' || sentence_months || '}'")} || '}}]' AS completion
FROM train_references WHERE coalesce(split, '') <> 'test' AND facts IS NOT NULL AND charge IS NOT NULL AND sentence_months IS NOT NULL AND lower({trim('opinion')}) NOT IN ('', '未知', 'unknown', 'null', 'none')""")
def sft_pairs(t: Tables) -> DataFrame:
    """Prompts and completions of the training records, as JSON."""
    return G.training_pairs(t.train_references, "ref_no", "Answer in JSON.").withColumns({c: F.to_json(c) for c in ("prompt", "completion")})


@P.add("SELECT split, dataset, count(*) AS n FROM train_references GROUP BY split, dataset")
def manifest_counts(t: Tables) -> DataFrame:
    return t.train_references.groupBy("split", "dataset").agg(F.count(F.lit(1)).alias("n"))


@P.add()
def manifest_snapshots(t: Tables) -> DataFrame:
    """Rows and snapshot hash of several tables."""
    out = None
    for name in ("train_references", "predictions", "request_ledger", "eval_items"):
        one = snapshot_hash(getattr(t, name)).select(F.lit(name).alias("name"), "n", "snapshot")
        out = one if out is None else out.unionByName(one)
    return out


@P.add("SELECT lang, name, count(*) AS n FROM (SELECT lang, 'references' AS name FROM train_references UNION ALL SELECT lang, 'documents' FROM documents UNION ALL SELECT lang, 'items' FROM eval_items) GROUP BY lang, name")
def union_of_inputs(t: Tables) -> DataFrame:
    out = None
    for name, rows in (("references", t.train_references), ("documents", t.documents), ("items", t.eval_items)):
        one = rows.select("lang", F.lit(name).alias("name"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("lang", "name").agg(F.count(F.lit(1)).alias("n"))


@P.add("SELECT id, arm FROM train_references, (SELECT DISTINCT arm FROM predictions) WHERE split IN ('dev', 'test') AND id IS NOT NULL EXCEPT SELECT id, arm FROM predictions")
def unpredicted_cases(t: Tables) -> DataFrame:
    """Held-out cases that an arm has no output for (arms are few; each case is crossed with their list)."""
    arms = t.predictions.agg(F.collect_set("arm").alias("arms"))
    cases = t.train_references.where("split IN ('dev', 'test') AND id IS NOT NULL").select("id").distinct().crossJoin(F.broadcast(arms))
    return cases.select("id", F.explode("arms").alias("arm")).subtract(t.predictions.select("id", "arm"))


QUERIES, SQL = P.queries, P.sql
