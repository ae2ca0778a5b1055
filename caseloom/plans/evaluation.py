"""Queries over predictions and gold: strict answers, coverage-gated metrics, paired arms, distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions.text import month_bin, parse_answer
from caseloom.operators import metrics as E

from .base import Plans, Tables

P = Plans()
ARMS = ("direct", "flat", "bound")


def gold_cases(t: Tables) -> DataFrame:
    """Dev and test cases, each id once (its first delivery)."""
    rows = t.train_references.where("split IN ('dev', 'test') AND sentence_months IS NOT NULL")
    return rows.groupBy("id").agg(F.min_by(F.struct("charge", "opinion", "sentence_months"), "ref_no").alias("g")).select("id", "g.*")


def arm_predictions(t: Tables) -> DataFrame:
    """Each id once an arm (its first output), ids without a gold case left out."""
    first = t.predictions.groupBy("id", "arm").agg(F.min_by(F.struct("text", "finish_reason"), "pred_no").alias("p")).select("id", "arm", "p.*")
    return first.join(gold_cases(t).select("id"), "id", "left_semi")


def arm_errors(t: Tables) -> DataFrame:
    """Every gold case under every arm."""
    gold, predictions = gold_cases(t), arm_predictions(t)
    out = None
    for arm in ARMS:
        one = E.errors(gold, predictions.where(F.col("arm") == arm)).withColumn("arm", F.lit(arm))
        out = one if out is None else out.unionByName(one)
    return out


_PY_WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{_PY_WS}+', ''), '{_PY_WS}+$', '')"


def _answers(source: str) -> str:
    """SQL: rows of source with ``months`` and ``reasoning`` of strict answers."""
    return f"""
a0 AS (SELECT *, {_strip("text")} AS s FROM {source}),
a1 AS (SELECT *, CASE WHEN starts_with(s, '```json' || chr(10)) AND ends_with(s, '```') THEN {_strip("substring(s, 9, len(s) - 11)")} ELSE s END AS j FROM a0),
answers AS (SELECT *, CASE WHEN json_valid(j) AND json_type(j) = 'OBJECT' AND json_type(j, '$.reasoning') = 'VARCHAR' AND {_strip("json_extract_string(j, '$.reasoning')")} <> ''
  AND json_type(j, '$.sentence_months') = 'UBIGINT' THEN json_extract(j, '$.sentence_months')::BIGINT END AS months FROM a1)"""


_DETAIL = f"""
gold AS (SELECT id, arg_min(charge, ref_no) AS charge, arg_min(sentence_months, ref_no) AS target FROM train_references WHERE split IN ('dev', 'test') AND sentence_months IS NOT NULL GROUP BY id),
firsts AS (SELECT * FROM predictions QUALIFY row_number() OVER (PARTITION BY id, arm ORDER BY pred_no) = 1),
{_answers("firsts")},
arms AS (SELECT unnest(['direct', 'flat', 'bound']) AS arm),
detail AS (SELECT gold.id, gold.charge, arms.arm, target, CASE WHEN coalesce(finish_reason, '') <> 'length' THEN months END AS prediction
  FROM gold CROSS JOIN arms LEFT JOIN answers ON answers.id = gold.id AND answers.arm = arms.arm),
d AS (SELECT *, prediction IS NOT NULL AS valid, abs(prediction - target) AS e FROM detail)"""
_SUMMARY = "count(*) AS n, sum(valid::INT)::BIGINT AS n_valid, sum(valid::INT) / count(*) AS coverage, avg(e) AS mae_valid, sqrt(avg(e * e)) AS rmse_valid, CASE WHEN sum(valid::INT) = count(*) THEN avg(e) END AS mae_full, CASE WHEN sum(valid::INT) = count(*) THEN sqrt(avg(e * e)) END AS rmse_full"


@P.add(f"WITH {_answers('predictions')} SELECT pred_no, months AS sentence_months FROM answers")
def strict_answers(t: Tables) -> DataFrame:
    return t.predictions.select("pred_no", parse_answer("text").alias("a")).select("pred_no", "a.sentence_months")


@P.add("SELECT pred_no FROM predictions WHERE id NOT IN (SELECT id FROM train_references WHERE split IN ('dev', 'test') AND sentence_months IS NOT NULL AND id IS NOT NULL) AND id IS NOT NULL")
def foreign_predictions(t: Tables) -> DataFrame:
    return E.unknown_keys(gold_cases(t), t.predictions.where("id IS NOT NULL")).select("pred_no")


@P.add("SELECT id, arm, count(*) AS n_rows FROM predictions GROUP BY id, arm HAVING count(*) > 1")
def repeated_predictions(t: Tables) -> DataFrame:
    from caseloom.functions.ids import duplicates

    return duplicates(t.predictions, "id", "arm")


@P.add(f"WITH {_DETAIL} SELECT id, arm, charge, target, valid, prediction, e AS absolute_error FROM d")
def case_errors(t: Tables) -> DataFrame:
    return arm_errors(t).drop("char_rouge_l")


@P.add()
def reasoning_similarity(t: Tables) -> DataFrame:
    """Mean character similarity of reasoning and opinion, over valid answers with an opinion."""
    return arm_errors(t).where("char_rouge_l IS NOT NULL").groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.avg("char_rouge_l").alias("mean_rouge"))


@P.add(f"WITH {_DETAIL} SELECT arm, {_SUMMARY} FROM d GROUP BY arm")
def summary_by_arm(t: Tables) -> DataFrame:
    return E.summarize(arm_errors(t), "arm")


@P.add(f"WITH {_DETAIL} SELECT arm, charge, grouping(arm, charge)::BIGINT AS level, {_SUMMARY} FROM d GROUP BY ROLLUP (arm, charge)")
def summary_rollup(t: Tables) -> DataFrame:
    rows = arm_errors(t)
    return rows.rollup("arm", "charge").agg(F.grouping_id().cast("bigint").alias("level"), *E.summary_columns())


@P.add(f"WITH {_DETAIL} SELECT id FROM d WHERE valid GROUP BY id HAVING count(DISTINCT arm) = 3")
def common_valid_cohort(t: Tables) -> DataFrame:
    return E.common_valid(arm_errors(t), "arm", len(ARMS))


@P.add(f"WITH {_DETAIL}, c AS (SELECT id FROM d WHERE valid GROUP BY id HAVING count(DISTINCT arm) = 3) SELECT arm, {_SUMMARY} FROM d WHERE id IN (SELECT id FROM c) GROUP BY arm")
def summary_of_cohort(t: Tables) -> DataFrame:
    rows = arm_errors(t)
    return E.summarize(rows.join(E.common_valid(rows, "arm", len(ARMS)), "id", "left_semi"), "arm")


@P.add(f"""WITH {_DETAIL} SELECT x.id, y.e - x.e AS delta FROM d x JOIN d y ON x.id = y.id AND x.arm = 'direct' AND y.arm = 'bound' WHERE x.valid AND y.valid""")
def paired_delta(t: Tables) -> DataFrame:
    rows = arm_errors(t)
    return E.paired(rows.where("arm = 'direct'"), rows.where("arm = 'bound'"))


_PAIRED = f"{_DETAIL}, dl AS (SELECT x.id, y.e - x.e AS delta FROM d x JOIN d y ON x.id = y.id AND x.arm = 'direct' AND y.arm = 'bound' WHERE x.valid AND y.valid)"
_STEPS = " + ".join(f"(p >= {x})::INT" for x in E.POISSON)
_BOOT = f"""h AS (SELECT delta, ('0x' || md5(id || '|42')[1:7])::BIGINT AS a, ('0x' || md5(id || '|42')[8:14])::BIGINT AS s FROM dl),
w AS (SELECT b, delta, {_STEPS} AS w FROM (SELECT b, delta, (a + b * s) % {E.PRIME} * 1000000 // {E.PRIME} AS p FROM h, (SELECT unnest(generate_series(0, 1999)) AS b))),
m AS (SELECT b, sum(delta * w) / sum(w) AS m FROM w GROUP BY b), o AS (SELECT list_sort(list(m)) AS o FROM m)"""


@P.add(f"WITH {_PAIRED}, {_BOOT} SELECT count(*) AS n, avg(delta) AS mean_delta, any_value(o[51]) AS ci_low, any_value(o[1951]) AS ci_high FROM dl, o")
def bootstrap_interval(t: Tables) -> DataFrame:
    """Interval of the difference between two arms over the cases that both answered."""
    return E.bootstrap(paired_delta(t))


@P.add(f"""WITH {_DETAIL} SELECT CASE WHEN count(*) = sum((x.valid AND y.valid)::INT) THEN 'compared' ELSE 'partial_coverage' END AS status, count(*) AS n, sum((x.valid AND y.valid)::INT)::BIGINT AS n_valid,
  CASE WHEN count(*) = sum((x.valid AND y.valid)::INT) THEN avg(y.e - x.e) END AS mean_delta, NULL::DOUBLE AS ci_low, NULL::DOUBLE AS ci_high FROM d x JOIN d y ON x.id = y.id AND x.arm = 'direct' AND y.arm = 'bound'""")
def compare_refused(t: Tables) -> DataFrame:
    """Two arms over all gold cases: coverage is partial, so no difference is given."""
    rows = arm_errors(t)
    return E.compare(rows.where("arm = 'direct'"), rows.where("arm = 'bound'"))


@P.add(f"WITH {_PAIRED}, {_BOOT} SELECT 'compared' AS status, count(*) AS n, count(*) AS n_valid, avg(delta) AS mean_delta, any_value(o[51]) AS ci_low, any_value(o[1951]) AS ci_high FROM dl, o")
def compare_common(t: Tables) -> DataFrame:
    """Two arms over the cases that both answered: full coverage, so they are compared."""
    rows = arm_errors(t).where("arm IN ('direct', 'bound')")
    common = rows.join(E.common_valid(rows, "arm", 2), "id", "left_semi")
    return E.compare(common.where("arm = 'direct'"), common.where("arm = 'bound'"))


@P.add(f"""WITH {_DETAIL}, s AS (SELECT *, id IN (SELECT id FROM d WHERE valid GROUP BY id HAVING count(DISTINCT arm) = 3) AS shared FROM d),
g AS (SELECT arm, CASE WHEN grouping(charge) = 0 THEN 'charge:' || charge WHEN grouping(shared) = 0 THEN 'shared:' || shared ELSE 'all' END AS scope, {_SUMMARY} FROM s GROUP BY GROUPING SETS ((arm), (arm, shared), (arm, charge)))
SELECT x.scope, x.n, x.mae_full AS direct_mae, y.mae_full AS bound_mae, y.mae_full - x.mae_full AS delta FROM g x JOIN g y ON x.scope = y.scope AND x.arm = 'direct' AND y.arm = 'bound'""")
def scoped_summary(t: Tables) -> DataFrame:
    """Two arms over all cases, over those all arms answered and not, and by charge; a difference only where both are fully covered."""
    rows = arm_errors(t)
    shared = E.common_valid(rows, "arm", len(ARMS)).withColumn("__s", F.lit(True))
    rows = rows.join(shared, "id", "left").withColumn("shared", F.coalesce("__s", F.lit(False)))
    sets = rows.groupingSets([["arm"], ["arm", "shared"], ["arm", "charge"]], "arm", "shared", "charge")
    g = sets.agg(F.grouping("charge").alias("gc"), F.grouping("shared").alias("gs"), *E.summary_columns())
    scope = F.when(F.col("gc") == 0, F.concat(F.lit("charge:"), "charge")).when(F.col("gs") == 0, F.concat(F.lit("shared:"), F.col("shared").cast("string"))).otherwise("all")
    g = g.withColumn("scope", scope)
    a, b = g.where("arm = 'direct'").select("scope", "n", F.col("mae_full").alias("direct_mae")), g.where("arm = 'bound'").select("scope", F.col("mae_full").alias("bound_mae"))
    return a.join(b, "scope").withColumn("delta", F.col("bound_mae") - F.col("direct_mae"))


@P.add(f"""WITH {_DETAIL} SELECT x.id, x.prediction AS before, y.prediction AS after FROM d x JOIN d y ON x.id = y.id AND x.arm = 'flat' AND y.arm = 'bound' WHERE x.prediction IS DISTINCT FROM y.prediction""")
def paired_changes(t: Tables) -> DataFrame:
    rows = arm_errors(t)
    a, b = rows.where("arm = 'flat'").select("id", F.col("prediction").alias("before")), rows.where("arm = 'bound'").select("id", F.col("prediction").alias("after"))
    return a.join(b, "id").where("NOT before <=> after")


@P.add(f"""WITH {_DETAIL} SELECT id, CASE WHEN count(DISTINCT prediction) = 1 THEN min(prediction) END AS label, count(prediction) AS n_votes FROM d GROUP BY id""")
def agreed_votes(t: Tables) -> DataFrame:
    """One label where all valid arms agree; conflicts give none."""
    return arm_errors(t).groupBy("id").agg(F.when(F.count_distinct("prediction") == 1, F.min("prediction")).alias("label"), F.count("prediction").alias("n_votes"))


@P.add("""WITH m AS (SELECT charge, round_even(quantile_cont(sentence_months, 0.5), 0)::BIGINT AS b FROM train_references WHERE split = 'train' AND sentence_months IS NOT NULL AND charge IS NOT NULL GROUP BY charge),
g AS (SELECT round_even(quantile_cont(sentence_months, 0.5), 0)::BIGINT AS b FROM train_references WHERE split = 'train' AND sentence_months IS NOT NULL)
SELECT ref_no, coalesce(m.b, g.b) AS baseline, m.b IS NULL AS fell_back FROM (SELECT ref_no, charge FROM train_references WHERE split IN ('dev', 'test')) t LEFT JOIN m USING (charge) CROSS JOIN g""")
def baseline_predictions(t: Tables) -> DataFrame:
    """Each held-out record with the median months of its charge in training, or of all where the charge has none."""
    rows = t.train_references.where("split = 'train' AND sentence_months IS NOT NULL")
    median = F.bround(F.percentile("sentence_months", 0.5), 0).cast("bigint")
    by, all_ = rows.where("charge IS NOT NULL").groupBy("charge").agg(median.alias("b")), rows.agg(median.alias("g"))
    held = t.train_references.where("split IN ('dev', 'test')").select("ref_no", "charge")
    return held.join(by, "charge", "left").crossJoin(F.broadcast(all_)).select("ref_no", F.coalesce("b", "g").alias("baseline"), F.col("b").isNull().alias("fell_back"))


@P.add("SELECT charge, round_even(quantile_cont(sentence_months, 0.5), 0)::BIGINT AS baseline, count(*) AS n FROM train_references WHERE split = 'train' AND sentence_months IS NOT NULL GROUP BY charge")
def median_baseline(t: Tables) -> DataFrame:
    rows = t.train_references.where("split = 'train' AND sentence_months IS NOT NULL")
    return rows.groupBy("charge").agg(F.bround(F.percentile("sentence_months", 0.5), 0).cast("bigint").alias("baseline"), F.count(F.lit(1)).alias("n"))


_Q = "count({0}) AS n, avg({0}) AS mean, min({0}) AS min, quantile_cont({0}, 0.1) AS p10, quantile_cont({0}, 0.25) AS p25, quantile_cont({0}, 0.5) AS median, quantile_cont({0}, 0.75) AS p75, quantile_cont({0}, 0.9) AS p90, max({0}) AS max"


@P.add(f"SELECT dataset, split, {_Q.format('sentence_months')} FROM train_references GROUP BY dataset, split")
def month_quantiles(t: Tables) -> DataFrame:
    return E.quantiles(t.train_references, "sentence_months", "dataset", "split")


@P.add(f"SELECT lang, {_Q.format('len(facts)')} FROM train_references GROUP BY lang")
def length_quantiles(t: Tables) -> DataFrame:
    return E.quantiles(t.train_references.withColumn("n_facts", F.char_length("facts")), "n_facts", "lang")


@P.add("""
WITH p AS (SELECT coalesce(sentence_months, -1) AS v, count(*) / sum(count(*)) OVER () AS p FROM train_references WHERE split = 'train' GROUP BY 1), q AS (SELECT coalesce(sentence_months, -1) AS v, count(*) / sum(count(*)) OVER () AS q FROM train_references WHERE split = 'test' GROUP BY 1)
SELECT sum(abs(coalesce(p, 0) - coalesce(q, 0))) / 2 AS distance FROM p FULL JOIN q USING (v)""")
def total_variation(t: Tables) -> DataFrame:
    return E.total_variation(t.train_references.where("split = 'train'"), t.train_references.where("split = 'test'"), "sentence_months")


@P.add("""
WITH m AS (SELECT charge, avg(sentence_months) AS m FROM train_references WHERE split = 'train' GROUP BY charge), n AS (SELECT charge, count(*) AS n FROM train_references WHERE split = 'test' AND charge IS NOT NULL GROUP BY charge)
SELECT sum(n * m) / sum(n) AS mean FROM n JOIN m USING (charge) WHERE m IS NOT NULL""")
def reweighted_mean(t: Tables) -> DataFrame:
    test = t.train_references.where("split = 'test' AND charge IS NOT NULL")
    return E.reweighted_mean(t.train_references.where("split = 'train'"), test, "charge", "sentence_months")


@P.add("""
WITH p AS (SELECT charge, sentence_months AS v, sum(len(facts)) AS m FROM train_references WHERE sentence_months IS NOT NULL AND len(facts) > 0 AND charge IS NOT NULL GROUP BY 1, 2),
c AS (SELECT *, sum(m) OVER (PARTITION BY charge ORDER BY v) AS c, sum(m) OVER (PARTITION BY charge) AS t FROM p)
SELECT charge, min(v) FILTER (WHERE c >= 0.5 * t) AS median_value, sum(m * v) / sum(m) AS mean_value, sum(m)::BIGINT AS total_mass FROM c GROUP BY charge""")
def weighted_median(t: Tables) -> DataFrame:
    rows = t.train_references.where("charge IS NOT NULL").withColumn("mass", F.char_length("facts").cast("bigint"))
    return E.weighted_median(rows, "charge", "sentence_months", "mass")


@P.add("SELECT split, bin, n, n / sum(n) OVER (PARTITION BY split) AS share FROM (SELECT split, CASE WHEN sentence_months <= 0 THEN '0' WHEN sentence_months <= 6 THEN '1-6' WHEN sentence_months <= 12 THEN '7-12' WHEN sentence_months <= 36 THEN '13-36' WHEN sentence_months <= 60 THEN '37-60' WHEN sentence_months <= 120 THEN '61-120' ELSE '>120' END AS bin, count(*) AS n FROM train_references WHERE sentence_months IS NOT NULL GROUP BY 1, 2)")
def profile_of_splits(t: Tables) -> DataFrame:
    n = t.train_references.where("sentence_months IS NOT NULL").groupBy("split", month_bin("sentence_months").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("split")))


@P.add("SELECT arm, max(prompt_tokens) AS most_prompt, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum((prompt_tokens + output_tokens > 1000)::INT)::BIGINT AS n_over FROM predictions GROUP BY arm")
def token_budget(t: Tables) -> DataFrame:
    over = (F.col("prompt_tokens") + F.col("output_tokens") > 1000).cast("bigint")
    return t.predictions.groupBy("arm").agg(F.max("prompt_tokens").alias("most_prompt"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum(over).alias("n_over"))


QUERIES, SQL = P.queries, P.sql
