"""Audits and builds over several tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.functions import text as X
from caseloom.operators import audits as B
from caseloom.operators import cases as K
from caseloom.operators import packaging as G
from caseloom.operators import sampling as D
from caseloom.operators import similarity as M

from .base import Plans, Tables
from .cases import _ADAPT, _PAIRS, OUTCOME, POST, grams, key
from .ledgers import _ONCE, once
from .logic import _ANSWER, _VISIBLE, messages_sql
from .sqltext import form, trim

P = Plans()

_CANDIDATES = f"""
listed AS (SELECT {key("charge")} AS key, min(charge) AS listed_charge FROM charge_targets GROUP BY 1),
raws AS (SELECT raw_no, fact, meta, CASE WHEN len(meta.accusation) = 1 THEN meta.accusation[1] END AS one, CASE WHEN len(meta.criminals) = 1 AND {trim("meta.criminals[1]")} <> '' THEN meta.criminals[1] END AS target_person FROM raw_cases),
cand AS (SELECT raw_no, listed_charge, target_person, CASE WHEN one IS NULL THEN 'charge_scope' WHEN listed_charge IS NULL THEN 'outside_charges' WHEN target_person IS NULL THEN 'target_scope'
  WHEN coalesce(meta.term_of_imprisonment.death_penalty, true) OR coalesce(meta.term_of_imprisonment.life_imprisonment, true) OR coalesce(meta.term_of_imprisonment.imprisonment, 0) <= 0 THEN 'non_fixed_positive_term'
  WHEN fact IS NULL OR {trim("fact")} = '' OR len(fact) > 700 THEN 'empty_or_overlength_facts' END AS reason FROM raws LEFT JOIN listed ON key = {key("one")})"""


@P.add(f"WITH {_CANDIDATES} SELECT raw_no, listed_charge, target_person, reason FROM cand")
def raw_candidates(t: Tables) -> DataFrame:
    """Raw records as annotation candidates with the first reason against them."""
    return K.candidates(t.raw_cases, t.charge_targets, 700).select("raw_no", "listed_charge", "target_person", "reason")


_POOL = f"""{_ADAPT}, kept AS (SELECT raw_no, member || ':' || line_no AS source_id, listed_charge, {form("fact")} AS f, meta.term_of_imprisonment.imprisonment AS months FROM adapted JOIN raw_cases USING (raw_no) WHERE reason IS NULL),
one AS (SELECT f, min(raw_no) FILTER (WHERE source_id = first) AS raw_no FROM (SELECT *, min(source_id) OVER (PARTITION BY f) AS first FROM kept) WHERE f IN (SELECT f FROM kept GROUP BY f HAVING count(DISTINCT (listed_charge, months)) = 1) GROUP BY f),
pool AS (SELECT k.raw_no, k.listed_charge, k.f FROM one JOIN kept k ON k.raw_no = one.raw_no),
guard AS (SELECT {form("facts")} AS f FROM train_references WHERE split IN ('dev', 'test')), clean AS (SELECT * FROM pool WHERE f NOT IN (SELECT f FROM guard WHERE f IS NOT NULL)),
capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY listed_charge ORDER BY md5(raw_no || '|42'), raw_no) AS r FROM clean) WHERE r <= 20)"""


@P.add(f"""WITH {_POOL} SELECT '1 raw' AS stage, count(*) AS n FROM raw_cases UNION ALL SELECT '2 adapted', count(*) FROM kept UNION ALL SELECT '3 one a text', count(*) FROM pool UNION ALL SELECT '4 not held out', count(*) FROM clean UNION ALL SELECT '5 capped', count(*) FROM capped""")
def pool_funnel(t: Tables) -> DataFrame:
    """How many raw records are left by each stage of building a pool: cascade, one record a text (none where labels conflict), held-out texts, cap a charge."""
    kept = K.adapt(t.raw_cases, t.charge_targets).where("reason IS NULL").select("raw_no", F.concat_ws(":", "member", F.col("line_no").cast("string")).alias("source_id"), "listed_charge", X.normalized_fact("fact").alias("f"), F.col("meta.term_of_imprisonment.imprisonment").alias("months"))
    label = F.struct("listed_charge", "months")
    one = kept.groupBy("f").agg(F.min(F.struct("source_id", "raw_no")).alias("x"), F.min(label).alias("low"), F.max(label).alias("high")).where("low = high")
    pool = one.select("f", F.col("x.raw_no").alias("raw_no"), F.col("low.listed_charge").alias("listed_charge"))
    held = t.train_references.where("split IN ('dev', 'test')").select(X.normalized_fact("facts").alias("f"))
    clean = pool.join(held, "f", "left_anti")
    stages = {"1 raw": t.raw_cases, "2 adapted": kept, "3 one a text": pool, "4 not held out": clean, "5 capped": D.per_class(clean, "listed_charge", "raw_no", 20)}
    out = None
    for name, rows in stages.items():
        n = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@P.add(f"""
WITH {_PAIRS}, rep AS (SELECT id, min(id) OVER (PARTITION BY f) AS rep, count(*) OVER (PARTITION BY f) AS copies FROM g), near AS (SELECT a AS id, b AS o FROM pairs WHERE a IN (SELECT rep FROM rep) AND b IN (SELECT rep FROM rep) UNION SELECT b, a FROM pairs WHERE a IN (SELECT rep FROM rep) AND b IN (SELECT rep FROM rep)),
d AS (SELECT id, count(*) AS n FROM near GROUP BY id), fl AS (SELECT ref_no, coalesce(regexp_matches(facts, '{OUTCOME}'), false)::INT + coalesce(regexp_matches(facts, '{POST}'), false)::INT AS n_risks FROM train_references)
SELECT fl.ref_no, n_risks, coalesce(rep.copies, 0) AS copies, coalesce(d.n, 0) AS near_texts, n_risks > 0 OR coalesce(rep.copies, 0) > 1 OR coalesce(d.n, 0) > 0 AS review FROM fl LEFT JOIN rep ON rep.id = fl.ref_no LEFT JOIN d ON d.id = rep.rep""")
def input_audit(t: Tables) -> DataFrame:
    """Every record with its risks, the copies of its text and the other texts near it, and whether it asks for review."""
    forms = M.written(M.gram_table(t.train_references, "ref_no", X.normalized_fact("facts")))
    pairs = M.pairs_of_written(forms)
    near = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("near_texts"))
    members = M.text_classes(forms).withColumnRenamed("id", "ref_no").join(near, "rep", "left")
    rows = t.train_references.select("ref_no", F.coalesce(F.size(X.input_risks("facts")), F.lit(0)).alias("n_risks")).join(members, "ref_no", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("ref_no", F.greatest("n_risks", F.lit(0)).alias("n_risks"), n("copies"), n("near_texts")).withColumn("review", (F.col("n_risks") > 0) | (F.col("copies") > 1) | (F.col("near_texts") > 0))


_SETTINGS = "(VALUES ('train', '1600'), ('dev', '200'), ('charges', '18'), ('columns', '17')) v(name, expected)"


@P.add(f"""
WITH f AS (SELECT split AS name, count(*)::VARCHAR AS actual FROM train_references WHERE split IS NOT NULL GROUP BY split UNION ALL SELECT 'charges', count(*)::VARCHAR FROM charge_targets)
SELECT coalesce(f.name, v.name) AS name, expected, actual, expected IS NOT DISTINCT FROM actual AS same FROM f FULL JOIN {_SETTINGS} ON f.name = v.name""")
def protocol_differences(t: Tables) -> DataFrame:
    """A frozen protocol against the counts that are there."""
    facts = t.train_references.where("split IS NOT NULL").groupBy(F.col("split").alias("name")).agg(F.count(F.lit(1)).alias("actual")).unionByName(t.charge_targets.agg(F.count(F.lit(1)).alias("actual")).select(F.lit("charges").alias("name"), "actual"))
    return B.protocol_differences(facts, {"train": "1600", "dev": "200", "charges": "18", "columns": "17"})


@P.add("""
WITH q AS (SELECT ref_no, facts, substring(facts, 5, 20) AS a, CASE WHEN ref_no % 4 = 0 THEN substring(facts, 1, 1) ELSE substring(facts, 30, 25) END AS b FROM train_references WHERE facts IS NOT NULL),
c AS (SELECT *, a <> '' AND instr(facts, a) > 0 AND instr(substring(facts, instr(facts, a) + 1), a) = 0 AS ga, b <> '' AND instr(facts, b) > 0 AND instr(substring(facts, instr(facts, b) + 1), b) = 0 AS gb, repeat('y', 900) AS y FROM q),
p AS (SELECT ref_no, CASE WHEN ref_no % 10 = 1 THEN 'claim_count' WHEN ref_no % 10 = 2 THEN 'empty_claim' WHEN NOT (ga AND gb) THEN 'quote_not_grounded' WHEN ref_no % 10 = 3 THEN 'too_long' END AS problem, y FROM c)
SELECT ref_no, CASE WHEN problem IS NULL THEN 'first' || chr(10) || 'second' END AS opinion, problem FROM p""")
def distilled_opinions(t: Tables) -> DataFrame:
    """Opinions distilled from claims with quotes, and what is wrong with the others."""
    n = F.col("ref_no")
    second = F.when(n % 4 == 0, F.substring("facts", 1, 1)).otherwise(F.substring("facts", 30, 25))
    long = lambda x: F.when(n % 10 == 3, F.repeat(F.lit("y"), F.lit(901))).otherwise(F.lit(x))
    claims = F.array(F.struct(long("first").alias("claim"), F.substring("facts", 5, 20).alias("quote")), F.struct(F.when(n % 10 == 2, " ").otherwise(long(" second ")).alias("claim"), second.alias("quote")))
    rows = t.train_references.where("facts IS NOT NULL").withColumn("claims", F.when(n % 10 != 1, claims).otherwise(F.slice(claims, 1, 0)))
    return B.distilled(rows, "ref_no", "facts", "claims")


@P.add(f"""
WITH {_ONCE}, s AS (SELECT id, mode, CASE WHEN bool_or(status = 'accepted') THEN 'done' ELSE 'open' END AS state FROM once WHERE id IS NOT NULL GROUP BY id, mode), e AS (SELECT DISTINCT id, CASE WHEN md5(id)[1] < '8' THEN 'done' ELSE 'open' END AS state FROM train_references WHERE split = 'train' AND id IS NOT NULL),
m AS (SELECT DISTINCT mode FROM s)
SELECT m.mode, count(*) AS total, count(*) FILTER (WHERE e.state = s.state) AS matched, count(*) FILTER (WHERE s.state IS NULL) AS absent FROM e CROSS JOIN m LEFT JOIN s ON s.id = e.id AND s.mode = m.mode GROUP BY m.mode""")
def expectation_agreement(t: Tables) -> DataFrame:
    """Expected states of all training cases against those each mode came to; what is absent counts as a mismatch."""
    states = once(t).where("id IS NOT NULL").groupBy("id", "mode").agg(F.when(F.bool_or(F.col("status") == "accepted"), "done").otherwise("open").alias("state"))
    expected = t.train_references.where("split = 'train' AND id IS NOT NULL").select("id", F.when(F.substring(F.md5("id"), 1, 1) < "8", "done").otherwise("open").alias("state")).distinct()
    return B.agreement(expected, states, ["id"], "mode")


@P.add("""
WITH r AS (SELECT ref_no, charge, sentence_months FROM train_references WHERE split = 'dev'), m AS (SELECT 'direct' AS arm, ref_no, charge, CASE WHEN ref_no % 11 = 0 THEN 999 ELSE sentence_months END AS sentence_months FROM r WHERE ref_no % 7 <> 0 UNION ALL SELECT 'flat', * FROM r UNION ALL SELECT 'flat', * FROM r WHERE ref_no % 13 = 0 UNION ALL SELECT 'bound', * FROM r UNION ALL SELECT 'bound', -1, 'x', 1),
t AS (SELECT arm, ref_no, count(*) AS n, any_value(charge) AS charge, any_value(sentence_months) AS months FROM m GROUP BY 1, 2), w AS (SELECT unnest(['direct', 'flat', 'bound']) AS arm, * FROM r)
SELECT coalesce(w.arm, t.arm) AS arm, coalesce(w.ref_no, t.ref_no) AS ref_no, CASE WHEN t.n IS NULL THEN 'missing' WHEN w.ref_no IS NULL THEN 'foreign' WHEN t.n > 1 THEN 'repeated' ELSE 'differs' END AS problem
FROM w FULL JOIN t ON w.arm = t.arm AND w.ref_no = t.ref_no WHERE t.n IS NULL OR w.ref_no IS NULL OR t.n > 1 OR w.charge IS DISTINCT FROM t.charge OR w.sentence_months IS DISTINCT FROM t.months""")
def package_differences(t: Tables) -> DataFrame:
    """The member tables of a package against its references: rows missing, doubled, foreign or with another label."""
    r = t.train_references.where("split = 'dev'").select("ref_no", "charge", "sentence_months")
    arm = lambda name, df: df.select(F.lit(name).alias("arm"), "ref_no", "charge", "sentence_months")
    direct = r.where("ref_no % 7 <> 0").withColumn("sentence_months", F.when(F.col("ref_no") % 11 == 0, F.lit(999)).otherwise(F.col("sentence_months")))
    foreign = t.spark.createDataFrame([(-1, "x", 1)], "ref_no bigint, charge string, sentence_months bigint")
    members = arm("direct", direct).unionByName(arm("flat", r)).unionByName(arm("flat", r.where("ref_no % 13 = 0"))).unionByName(arm("bound", r.unionByName(foreign)))
    return B.package_differences(r, members, "ref_no", ["direct", "flat", "bound"], ["charge", "sentence_months"])


@P.add("""
WITH s AS (SELECT ref_no, len(facts) AS n, instr(facts, target_person) - 1 AS a, len(target_person) AS l FROM train_references WHERE split = 'train' AND facts IS NOT NULL), c AS (SELECT *, CASE WHEN a >= 0 AND l > 0 THEN a + l + CASE WHEN ref_no % 5 = 0 THEN 100000 ELSE 0 END END AS b FROM s)
SELECT ref_no, CASE WHEN ref_no % 17 = 0 THEN 'missing' ELSE 'outside' END AS problem FROM c WHERE ref_no % 17 = 0 OR b > n""")
def sidecar_problems(t: Tables) -> DataFrame:
    """Training records without their person, the places it stood at kept beside them: those whose places don't fit."""
    rows = t.train_references.where("split = 'train' AND facts IS NOT NULL").select("ref_no", "facts", "charge", "target_person")
    start = F.instr("facts", F.col("target_person")) - 1
    span = F.struct(start.alias("start_pos"), (start + F.char_length("target_person") + F.when(F.col("ref_no") % 5 == 0, 100_000).otherwise(0)).alias("end_pos"))
    there = (F.char_length("target_person") > 0) & (start >= 0)
    frame, sidecar = B.without_column(rows, "ref_no", "target_person", F.when(there, F.array(span)).otherwise(F.array().cast("array<struct<start_pos:int,end_pos:int>>")))
    return B.sidecar_problems(frame, sidecar.where("ref_no % 17 <> 0"), "ref_no", "facts")


@P.add(f"""
WITH {_ONCE}, ok AS (SELECT DISTINCT id FROM once WHERE status = 'accepted' AND id IS NOT NULL), r AS (SELECT ref_no, id, split, charge FROM train_references WHERE split = 'train' AND facts IS NOT NULL AND charge IS NOT NULL AND id IN (SELECT id FROM ok)),
b AS (SELECT charge, count(DISTINCT id) AS n FROM train_references WHERE split = 'train' AND id IN (SELECT id FROM request_ledger) GROUP BY charge)
SELECT arm, r.charge, count(*) AS n_pairs, any_value(b.n) AS n_requested FROM r CROSS JOIN (SELECT unnest(['direct', 'flat', 'bound']) AS arm) JOIN b ON b.charge = r.charge GROUP BY 1, 2""")
def prepared_package(t: Tables) -> DataFrame:
    """Annotated training records fanned out over three arms, counted by charge, beside the requested ones."""
    ok = once(t).where("status = 'accepted' AND id IS NOT NULL").select("id").distinct()
    train = t.train_references.where("split = 'train'")
    rows = train.where("facts IS NOT NULL AND charge IS NOT NULL").join(ok, "id", "left_semi")
    asked = train.join(t.request_ledger.select("id").distinct(), "id", "left_semi").groupBy("charge").agg(F.count_distinct("id").alias("n_requested"))
    fanned = rows.select("charge", F.explode(F.array(*[F.lit(a) for a in ("direct", "flat", "bound")])).alias("arm"))
    return fanned.groupBy("arm", "charge").agg(F.count(F.lit(1)).alias("n_pairs")).join(asked, "charge").select("arm", "charge", "n_pairs", "n_requested")


@P.add(f"""SELECT ref_no, sha256('{{"max_tokens":600,"messages":' || {messages_sql(_ANSWER, _VISIBLE)} || ',"model":"any","temperature":0}}') AS request_hash FROM train_references WHERE split = 'train' AND facts IS NOT NULL AND charge IS NOT NULL""")
def request_payloads(t: Tables) -> DataFrame:
    """The hash of the request that would annotate each training record: model, settings and messages."""
    rows = t.train_references.where("split = 'train' AND facts IS NOT NULL AND charge IS NOT NULL")
    body = F.struct(F.lit(600).alias("max_tokens"), G.messages("Answer in JSON.", G.visible(rows)).alias("messages"), F.lit("any").alias("model"), F.lit(0).alias("temperature"))
    return rows.select("ref_no", F.sha2(F.to_json(body), 256).alias("request_hash"))


@P.add("SELECT charge, array_to_string(list_sort(list_distinct(flatten(list(relevant_articles_label)))), ',') AS articles FROM train_references WHERE relevant_articles_label IS NOT NULL AND charge IS NOT NULL GROUP BY charge")
def articles_of_charges(t: Tables) -> DataFrame:
    """The distinct articles that each charge's records name, in order."""
    n = t.train_references.where("relevant_articles_label IS NOT NULL AND charge IS NOT NULL").groupBy("charge").agg(F.collect_set("relevant_articles_label").alias("a"))
    return n.select("charge", F.array_join(B.sorted_distinct(F.col("a")), ",").alias("articles"))


QUERIES, SQL = P.queries, P.sql
