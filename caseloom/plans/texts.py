"""Queries over text columns: risks, clauses, units, quotes, cues, bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.functions import text as X
from caseloom.operators import cases as K

from .base import Plans, Tables
from .cases import OUTCOME, POST, key
from .sqltext import form, nfkc, spans

P = Plans()


@P.add(f"SELECT ref_no, sha256({form('facts')}) AS text_hash FROM train_references WHERE facts IS NOT NULL")
def normalized_hash(t: Tables) -> DataFrame:
    return t.train_references.where("facts IS NOT NULL").select("ref_no", F.sha2(X.normalized_fact("facts"), 256).alias("text_hash"))


@P.add(f"SELECT ref_no, {form('facts')} AS form FROM train_references")
def nfkc_facts(t: Tables) -> DataFrame:
    return t.train_references.select("ref_no", X.normalized_fact("facts").alias("form"))


@P.add(f"SELECT DISTINCT charge, {key('charge')} AS charge_key FROM train_references WHERE charge IS NOT NULL")
def charge_keys(t: Tables) -> DataFrame:
    return t.train_references.where("charge IS NOT NULL").select("charge", X.charge_key("charge").alias("charge_key")).distinct()


@P.add(f"""
SELECT raw_no, 'possible_outcome_text_review' AS risk FROM raw_cases WHERE regexp_matches(fact, '{OUTCOME}')
UNION ALL SELECT raw_no, 'postjudgment_input_review' FROM raw_cases WHERE regexp_matches(fact, '{POST}')""")
def input_risks(t: Tables) -> DataFrame:
    return t.raw_cases.select("raw_no", F.explode(X.input_risks("fact")).alias("risk"))


@P.add(f"""SELECT dataset, count(*) AS n, sum((risk)::INT) AS n_risk FROM (SELECT dataset, coalesce(regexp_matches(facts, '{OUTCOME}') OR regexp_matches(facts, '{POST}'), false) AS risk FROM train_references) GROUP BY dataset""")
def screen_report(t: Tables) -> DataFrame:
    risk = F.coalesce(F.size(X.input_risks("facts")) > 0, F.lit(False)) & F.col("facts").isNotNull()
    return t.train_references.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.sum(risk.cast("bigint")).alias("n_risk"))


#: Circumstances that these tables' texts name.
_NAMED = ("退缴", "传唤", "签收", "扣押")
_TERMS = ", ".join(f"'{x}'" for x in _NAMED)


@P.add(f"""SELECT ref_no, term FROM (SELECT ref_no, facts, opinion, unnest([{_TERMS}]) AS term FROM train_references WHERE opinion IS NOT NULL) WHERE contains(opinion, term) AND NOT coalesce(contains(facts, term), false)""")
def opinion_only_terms(t: Tables) -> DataFrame:
    return t.train_references.where("opinion IS NOT NULL").select("ref_no", F.explode(X.opinion_only_terms("facts", "opinion", _NAMED)).alias("term"))


@P.add(f"""SELECT raw_no, clause FROM (SELECT raw_no, unnest(regexp_split_to_array(fact, '[。；\n]')) AS clause FROM raw_cases) WHERE regexp_matches(clause, '{X.TERM}') AND regexp_matches(clause, '{X.NUMBER}')""")
def clause_risk_filter(t: Tables) -> DataFrame:
    return t.raw_cases.select("raw_no", F.explode(X.clauses_with_terms("fact")).alias("clause"))


_HINTS = f"""
SELECT raw_no, 'possible_outcome_text_review' AS kind, NULL::INT AS start_pos, NULL::INT AS end_pos, NULL::VARCHAR AS quote FROM raw_cases WHERE regexp_matches(fact, '{OUTCOME}')
UNION ALL SELECT raw_no, 'postjudgment_input_review', NULL, NULL, NULL FROM raw_cases WHERE regexp_matches(fact, '{POST}')
UNION ALL {spans("raw_cases", "raw_no", "fact", {k: v.replace(chr(92) + "n", chr(10)) for k, v in X.HINTS.items()})}"""


@P.add(_HINTS)
def hint_spans(t: Tables) -> DataFrame:
    """Review flags of raw records, hints with their places."""
    return K.review_flags(t.raw_cases, "raw_no", "fact")


@P.add(f"SELECT kind, count(DISTINCT raw_no) AS n_rows, count(*) AS n_spans FROM ({_HINTS}) GROUP BY kind")
def rows_not_spans_counts(t: Tables) -> DataFrame:
    return K.review_flags(t.raw_cases, "raw_no", "fact").groupBy("kind").agg(F.count_distinct("raw_no").alias("n_rows"), F.count(F.lit(1)).alias("n_spans"))


_CUE = "\nUNION ALL ".join(f"SELECT '{k}' AS cue, count(*) AS n_rows FROM train_references WHERE regexp_matches(facts, '{v.replace(chr(92) + 'd', chr(92) + 'p{Nd}')}')" for k, v in X.CUES.items())


@P.add(f"SELECT * FROM ({_CUE}) WHERE n_rows > 0")
def rows_with_cue(t: Tables) -> DataFrame:
    """Rows that hold each cue: one pass of pattern tests, no spans."""
    java = {k: v.replace("\\d", "\\p{Nd}") for k, v in X.CUES.items()}
    n = t.train_references.agg(*[F.count_if(F.col("facts").rlike(v)).alias(k) for k, v in java.items()])
    return n.select(F.explode(F.create_map(*[x for k in java for x in (F.lit(k), F.col(k))])).alias("cue", "n_rows")).where("n_rows > 0")


@P.add(spans("train_references", "ref_no", "facts", X.CUES))
def cue_spans(t: Tables) -> DataFrame:
    return t.train_references.where("facts IS NOT NULL").select("ref_no", F.explode(X.find_spans(X.CUES)("facts")).alias("s")).select("ref_no", "s.*")


@P.add("""
WITH u AS (SELECT ref_no, regexp_extract_all(facts, '[^。！？；\n]*[。！？；\n]+|[^。！？；\n]+') AS p FROM train_references WHERE facts <> ''),
n AS (SELECT ref_no, p, unnest(generate_series(1, len(p))) AS i FROM u)
SELECT ref_no, 's' || i AS id, coalesce(list_sum(list_transform(p[1:i - 1], lambda x: len(x))), 0)::INT AS start_pos, list_sum(list_transform(p[1:i], lambda x: len(x)))::INT AS end_pos, p[i] AS text FROM n""")
def source_units(t: Tables) -> DataFrame:
    return t.train_references.where("facts <> ''").select("ref_no", F.explode(X.source_units("facts")).alias("u")).select("ref_no", "u.*")


@P.add("""
WITH u AS (SELECT ref_no, regexp_extract_all(facts, '[^。！？；\n]*[。！？；\n]+|[^。！？；\n]+') AS p FROM train_references WHERE facts <> ''), n AS (SELECT ref_no, unnest(p) AS x FROM u),
c AS (SELECT ref_no, x, unnest(generate_series(0, len(x) - 1, 160)) AS o FROM n)
SELECT ref_no, count(*) AS n_chunks, max(len(substring(x, (o + 1)::INT, 160))) AS longest FROM c WHERE NOT regexp_matches(substring(x, (o + 1)::INT, 160), '^[\t-\r    -     　]*$') GROUP BY ref_no""")
def sentence_chunks(t: Tables) -> DataFrame:
    """Units cut into chunks of 160 characters, blank ones dropped."""
    u = t.train_references.where("facts <> ''").select("ref_no", F.explode(X.source_units("facts")).alias("u"))
    c = u.select("ref_no", F.explode(F.sequence(F.lit(0), F.char_length("u.text") - 1, F.lit(160))).alias("o"), "u")
    chunk = F.substring(F.col("u.text"), F.col("o") + 1, F.lit(160))
    return c.select("ref_no", chunk.alias("x")).where(X.trim_space("x") != "").groupBy("ref_no").agg(F.count(F.lit(1)).alias("n_chunks"), F.max(F.char_length("x")).alias("longest"))


@P.add("""
WITH q AS (SELECT ref_no, facts, target_person AS quote FROM train_references WHERE facts IS NOT NULL),
p AS (SELECT ref_no, quote, facts, instr(facts, quote) AS a, instr(substring(facts, instr(facts, quote) + 1), quote) AS b FROM q)
SELECT ref_no, CASE WHEN quote IS NULL OR quote = '' THEN 'empty' WHEN a = 0 THEN 'absent' WHEN b > 0 THEN 'ambiguous' ELSE 'found' END AS status,
  CASE WHEN a > 0 AND b = 0 AND quote <> '' THEN a - 1 END AS start_pos, CASE WHEN a > 0 AND b = 0 AND quote <> '' THEN a - 1 + len(quote) END AS end_pos FROM p""")
def person_quotes(t: Tables) -> DataFrame:
    return t.train_references.where("facts IS NOT NULL").select("ref_no", X.quote_status("facts", "target_person").alias("q")).select("ref_no", "q.*")


@P.add("""
WITH q AS (SELECT ref_no, facts, substring(facts, 11, 8) AS quote FROM train_references WHERE facts IS NOT NULL),
p AS (SELECT ref_no, quote, instr(facts, quote) AS a, instr(substring(facts, instr(facts, quote) + 1), quote) AS b FROM q)
SELECT ref_no, CASE WHEN quote = '' THEN 'empty' WHEN a = 0 THEN 'absent' WHEN b > 0 THEN 'ambiguous' ELSE 'found' END AS status,
  CASE WHEN a > 0 AND b = 0 AND quote <> '' THEN a - 1 END AS start_pos, CASE WHEN a > 0 AND b = 0 AND quote <> '' THEN a - 1 + len(quote) END AS end_pos FROM p""")
def quote_resolution(t: Tables) -> DataFrame:
    rows = t.train_references.where("facts IS NOT NULL").withColumn("quote", F.substring("facts", 11, 8))
    return rows.select("ref_no", X.quote_status("facts", "quote").alias("q")).select("ref_no", "q.*")


@P.add("""
WITH r AS (SELECT ref_no, target_person AS n, str_split(facts, target_person) AS parts FROM train_references WHERE target_person <> '' AND contains(facts, target_person))
SELECT ref_no, len(parts) - 1 - len(list_filter(parts[2:], lambda x: x[1] IN ('某', 'X', '×', '*'))) AS n_places FROM r""")
def person_places(t: Tables) -> DataFrame:
    """How often a record's person stands in its facts, longer placeholders left out."""
    return t.train_references.where("target_person <> ''").where(F.contains("facts", "target_person")).select("ref_no", F.size(X.name_spans("facts", "target_person")).cast("bigint").alias("n_places"))


@P.add("SELECT CASE WHEN sentence_months <= 0 THEN '0' WHEN sentence_months <= 6 THEN '1-6' WHEN sentence_months <= 12 THEN '7-12' WHEN sentence_months <= 36 THEN '13-36' WHEN sentence_months <= 60 THEN '37-60' WHEN sentence_months <= 120 THEN '61-120' ELSE '>120' END AS bin, count(*) AS n FROM train_references WHERE sentence_months IS NOT NULL GROUP BY 1")
def month_histogram(t: Tables) -> DataFrame:
    return t.train_references.where("sentence_months IS NOT NULL").groupBy(X.month_bin("sentence_months").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@P.add("""SELECT pred_no, substring(text, 1, p - 1) || '#' || substring(text, p + 1) AS view FROM (SELECT pred_no, text, instr(text, ':') AS p FROM predictions) WHERE p > 0""")
def spliced_views(t: Tables) -> DataFrame:
    """A mark put over the character at a known place of each output."""
    at = F.instr("text", ":") - 1
    return t.predictions.where(F.instr("text", ":") > 0).select("pred_no", X.overlay_at("text", F.lit("#"), at, at + 1).alias("view"))


@P.add()
def json_prefixes(t: Tables) -> DataFrame:
    return t.predictions.select("pred_no", X.json_prefix("text").alias("prefix")).where("prefix IS NOT NULL")


QUERIES, SQL = P.queries, P.sql
