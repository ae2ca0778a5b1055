"""Queries on annotation protocols, typed events, screens, reviews and packages.

The test tables hold no annotations, so bodies, observations and plans are made
of their records by fixed rules, the same in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions import text as X
from caseloom.functions.kleene import state_name
from caseloom.operators import annotations as A
from caseloom.operators import events as V
from caseloom.operators import metrics as E
from caseloom.operators import packaging as G
from caseloom.operators import review as W
from caseloom.operators import screens as Q
from caseloom.operators import similarity as M

from .base import Plans, Tables
from .cases import _PAIRS, grams
from .ledgers import _ONCE, once
from .logic import _ANSWER, _STATES, _VISIBLE, _states, messages_sql
from .sqltext import json_text, trim

P = Plans()
SYSTEM = "Answer in JSON."

# ---- annotation bodies --------------------------------------------------------------------------------------
BODY = "struct<decision:string,issues:array<string>,evidence:array<struct<quote:string,subject:string,relation:string,kind:string>>,summary:string>"


def bodies(t: Tables) -> DataFrame:
    """(ref_no, facts, body) of every record with facts, with all kinds of faults."""
    n, quote = F.col("ref_no"), F.substring("facts", 11, 12)
    item = lambda q, s: F.struct(
        q.alias("quote"), s.alias("subject"), F.when(n % 4 == 0, "target").when(n % 4 == 1, "uncertain").when(n % 4 == 2, "other").otherwise("witness").alias("relation"),
        F.when(n % 6 == 0, "guess").otherwise("action").alias("kind"),
    )
    subject = F.when(n % 3 == 1, F.substring(quote, 1, 2)).when(n % 3 == 2, "nobody")
    first = F.array(item(quote, subject))
    evidence = F.when(n % 10 == 3, F.array(item(F.lit("not in the source"), F.lit(" ")))).when(n % 9 == 0, F.concat(first, first)).when(n % 10 == 7, F.array().cast(first_type())).otherwise(first)
    body = F.struct(
        F.when(n % 7 == 0, "review").when(n % 7 == 1, "maybe").otherwise("keep").alias("decision"),
        F.when(n % 7 == 0, F.array(F.lit("unclear"))).when(n % 5 == 0, F.array(F.lit(""), F.repeat(F.lit("x"), F.lit(250)))).otherwise(F.array().cast("array<string>")).alias("issues"),
        evidence.alias("evidence"), F.when(n % 11 == 0, None).when(n % 13 == 0, F.repeat(F.lit("s"), F.lit(201))).otherwise("summary").alias("summary"),
    )
    return t.train_references.where("facts IS NOT NULL").select("ref_no", "facts", body.cast(BODY).alias("body"))


def first_type() -> str:
    return "array<struct<quote:string,subject:string,relation:string,kind:string>>"


_BODIES = """b0 AS (SELECT ref_no, facts, ref_no AS n, substring(facts, 11, 12) AS q FROM train_references WHERE facts IS NOT NULL),
b AS (SELECT ref_no, facts, n, CASE WHEN n % 7 = 0 THEN 'review' WHEN n % 7 = 1 THEN 'maybe' ELSE 'keep' END AS decision,
  CASE WHEN n % 7 = 0 THEN ['unclear'] WHEN n % 5 = 0 THEN ['', repeat('x', 250)] ELSE []::VARCHAR[] END AS issues,
  CASE WHEN n % 11 = 0 THEN NULL WHEN n % 13 = 0 THEN repeat('s', 201) ELSE 'summary' END AS summary,
  CASE WHEN n % 10 = 3 THEN ['not in the source'] WHEN n % 9 = 0 THEN [q, q] WHEN n % 10 = 7 THEN []::VARCHAR[] ELSE [q] END AS quotes,
  CASE WHEN n % 10 = 3 THEN ' ' WHEN n % 3 = 1 THEN substring(q, 1, 2) WHEN n % 3 = 2 THEN 'nobody' END AS subject,
  CASE n % 4 WHEN 0 THEN 'target' WHEN 1 THEN 'uncertain' WHEN 2 THEN 'other' ELSE 'witness' END AS relation, CASE WHEN n % 6 = 0 THEN 'guess' ELSE 'action' END AS kind FROM b0),
i AS (SELECT *, quotes[k + 1] AS quote FROM (SELECT *, unnest(generate_series(0, len(quotes) - 1)) AS k FROM b))"""


def _checks_sql(strict: bool) -> str:
    body = [
        ("decision", "expected_keep_or_review", "decision NOT IN ('keep', 'review')"),
        ("issues", "expected_list_of_nonempty_strings", "len(list_filter(issues, lambda x: trim(x) = ''" + (" OR len(x) > 240" if strict else "") + ")) > 0"),
        ("summary", "expected_string", "summary IS NULL"), ("evidence", "keep_requires_at_least_one_item", "decision = 'keep' AND len(quotes) = 0"),
        ("summary", "keep_requires_nonempty_summary", "decision = 'keep' AND coalesce(trim(summary), '') = ''"), ("issues", "keep_requires_empty_issues", "decision = 'keep' AND len(issues) > 0"),
        ("issues", "review_requires_explanation", "decision = 'review' AND len(issues) = 0"),
    ]
    item = [
        ("quote", "expected_nonempty_string", "coalesce(trim(quote), '') = ''"), ("relation", "invalid_enum", "relation NOT IN ('target', 'other', 'uncertain')"), ("kind", "invalid_enum", "kind NOT IN ('action', 'outcome', 'post_event', 'context')"),
        ("subject", "expected_nonempty_string_or_null", "trim(subject) = ''"),
    ]
    if strict:
        body.append(("summary", "too_long", "len(summary) > 200"))
        item += [
            ("quote", "must_match_source_exactly_once", "trim(quote) <> '' AND (len(facts) - len(replace(facts, quote, ''))) / len(quote) <> 1"), ("quote", "duplicate_evidence_item", "trim(quote) <> '' AND list_contains(quotes[1:k], quote)"),
            ("subject", "null_subject_but_definite_relation", "subject IS NULL AND relation <> 'uncertain'"), ("subject", "subject_mention_absent_from_this_quote", "trim(subject) <> '' AND NOT contains(quote, subject)"),
        ]
    else:
        item.append(("quote", "quote_not_in_source", "trim(quote) <> '' AND NOT contains(facts, quote)"))
    rows = [f"SELECT ref_no, '{p}' AS path, '{m}' AS problem FROM b WHERE {w}" for p, m, w in body] + [f"SELECT ref_no, 'evidence[' || k || '].{p}', '{m}' FROM i WHERE {w}" for p, m, w in item]
    return f"WITH {_BODIES}\n" + "\nUNION ALL ".join(rows)


@P.add(_checks_sql(False))
def structure_problems(t: Tables) -> DataFrame:
    """Annotation bodies read loosely: form, and quotes that stand in their source."""
    return A.structure_problems(bodies(t), "ref_no", "body", "facts")


@P.add(_checks_sql(True))
def strict_structure_problems(t: Tables) -> DataFrame:
    """Annotation bodies read strictly: sizes, quotes at exactly one place, subjects within their quotes."""
    return A.structure_problems(bodies(t), "ref_no", "body", "facts", A.STRICT)


@P.add(f"""
WITH r AS (SELECT pred_no, finish_reason AS f, {trim("text")} AS x FROM predictions), o AS (SELECT pred_no, f, CASE WHEN json_valid(x) AND json_type(x) = 'OBJECT' THEN x END AS x FROM r),
k AS (SELECT *, array_to_string(list_sort(list_filter(['evidence', 'reasoning', 'sentence_months'], lambda y: NOT list_contains(json_keys(x), y))), ',') AS missing,
  array_to_string(list_sort(list_filter(json_keys(x), lambda y: NOT list_contains(['evidence', 'reasoning', 'sentence_months'], y))), ',') AS unexpected FROM o),
p AS (SELECT *, CASE WHEN f <> 'stop' THEN 'incomplete_response' WHEN x IS NULL THEN 'invalid_JSON' WHEN missing <> '' OR unexpected <> '' THEN 'wrong_fields' END AS problem FROM k)
SELECT pred_no, problem, CASE WHEN problem = 'wrong_fields' THEN missing END AS missing, CASE WHEN problem = 'wrong_fields' THEN unexpected END AS unexpected FROM p WHERE problem IS NOT NULL""")
def response_problems(t: Tables) -> DataFrame:
    """Raw outputs that were cut off, are no single object, or lack a field."""
    return A.response_problems(t.predictions, "pred_no", "text", "finish_reason", ("reasoning", "sentence_months", "evidence"))


@P.add(f"WITH {_BODIES} SELECT decision, count(*) AS quotes, count(*) FILTER (WHERE trim(quote) <> '' AND contains(facts, quote)) AS source_quotes, count(*) FILTER (WHERE subject <> '' AND contains(quote, subject)) AS literal_subject_in_quote FROM i GROUP BY decision")
def evidence_counts(t: Tables) -> DataFrame:
    items = bodies(t).select("facts", "body.decision", F.explode("body.evidence").alias("e")).select("facts", "decision", "e.*")
    return A.evidence_counts(items, "decision", "quote", "subject", "facts")


_PRINT = f"sha256({_VISIBLE} || chr(10) || 'rules 1')"


@P.add(f"""
WITH r AS (SELECT ref_no, {_PRINT} AS p FROM train_references WHERE split = 'dev' AND facts IS NOT NULL AND charge IS NOT NULL), a AS (SELECT ref_no, CASE WHEN ref_no % 9 = 0 THEN 'stale' ELSE p END AS p FROM r WHERE ref_no % 8 <> 0 UNION ALL SELECT -1, 'none')
SELECT coalesce(r.ref_no, a.ref_no) AS ref_no, CASE WHEN r.ref_no IS NULL THEN 'foreign' WHEN a.ref_no IS NULL THEN 'unannotated' ELSE 'changed_input' END AS problem FROM r FULL JOIN a ON r.ref_no = a.ref_no WHERE r.p IS DISTINCT FROM a.p""")
def binding_problems(t: Tables) -> DataFrame:
    """Annotations bound to their inputs by fingerprint: some missing, some of other inputs, one of no record."""
    rows = t.train_references.where("split = 'dev' AND facts IS NOT NULL AND charge IS NOT NULL").select("ref_no", A.annotation_fingerprint(G.visible(t.train_references), F.lit("rules 1")).alias("p"))
    made = rows.where("ref_no % 8 <> 0").select("ref_no", F.when(F.col("ref_no") % 9 == 0, "stale").otherwise(F.col("p")).alias("p"))
    return A.binding_problems(made.unionByName(t.spark.createDataFrame([(-1, "none")], "ref_no bigint, p string")), rows, "ref_no", "p")


FLAGS = [
    A.Flag("cue_unknown", "unknown", "returned", "退缴|扣押"), A.Flag("long_refuted", "refuted", "long"), A.Flag("weighed_many", "supported", "weighed", "[0-9]{3}", "quote"), A.Flag("witness_named", "supported", "witness", "某", "quote"),
    A.Flag("unknown_with_evidence", "unknown", needs_quote=True),
]


@P.add(f"""
WITH {_STATES}, s AS (UNPIVOT (SELECT t.ref_no, t.facts, substring(t.facts, 1, 40) AS quote, {", ".join(f"CASE WHEN st.{c} THEN 'supported' WHEN NOT st.{c} THEN 'refuted' ELSE 'unknown' END AS {c}" for c in ("witness", "weighed", "returned", "long"))} FROM train_references t JOIN st USING (ref_no)) ON witness, weighed, returned, long INTO NAME condition VALUE status),
f AS (SELECT ref_no, unnest(list_filter([CASE WHEN status = 'unknown' AND condition = 'returned' AND regexp_matches(coalesce(facts, ''), '退缴|扣押') THEN 'cue_unknown' END, CASE WHEN status = 'refuted' AND condition = 'long' THEN 'long_refuted' END,
  CASE WHEN status = 'supported' AND condition = 'weighed' AND regexp_matches(coalesce(quote, ''), '[0-9]{{3}}') THEN 'weighed_many' END, CASE WHEN status = 'supported' AND condition = 'witness' AND contains(coalesce(quote, ''), '某') THEN 'witness_named' END,
  CASE WHEN status = 'unknown' AND coalesce(quote, '') <> '' THEN 'unknown_with_evidence' END], lambda x: x IS NOT NULL)) AS flag FROM s)
SELECT DISTINCT ref_no, flag FROM f""")
def state_flags(t: Tables) -> DataFrame:
    """Reviewer's flags on the condition states of every record."""
    names = ("witness", "weighed", "returned", "long")
    rows = _states(t).join(t.train_references.select("ref_no", "facts", F.substring("facts", 1, 40).alias("quote")), "ref_no")
    each = F.array(*[F.struct(F.lit(c).alias("condition"), state_name(F.col("states")[c]).alias("status")) for c in names])
    return A.state_flags(rows.select("ref_no", "facts", "quote", F.explode(each).alias("s")).select("ref_no", "facts", "quote", "s.*"), "ref_no", "condition", "status", "facts", "quote", FLAGS)


@P.add("""
WITH u AS (SELECT ref_no, facts, regexp_extract_all(facts, '[^。！？；\n]*[。！？；\n]+|[^。！？；\n]+') AS p FROM train_references WHERE facts <> '' AND split = 'train'),
s AS (SELECT ref_no, facts, k::INT AS i, coalesce(list_sum(list_transform(p[1:k], lambda x: len(x))), 0) AS a, list_sum(list_transform(p[1:k + 1], lambda x: len(x))) AS b FROM (SELECT *, unnest(generate_series(0, len(p) - 1)) AS k FROM u)),
q AS (SELECT ref_no, facts, unnest([{'q': substring(facts, 3, 9), 'r': 'target'}, {'q': substring(facts, 6, 5), 'r': CASE WHEN ref_no % 3 = 0 THEN 'other' ELSE 'target' END}, {'q': substring(facts, 41, 30), 'r': 'other'}]) AS x FROM u),
l AS (SELECT ref_no, x.r AS r, instr(facts, x.q) - 1 AS a, len(x.q) AS n FROM q WHERE x.q <> '' AND instr(substring(facts, instr(facts, x.q) + 1), x.q) = 0),
v AS (SELECT s.ref_no, s.i, min(r) AS low, max(r) AS high FROM s JOIN l ON s.ref_no = l.ref_no AND s.a <= l.a AND l.a + l.n <= s.b GROUP BY 1, 2)
SELECT s.ref_no, s.i, CASE WHEN low = high THEN low END AS label, CASE WHEN low IS NULL THEN 'unlabelled' WHEN low <> high THEN 'conflict' ELSE 'labelled' END AS outcome FROM s LEFT JOIN v USING (ref_no, i)""")
def span_votes(t: Tables) -> DataFrame:
    """Units of the training records with the one relation that the quotes within them vote for."""
    rows = t.train_references.where("facts <> '' AND split = 'train'")
    spans = rows.select("ref_no", F.posexplode(X.source_units("facts")).alias("i", "u")).select("ref_no", "i", "u.start_pos", "u.end_pos")
    made = F.array(
        F.struct(F.substring("facts", 3, 9).alias("quote"), F.lit("target").alias("relation")), F.struct(F.substring("facts", 6, 5).alias("quote"), F.when(F.col("ref_no") % 3 == 0, "other").otherwise("target").alias("relation")),
        F.struct(F.substring("facts", 41, 30).alias("quote"), F.lit("other").alias("relation")),
    )
    return A.span_votes(rows.select("ref_no", "facts", F.explode(made).alias("x")).select("ref_no", "facts", "x.*"), spans, "ref_no", "facts")


# ---- typed events -------------------------------------------------------------------------------------------
#: Invented events: kind, the words that tell of it, its condition, and what it says of that (None: nothing).
EVENTS = [("summons", "传唤", "appearance", None), ("stopped", "截停", "appearance", False), ("came", "前往", "appearance", True), ("silent", "一言不发", "statement", False), ("said", "称：", "statement", True), ("repaid", "退缴", "repayment", True), ("lent", "借给", "repayment", False), ("shared", "平分", "outcome", True)]
CONDITIONS = [("appearance", False, "current_case", False), ("statement", False, "current_case", False), ("repayment", True, "current_case", False), ("outcome", False, "current_case", True)]


def event_tables(t: Tables) -> tuple[DataFrame, DataFrame]:
    return t.spark.createDataFrame([(k, c, e) for k, _, c, e in EVENTS if k != "lent"], "kind string, condition_id string, effect boolean"), t.spark.createDataFrame(CONDITIONS, "condition_id string, takes_proxy boolean, scope string, case_wide boolean")


def observations(t: Tables) -> DataFrame:
    """(ref_no, no, kind, actor, scope, coverage, unit_ids, units): the units of training records that hold an event's words."""
    rows = t.train_references.where("facts <> '' AND split = 'train'").select("ref_no", X.source_units("facts").alias("units"))
    each = rows.select("ref_no", "units", F.posexplode("units").alias("i", "u"))
    kinds = F.array_compact(F.array(*[F.when(F.contains(F.col("u.text"), F.lit(w)), F.struct(F.lit(n).alias("k"), F.lit(k).alias("kind"))) for n, (k, w, _, _) in enumerate(EVENTS)]))
    o = each.select("ref_no", "units", "i", "u", F.explode(kinds).alias("e"))
    i = F.col("i") + F.col("e.k")
    ids = F.when(i % 17 == 5, F.array(F.col("u.id"), F.lit("s0"))).when(i % 17 == 6, F.array(F.col("u.id"), F.lit("s1"))).otherwise(F.array("u.id"))
    return o.select(
        "ref_no", (F.col("i") * 10 + F.col("e.k")).alias("no"), "e.kind", F.when(i % 7 == 0, "unclear").when(i % 5 == 0, "proxy").when(i % 11 == 0, "other").when(i % 19 == 3, "nobody").otherwise("defendant").alias("actor"),
        F.when(i % 13 == 0, "unclear").otherwise("current_case").alias("scope"), F.when(i % 3 == 0, "single_event").otherwise("case_wide").alias("coverage"), ids.alias("unit_ids"), "units",
    )


_OBS = f"""u AS (SELECT ref_no, regexp_extract_all(facts, '[^。！？；\n]*[。！？；\n]+|[^。！？；\n]+') AS p FROM train_references WHERE facts <> '' AND split = 'train'),
n AS (SELECT ref_no, p, unnest(generate_series(0, len(p) - 1)) AS i FROM u),
ev AS (SELECT * FROM (VALUES {", ".join(f"({n}, '{k}', '{w}', '{c}', {'NULL' if e is None else str(e).lower()}::BOOLEAN)" for n, (k, w, c, e) in enumerate(EVENTS))}) v(k, kind, word, condition_id, effect)),
o AS (SELECT ref_no, i * 10 + k AS no, kind, condition_id, effect, i, i + k AS x, p FROM n JOIN ev ON contains(p[i + 1], word)),
obs AS (SELECT *, CASE WHEN x % 7 = 0 THEN 'unclear' WHEN x % 5 = 0 THEN 'proxy' WHEN x % 11 = 0 THEN 'other' WHEN x % 19 = 3 THEN 'nobody' ELSE 'defendant' END AS actor, CASE WHEN x % 13 = 0 THEN 'unclear' ELSE 'current_case' END AS scope,
  CASE WHEN x % 3 = 0 THEN 'single_event' ELSE 'case_wide' END AS coverage, CASE WHEN x % 17 = 5 THEN ['s' || (i + 1), 's0'] WHEN x % 17 = 6 THEN ['s' || (i + 1), 's1'] ELSE ['s' || (i + 1)] END AS ids FROM o),
bad AS (SELECT ref_no, no, unnest(list_filter([CASE WHEN kind = 'lent' THEN 'unknown_kind' END, CASE WHEN count(*) OVER (PARTITION BY ref_no, kind) > 3 THEN 'over_budget' END, CASE WHEN actor = 'nobody' THEN 'invalid_binding' END,
  CASE WHEN list_contains(ids, 's0') OR (len(ids) = 2 AND ids[1] = ids[2]) THEN 'invalid_units' END], lambda y: y IS NOT NULL)) AS problem FROM obs)"""


@P.add(f"WITH {_OBS} SELECT ref_no, no, problem FROM bad")
def event_problems(t: Tables) -> DataFrame:
    return V.event_problems(observations(t), "ref_no", event_tables(t)[0])


_REDUCED = f"""{_OBS}, good AS (SELECT * FROM obs WHERE (ref_no, no) NOT IN (SELECT (ref_no, no) FROM bad)),
j AS (SELECT *, condition_id = 'outcome' AS wide, (actor = 'defendant' OR (actor = 'proxy' AND condition_id = 'repayment')) AND scope = 'current_case' AND (condition_id <> 'outcome' OR coverage = 'case_wide') AS ok FROM good),
r AS (SELECT ref_no, condition_id, bool_or(wide AND actor = 'defendant' AND scope = 'current_case' AND coverage <> 'case_wide') AS partial, bool_or(actor = 'unclear' OR scope = 'unclear') AS unclear,
  count(*) FILTER (WHERE ok AND effect) AS yes, count(*) FILTER (WHERE ok AND NOT effect) AS no, list(kind ORDER BY no) AS kinds, count(DISTINCT i) FILTER (WHERE ok AND effect IS NOT NULL AND len(ids) = 1) AS used1 FROM j GROUP BY 1, 2),
c AS (SELECT * FROM (SELECT ref_no FROM u), (SELECT unnest(['appearance', 'statement', 'repayment', 'outcome']) AS condition_id)),
f AS (SELECT c.ref_no, c.condition_id, yes, no, kinds, CASE WHEN yes IS NULL THEN 'not_mentioned' WHEN partial THEN 'partial_case_outcome' WHEN unclear THEN 'binding_unclear' WHEN yes > 0 AND no > 0 THEN 'conflicting_evidence' WHEN yes + no = 0 THEN 'insufficient_evidence' ELSE 'none' END AS reason FROM c LEFT JOIN r USING (ref_no, condition_id))"""


def _reduced(t: Tables) -> DataFrame:
    events, conditions = event_tables(t)
    o = observations(t)
    good = o.join(V.event_problems(o, "ref_no", events).select("ref_no", "no").distinct(), ["ref_no", "no"], "left_anti")
    return V.reduce_events(t.train_references.where("facts <> '' AND split = 'train'").select("ref_no"), good, "ref_no", events, conditions)


@P.add(f"""WITH {_REDUCED} SELECT ref_no, condition_id, CASE WHEN reason = 'none' AND yes > 0 THEN 'supported' WHEN reason = 'none' THEN 'refuted' ELSE 'unknown' END AS state, reason, coalesce(array_to_string(kinds, ','), '') AS kinds FROM f""")
def event_states(t: Tables) -> DataFrame:
    """The state of every condition by the usable events of each training record."""
    return _reduced(t).withColumn("kinds", F.array_join("kinds", ",")).select("ref_no", "condition_id", "state", "reason", "kinds")


@P.add(f"""
WITH {_REDUCED}, w AS (SELECT j.ref_no, j.condition_id, f.reason, j.ok AND j.effect IS NOT NULL AS used, unnest(list_transform(ids, lambda x: p[(x[2:])::INT])) AS quote, unnest(list_transform(ids, lambda x: (x[2:])::INT)) AS k FROM j JOIN f USING (ref_no, condition_id))
SELECT ref_no, condition_id, CASE WHEN reason = 'none' THEN 'evidence' ELSE 'context' END AS role, count(DISTINCT k) AS n_spans, sum(DISTINCT k)::BIGINT AS unit_sum FROM w WHERE used OR reason <> 'none' GROUP BY 1, 2, 3""")
def event_spans(t: Tables) -> DataFrame:
    """How many distinct spans back each state, or stand as context where it is unknown, and the sum of their unit numbers."""
    rows = _reduced(t).select("ref_no", "condition_id", F.explode(F.array(F.struct(F.lit("evidence").alias("role"), F.col("evidence").alias("s")), F.struct(F.lit("context").alias("role"), F.col("context").alias("s")))).alias("x"))
    units = t.train_references.select("ref_no", X.source_units("facts").alias("units"))
    each = rows.select("ref_no", "condition_id", "x.role", F.explode("x.s").alias("s")).join(units, "ref_no")
    number = F.array_position(F.transform("units", lambda u: u["start_pos"]), F.col("s.start_pos"))
    return each.groupBy("ref_no", "condition_id", "role").agg(F.count(F.lit(1)).alias("n_spans"), F.sum(number).alias("unit_sum"))


@P.add(f"""
WITH {_ONCE}, c AS (SELECT id, arg_min(charge, ref_no) AS charge FROM train_references GROUP BY id), r AS (SELECT o.mode, o.status, c.charge, o.reason IS NOT NULL AS explained FROM once o LEFT JOIN c USING (id))
SELECT mode, CASE WHEN grouping(charge) = 0 THEN 'charge' WHEN grouping(status) = 0 THEN 'status' ELSE 'all' END AS scope, CASE WHEN grouping(charge) = 0 THEN charge WHEN grouping(status) = 0 THEN status END AS name, count(*) AS requested, count(*) FILTER (WHERE status <> 'accepted') AS failed, count(*) FILTER (WHERE explained) AS explained
FROM r GROUP BY GROUPING SETS ((mode), (mode, status), (mode, charge))""")
def request_denominators(t: Tables) -> DataFrame:
    """Requests of each mode, in all, by status and by charge, failures included in every denominator."""
    charges = t.train_references.groupBy("id").agg(F.min_by("charge", "ref_no").alias("charge"))
    rows = once(t).join(charges, "id", "left")
    sets = rows.withColumn("bad", (F.col("status") != "accepted").cast("bigint")).groupingSets([["mode"], ["mode", "status"], ["mode", "charge"]], "mode", "status", "charge")
    g = sets.agg(F.grouping("charge").alias("gc"), F.grouping("status").alias("gs"), F.count(F.lit(1)).alias("requested"), F.sum("bad").alias("failed"), F.count("reason").alias("explained"))
    scope = F.when(F.col("gc") == 0, "charge").when(F.col("gs") == 0, "status").otherwise("all")
    return g.select("mode", scope.alias("scope"), F.when(F.col("gc") == 0, F.col("charge")).when(F.col("gs") == 0, F.col("status")).alias("name"), "requested", "failed", "explained")


# ---- screens ------------------------------------------------------------------------------------------------
#: Clauses that a screen withholds in these tables' texts.
RISK = ("传唤|查获", "[0-9]{2}[吨捆]")


def _hits(text: str) -> Column:
    return F.filter(F.split(F.col(text), "[。；\n]"), lambda x: x.rlike(RISK[0]) & x.rlike(RISK[1]))


_HELD = f"held AS (SELECT DISTINCT id FROM (SELECT id, unnest(regexp_split_to_array(facts, '[。；\n]')) AS c FROM train_references WHERE id IS NOT NULL) WHERE regexp_matches(c, '{RISK[0]}') AND regexp_matches(c, '{RISK[1]}'))"


def _screened(t: Tables) -> dict[str, DataFrame]:
    held = Q.quarantined(t.train_references.where("id IS NOT NULL AND facts IS NOT NULL"), "id", _hits("facts"))
    return Q.withhold({"references": t.train_references, "predictions": t.predictions}, "id", held)


@P.add(f"""
WITH {_HELD}, b AS (SELECT split, charge, count(*) AS b, count(*) FILTER (WHERE id IS NULL OR id NOT IN (SELECT id FROM held)) AS a FROM train_references GROUP BY 1, 2), s AS (SELECT split, sum(b)::BIGINT AS n_before, sum(a)::BIGINT AS n_after, count(*) FILTER (WHERE a = 0) AS lost_classes FROM b GROUP BY split)
SELECT *, CASE WHEN n_after = 0 THEN 'emptied' WHEN n_after < 0.5 * n_before THEN 'too_many_removed' WHEN lost_classes > 0 THEN 'class_lost' END AS problem FROM s""")
def screen_guards(t: Tables) -> DataFrame:
    """What a screen leaves of each split, and whether it may stand."""
    return Q.screen_guards(t.train_references, _screened(t)["references"], "split", "charge")


@P.add(f"""
WITH {_HELD}, p AS (SELECT id, arm, count(*) AS n FROM predictions WHERE id IS NULL OR id NOT IN (SELECT id FROM held) GROUP BY 1, 2), c AS (SELECT DISTINCT id, a AS arm FROM p, (SELECT unnest(['direct', 'flat', 'bound']) AS a) WHERE p.arm IN ('direct', 'flat', 'bound'))
SELECT c.id, c.arm, CASE WHEN n IS NULL THEN 'missing' ELSE 'repeated' END AS problem FROM c LEFT JOIN p USING (id, arm) WHERE n IS NULL OR n > 1""")
def screened_arm_pairing(t: Tables) -> DataFrame:
    """Outputs of the records that a screen leaves: arms that lack one or hold it twice."""
    return Q.arm_pairing(_screened(t)["predictions"], "id", "arm", ["direct", "flat", "bound"])


@P.add("""
WITH s AS (SELECT id, dataset, source_id FROM train_references WHERE split IN ('dev', 'test')), f AS (SELECT * FROM train_references p WHERE split = 'train' AND NOT EXISTS (SELECT 1 FROM s WHERE s.id = p.id) AND NOT EXISTS (SELECT 1 FROM s WHERE s.dataset = p.dataset AND s.source_id = p.source_id))
SELECT ref_no, charge, r AS rank_in_class FROM (SELECT ref_no, charge, row_number() OVER (PARTITION BY charge ORDER BY md5(ref_no || '|42'), ref_no) AS r FROM f) WHERE r <= 30""")
def unexposed_cohort(t: Tables) -> DataFrame:
    """At most 30 training records a charge that share neither id nor source with a held-out one."""
    from caseloom.operators.sampling import per_class

    rows = t.train_references
    return per_class(Q.unexposed(rows.where("split = 'train'"), rows.where("split IN ('dev', 'test')"), "id", ["dataset", "source_id"]).select("ref_no", "charge"), "charge", "ref_no", 30)


@P.add(f"""
WITH g AS ({grams('ref_no', 'facts', 'train_references')}), s AS (SELECT ref_no AS id, split FROM train_references),
c AS (SELECT g.id, len(g) AS n, g.g AS g, f FROM g JOIN s USING (id) WHERE split = 'train'), i AS (SELECT g.id, len(g) AS n, g.g AS g, f FROM g JOIN s USING (id) WHERE split = 'dev'),
cg AS (SELECT id, n, unnest(g) AS x FROM (SELECT id, len(g) AS n, g FROM c)), ig AS (SELECT id, n, unnest(g) AS x FROM (SELECT id, len(g) AS n, g FROM i)), h AS (SELECT cg.id, ig.id AS d, count(*) AS k, any_value(least(cg.n, ig.n)) AS m FROM cg JOIN ig USING (x) GROUP BY 1, 2),
hit AS (SELECT id FROM h WHERE m >= 20 AND k >= 0.85 * m UNION SELECT c.id FROM c JOIN i ON c.f = i.f)
SELECT ref_no FROM train_references WHERE split = 'train' AND ref_no NOT IN (SELECT id FROM hit)""")
def train_minus_dev(t: Tables) -> DataFrame:
    """Training records without those whose text contains, equals or stands in that of a dev record."""
    table = lambda split: M.gram_table(t.train_references.where(F.col("split") == split), "ref_no", X.normalized_fact("facts"))
    hit = M.guard_matches(table("train"), table("dev")).select(F.col("id").alias("ref_no")).distinct()
    return t.train_references.where("split = 'train'").select("ref_no").join(hit, "ref_no", "left_anti")


# ---- reviews ------------------------------------------------------------------------------------------------
def _review(t: Tables) -> tuple[DataFrame, ...]:
    """(records, flags, pairs, quarantine, dismissals, links) over the dev and test records."""
    records = t.train_references.where("split IN ('dev', 'test')").select(F.col("ref_no").alias("id"), "facts", "charge", "sentence_months", "split")
    n = F.col("id")
    flags = records.select("id", F.explode(F.array_compact(F.array(*[F.when(F.contains("facts", F.lit(w)), F.lit(w)) for w in ("传唤", "退缴")]))).alias("kind"))
    pairs = records.where("id % 3 = 0").select(n.alias("left_id"), (n + 1).alias("right_id")).join(records.select(F.col("id").alias("right_id")), "right_id", "left_semi")
    quarantine = records.where("id % 9 = 0").select("id", F.when(n % 18 == 0, W.DUPLICATE).when(n % 27 == 0, "").otherwise("scope").alias("reason"))
    dismissals = records.where("id % 5 = 0").select("id", F.lit("传唤").alias("kind"))
    links = quarantine.where("id % 36 = 0").select(n.alias("excluded"), (n + 1).alias("representative"))
    return records, flags, pairs, quarantine, dismissals, links


_REVIEW = f"""rec AS (SELECT ref_no AS id, facts, charge, sentence_months, split FROM train_references WHERE split IN ('dev', 'test')),
fl AS (SELECT id, k AS kind FROM rec, (SELECT unnest(['传唤', '退缴']) AS k) WHERE contains(facts, k)), pr AS (SELECT id AS l, id + 1 AS r FROM rec WHERE id % 3 = 0 AND id + 1 IN (SELECT id FROM rec)),
qu AS (SELECT id, CASE WHEN id % 18 = 0 THEN '{W.DUPLICATE}' WHEN id % 27 = 0 THEN '' ELSE 'scope' END AS reason FROM rec WHERE id % 9 = 0), di AS (SELECT id, '传唤' AS kind FROM rec WHERE id % 5 = 0), li AS (SELECT id AS e, id + 1 AS p FROM qu WHERE id % 36 = 0)"""


@P.add(f"""
WITH {_REVIEW}
SELECT id, 'no_reason' AS problem FROM qu WHERE reason = '' UNION ALL SELECT id, 'dismissed_and_quarantined' FROM di WHERE id IN (SELECT id FROM qu) UNION ALL SELECT id, 'flag_not_audited' FROM di WHERE NOT EXISTS (SELECT 1 FROM fl WHERE fl.id = di.id AND fl.kind = di.kind)
UNION ALL SELECT id, 'no_representative' FROM qu WHERE reason = '{W.DUPLICATE}' AND id NOT IN (SELECT e FROM li) UNION ALL SELECT e, 'pair_not_audited' FROM li WHERE NOT EXISTS (SELECT 1 FROM pr WHERE l = e AND r = p)
UNION ALL SELECT e, 'labels_differ' FROM li JOIN rec a ON a.id = e JOIN rec b ON b.id = p WHERE a.charge IS DISTINCT FROM b.charge OR a.sentence_months IS DISTINCT FROM b.sentence_months OR a.split IS DISTINCT FROM b.split""")
def review_plan_problems(t: Tables) -> DataFrame:
    """What a review plan decides without its audit bearing it out."""
    return W.plan_problems(*_review(t), labels=["charge", "sentence_months", "split"])


@P.add(f"""
WITH {_REVIEW}, lf AS (SELECT id, list_sort(list_distinct(list(kind))) AS k FROM fl WHERE NOT EXISTS (SELECT 1 FROM di WHERE di.id = fl.id AND di.kind = fl.kind) GROUP BY id), op AS (SELECT * FROM pr WHERE l NOT IN (SELECT id FROM qu) AND r NOT IN (SELECT id FROM qu))
SELECT rec.id, qu.reason, li.p AS representative, CASE WHEN qu.id IS NULL THEN array_to_string(lf.k, ',') END AS remaining_flags, CASE WHEN qu.id IS NULL THEN rec.id IN (SELECT l FROM op UNION SELECT r FROM op) END AS unresolved_overlap,
  CASE WHEN qu.id IS NOT NULL THEN 'quarantine' WHEN lf.id IS NOT NULL OR rec.id IN (SELECT l FROM op UNION SELECT r FROM op) THEN 'pending' ELSE 'retained' END AS part
FROM rec LEFT JOIN qu USING (id) LEFT JOIN li ON li.e = rec.id LEFT JOIN lf ON lf.id = rec.id""")
def reviewed_records(t: Tables) -> DataFrame:
    """Every record in its part after review, with its reason, representative and what is left open."""
    out = W.apply_plan(*_review(t))
    return out.select("id", "reason", "representative", F.array_join("remaining_flags", ",").alias("remaining_flags"), "unresolved_overlap", "part")


# ---- packages -----------------------------------------------------------------------------------------------
_RULES = "[1,2]"


@P.add(f"""
WITH {_STATES}, v AS (SELECT t.ref_no, t.id, t.split, {json_text("t.charge")} AS c, {json_text("t.facts")} AS f, 'base' || chr(44) || coalesce(st.returned::VARCHAR, 'null') AS e FROM train_references t JOIN st USING (ref_no) WHERE t.split IN ('dev', 'test') AND t.facts IS NOT NULL AND t.charge IS NOT NULL),
b AS (SELECT ref_no, id, split, unnest([{{'v': 'base', 'u': '{{"charge":' || c || ',"facts":' || f || '}}'}}, {{'v': 'rules', 'u': '{{"candidate_rules":"{_RULES}","charge":' || c || ',"facts":' || f || '}}'}},
  {{'v': 'concat', 'u': '{{"candidate_rules":"{_RULES}","charge":' || c || ',"condition_evidence":"' || e || '","facts":' || f || '}}'}}, {{'v': 'composed', 'u': '{{"candidate_rules":"{_RULES}","charge":' || c || ',"composed_rule_trace":"open","condition_evidence":"' || e || '","facts":' || f || '}}'}}]) AS x FROM v)
SELECT ref_no, id, split, x.v AS variant, sha256({messages_sql(_ANSWER, "x.u")}) AS prompt_hash FROM b""")
def variant_jobs(t: Tables) -> DataFrame:
    """Jobs of all four variants of what a prompt shows, by hash."""
    rows = t.train_references.where("split IN ('dev', 'test')").join(_states(t), "ref_no")
    evidence = F.concat(F.lit("base,"), F.coalesce(F.col("states")["returned"].cast("string"), F.lit("null")))
    return G.variant_jobs(rows, "ref_no", SYSTEM, F.lit(_RULES), evidence, F.lit("open")).select("ref_no", "id", "split", "variant", "prompt_hash")


_MASKED = f"""mk AS (SELECT ref_no, id, split, coalesce(target_person <> '' AND contains(facts, target_person), false) AS available, {json_text("charge")} AS c, {json_text("facts")} AS f, {json_text("target_person")} AS p FROM train_references WHERE split = 'dev' AND facts IS NOT NULL AND charge IS NOT NULL),
mj AS (SELECT ref_no, id, split, available, unnest([{{'a': 'original', 'u': '{{"charge":' || c || ',"facts":' || f || '}}'}}, {{'a': 'target', 'u': '{{"charge":' || c || ',"facts":' || f || CASE WHEN available THEN ',"target_person":' || p ELSE '' END || '}}'}}]) AS x FROM mk)"""


@P.add(f"WITH {_MASKED} SELECT ref_no, id, split, available, x.a AS arm, sha256({messages_sql(_ANSWER, 'x.u')}) AS prompt_hash FROM mj")
def masked_pair(t: Tables) -> DataFrame:
    """Two jobs for each dev record, one with the person where the facts name it."""
    return G.masked_pair(t.train_references.where("split = 'dev'"), "ref_no", SYSTEM).drop("messages")


@P.add("""
WITH j AS (SELECT ref_no, coalesce(target_person <> '' AND contains(facts, target_person), false) AS available FROM train_references WHERE split = 'dev' AND facts IS NOT NULL AND charge IS NOT NULL)
SELECT ref_no, 'missing_arm' AS problem FROM j WHERE ref_no % 7 = 0 UNION ALL SELECT ref_no, 'hash_differs' FROM j WHERE ref_no % 5 = 0 UNION ALL SELECT ref_no, 'inputs_differ' FROM j WHERE ref_no % 7 = 0""")
def pair_problems(t: Tables) -> DataFrame:
    """Pairs of jobs that aren't whole: some without their target arm, some with another hash."""
    made = G.masked_pair(t.train_references.where("split = 'dev'"), "ref_no", SYSTEM).where("NOT (ref_no % 7 = 0 AND arm = 'target')")
    return G.pair_problems(made.withColumn("prompt_hash", F.when(F.col("ref_no") % 5 == 0, "other").otherwise(F.col("prompt_hash"))), "ref_no", SYSTEM)


@P.add("""
WITH j AS (SELECT id, min(prompt_hash) AS h FROM predictions WHERE arm = 'direct' AND id IS NOT NULL GROUP BY id), p AS (SELECT id, count(*) AS n, min(prompt_hash) AS lo, max(prompt_hash) AS hi FROM predictions WHERE arm = 'bound' GROUP BY id)
SELECT coalesce(j.id, p.id) AS id, CASE WHEN p.n IS NULL THEN 'missing' WHEN j.id IS NULL THEN 'foreign' WHEN n > 1 THEN 'repeated' ELSE 'other_prompt' END AS problem FROM j FULL JOIN p ON j.id = p.id WHERE p.n IS NULL OR j.id IS NULL OR n > 1 OR lo <> h OR hi <> h""")
def prediction_problems(t: Tables) -> DataFrame:
    """Outputs of one arm against the prompts that another arm was given."""
    jobs = t.predictions.where("arm = 'direct' AND id IS NOT NULL").groupBy("id").agg(F.min("prompt_hash").alias("prompt_hash"))
    return G.prediction_problems(jobs, t.predictions.where("arm = 'bound'"), "id")


@P.add("""
WITH l AS (SELECT md5(id)[1:2] AS g, id, row_number() OVER (PARTITION BY md5(id)[1:2] ORDER BY id, pred_no) AS position FROM predictions WHERE arm = 'flat' AND id IS NOT NULL), r AS (SELECT md5(id)[1:2] AS g, id, row_number() OVER (PARTITION BY md5(id)[1:2] ORDER BY id, pred_no) AS position FROM predictions WHERE arm = 'bound' AND id IS NOT NULL)
SELECT coalesce(l.g, r.g) AS g, coalesce(l.position, r.position) AS position, l.id AS left_key, r.id AS right_key FROM l FULL JOIN r ON l.g = r.g AND l.position = r.position WHERE l.id IS DISTINCT FROM r.id""")
def order_differences(t: Tables) -> DataFrame:
    """Places of two arms' ordered lists (one a part of the ids) that hold different cases."""
    side = lambda arm: t.predictions.where((F.col("arm") == arm) & F.col("id").isNotNull()).select("id", "pred_no", F.substring(F.md5("id"), 1, 2).alias("g"))
    return G.order_differences(side("flat"), side("bound"), "g", ["id", "pred_no"], "id")


@P.add("SELECT lang, n, coalesce(nullif(list_position(['zh', 'en', 'ja'], lang), 0), 4) AS place FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)")
def listed_order(t: Tables) -> DataFrame:
    """Languages in a given order, others behind."""
    n = t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.coalesce(G.listed_order("lang", ["zh", "en", "ja"]), F.lit(4)).cast("bigint"))


@P.add("""
WITH per AS (SELECT charge, sentence_months AS v, count(*)::DOUBLE AS m, max(ref_no) AS g FROM train_references WHERE charge IS NOT NULL AND sentence_months IS NOT NULL GROUP BY 1, 2), s AS (SELECT charge, v, g, m / sum(m) OVER (PARTITION BY charge) AS m FROM per), k AS (SELECT * FROM s WHERE m >= 0.02),
w AS (SELECT *, sum(m) OVER (PARTITION BY charge ORDER BY v) AS c, sum(m) OVER (PARTITION BY charge) AS t, row_number() OVER (PARTITION BY charge ORDER BY m DESC, v) AS r FROM k)
SELECT charge, min(v) FILTER (WHERE c >= t * 0.5) AS median_value, sum(m * v) / sum(m) AS mean_value, array_to_string(list(v ORDER BY r) FILTER (WHERE r <= 8), ',') AS top_values, 1 - sum(m) AS pruned_mass, max(g) AS greedy_value FROM w GROUP BY charge""")
def number_summary(t: Tables) -> DataFrame:
    """Months of each charge as a weighted distribution: median, mean, the eight heaviest, and what was pruned."""
    rows = t.train_references.where("charge IS NOT NULL").withColumn("mass", F.lit(1.0))
    return E.number_summary(rows, "charge", "sentence_months", "mass", "ref_no", least=0.02).withColumn("top_values", F.array_join("top_values", ","))


@P.add("SELECT item_id, CASE WHEN item_id * 1e8 < 7e9 THEN 'full' WHEN item_id * 1e8 >= 7e9 THEN 'lora' END AS mode, CASE lang WHEN 'zh' THEN 'units' WHEN 'th' THEN 'blanks' END AS policy FROM eval_items")
def dispatched_modes(t: Tables) -> DataFrame:
    """Names chosen by a bound and by a table."""
    return t.eval_items.select("item_id", X.training_mode(F.col("item_id") * 1e8).alias("mode"), X.dispatched("lang", {"zh": "units", "th": "blanks"}).alias("policy"))


QUERIES, SQL = P.queries, P.sql
