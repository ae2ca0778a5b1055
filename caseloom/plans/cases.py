"""Queries over case records: ingest, hygiene, duplicates, similarity, splits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.functions import text as X
from caseloom.functions.ids import digest, snapshot_hash
from caseloom.operators import cases as K
from caseloom.operators import sampling as D
from caseloom.operators import similarity as M
from caseloom.operators.components import entity_components
from caseloom.session import cut, join_unique

from .base import Plans, Tables
from .sqltext import WS, form, json_text, plain, trim

P = Plans()

def key(c: str) -> str:
    outer = rf"regexp_replace({trim(c)}, '^[\[\]【】]+|[\[\]【】]+$', '', 'g')"
    return f"regexp_replace(regexp_replace({outer}, '罪$', ''), '[{WS[1:-1]}\\[\\]【】，,、]', '', 'g')"


def grams(id: str, text: str, table: str) -> str:
    return f"SELECT {id} AS id, f, list_distinct(list_transform(generate_series(1, greatest(1, len(f) - 4)), lambda i: substring(f, i, 5))) AS g FROM (SELECT {id}, {form(text)} AS f FROM {table}) WHERE f <> ''"


OUTCOME, POST = X.OUTCOME.replace("\\n", "\n"), X.POSTJUDGMENT


@P.add(f"""
SELECT ref_no, id, dataset, split, source_id, nullif({trim("charge")}, '') AS charge, sentence_months,
       CASE WHEN lower({trim("opinion")}) NOT IN ('', '未知', 'unknown', 'null', 'none') THEN opinion END AS opinion
FROM train_references""")
def canonical_cases(t: Tables) -> DataFrame:
    charge = X.trim_space("charge")
    return t.train_references.select("ref_no", "id", "dataset", "split", "source_id", F.when(charge != "", charge).alias("charge"), "sentence_months", X.opinion_or_null("opinion").alias("opinion"))


@P.add(f"""
WITH r AS (SELECT member || ':' || line_no AS source_id, fact AS facts, meta.accusation[1] AS charge, meta.term_of_imprisonment.imprisonment AS judge FROM raw_cases)
SELECT 'raw:train:' || sha256('[' || {json_text("source_id")} || ',' || {json_text("facts")} || ']')[1:20] AS id, 'raw' AS dataset, 'train' AS split, source_id, facts, {trim("charge")} AS charge, NULL::VARCHAR AS opinion,
  CASE WHEN judge >= 0 THEN judge END AS sentence_months, 'given_charge' AS protocol, sha256('{{"charge":' || {json_text(trim("charge"))} || ',"facts":' || {json_text("facts")} || '}}') AS input_hash,
  CASE WHEN facts IS NULL OR {trim("facts")} = '' THEN 'missing_facts' WHEN charge IS NULL OR {trim("charge")} = '' THEN 'missing_charge' WHEN judge IS NULL OR judge < 0 THEN 'invalid_months' END AS error FROM r""")
def canonicalized_raw(t: Tables) -> DataFrame:
    """Raw records brought to the canonical schema, with what is wrong with each."""
    raw = t.raw_cases.select(F.concat_ws(":", "member", F.col("line_no").cast("string")).alias("source_id"), "fact", F.get("meta.accusation", F.lit(0)).alias("charge"), F.col("meta.term_of_imprisonment.imprisonment").alias("judge"))
    return K.canonicalize(raw, "raw", "train")


@P.add(f"""SELECT ref_no, sha256('{{"charge":' || {json_text("charge")} || ',"facts":' || {json_text("facts")} || '}}') AS input_digest FROM train_references""")
def input_digests(t: Tables) -> DataFrame:
    """The content hash of every record's visible input, nulls included."""
    return t.train_references.select("ref_no", digest(facts=F.col("facts"), charge=F.col("charge")).alias("input_digest"))


_ROW = " || ',' || ".join(
    f"""'"{c}":' || """ + (json_text(c) if kind == "text" else f"coalesce('\"' || strftime({c} AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%g') || 'Z\"', 'null')" if kind == "time" else f"coalesce(to_json({c})::VARCHAR, 'null')")
    for c, kind in sorted({**{c: "text" for c in ("id", "dataset", "split", "source_id", "facts", "charge", "target_person", "opinion", "protocol", "input_hash", "label_provenance", "lang")}, **{c: "number" for c in ("ref_no", "sentence_months", "relevant_articles_label")}, **{c: "time" for c in ("ruled_at", "ingested_at")}}.items())
)


@P.add(f"""
WITH h AS (SELECT md5('{{' || {_ROW} || '}}') AS h FROM train_references), n AS (SELECT count(*) AS n, sum(('0x' || h[1:15])::BIGINT::HUGEINT) AS a, sum(('0x' || h[17:31])::BIGINT::HUGEINT) AS b FROM h)
SELECT n, sha256(a::VARCHAR || '|' || b::VARCHAR) AS snapshot FROM n""")
def snapshot_of_references(t: Tables) -> DataFrame:
    return snapshot_hash(t.train_references)


@P.add("SELECT id, count(*) AS n_rows FROM train_references GROUP BY id HAVING count(*) > 1")
def repeated_ids(t: Tables) -> DataFrame:
    from caseloom.functions.ids import duplicates

    return duplicates(t.train_references, "id")


_ADAPT = f"""
listed AS (SELECT {key("charge")} AS key, min(charge) AS listed_charge FROM charge_targets GROUP BY 1),
raws AS (SELECT raw_no, fact, meta, CASE WHEN len(meta.accusation) = 1 THEN meta.accusation[1] END AS one FROM raw_cases),
adapted AS (SELECT raw_no, listed_charge, CASE
  WHEN one IS NULL THEN 'multiple_or_missing_charges'
  WHEN listed_charge IS NULL THEN 'outside_target_charges'
  WHEN coalesce(len(meta.criminals), 0) <> 1 THEN 'multiple_or_missing_defendants'
  WHEN coalesce(meta.term_of_imprisonment.death_penalty, true) OR coalesce(meta.term_of_imprisonment.life_imprisonment, true) THEN 'non_fixed_or_missing_sentence_type'
  WHEN coalesce(meta.term_of_imprisonment.imprisonment, 0) <= 0 THEN 'nonpositive_or_invalid_months'
  WHEN fact IS NULL OR {trim("fact")} = '' THEN 'missing_facts'
  WHEN regexp_matches(fact, '{OUTCOME}') THEN 'possible_outcome_text_review'
  WHEN regexp_matches(fact, '{POST}') THEN 'postjudgment_input_review' END AS reason
  FROM raws LEFT JOIN listed ON key = {key("one")})"""


@P.add(f"WITH {_ADAPT} SELECT raw_no, listed_charge, reason FROM adapted")
def adapted_raw(t: Tables) -> DataFrame:
    return K.adapt(t.raw_cases, t.charge_targets).select("raw_no", "listed_charge", "reason")


@P.add(f"WITH {_ADAPT} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM adapted GROUP BY 1")
def reject_cascade_counts(t: Tables) -> DataFrame:
    return K.adapt(t.raw_cases, t.charge_targets).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@P.add(f"""WITH {_ADAPT}
SELECT listed_charge AS charge, count(*) AS n, sum(len({plain("fact")})) AS n_chars FROM adapted JOIN raw_cases USING (raw_no) WHERE reason IS NULL GROUP BY 1""")
def clean_pool_by_charge(t: Tables) -> DataFrame:
    """Flagship: raw records that pass the cascade, counted per charge."""
    kept = K.adapt(t.raw_cases, t.charge_targets).where("reason IS NULL")
    return kept.groupBy(F.col("listed_charge").alias("charge")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length(X.without_space("fact"))).alias("n_chars"))


@P.add(f"""
WITH m AS (SELECT lower(member || ':' || line_no) AS s, fact, count(*) AS n_lines, min(raw_no) AS first_raw FROM raw_cases WHERE fact IS NOT NULL GROUP BY 1, 2),
n AS (SELECT s, sum(n_lines)::BIGINT AS n_lines FROM m GROUP BY s)
SELECT t.ref_no, n.n_lines, m.first_raw AS raw_no, m.s IS NOT NULL AS facts_match
FROM (SELECT ref_no, facts, regexp_replace(lower(trim(source_id)), '^\\./', '') AS s FROM train_references WHERE facts IS NOT NULL) t JOIN n USING (s) LEFT JOIN m ON m.s = t.s AND m.fact = t.facts""")
def source_back_join(t: Tables) -> DataFrame:
    """Records with the number of raw lines of their source, and the first of them that holds the record's text.

    Lines are collapsed to one row a source and text first, so a source of many
    records and many lines gives one row a record instead of their product.
    """
    raw = t.raw_cases.where("fact IS NOT NULL").select(F.lower(F.concat_ws(":", "member", F.col("line_no").cast("string"))).alias("s"), "raw_no", "fact")
    lines = raw.groupBy("s", F.sha2("fact", 256).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.min("raw_no").alias("raw_no"))
    refs = t.train_references.where("facts IS NOT NULL AND source_id IS NOT NULL").select("ref_no", F.sha2("facts", 256).alias("h"), F.regexp_replace(F.lower(F.trim("source_id")), r"^\./", "").alias("s"))
    known = join_unique(refs, lines.groupBy("s").agg(F.sum("n").alias("n_lines")), ["s"])
    return join_unique(known, lines.select("s", "h", "raw_no"), ["s", "h"], "left").select("ref_no", "n_lines", "raw_no", F.col("raw_no").isNotNull().alias("facts_match"))


_FORMS = f"forms AS (SELECT *, {form('facts')} AS f FROM train_references)"


@P.add(f"WITH {_FORMS} SELECT sha256(f) AS text_hash, count(*) AS n_rows, min(ref_no) AS first_key FROM forms WHERE f <> '' GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(t: Tables) -> DataFrame:
    return K.exact_groups(t.train_references, "ref_no", X.normalized_fact("facts"))


@P.add(f"""
WITH {_FORMS}, g AS (SELECT sha256(f) AS text_hash, count(*) AS n_rows, count(DISTINCT (coalesce(charge, chr(0)), coalesce(sentence_months, -1))) AS k, min(source_id) AS first FROM forms WHERE f <> '' GROUP BY 1)
SELECT text_hash, n_rows, k > 1 AS conflict, CASE WHEN k = 1 THEN first END AS survivor FROM g""")
def conflicting_duplicates(t: Tables) -> DataFrame:
    return K.resolve_duplicates(t.train_references, X.normalized_fact("facts"), ["charge", "sentence_months"], "source_id")


@P.add(f"""
SELECT dataset, source_id, count(*) AS n_rows, count(DISTINCT split) AS n_splits FROM train_references WHERE source_id IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT split) > 1""")
def cross_split_sources(t: Tables) -> DataFrame:
    return t.train_references.where("source_id IS NOT NULL").groupBy("dataset", "source_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("split").alias("n_splits")).where("n_splits > 1")


@P.add(f"""
WITH {_FORMS} SELECT sha256(f) AS text_hash, count(DISTINCT dataset) AS n_datasets, count(*) AS n_rows FROM forms WHERE f <> '' GROUP BY 1 HAVING count(DISTINCT dataset) > 1""")
def cross_dataset_overlap(t: Tables) -> DataFrame:
    rows = t.train_references.select("dataset", X.normalized_fact("facts").alias("f")).where("f <> ''")
    return rows.groupBy(F.sha2("f", 256).alias("text_hash")).agg(F.count_distinct("dataset").alias("n_datasets"), F.count(F.lit(1)).alias("n_rows")).where("n_datasets > 1")


@P.add(f"""
WITH {_FORMS}, tr AS (SELECT * FROM forms WHERE split = 'train'), dv AS (SELECT * FROM forms WHERE split = 'dev')
SELECT 'id' AS kind, count(*) AS n FROM tr WHERE id IN (SELECT id FROM dv)
UNION ALL SELECT 'source', count(*) FROM tr WHERE EXISTS (SELECT 1 FROM dv WHERE dv.dataset = tr.dataset AND dv.source_id = tr.source_id)
UNION ALL SELECT 'facts', count(*) FROM tr WHERE f IN (SELECT f FROM dv WHERE f <> '')""")
def train_dev_disjointness(t: Tables) -> DataFrame:
    """Train rows that share an id, a source or a text with a dev row; a clean split has none."""
    rows = t.train_references.withColumn("f", X.normalized_fact("facts")).withColumn("f", F.when(F.col("f") != "", F.col("f")))
    tr, dv = rows.where("split = 'train'"), rows.where("split = 'dev'")
    out = None
    for kind, cols in (("id", ["id"]), ("source", ["dataset", "source_id"]), ("facts", ["f"])):
        one = tr.join(dv.select(*cols), cols, "left_semi").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@P.add(f"WITH g AS ({grams('ref_no', 'facts', 'train_references')}) SELECT id AS ref_no, len(g) AS n_grams FROM g")
def gram_counts(t: Tables) -> DataFrame:
    return M.gram_table(t.train_references, "ref_no", X.normalized_fact("facts")).select(F.col("id").alias("ref_no"), F.size("runs").alias("n_grams"))


@P.add(f"""
WITH c AS ({grams('doc_id', 'text', 'documents')}), i AS ({grams('item_id', 'text', 'eval_items')}),
cg AS (SELECT id, len(g) AS n, unnest(g) AS x FROM c), ig AS (SELECT id, len(g) AS n, unnest(g) AS x FROM i),
s AS (SELECT cg.id, ig.id AS guard_id, count(*) AS n_shared, any_value(least(cg.n, ig.n)) AS n_least FROM cg JOIN ig USING (x) GROUP BY 1, 2)
SELECT id, guard_id, n_shared, n_least FROM s WHERE n_least >= 20 AND n_shared >= 0.85 * n_least
UNION SELECT c.id, i.id, len(i.g), len(i.g) FROM c JOIN i ON c.f = i.f""")
def benchmark_containment(t: Tables) -> DataFrame:
    """Documents that contain a held-out item, or stand in it, by shared character runs."""
    return M.guard_matches(M.gram_table(t.documents, "doc_id", X.normalized_fact("text")), M.gram_table(t.eval_items, "item_id", X.normalized_fact("text")))


@P.add(f"""
WITH c AS ({grams('doc_id', 'text', 'documents')}), i AS ({grams('item_id', 'text', 'eval_items')}),
cg AS (SELECT id, len(g) AS n, unnest(g) AS x FROM c), ig AS (SELECT id, len(g) AS n, unnest(g) AS x FROM i),
s AS (SELECT cg.id, ig.id AS guard_id, count(*) AS n_shared, any_value(least(cg.n, ig.n)) AS n_least FROM cg JOIN ig USING (x) GROUP BY 1, 2),
hit AS (SELECT id FROM s WHERE n_least >= 20 AND n_shared >= 0.85 * n_least UNION SELECT c.id FROM c JOIN i ON c.f = i.f)
SELECT source, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT id FROM hit) GROUP BY source""")
def decontaminated_by_source(t: Tables) -> DataFrame:
    hit = benchmark_containment(t).select(F.col("id").alias("doc_id")).distinct()
    return t.documents.join(hit, "doc_id", "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


_PAIRS = f"""
g AS ({grams('ref_no', 'facts', 'train_references')}), x AS (SELECT id, len(g) AS n, unnest(g) AS x FROM g),
s AS (SELECT p.id AS a, q.id AS b, count(*) AS n_shared, any_value(least(p.n, q.n)) AS n_least FROM x p JOIN x q ON p.x = q.x AND p.id < q.id GROUP BY 1, 2),
pairs AS (SELECT a, b, n_shared, n_least FROM s WHERE n_least >= 20 AND n_shared >= 0.85 * n_least UNION SELECT p.id, q.id, len(p.g), len(p.g) FROM g p JOIN g q ON p.f = q.f AND p.id < q.id)"""


@P.add(f"WITH {_PAIRS}, rep AS (SELECT f, min(id) AS id FROM g GROUP BY f) SELECT a, b, n_shared, n_least FROM pairs WHERE a IN (SELECT id FROM rep) AND b IN (SELECT id FROM rep)")
def containment_pairs(t: Tables) -> DataFrame:
    """Pairs of different texts, each under the least ref_no that has it."""
    return M.containment_pairs(M.gram_table(t.train_references, "ref_no", X.normalized_fact("facts")))


@P.add(f"""
WITH g AS ({grams('ref_no', 'facts', 'train_references')}) SELECT id AS ref_no, min(id) OVER (PARTITION BY f) AS rep, count(*) OVER (PARTITION BY f) AS copies FROM g""")
def text_members(t: Tables) -> DataFrame:
    """The text that each record stands under in containment_pairs."""
    return M.text_classes(M.gram_table(t.train_references, "ref_no", X.normalized_fact("facts"))).withColumnRenamed("id", "ref_no")


@P.add(f"""
WITH {_PAIRS}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), n AS (SELECT a, list(b) AS near FROM e GROUP BY a),
dropped AS (SELECT list_reduce(list([a] || near ORDER BY md5(a || '|42'), a), lambda kept, x: CASE WHEN list_has_any(x[2:], kept) THEN kept ELSE list_append(kept, x[1]) END, []::BIGINT[]) AS kept FROM n)
SELECT ref_no FROM train_references WHERE facts IS NOT NULL AND (ref_no NOT IN (SELECT a FROM n) OR list_contains((SELECT kept FROM dropped), ref_no))""")
def greedy_dedup(t: Tables) -> DataFrame:
    """Records kept when each is dropped that matches an earlier kept one, in draw order."""
    rows = t.train_references.where("facts IS NOT NULL")
    return M.greedy_distinct(rows, "ref_no", X.normalized_fact("facts"), D.draw_order("ref_no")).select("ref_no")


_COMP = f"""
e AS (SELECT ref_no, dataset || chr(1) || source_id AS s, {form("facts")} AS f FROM train_references WHERE {{0}}),
k AS (SELECT ref_no, 's' || s AS k FROM e WHERE s IS NOT NULL UNION ALL SELECT ref_no, 'f' || f FROM e WHERE f <> ''),
hub AS (SELECT k, min(ref_no) AS h FROM k GROUP BY k), edge AS (SELECT DISTINCT ref_no AS a, h AS b FROM k JOIN hub USING (k) WHERE ref_no <> h), both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach AS (SELECT ref_no AS a, ref_no AS b FROM e UNION SELECT reach.a, w.b FROM reach JOIN both_ways w ON reach.b = w.a),
comp AS (SELECT a AS ref_no, min(b) AS first_ref FROM reach GROUP BY a)"""


@P.add(f"""
WITH RECURSIVE {_COMP.replace("{0}", "true")} SELECT ref_no, first_ref FROM comp""")
def case_components(t: Tables) -> DataFrame:
    """Records linked by a source or a text, with the smallest ref_no of their component."""
    rows = t.train_references.select("ref_no", F.concat_ws("\u0001", "dataset", "source_id").alias("s"), "source_id", "dataset", X.normalized_fact("facts").alias("f"))
    s, f = F.when(F.col("source_id").isNotNull() & F.col("dataset").isNotNull(), F.col("s")), F.when(F.col("f") != "", F.col("f"))
    parts = entity_components(rows, "ref_no", [s, f])
    parts = cut(parts, "parts")
    first = parts.groupBy("component").agg(F.min("ref_no").alias("first_ref"), F.count(F.lit(1)).alias("n"))
    return join_unique(parts, first.select("component", "first_ref"), ["component"], counts=first).select("ref_no", "first_ref")


@P.add(f"""
WITH RECURSIVE {_COMP.replace("{0}", "split = 'train'")},
g AS (SELECT first_ref, array_to_string(list_sort(list_distinct(list(charge) FILTER (WHERE charge IS NOT NULL))), '|') AS stratum FROM comp JOIN train_references USING (ref_no) GROUP BY first_ref),
r AS (SELECT first_ref, row_number() OVER (PARTITION BY coalesce(stratum, '') ORDER BY md5(first_ref || '|42'), first_ref) AS r, count(*) OVER (PARTITION BY coalesce(stratum, '')) AS c FROM g)
SELECT ref_no, first_ref AS first_key, CASE WHEN r <= CASE WHEN c > 1 THEN least(c - 1, greatest(1, round_even(c * 0.1, 0))) ELSE 0 END THEN 'dev' ELSE 'train' END AS new_split FROM comp JOIN r USING (first_ref)""")
def group_split(t: Tables) -> DataFrame:
    """A train/dev split of the training records that keeps sources and equal texts together."""
    rows = t.train_references.where("split = 'train'").withColumn("f", X.normalized_fact("facts"))
    s = F.when(F.col("source_id").isNotNull() & F.col("dataset").isNotNull(), F.concat_ws("\u0001", "dataset", "source_id"))
    return D.group_split(rows, "ref_no", [s, F.when(F.col("f") != "", F.col("f"))], "charge").select("ref_no", "first_key", "new_split")


@P.add("SELECT ref_no, charge, rank_in_class FROM (SELECT ref_no, charge, row_number() OVER (PARTITION BY charge ORDER BY md5(ref_no || '|42'), ref_no) AS rank_in_class FROM train_references) WHERE rank_in_class <= 5")
def per_class_cap(t: Tables) -> DataFrame:
    return D.per_class(t.train_references.select("ref_no", "charge"), "charge", "ref_no", 5)


@P.add("""
WITH r AS (SELECT ref_no, charge, row_number() OVER (PARTITION BY charge ORDER BY md5(ref_no || '|42'), ref_no) AS rank_in_class FROM train_references WHERE coalesce(split, '') <> 'test' AND charge IS NOT NULL)
SELECT ref_no, charge, rank_in_class FROM r ORDER BY rank_in_class, charge, ref_no LIMIT 200""")
def balanced_sample(t: Tables) -> DataFrame:
    rows = t.train_references.where("NOT split <=> 'test' AND charge IS NOT NULL").select("ref_no", "charge")
    return D.round_robin(rows, "charge", "ref_no", 200)


@P.add("SELECT charge, arg_min(ref_no, ref_no) AS ref_no FROM train_references WHERE charge IS NOT NULL GROUP BY charge")
def first_of_class(t: Tables) -> DataFrame:
    return t.train_references.where("charge IS NOT NULL").groupBy("charge").agg(F.min_by("ref_no", "ref_no").alias("ref_no"))


@P.add("SELECT ref_no, id FROM train_references ORDER BY md5(id || '|7'), ref_no LIMIT 60")
def review_draw(t: Tables) -> DataFrame:
    return t.train_references.select("ref_no", "id").orderBy(D.draw_order("id", 7), "ref_no").limit(60)


@P.add(f"""
SELECT split, count(*) AS n, count(DISTINCT charge) AS n_charges, sum((facts IS NULL)::INT) AS no_facts,
  sum((opinion IS NULL OR lower({trim("opinion")}) IN ('', '未知', 'unknown', 'null', 'none'))::INT) AS no_opinion, sum((sentence_months = 0)::INT) AS zero_months
FROM train_references GROUP BY split""")
def corpus_audit(t: Tables) -> DataFrame:
    yes = lambda c: F.sum(c.cast("int").cast("bigint"))
    return t.train_references.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("charge").alias("n_charges"), yes(F.col("facts").isNull()).alias("no_facts"), yes(X.opinion_or_null("opinion").isNull()).alias("no_opinion"), yes(F.col("sentence_months") == 0).alias("zero_months"))


@P.add(f"WITH k AS (SELECT {key('charge')} AS key, min(charge) AS listed FROM charge_targets GROUP BY 1), r AS (SELECT ref_no, {key('charge')} AS key FROM train_references) SELECT ref_no, listed FROM r JOIN k USING (key)")
def charge_dimension_join(t: Tables) -> DataFrame:
    names = t.charge_targets.groupBy(X.charge_key("charge").alias("key")).agg(F.min("charge").alias("listed"))
    return t.train_references.where("charge IS NOT NULL").select("ref_no", X.charge_key("charge").alias("key")).join(F.broadcast(names), "key").select("ref_no", "listed")


QUERIES, SQL = P.queries, P.sql
