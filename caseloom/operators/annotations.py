"""Annotations against their texts: quotes to spans, span checks, coverage, and observations to states."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.text import json_prefix, quote_status, trim_space


def resolve_quotes(df: DataFrame, key: str, text: str, quotes: str) -> DataFrame:
    """(key, quote, status, start_pos, end_pos) of every quote of an array column; see ``quote_status``."""
    rows = df.select(key, text, F.explode(quotes).alias("quote"))
    return rows.select(key, "quote", quote_status(text, "quote").alias("q")).select(key, "quote", "q.*")


def span_problems(df: DataFrame, key: str, text: str, spans: str) -> DataFrame:
    """(key, i, problem) of every span (start_pos, end_pos, quote) that lies outside its text or differs from it."""
    rows = df.select(key, text, F.posexplode(spans).alias("i", "s"))
    inside = (F.col("s.start_pos") >= 0) & (F.col("s.start_pos") < F.col("s.end_pos")) & (F.col("s.end_pos") <= F.char_length(text))
    same = F.substring(F.col(text), F.col("s.start_pos") + 1, F.col("s.end_pos") - F.col("s.start_pos")) == F.col("s.quote")
    problem = F.when(~F.coalesce(inside, F.lit(False)), "outside").when(~F.coalesce(same, F.lit(False)), "differs")
    return rows.select(key, "i", problem.alias("problem")).where("problem IS NOT NULL")


def coverage_problems(annotations: DataFrame, key: str, conditions: str, wanted: list[str]) -> DataFrame:
    """(key, condition_id, problem) where conditions (condition_id, status, evidence) miss, repeat or add one, carry an unknown status, or a definite status without evidence."""
    names = F.transform(conditions, lambda c: c["condition_id"])
    want = F.array(*[F.lit(x) for x in wanted])
    named = lambda ids, problem: F.transform(ids, lambda x: F.struct(x.alias("condition_id"), F.lit(problem).alias("problem")))
    twice = F.filter(want, lambda x: F.size(F.filter(names, lambda y: y == x)) > 1)
    status = F.transform(F.filter(conditions, lambda c: ~F.coalesce(c["status"].isin("supported", "refuted", "unknown"), F.lit(False))), lambda c: c["condition_id"])
    bare = F.transform(F.filter(conditions, lambda c: c["status"].isin("supported", "refuted") & (F.coalesce(F.size(c["evidence"]), F.lit(0)) <= 0)), lambda c: c["condition_id"])
    all_problems = F.concat(named(F.array_except(want, names), "missing"), named(F.array_except(names, want), "not_asked"), named(twice, "repeated"), named(status, "bad_status"), named(bare, "no_evidence"))
    return annotations.select(key, F.explode(all_problems).alias("p")).select(key, "p.*")


def reduce_observations(observations: DataFrame, key: str, condition: str, polarity: str, eligible: str) -> DataFrame:
    """(key, condition, state, reason, n_used, n_dropped): one state for all observations of a condition.

    ``polarity`` is true for support, false for refutation.  Any ineligible
    observation leaves the state unknown (binding_gate), both polarities among
    the eligible are conflicting_evidence, none is insufficient_evidence.
    Aggregates only, so order doesn't matter.
    """
    good = F.coalesce(F.col(eligible), F.lit(False))
    out = observations.groupBy(key, condition).agg(
        F.count(F.when(good, 1)).alias("n_used"), F.count(F.when(~good, 1)).alias("n_dropped"),
        F.count(F.when(good & F.col(polarity), 1)).alias("__yes"), F.count(F.when(good & ~F.col(polarity), 1)).alias("__no"),
    )
    reason = F.when(F.col("n_dropped") > 0, "binding_gate").when((F.col("__yes") > 0) & (F.col("__no") > 0), "conflicting_evidence").when(F.col("__yes") + F.col("__no") == 0, "insufficient_evidence").otherwise("none")
    return out.select(key, condition, F.when(reason == "none", F.col("__yes") > 0).alias("state"), reason.alias("reason"), "n_used", "n_dropped")


# ---- fixed values: fields of an annotation body, what they may hold, and the names of what can be wrong ----
BODY_FIELDS = ("decision", "issues", "evidence", "summary")
DECISIONS, RELATIONS, KINDS = ("keep", "review"), ("target", "other", "uncertain"), ("action", "outcome", "post_event", "context")
# ------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Limits:
    """How strictly bodies are read.  The loose form checks form and source only; sizes are bounds where they are given."""

    issues: int | None = None
    issue_chars: int | None = None
    summary_chars: int | None = None
    evidence: int | None = None
    quote_chars: int | None = None
    #: A quote must stand in its source at exactly one place, no two items may share one, and a subject must stand in it.
    exact: bool = False


LOOSE, STRICT = Limits(), Limits(10, 240, 200, 6, 160, True)


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def _over(size: Column, most: int | None) -> Column:
    return F.lit(False) if most is None else size > most


def _body_checks(b: Column, limits: Limits) -> list[tuple[str, str, Column]]:
    """(path, problem, whether it is there) for the body itself."""
    n, notes = F.coalesce(F.size(b["evidence"]), F.lit(0)), F.coalesce(F.size(b["issues"]), F.lit(0))
    keep, review = b["decision"] == "keep", b["decision"] == "review"
    bad_note = F.exists(b["issues"], lambda x: _blank(x) | _over(F.char_length(x), limits.issue_chars))
    return [
        ("decision", "expected_keep_or_review", b["decision"].isNull() | ~b["decision"].isin(*DECISIONS)),
        ("issues", "expected_list_of_nonempty_strings", b["issues"].isNull() | bad_note),
        ("issues", "too_many", _over(notes, limits.issues)),
        ("summary", "expected_string", b["summary"].isNull()),
        ("summary", "too_long", _over(F.char_length(b["summary"]), limits.summary_chars)),
        ("evidence", "expected_list", b["evidence"].isNull()),
        ("evidence", "too_many", _over(n, limits.evidence)),
        ("evidence", "keep_requires_at_least_one_item", keep & (n == 0)),
        ("summary", "keep_requires_nonempty_summary", keep & _blank(b["summary"])),
        ("issues", "keep_requires_empty_issues", keep & (notes > 0)),
        ("issues", "review_requires_explanation", review & (notes == 0)),
    ]


def _item_checks(x: Column, i: Column, items: Column, text: Column, limits: Limits) -> list[tuple[str, str, Column]]:
    """(field, problem, whether it is there) for one evidence item."""
    quote, subject = x["quote"], x["subject"]
    given = ~_blank(quote)
    checks = [
        ("quote", "expected_nonempty_string", _blank(quote)),
        ("quote", "too_long", given & _over(F.char_length(quote), limits.quote_chars)),
        ("relation", "invalid_enum", x["relation"].isNull() | ~x["relation"].isin(*RELATIONS)),
        ("kind", "invalid_enum", x["kind"].isNull() | ~x["kind"].isin(*KINDS)),
        ("subject", "expected_nonempty_string_or_null", subject.isNotNull() & _blank(subject)),
    ]
    if not limits.exact:
        return [*checks, ("quote", "quote_not_in_source", given & ~F.contains(text, quote))]
    places = (F.char_length(text) - F.char_length(F.replace(text, quote, F.lit("")))) / F.char_length(quote)
    earlier = F.exists(F.slice(items, F.lit(1), i), lambda y: y["quote"] == quote)
    return [
        *checks, ("quote", "must_match_source_exactly_once", given & (places != 1)), ("quote", "duplicate_evidence_item", given & earlier),
        ("subject", "null_subject_but_definite_relation", subject.isNull() & ~F.coalesce(x["relation"] == "uncertain", F.lit(False))),
        ("subject", "subject_mention_absent_from_this_quote", subject.isNotNull() & ~_blank(subject) & ~F.coalesce(F.contains(quote, subject), F.lit(False))),
    ]


def structure_problems(bodies: DataFrame, key: str, body: str, text: str, limits: Limits = LOOSE) -> DataFrame:
    """(key, path, problem) of everything that is wrong with annotation bodies (decision, issues, evidence, summary).

    Evidence items are (quote, subject, relation, kind).  Nothing is repaired;
    a null body is itself a problem (path $).
    """
    b, source = F.col(body), F.col(text)

    def told(path: Column | str, problem: str, bad: Column) -> Column:
        path = F.lit(path) if isinstance(path, str) else path
        return F.when(F.coalesce(bad, F.lit(False)), F.struct(path.alias("path"), F.lit(problem).alias("problem")))

    def item(x: Column, i: Column) -> Column:
        path = lambda name: F.concat(F.lit("evidence["), i.cast("string"), F.lit("]." + name))
        return F.array_compact(F.array(*[told(path(name), problem, bad) for name, problem, bad in _item_checks(x, i, b["evidence"], source, limits)]))

    whole = F.array_compact(F.array(*[told(*check) for check in _body_checks(b, limits)]))
    items = F.when(b["evidence"].isNotNull(), F.flatten(F.transform(b["evidence"], item)))
    none = F.array(F.struct(F.lit("$").alias("path"), F.lit("expected_JSON_object").alias("problem")))
    problems = F.when(b.isNull(), none).otherwise(F.concat(whole, F.coalesce(items, F.array().cast("array<struct<path:string,problem:string>>"))))
    return bodies.select(key, F.explode(problems).alias("p")).select(key, "p.*")


def response_problems(responses: DataFrame, key: str, text: str, finish: str, fields: tuple[str, ...] = BODY_FIELDS) -> DataFrame:
    """(key, problem, missing, unexpected) of raw responses: cut off, no single JSON object, or other fields than wanted.

    Field names are joined by commas in order; a response that stopped by
    itself and is one object with exactly the wanted fields has no row.
    """
    keys = F.json_object_keys(F.col("__o"))
    want = F.array(*[F.lit(x) for x in sorted(fields)])
    rows = responses.select(key, F.col(finish).alias("__f"), F.when(json_prefix(text) == trim_space(text), trim_space(text)).alias("__o"))
    listed = lambda names: F.array_join(F.sort_array(names), ",")
    missing, unexpected = listed(F.array_except(want, keys)), listed(F.array_except(keys, want))
    cut_off = F.col("__f").isNotNull() & (F.col("__f") != "stop")
    problem = F.when(cut_off, "incomplete_response").when(F.col("__o").isNull(), "invalid_JSON").when((missing != "") | (unexpected != ""), "wrong_fields")
    wrong = problem == "wrong_fields"
    return rows.select(key, problem.alias("problem"), F.when(wrong, missing).alias("missing"), F.when(wrong, unexpected).alias("unexpected")).where("problem IS NOT NULL")


def evidence_counts(items: DataFrame, by: str, quote: str, subject: str, text: str) -> DataFrame:
    """(by, quotes, source_quotes, literal_subject_in_quote): how many quotes stand in their source, and subjects in their quote."""
    q, s = F.col(quote), F.col(subject)
    return items.groupBy(by).agg(
        F.count(F.lit(1)).alias("quotes"), F.count_if(~_blank(q) & F.contains(F.col(text), q)).alias("source_quotes"), F.count_if((s != "") & F.contains(q, s)).alias("literal_subject_in_quote"),
    )


def annotation_fingerprint(visible: Column, bundle: Column) -> Column:
    """The hash that binds an annotation to what was seen and the rules it was made under."""
    return F.sha2(F.concat_ws("\n", visible, bundle), 256)


def binding_problems(annotations: DataFrame, records: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """(key, problem) where annotations and records (both with ``fingerprint``) don't belong together: foreign, unannotated or changed_input."""
    a = annotations.select(key, F.col(fingerprint).alias("__a"), F.lit(True).alias("__x"))
    r = records.select(key, F.col(fingerprint).alias("__r"), F.lit(True).alias("__y"))
    problem = F.when(F.col("__y").isNull(), "foreign").when(F.col("__x").isNull(), "unannotated").when(~F.col("__a").eqNullSafe(F.col("__r")), "changed_input")
    return a.join(r, key, "full").select(key, problem.alias("problem")).where("problem IS NOT NULL")


@dataclass(frozen=True)
class Flag:
    """A reviewer's flag on a condition's state: which condition (None: any), which state, and what its text (facts or quote) shows."""

    name: str
    status: str
    condition: str | None = None
    pattern: str | None = None
    of: str = "facts"
    needs_quote: bool = False


def state_flags(states: DataFrame, key: str, condition: str, status: str, text: str, quote: str, flags: list[Flag]) -> DataFrame:
    """(key, flag) of each distinct flag that any of a record's condition states raises."""
    tests = []
    for f in flags:
        hit = F.col(status) == f.status
        if f.condition is not None:
            hit = hit & (F.col(condition) == f.condition)
        if f.pattern is not None:
            hit = hit & F.coalesce(F.col(text if f.of == "facts" else quote), F.lit("")).rlike(f.pattern)
        if f.needs_quote:
            hit = hit & (F.coalesce(F.col(quote), F.lit("")) != "")
        tests.append(F.when(hit, F.lit(f.name)))
    return states.select(key, F.explode(F.array_compact(F.array(*tests))).alias("flag")).distinct()


def span_votes(quotes: DataFrame, spans: DataFrame, key: str, text: str) -> DataFrame:
    """(key, i, label, outcome) of every span (key, i, start_pos, end_pos): the one relation of the quotes that lie within it.

    ``quotes`` holds (key, text, quote, relation).  A quote that stands at no
    single place or in no single span votes for nothing; a span with one voted
    relation carries it, others are ``conflict`` or ``unlabelled``.
    """
    placed = quotes.select(key, "relation", quote_status(text, "quote").alias("q")).where("q.status = 'found'").select(key, "relation", F.col("q.start_pos").alias("a"), F.col("q.end_pos").alias("b"))
    voted = placed.join(spans, key).where("start_pos <= a AND b <= end_pos").groupBy(key, "i").agg(F.min("relation").alias("low"), F.max("relation").alias("high"))
    outcome = F.when(F.col("low").isNull(), "unlabelled").when(F.col("low") != F.col("high"), "conflict").otherwise("labelled")
    return spans.join(voted, [key, "i"], "left").select(key, "i", F.when(outcome == "labelled", F.col("low")).alias("label"), outcome.alias("outcome"))
