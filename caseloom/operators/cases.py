"""Ingest and hygiene of case records: canonical form, ordered rejection, duplicates, screens, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions import text as X
from caseloom.functions.ids import digest
from caseloom.session import fits_broadcast

#: Names under which a field may arrive, best first.
ALIASES = {"facts": ("facts", "justice", "fact"), "charge": ("charge", "caseCause"), "sentence_months": ("sentence_months", "judge"), "source_id": ("source_id", "filename", "id")}


def _field(df: DataFrame, name: str) -> Column:
    """The first of a field's names that the frame has (a present null wins over later names)."""
    for alias in ALIASES[name]:
        if alias in df.columns:
            return F.col(alias)
    return F.lit(None)


def canonicalize(df: DataFrame, dataset: str, split: str, row_number: Column | None = None) -> DataFrame:
    """Records in the canonical schema, with ``error`` naming what is wrong with a row (null: nothing).

    Months must be a finite non-negative whole number (12.0 passes, text, true
    and 1.5 do not); missing opinions become null; charges are trimmed.  Ids
    hash the source and the facts; input_hash covers only facts and charge.
    Rows are never dropped here.
    """
    if split not in ("train", "dev", "test"):
        raise ValueError("split must be train, dev or test")
    facts, charge, months = _field(df, "facts"), _field(df, "charge"), _field(df, "sentence_months")
    kind = dict(df.dtypes).get(next((a for a in ALIASES["sentence_months"] if a in df.columns), ""), "void")
    number = months.cast("double") if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal") else F.lit(None).cast("double")
    whole = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < 9e15) & (number >= 0) & (number == F.floor(number))
    blank = lambda c: c.isNull() | (X.trim_space(c.cast("string")) == "")
    error = F.when(blank(facts), "missing_facts").when(blank(charge), "missing_charge").when(~whole, "invalid_months")
    source = F.coalesce(_field(df, "source_id").cast("string"), (row_number if row_number is not None else F.lit(None)).cast("string"))
    opinion = X.opinion_or_null(F.col("opinion")) if "opinion" in df.columns else F.lit(None).cast("string")
    key = F.substring(F.sha2(F.to_json(F.array(source, facts)), 256), 1, 20)
    return df.select(
        F.concat_ws(":", F.lit(dataset), F.lit(split), key).alias("id"), F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), source.alias("source_id"),
        facts.alias("facts"), X.trim_space(charge).alias("charge"), opinion.alias("opinion"), F.when(whole, number.cast("bigint")).alias("sentence_months"),
        F.lit("given_charge").alias("protocol"), digest(facts=facts, charge=X.trim_space(charge)).alias("input_hash"), error.alias("error"),
    )


def adapt(raw: DataFrame, charges: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Nested raw records with their charge as listed and the first reason to reject them (null: kept).

    Reasons in order: several or no charges, a charge outside ``charges``,
    several or no defendants, no fixed term, months that aren't positive, blank
    (or overlong) facts, then the first risk of the text.  ``charges`` holds
    the listed names (a small fixed dimension).
    """
    names = charges.where("charge IS NOT NULL").groupBy(X.charge_key("charge").alias("__key")).agg(F.min("charge").alias("listed_charge"))
    only = F.when(F.size("meta.accusation") == 1, F.get("meta.accusation", F.lit(0)))
    rows = raw.withColumn("__key", X.charge_key(only)).join(F.broadcast(names) if fits_broadcast(names, 10_000) else names, "__key", "left").drop("__key")
    term = F.col("meta.term_of_imprisonment")
    flag = lambda name: F.coalesce(term[name], F.lit(True))  # noqa: E731  (missing counts as set)
    months = term["imprisonment"]
    risks = X.input_risks(F.col("fact"))
    long = F.lit(False) if max_chars is None else F.char_length("fact") > max_chars
    reason = (
        F.when(only.isNull(), "multiple_or_missing_charges")
        .when(F.col("listed_charge").isNull(), "outside_target_charges")
        .when(F.coalesce(F.size("meta.criminals"), F.lit(0)) != 1, "multiple_or_missing_defendants")
        .when(flag("death_penalty") | flag("life_imprisonment"), "non_fixed_or_missing_sentence_type")
        .when(F.coalesce(months, F.lit(0)) <= 0, "nonpositive_or_invalid_months")
        .when(F.col("fact").isNull() | (X.trim_space("fact") == "") | long, "missing_facts" if max_chars is None else "empty_or_overlength_facts")
        .otherwise(F.get(risks, F.lit(0)))
    )
    return rows.withColumn("reason", reason)


def candidates(raw: DataFrame, charges: DataFrame, max_chars: int = 2400) -> DataFrame:
    """Raw records as annotation candidates: their charge as listed, the one person they concern, and the first reason against them.

    Reasons in order: charge_scope (not exactly one), outside_charges,
    target_scope (not exactly one named person), non_fixed_positive_term,
    empty_or_overlength_facts.
    """
    names = charges.where("charge IS NOT NULL").groupBy(X.charge_key("charge").alias("__key")).agg(F.min("charge").alias("listed_charge"))
    only = F.when(F.size("meta.accusation") == 1, F.get("meta.accusation", F.lit(0)))
    person = F.when(F.size("meta.criminals") == 1, F.get("meta.criminals", F.lit(0)))
    names = F.broadcast(names) if fits_broadcast(names, 10_000) else names
    rows = raw.withColumn("__key", X.charge_key(only)).join(names, "__key", "left").drop("__key").withColumn("target_person", F.when(X.trim_space(person) != "", person))
    term = F.col("meta.term_of_imprisonment")
    fixed = ~F.coalesce(term["death_penalty"], F.lit(True)) & ~F.coalesce(term["life_imprisonment"], F.lit(True)) & (F.coalesce(term["imprisonment"], F.lit(0)) > 0)
    reason = (
        F.when(only.isNull(), "charge_scope").when(F.col("listed_charge").isNull(), "outside_charges").when(F.col("target_person").isNull(), "target_scope").when(~fixed, "non_fixed_positive_term")
        .when(F.col("fact").isNull() | (X.trim_space("fact") == "") | (F.char_length("fact") > max_chars), "empty_or_overlength_facts")
    )
    return rows.withColumn("reason", reason)


def exact_groups(df: DataFrame, key: str, form: Column, least: int = 2) -> DataFrame:
    """(text_hash, n_rows, first_key) of texts that stand ``least`` times or more in the given form; null and blank texts are left out."""
    rows = df.select(key, form.alias("__f")).where("__f IS NOT NULL AND __f <> ''")
    return rows.groupBy(F.sha2("__f", 256).alias("text_hash")).agg(F.count(F.lit(1)).alias("n_rows"), F.min(key).alias("first_key")).where(F.col("n_rows") >= least)


def resolve_duplicates(df: DataFrame, form: Column, labels: list[str], source: str) -> DataFrame:
    """One decision per text: (text_hash, n_rows, n_labels, conflict, survivor).

    A text whose copies carry different labels is dropped whole (conflict, no
    survivor); otherwise the copy with the least ``source`` survives.
    """
    rows = df.withColumn("__f", form).where("__f IS NOT NULL AND __f <> ''")
    label = F.to_json(F.struct(*labels), {"ignoreNullFields": "false"})
    out = rows.groupBy(F.sha2("__f", 256).alias("text_hash")).agg(F.count(F.lit(1)).alias("n_rows"), F.min(label).alias("__low"), F.max(label).alias("__high"), F.min(source).alias("__first"))
    conflict = F.col("__low") != F.col("__high")
    return out.select("text_hash", "n_rows", conflict.alias("conflict"), F.when(~conflict, F.col("__first")).alias("survivor"))


def review_flags(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, start_pos, end_pos, quote) of every review flag: risk families without a place, hints with theirs."""
    risks = F.transform(X.input_risks(F.col(text)), lambda k: F.struct(k.alias("kind"), F.lit(None).cast("int").alias("start_pos"), F.lit(None).cast("int").alias("end_pos"), F.lit(None).cast("string").alias("quote")))
    return df.where(F.col(text).isNotNull()).select(key, F.explode(F.concat(risks, X.find_spans(X.HINTS)(F.col(text)))).alias("f")).select(key, "f.*")


def partition_reviewed(df: DataFrame, key: str, quarantine: DataFrame, pending: DataFrame) -> DataFrame:
    """Every row once with ``part``: quarantined before pending before retained."""
    q = quarantine.select(key).distinct().withColumn("__q", F.lit(True))
    p = pending.select(key).distinct().withColumn("__p", F.lit(True))
    part = F.when(F.col("__q"), "quarantine").when(F.col("__p"), "pending").otherwise("retained")
    return df.join(q, key, "left").join(p, key, "left").withColumn("part", part).drop("__q", "__p")
