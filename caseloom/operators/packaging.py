"""Prompts, label-free jobs, training pairs and checks that labels stay out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.functions.text import opinion_or_null

#: The only fields a job may carry.
JOB_FIELDS = ("id", "variant", "split", "messages", "prompt_hash")


def visible(df: DataFrame, person: str | None = "target_person") -> Column:
    """What a model may see: facts, charge and, where there is one, the person, as canonical JSON."""
    fields = [F.col("charge"), F.col("facts")]
    if person and person in df.columns:
        fields.append(F.when(F.col(person) != "", F.col(person)).alias(person))
    return F.to_json(F.struct(*fields))


def messages(system: str, user: Column) -> Column:
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def jobs(df: DataFrame, key: str, system: str, variant: str = "direct") -> DataFrame:
    """One job for each row with facts and a charge: nothing but allowed fields, the prompt hashed."""
    rows = df.where("facts IS NOT NULL AND charge IS NOT NULL").withColumn("messages", messages(system, visible(df)))
    return rows.select(key, "id", F.lit(variant).alias("variant"), "split", "messages", F.sha2(F.to_json("messages"), 256).alias("prompt_hash"))


def training_pairs(df: DataFrame, key: str, system: str, variant: str = "direct") -> DataFrame:
    """Prompt and completion of every row outside the test split that has an opinion and a label.

    A row without a split isn't a test row and passes; test rows never do.
    """
    opinion = opinion_or_null("opinion")
    rows = df.where("NOT split <=> 'test' AND facts IS NOT NULL AND charge IS NOT NULL AND sentence_months IS NOT NULL").where(opinion.isNotNull())
    answer = F.to_json(F.struct(opinion.alias("reasoning"), F.col("sentence_months")))
    return rows.select(
        key, "id", "split", F.lit(variant).alias("variant"), "dataset", "source_id", messages(system, visible(df)).alias("prompt"),
        F.array(F.struct(F.lit("assistant").alias("role"), answer.alias("content"))).alias("completion"),
    )


def check_job_fields(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """The frame, or ValueError if it carries a field that isn't allowed."""
    odd = set(df.columns) - set(JOB_FIELDS) - set(extra)
    if odd:
        raise ValueError(f"fields not allowed in jobs: {sorted(odd)}")
    return df


#: Fixed value: how much of the rules a prompt shows: nothing, the rules, also the evidence, also the composed states.
VARIANTS = ("base", "rules", "concat", "composed")


def variant_body(df: DataFrame, variant: str, rules: Column, evidence: Column, trace: Column, person: str | None = None) -> Column:
    """The visible input of a variant as canonical JSON (keys in order); ``rules``, ``evidence`` and ``trace`` are what the variants add."""
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant}")
    shown = {"charge": F.col("charge"), "facts": F.col("facts")}
    if person:
        shown[person] = F.when(F.col(person) != "", F.col(person))
    for name, value in list({"candidate_rules": rules, "condition_evidence": evidence, "composed_rule_trace": trace}.items())[: VARIANTS.index(variant)]:
        shown[name] = value
    return F.to_json(F.struct(*[shown[k].alias(k) for k in sorted(shown)]))


def variant_jobs(df: DataFrame, key: str, system: str, rules: Column, evidence: Column, trace: Column) -> DataFrame:
    """A job of every variant for each row with facts and a charge."""
    rows = df.where("facts IS NOT NULL AND charge IS NOT NULL")
    bodies = F.array(*[F.struct(F.lit(v).alias("variant"), variant_body(df, v, rules, evidence, trace).alias("user")) for v in VARIANTS])
    made = rows.select(key, "id", "split", F.explode(bodies).alias("b")).select(key, "id", "split", F.col("b.variant").alias("variant"), messages(system, F.col("b.user")).alias("messages"))
    return made.withColumn("prompt_hash", F.sha2(F.to_json("messages"), 256))


def masked_pair(df: DataFrame, key: str, system: str, person: str = "target_person") -> DataFrame:
    """Two jobs for each row with facts and a charge: ``original`` without the person, ``target`` with it where the facts name it (``available``)."""
    rows = df.where("facts IS NOT NULL AND charge IS NOT NULL").withColumn("available", F.coalesce((F.col(person) != "") & F.contains(F.col("facts"), F.col(person)), F.lit(False)))
    plain = [F.col("charge"), F.col("facts")]
    named = F.when(F.col("available"), F.col(person)).alias(person)
    arms = F.array(F.struct(F.lit("original").alias("arm"), F.to_json(F.struct(*plain)).alias("user")), F.struct(F.lit("target").alias("arm"), F.to_json(F.struct(*plain, named)).alias("user")))
    made = rows.select(key, "id", "split", "available", F.explode(arms).alias("a")).select(key, "id", "split", "available", F.col("a.arm").alias("arm"), messages(system, F.col("a.user")).alias("messages"))
    return made.withColumn("prompt_hash", F.sha2(F.to_json("messages"), 256))


def pair_problems(jobs: DataFrame, key: str, system: str, person: str = "target_person") -> DataFrame:
    """(key, problem) of jobs in two arms that aren't the same but for the person.

    missing_arm, wrong_system, hash_differs (a job's prompt_hash), unexpected_fields,
    inputs_differ (facts or charge), person_not_in_facts, person_in_original.
    """
    user = F.from_json(F.col("messages")[1]["content"], f"facts string, charge string, {person} string")
    keys = F.json_object_keys(F.col("messages")[1]["content"])
    rows = jobs.select(
        key, "arm", user.alias("u"), (F.col("messages")[0]["content"] == system).alias("sys"), (F.sha2(F.to_json("messages"), 256) == F.col("prompt_hash")).alias("same"),
        (F.size(F.array_except(keys, F.array(F.lit("facts"), F.lit("charge"), F.lit(person)))) == 0).alias("fields"),
    )
    one = lambda arm: F.max(F.when(F.col("arm") == arm, F.struct("u.facts", "u.charge", F.col(f"u.{person}").alias("person"))))
    per = rows.groupBy(key).agg(one("original").alias("o"), one("target").alias("t"), F.min("sys").alias("sys"), F.min("same").alias("same"), F.min("fields").alias("fields"))
    o, t = F.col("o"), F.col("t")
    tests = [
        ("missing_arm", o.isNull() | t.isNull()), ("wrong_system", ~F.col("sys")), ("hash_differs", ~F.col("same")), ("unexpected_fields", ~F.col("fields")),
        ("inputs_differ", ~(o["facts"].eqNullSafe(t["facts"]) & o["charge"].eqNullSafe(t["charge"]))), ("person_not_in_facts", t["person"].isNotNull() & ~F.contains(t["facts"], t["person"])), ("person_in_original", o["person"].isNotNull()),
    ]
    return per.select(key, F.explode(F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in tests]))).alias("problem"))


def prediction_problems(jobs: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """(key, problem) where outputs don't answer the frozen jobs: missing, foreign, repeated or other_prompt (by prompt_hash)."""
    p = predictions.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("prompt_hash").alias("__low"), F.max("prompt_hash").alias("__high"))
    j = jobs.select(key, F.col("prompt_hash").alias("__job"))
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("__job").isNull(), "foreign").when(F.col("n") > 1, "repeated").when((F.col("__low") != F.col("__job")) | (F.col("__high") != F.col("__job")), "other_prompt")
    return j.join(p, key, "full").select(key, problem.alias("problem")).where("problem IS NOT NULL")


def order_differences(left: DataFrame, right: DataFrame, group: str, order: list[str], key: str) -> DataFrame:
    """(group, position, left_key, right_key) of the places of two ordered lists, one a group, that hold different keys."""
    def placed(df: DataFrame, name: str) -> DataFrame:
        return df.select(group, F.row_number().over(Window.partitionBy(group).orderBy(*order)).alias("position"), F.col(key).alias(name))

    both = placed(left, "left_key").join(placed(right, "right_key"), [group, "position"], "full")
    return both.where(~F.col("left_key").eqNullSafe(F.col("right_key")))


def listed_order(value: Column | str, names: list[str]) -> Column:
    """The place of a value in a given list, from 1; values that aren't listed come last."""
    place = F.array_position(F.array(*[F.lit(x) for x in names]), F.col(value) if isinstance(value, str) else value)
    return F.when(place > 0, place).otherwise(len(names) + 1)
