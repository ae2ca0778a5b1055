"""The pN_ queries over the test tables, each over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.session import cut, load

from . import forms, leakage, mixing, neardup, overlap, pieces, sampling, sentences, splits, tokens

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.irregular_values(load(spark, sf_dir, "train_references"), "ref_no", ["facts", "target_person"])


def p1_regular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """facts and target_person of every record in regular form."""
    return forms.regular_columns(load(spark, sf_dir, "train_references").select("ref_no", "facts", "target_person"), ["facts", "target_person"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlapping_pairs(load(spark, sf_dir, "train_references"), "ref_no", "facts", "split")


def p2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record with its text class and the number of records across the splits that it overlaps."""
    return overlap.linked_rows(load(spark, sf_dir, "train_references"), "ref_no", "facts", "split")


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps with the training split per evaluation split, dataset and source_id."""
    return overlap.overlap_counts(load(spark, sf_dir, "train_references"), "ref_no", "facts", "split", ["dataset", "source_id"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "train_references")
    return sentences.sentence_units(rows, "ref_no", "facts", sentences.train(sentences.sample(rows, "ref_no", "facts")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.straddling_rows(load(spark, sf_dir, "train_references"), "ref_no", [splits.source_entity()], "split")


def p4_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split for every record: records of one source, or with one id, share it."""
    rows = load(spark, sf_dir, "train_references")
    return splits.assign_splits(rows, "ref_no", [splits.source_entity(), "id"], load(spark, sf_dir, "split_targets"))


def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached shares of p4_assigned."""
    targets = load(spark, sf_dir, "split_targets")
    return splits.split_report(p4_assigned(spark, sf_dir), targets)


def _candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    targets = load(spark, sf_dir, "charge_targets")
    rows = load(spark, sf_dir, "train_references").where("split = 'train'").select("ref_no", "id", "charge")
    return sampling.candidates(rows, targets, "id", "charge", "ref_no"), targets


def _drawn(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(the drawn and corrected sample, wanted rows of each charge)."""
    found, targets = _candidates(spark, sf_dir)
    found = cut(found, "candidates")
    wanted = cut(sampling.quotas(found, targets), "quotas")
    return sampling.proportional_sample(found, wanted, "ref_no"), wanted


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, wanted = _drawn(spark, sf_dir)
    return sampling.short_categories(found, wanted)


def p5_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed rows, wanted rows and deficit of each listed charge."""
    return sampling.quotas(*_candidates(spark, sf_dir))


def p5_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample: as many rows of each charge as wanted, or all where they don't suffice."""
    return _drawn(spark, sf_dir)[0].select("ref_no", "id", F.col("category").alias("charge"))


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted, drawn and missing rows of each listed charge in p5_sample."""
    return sampling.sample_report(*_drawn(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(load(spark, sf_dir, "train_references"), "ref_no", "facts")


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(load(spark, sf_dir, "documents"), "doc_id", "text", load(spark, sf_dir, "eval_items"), "item_id", "text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item with the number of documents it leaked into and its longest match."""
    return leakage.leaked_items(load(spark, sf_dir, "eval_items"), _leaks(spark, sf_dir), "item_id")


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents left once those with leaked items are removed."""
    documents = load(spark, sf_dir, "documents")
    return leakage.clean_documents(documents, _leaks(spark, sf_dir), "doc_id").select("doc_id", "source", "lang")


def _mixture_plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    counted = cut(tokens.with_token_counts(load(spark, sf_dir, "documents").select("doc_id", "source", "text"), "text"), "tokens")
    return counted, mixing.source_plan(counted, load(spark, sf_dir, "source_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted, plan = _mixture_plan(spark, sf_dir)
    return mixing.short_sources(mixing.replicate(counted, plan, "doc_id"), plan)


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture in its global order: each use of a document."""
    counted, plan = _mixture_plan(spark, sf_dir)
    return mixing.shuffled(mixing.replicate(counted, plan, "doc_id"), "doc_id").select("doc_id", "copy", "source", "n_tokens", "place")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached shares of p8_mixture."""
    counted, plan = _mixture_plan(spark, sf_dir)
    return mixing.reached_shares(mixing.replicate(counted, plan, "doc_id"), plan)


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents")
    return pieces.split_oversized(rows, "doc_id", "text", model=sentences.train(sentences.sample(rows, "doc_id", "text", 1500)))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).where("piece_no = 1").select("doc_id")


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of at most 1,500 tokens of every document that has more."""
    return _pieces(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit()}
