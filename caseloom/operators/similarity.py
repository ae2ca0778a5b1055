"""Containment joins on character runs.

Score: shared runs over the smaller set; a pair needs that smaller set to hold
at least 20 runs.  Texts equal in their normal form score 1 whatever their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.text import gram_hashes
from caseloom.session import cut, fits_broadcast, join_unique, spread

from . import containment as C

LEAST_RUNS = 20
#: Guard run hashes that may be broadcast (12 bytes each, some 6 MB); more take the join of all texts.
MOST_BROADCAST = 250_000
#: Keys (8 bytes each) that may be broadcast to leave texts out before they are shuffled.
MOST_KEYS = 1_000_000


def text_classes(grams: DataFrame, order: Column | None = None) -> DataFrame:
    """(id, rep, copies) of every row of a gram table: rows of one normal form have one representative.

    It is the row that comes first in ``order``, by default the one of least id.
    """
    first = F.min(F.struct(*([order.alias("o")] if order is not None else []), F.col("id")))
    reps = grams.groupBy("form_hash").agg(first.alias("f"), F.count(F.lit(1)).alias("n"))
    members = join_unique(grams.select("id", "form_hash"), reps.select("form_hash", F.col("f.id").alias("rep"), F.col("n").alias("copies")), ["form_hash"], counts=reps.select("form_hash", "n"))
    return members.select("id", "rep", "copies")


def gram_table(df: DataFrame, key: str, form: Column) -> DataFrame:
    """(id, form_hash, form, runs) of every text that isn't null or blank in its normal form; runs are computed where they are asked for."""
    return spread(df.select(F.col(key).alias("id"), form.alias("form"))).where("form IS NOT NULL AND form <> ''").select("id", F.xxhash64("form").alias("form_hash"), "form", gram_hashes(F.col("form")).alias("runs"))


def written(grams: DataFrame) -> DataFrame:
    """(id, form_hash, form) of a gram table, written once: what classes and pairs are made of."""
    return cut(grams.select("id", "form_hash", "form"), "forms", "zstd")


def _few(keys: DataFrame) -> DataFrame:
    keys = cut(keys, "keys")
    return F.broadcast(keys) if fits_broadcast(keys, MOST_KEYS) else keys


def guard_matches(corpus: DataFrame, guard: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(id, guard_id, n_shared, n_least) of corpus texts contained in, or containing, a guard text.

    Both sides are gram tables.  The guard's runs are broadcast when they are
    few enough (counted first); else candidates are found among all texts.
    """
    g = guard.select(F.col("id").alias("guard_id"), F.size("runs").alias("gn"), F.explode("runs").alias("run"))
    if fits_broadcast(g, MOST_BROADCAST):
        c = corpus.select("id", F.size("runs").alias("cn"), F.explode("runs").alias("run"))
        shared = c.join(F.broadcast(g), "run").groupBy("id", "guard_id").agg(F.count(F.lit(1)).alias("n_shared"), F.least(F.first("cn"), F.first("gn")).alias("n_least"))
        near = shared.where(f"n_least >= {LEAST_RUNS} AND n_shared >= {threshold} * n_least")
    else:
        near = _near_guard(corpus, guard, threshold)
    hashes = guard.select(F.col("id").alias("guard_id"), "form_hash", F.size("runs").alias("n"))
    exact = corpus.select("id", "form_hash").join(hashes, "form_hash").select("id", "guard_id", F.col("n").cast("bigint").alias("n_shared"), F.col("n").alias("n_least"))
    return near.unionByName(exact).distinct()


def _near_guard(corpus: DataFrame, guard: DataFrame, threshold: float) -> DataFrame:
    """Pairs of corpus and guard rows of different texts: texts of both sides stand once, under their form's hash, and only sides that differ meet."""
    rows = cut(corpus.select(F.lit(1).alias("side"), "id", "form_hash", "form").unionByName(guard.select(F.lit(2).alias("side"), "id", "form_hash", "form")), "sides", "zstd")
    own = F.struct("side", "id")
    classes = rows.groupBy("form_hash").agg(F.min(own).alias("f"), F.bit_or("side").alias("both"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = _few(join_unique(rows.select("side", "id", "form_hash"), classes.select("form_hash", "f"), ["form_hash"], counts=classes.select("form_hash", "n")).where(own != F.col("f")).select("side", "id"))
    both = _few(classes.where("both = 3").select("form_hash", "both"))
    texts = rows.join(later, ["side", "id"], "left_anti").join(both, "form_hash", "left").select(F.col("form_hash").alias("id"), "form", F.coalesce("both", "side").alias("side"))
    pairs = cut(_text_pairs(texts, threshold), "near")
    met = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "n_shared", "n_least").unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y"), "n_shared", "n_least"))
    c, g = rows.where("side = 1").select("id", F.col("form_hash").alias("x")), rows.where("side = 2").select(F.col("id").alias("guard_id"), F.col("form_hash").alias("y"))
    return met.join(c, "x").join(g, "y").select("id", "guard_id", "n_shared", "n_least")


def _text_pairs(texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b, n_shared, n_least) of pairs of texts (id, form and maybe side), each standing once: candidates, verified on whole texts."""
    pairs = C.candidates(texts, threshold, LEAST_RUNS)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    some = texts.select("id", "form").join(_few(ids), "id", "left_semi")
    both = join_unique(pairs, some.select(F.col("id").alias("a"), F.col("form").alias("fa")), ["a"])
    both = join_unique(both, some.select(F.col("id").alias("b"), F.col("form").alias("fb")), ["b"], counts=pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")))
    kind = pairs.schema["a"].dataType.simpleString()
    checked = both.select("a", "b", "fa", "fb").mapInArrow(C.shared_runs, f"a {kind}, b {kind}, n_shared bigint, n_least int")
    return checked.where(f"n_least >= {LEAST_RUNS}").where(F.col("n_shared") >= F.col("n_least") * threshold - 1e-9)


def containment_pairs(grams: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(a, b, n_shared, n_least) of all pairs a < b of different texts within one gram table.

    Copies stand as one text under their least id; ``text_classes`` tells which
    rows it stands for, so a text that stands a million times gives no more
    pairs than one that stands once.
    """
    return pairs_of_written(written(grams), threshold)


def pairs_of_written(forms: DataFrame, threshold: float = 0.85) -> DataFrame:
    """``containment_pairs`` of a table that ``written`` made."""
    classes = forms.groupBy("form_hash").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = join_unique(forms.select("id", "form_hash"), classes.select("form_hash", "rep"), ["form_hash"], counts=classes.select("form_hash", "n"))
    return _text_pairs(forms.join(_few(copies.where("id <> rep").select("id")), "id", "left_anti").select("id", "form"), threshold)


def greedy_distinct(rows: DataFrame, key: str, form: Column, order: Column, threshold: float = 0.85) -> DataFrame:
    """The rows left when each is dropped whose text equals, contains or stands in that of an earlier kept one.

    Of copies only the first in ``order`` can be kept, so pairs are made of one
    row a text.  Rows with null or blank text match nothing and stay.
    """
    forms = written(gram_table(rows, key, form))
    members = text_classes(forms.select("id", "form_hash").join(rows.select(F.col(key).alias("id"), order.alias("__o")), "id"), F.col("__o"))
    later = _few(members.where("id <> rep").select("id"))
    pairs = cut(_text_pairs(forms.join(later, "id", "left_anti").select("id", "form"), threshold), "near")
    return greedy_keep(rows.join(later.withColumnRenamed("id", key), key, "left_anti"), pairs, key, order)


def greedy_keep(nodes: DataFrame, edges: DataFrame, key: str, order: Column) -> DataFrame:
    """Rows kept by greedy de-duplication: a row is kept unless an earlier kept row matches it.

    ``edges`` (a, b) link matching rows.  Rounds of the lexicographically first
    independent set: an undecided row with no undecided earlier neighbour is
    kept, its later neighbours are dropped.  Each round is two joins on the
    undecided edges; rows without an edge never enter the loop.
    """
    rank = nodes.select(F.col(key).alias("id"), F.struct(order, F.col(key)).alias("r"))
    linked = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    ranked = linked.join(rank.select(F.col("id").alias("a"), F.col("r").alias("ra")), "a").join(rank.select(F.col("id").alias("b"), F.col("r").alias("rb")), "b")
    todo = cut(ranked.where("rb < ra").select("a", "b"), "greedy")  # a has the earlier neighbour b
    dropped = None
    while todo.limit(1).count():
        free = todo.select(F.col("b").alias("id")).distinct().join(todo.select(F.col("a").alias("id")).distinct(), "id", "left_anti")
        out = cut(todo.join(free, todo["b"] == free["id"], "left_semi").select(F.col("a").alias("id")).distinct(), "dropped")
        dropped = out if dropped is None else dropped.unionByName(out)
        gone = todo.join(out.withColumnRenamed("id", "a"), "a", "left_anti").join(out.withColumnRenamed("id", "b"), "b", "left_anti")
        todo = cut(gone, "greedy")
    return nodes if dropped is None else nodes.join(dropped.withColumnRenamed("id", key), key, "left_anti")
