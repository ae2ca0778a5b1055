"""Session defaults, table loading and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_CHECKPOINTS: dict[str, str] = {}


def session(app: str = "caseloom", master: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """A session with the settings the library is written for; an existing one is reused."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for cut lineages: spark.checkpoint.dir, or a temporary one where that is unset and all runs in one process.

    A cluster without that setting is refused: a folder of one machine is
    neither seen by the others nor kept when it is lost.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_CHECKPOINTS:
        _LOCAL_CHECKPOINTS[app] = tempfile.mkdtemp(prefix="caseloom-")
        atexit.register(shutil.rmtree, _LOCAL_CHECKPOINTS[app], True)
    return "file://" + _LOCAL_CHECKPOINTS[app]


def spread(df: DataFrame) -> DataFrame:
    """The frame in at least as many partitions as there are cores.

    Only a table read from fewer files or row groups than that (a small one) is
    dealt out anew, before work that is heavy per row; a large one is left as it is,
    and so is what comes out of a shuffle (asking for its partitions would run it).
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        if jvm is not None:
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may be gone by now
        pass


def cut(df: DataFrame, name: str = "cut", compression: str = "snappy") -> DataFrame:
    """Writes the frame to the shared folder and reads it back.

    The copy is a parquet table outside the executors, so later stages neither
    recompute what came before nor depend on an executor that held it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def fits_broadcast(df: DataFrame, most_rows: int) -> bool:
    """Whether the frame has at most that many rows (reads no more than one beyond)."""
    return df.limit(most_rows + 1).count() <= most_rows


#: Left rows from which a key counts as hot, and the number of hot keys handled apart.
HOT_ROWS, HOT_KEYS = 50_000, 256


def join_unique(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """Joins any number of left rows to a right side with at most one row a key, safe for hot left keys.

    The ``HOT_KEYS`` fullest keys with more than ``HOT_ROWS`` left rows are taken
    apart: their right rows, at most that many, are broadcast, so hot left rows
    aren't shuffled (any other key holds less than one part in ``HOT_KEYS`` of
    the rows).  The rest takes a shuffle join.  ``counts`` (key columns and
    ``n``) saves counting the left rows.  Null keys match nothing.
    Nothing runs here; an empty hot side is pruned when the plan runs.
    """
    if counts is None:
        counts = left.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    hot = F.broadcast(counts.where(F.col("n") > HOT_ROWS).dropna(subset=on).orderBy(F.desc("n"), *on).limit(HOT_KEYS).select(*on))
    few = F.broadcast(right.join(hot, on, "left_semi"))
    warm = left.join(few, on) if how == "inner" else left.join(hot, on, "left_semi").join(few, on, how)
    cold = left.join(hot, on, "left_anti").join(right, on, how)
    return warm.unionByName(cold)
