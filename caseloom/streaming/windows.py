"""Event-time windows with bounded state: late rows are dropped behind the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table_stream(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int = 1) -> DataFrame:
    """The parquet files of a folder (or one file) as a stream with the schema of a known table."""
    reader = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isFile():
        folder, name = path.rsplit("/", 1)
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def windowed_counts(events: DataFrame, time: str, by: str, value: str, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums for each tumbling or sliding window and group."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    out = events.withWatermark(time, late).groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "total")


def sessions(events: DataFrame, time: str, by: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each group that end after a gap."""
    out = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("s"), by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), by, "n")


def deliveries_once(rows: DataFrame, key: list[str], time: str, late: str = "1 day") -> DataFrame:
    """Rows with repeated deliveries dropped, state kept no longer than the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(key)
