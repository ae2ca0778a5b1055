"""Content hashes, order-free snapshot hashes and uniqueness checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digest(**fields: Column) -> Column:
    """SHA-256 of the canonical JSON of the fields: keys in order, no blanks, nulls kept."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def snapshot_hash(df: DataFrame) -> DataFrame:
    """One row (n, snapshot): row count and a hash of the rows that doesn't depend on their order.

    Rows are hashed to two numbers of 60 bits each, which are summed, so nothing
    is gathered or sorted.
    """
    cols = sorted(df.columns)
    row = F.md5(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}))
    sums = [F.coalesce(F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string") for at in (1, 17)]
    return df.agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws("|", *sums), 256).alias("snapshot"))


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    """Keys that stand more than once, with their number of rows; null keys count as one."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def assert_unique(df: DataFrame, *key: str) -> DataFrame:
    """The frame, or ValueError if a key stands twice (one aggregation is run)."""
    bad = duplicates(df, *key).limit(3).collect()
    if bad:
        raise ValueError(f"duplicate key {key}: {[tuple(r) for r in bad]}")
    return df


def git_blob_id(content: Column | str) -> Column:
    """The SHA-1 that git gives a file of this content."""
    content = F.col(content) if isinstance(content, str) else content
    head = F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string"), F.lit("\0")), "UTF-8")
    return F.sha1(F.concat(head, content))
