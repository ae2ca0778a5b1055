"""JSON and JSON-lines records, members of ZIP archives, and guarded writes."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_rows(spark: SparkSession, path: str, schema: T.StructType, require: bool = True) -> DataFrame:
    """JSON objects with a given schema: a JSON array file or JSON lines, told apart by the first character.

    Blank lines are skipped, a byte-order mark is looked over.  A record that
    doesn't fit the schema or is no object raises; so does an empty input,
    unless ``require`` is false.
    """
    head = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    if not head:
        if require:
            raise ValueError(f"no records in {path}")
        return spark.createDataFrame([], schema)
    first = head[0][0].lstrip("﻿").lstrip()[:1]
    if first not in "[{":
        raise ValueError(f"{path} holds no JSON objects")
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    return reader.option("multiLine", True).json(path) if first == "[" else reader.json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON document of a given schema a file, a byte-order mark looked over; a file that doesn't fit raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)


def write_rows(df: DataFrame, path: str, form: str = "json") -> None:
    """Writes to a new folder only; Spark's commit protocol makes the result all or nothing."""
    df.write.mode("errorifexists").format(form).save(path)


def train_member(name: str) -> bool:
    """Whether a member's path names a training part and no held-out one."""
    tokens = set(re.split(r"[/_.\-]+", name.lower()))
    return "train" in tokens and not tokens & {"test", "valid", "dev"}


def zip_lines(spark: SparkSession, path: str, member: str | None = None, train_only: bool = False) -> DataFrame:
    """(archive, member, line_no from 1, line) of every non-blank line of the members of ZIP files.

    Each archive is one task's work (a deflated member can't be split); its
    members are streamed line by line and leave in batches of bounded size.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for archive, content in zip(frame["path"], frame["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if name.endswith("/") or (member is not None and name != member):
                            continue
                        if train_only and not train_member(name):
                            raise ValueError(f"not a training member: {name}")
                        rows: list[tuple] = []
                        with z.open(name) as handle:
                            for number, line in enumerate(io.TextIOWrapper(handle, encoding="utf-8-sig"), 1):
                                if line.strip():
                                    rows.append((archive, name, number, line.rstrip("\n")))
                                if len(rows) == 2000:
                                    yield pd.DataFrame(rows, columns=["archive", "member", "line_no", "line"])
                                    rows = []
                        yield pd.DataFrame(rows, columns=["archive", "member", "line_no", "line"])

    return files.mapInPandas(scan, "archive string, member string, line_no bigint, line string")


def parsed_lines(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Lines as records (column ``raw``), null where a line is no object of the schema."""
    return lines.withColumn("raw", F.from_json("line", schema))


def to_json_lines(rows: list[dict]) -> bytes:
    """JSON lines with characters as they are."""
    return "".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows).encode("utf-8")
