import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.sources import archives, records
from caseloom.streaming import ledger as SL
from caseloom.streaming import windows as SW

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType())])


def test_json_rows(spark, tmp_path):
    rows = [{"id": "甲", "n": 1}, {"id": "b", "n": None}]
    (tmp_path / "a.json").write_text("﻿" + json.dumps(rows, ensure_ascii=False, indent=1), encoding="utf-8")
    (tmp_path / "b.jsonl").write_bytes(b"\n" + records.to_json_lines(rows))
    (tmp_path / "empty.jsonl").write_text("\n \n")
    (tmp_path / "bad.jsonl").write_text("3\n")
    for name in ("a.json", "b.jsonl"):
        assert sorted(map(tuple, records.read_rows(spark, str(tmp_path / name), SCHEMA).collect()), key=str) == [("b", None), ("甲", 1)]
    for name in ("empty.jsonl", "bad.jsonl"):
        with pytest.raises(ValueError):
            records.read_rows(spark, str(tmp_path / name), SCHEMA)
    assert records.read_rows(spark, str(tmp_path / "empty.jsonl"), SCHEMA, require=False).count() == 0
    df = spark.createDataFrame([("a", 1)], SCHEMA)
    records.write_rows(df, str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exist"):
        records.write_rows(df, str(tmp_path / "out"))


def test_zip_lines(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("set/data_train.json", "﻿{\"id\": \"a\", \"n\": 1}\n\n{\"id\": \"b\"}\n")
        z.writestr("set/data_test.json", "{}\n")
    lines = records.zip_lines(spark, str(tmp_path), "set/data_train.json", train_only=True)
    assert sorted((r.line_no, r.raw.id) for r in records.parsed_lines(lines, SCHEMA).collect()) == [(1, "a"), (3, "b")]
    assert records.zip_lines(spark, str(tmp_path)).count() == 3
    assert [records.train_member(x) for x in ("a/data_train.json", "train/dev.json", "data.json", "TRAIN_valid")] == [True, False, False, False]


def test_archives(spark, tmp_path):
    def package(name, members, sums=None):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for n, data in members:
                z.writestr(n, data)
            if sums is not None:
                z.writestr(archives.CHECKSUMS, json.dumps(sums))

    h = lambda b: hashlib.sha256(b).hexdigest()
    package("good.zip", [("a.txt", b"hello\n"), ("b.txt", b"")], {"a.txt": h(b"hello\n"), "b.txt": h(b"")})
    package("bad.zip", [("a.txt", b"x"), ("../e", b"y"), ("more", b"z" * 2000)], {"a.txt": h(b"y"), "gone": h(b""), "../e": h(b"y")})
    package("bare.zip", [("a.txt", b"x")])
    with pytest.warns(UserWarning):
        package("twice.zip", [("a.txt", b"x"), ("a.txt", b"x")], {"a.txt": h(b"x")})
    members = archives.zip_members(spark, str(tmp_path), most_bytes=1000)
    expected = spark.createDataFrame([("a.txt",), ("b.txt",)], "name string")
    got = {}
    for r in archives.package_problems(members, expected, most_bytes=1000, most_total=1500).collect():
        got.setdefault(r.package.rsplit("/", 1)[1], set()).add((r.name, r.problem))
    assert got == {
        "bad.zip": {("a.txt", "altered"), ("../e", "unsafe_name"), ("more", "oversized"), ("more", "unlisted"), (None, "oversized_package"), ("gone", "missing"), ("../e", "not_expected"), ("more", "not_expected"), ("b.txt", "expected")},
        "bare.zip": {(None, "no_checksums"), ("b.txt", "expected")}, "twice.zip": {("a.txt", "repeated"), ("b.txt", "expected")},
    }
    assert archives.package_problems(members.limit(0)).count() == 0
    archives.write_package(members.where("package LIKE '%good.zip' AND name <> 'checksums.json'"), str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exist"):
        archives.write_package(members, str(tmp_path / "out"))
    rows, problems = archives.read_package(spark, str(tmp_path / "out"))
    assert rows.count() == 2 and problems.count() == 0
    folder = archives.fresh_folder(str(tmp_path / "f"))
    (folder / "a").write_bytes(b"hello\n")
    (folder / "b").write_bytes(b"x")
    with pytest.raises(ValueError):
        archives.fresh_folder(str(folder))
    found = archives.folder_manifest(spark, str(folder))
    assert {r.name: r.git_blob for r in found.collect()}["a"] == "ce013625030ba8dba906f756967f9e9ca394464a"
    expected = found.where("name = 'a'").select("name", "sha256").unionByName(spark.createDataFrame([("b", "0"), ("c", "1")], "name string, sha256 string"))
    assert {tuple(r) for r in archives.manifest_differences(found, expected).collect()} == {("b", "altered"), ("c", "missing")}


def run(stream, mode, tmp_path, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.sql(f"SELECT * FROM {name}").collect()


def test_streamed_ledger_over_batches(spark, tmp_path):
    batches = [[("r1", 1, "rejected", 1, 1), ("r2", 1, "pending", 2, 2), ("r3", 1, "pending", 7, 9), ("r3", 1, "rejected", 5, 8)], [("r1", 2, "accepted", 3, 3), ("r1", 1, "rejected", 1, 1)], [("r1", 3, "api_error", 4, 4), ("r2", 2, "rejected", 5, 5), (None, 1, "x", 6, 6)]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, "request_hash string, attempt bigint, status string, entry_no bigint, recorded_at bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        assert i < 3
    like = spark.read.parquet(str(tmp_path / "in"))
    rows = run(SL.request_states(SW.read_table_stream(spark, str(tmp_path / "in"), like)), "update", tmp_path, "ledger")
    last = {}
    for r in rows:
        last[r.request_hash] = max(last.get(r.request_hash, (0,)), (r.last_attempt, r.attempts, r.state))
    # Of an attempt delivered twice the entry recorded first counts, whatever its status is called.
    assert last == {"r1": (3, 3, "accepted"), "r2": (2, 2, "rejected"), "r3": (1, 1, "rejected")}


def test_windows(spark, tmp_path):
    rows = [("2024-01-01 00:05:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 03:00:00", "a", 4.0), ("2024-01-02 00:00:00", "b", 8.0)]
    df = spark.createDataFrame(rows, "t string, by string, v double").select(F.col("t").cast("timestamp").alias("t"), "by", "v")
    df.coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = lambda: SW.read_table_stream(spark, str(tmp_path / "ev"), df)
    assert sorted(r.n for r in run(SW.windowed_counts(stream(), "t", "by", "v"), "append", tmp_path, "w1")) == [1, 2]
    assert sorted(r.n for r in run(SW.sessions(stream(), "t", "by", "1 hour"), "append", tmp_path, "w2")) == [1, 2]
    assert len(run(SW.deliveries_once(stream(), ["by"], "t"), "append", tmp_path, "w3")) == 2
