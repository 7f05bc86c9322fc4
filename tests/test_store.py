"""Snapshots are stored all or nothing, and read as listed."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from snapdiff.sources import store as S


def rows(spark, *names, host="h"):
    return spark.createDataFrame([(host, n, i) for i, n in enumerate(names)], "hostname_port string, name string, x int")


def failing(spark):
    return rows(spark, "a").withColumn("x", F.raise_error(F.lit("no such body")).cast("int"))


def test_a_failed_write_is_not_seen_and_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "s")
    S.write_snapshot(spark, {"t": rows(spark, "a")}, path)
    with pytest.raises(Exception, match="no such body"):
        S.write_snapshot(spark, {"t": rows(spark, "b", "c"), "u": rows(spark, "d"), "v": failing(spark)}, path)
    assert [r.snapshot_id for r in S.snapshot_list(spark, path).collect()] == [0]
    assert S.read_snapshot(spark, path, "t", [0, 1]).count() == S.read_snapshot(spark, path, "t").count() == 1
    assert spark.read.parquet(f"{path}/t").count() == 3  # the half snapshot is there, but not listed
    assert S.write_snapshot(spark, {"t": rows(spark, *"abcde"), "v": rows(spark, "v")}, path, "again") == 1
    assert S.read_snapshot(spark, path, "t", [1]).count() == 5
    assert S.read_snapshot(spark, path, "u").count() == S.read_snapshot(spark, path, "u", [1]).count() == 0  # left by the failed one
    assert spark.read.parquet(f"{path}/t").where("snapshot_id = 1").count() == 5


def test_an_empty_dataset_does_not_show_what_failed(spark, tmp_path):
    path = str(tmp_path / "s")
    with pytest.raises(Exception, match="no such body"):
        S.write_snapshot(spark, {"t": rows(spark, "b"), "v": failing(spark)}, path)
    assert S.write_snapshot(spark, {"t": rows(spark, "b").where("false"), "v": rows(spark, "v")}, path) == 0
    assert S.read_snapshot(spark, path, "t", [0]).count() == 0 and S.read_snapshot(spark, path, "v", [0]).count() == 1
    assert S.listed(spark, path).first().datasets == {"t": 0, "v": 1}


def test_two_writers_get_different_numbers(spark, tmp_path):
    path = str(tmp_path / "s")
    S.write_snapshot(spark, {"t": rows(spark, "a")}, path)
    assert S._claim(spark, path, 1) and not S._claim(spark, path, 1)  # another writer is at work
    assert S.write_snapshot(spark, {"t": rows(spark, "b", "c")}, path) == 2
    S._release(spark, path, 1)
    assert sorted(r.snapshot_id for r in S.read_snapshot(spark, path, "t").collect()) == [0, 2, 2]


def test_a_numbered_snapshot_is_written_once(spark, tmp_path):
    path = str(tmp_path / "s")
    assert S.write_snapshot(spark, {"t": rows(spark, "a")}, path, number=5) == 5
    assert S.write_snapshot(spark, {"t": rows(spark, "b", "c")}, path, number=5) == 5
    assert [r.name for r in S.read_snapshot(spark, path, "t").collect()] == ["a"]
    assert S.write_snapshot(spark, {"t": rows(spark, "d")}, path) == 6


def test_lists_kept_without_counts_show_everything(spark, tmp_path):
    path = str(tmp_path / "s")
    rows(spark, "a").withColumn("snapshot_id", F.lit(3)).write.partitionBy("snapshot_id").parquet(f"{path}/t")
    spark.createDataFrame([(3, dt.datetime(2024, 1, 1), "old")], S.CATALOG).write.parquet(f"{path}/snapshots")
    assert S.read_snapshot(spark, path, "t").count() == S.read_snapshot(spark, path, "t", [3]).count() == 1


def test_reading_some_snapshots_prunes_the_others(spark, tmp_path):
    path = str(tmp_path / "s")
    for n in range(3):
        S.write_snapshot(spark, {"t": rows(spark, *"abc"[: n + 1])}, path)
    plan = S.read_snapshot(spark, path, "t", [2])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snapshot_id" in plan and S.read_snapshot(spark, path, "t", [2]).count() == 3


class Killed(Exception):
    pass


def test_a_stream_of_payloads_is_filed_once_though_a_run_was_killed(spark, tmp_path, monkeypatch):
    src, path, ck = (str(tmp_path / n) for n in ("in", "s", "ck"))
    schema = "hostname_port string, captured_at timestamp, body string"
    for n in range(3):
        spark.createDataFrame([(f"h{i}", dt.datetime(2024, 1, 1, 0, n), f"{n}{i}") for i in range(2)], schema).coalesce(1).write.mode("append").parquet(src)
    tables = lambda b: {"bodies": b.select("hostname_port", "body"), "hosts": b.select("hostname_port").distinct()}

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        q = stream.writeStream.foreachBatch(S.snapshot_sink(path, tables, "polled")).option("checkpointLocation", ck).trigger(availableNow=True).start()
        q.awaitTermination(120)

    whole, calls = S.write_snapshot, []

    def dies(*a, **k):
        calls.append(1)
        if len(calls) == 2:  # the second batch: after its first dataset
            whole(a[0], {"bodies": a[1]["bodies"], "hosts": failing(spark)}, *a[2:], **k)
        return whole(*a, **k)

    monkeypatch.setattr(S, "write_snapshot", dies)
    with pytest.raises(Exception, match="no such body"):
        run()
    assert S.snapshot_list(spark, path).count() == 1
    monkeypatch.setattr(S, "write_snapshot", whole)
    run()
    run()
    assert sorted((r.snapshot_id, str(r.ts)) for r in S.snapshot_list(spark, path).collect()) == [(n, f"2024-01-01 00:0{n}:00") for n in range(3)]
    assert sorted(r.body for r in S.read_snapshot(spark, path, "bodies").collect()) == [f"{n}{i}" for n in range(3) for i in range(2)]
    assert S.read_snapshot(spark, path, "hosts").count() == 6
