"""Streams against their batch twins."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from snapdiff.operators import numeric as N
from snapdiff.streaming import follow as T


def test_live_diff_equals_batch(spark, tmp_path):
    schema = "hostname_port string, metric_type string, metric_id string, name string, captured_at timestamp, value long"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for poll in range(3):
        rows = [("h", "server", str(k), "n", dt.datetime(2024, 1, 1, 0, poll), (10 * (poll + 1) + k) % 25) for k in range(5)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = T.live_diff(stream, ttl=None).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start(out)
    q.awaitTermination(120)
    assert q.exception() is None
    got = sorted((r.metric_id, r.captured_at, r.delta, r.reset) for r in spark.read.parquet(out).collect())
    batch = N.series_rates(spark.read.parquet(src).withColumn("captured_at", F.col("captured_at")))
    want = sorted((r.metric_id, r.captured_at, float(r.delta), r.reset) for r in batch.collect())
    assert got == want and any(w[3] for w in want)


def test_follow_logs_drops_repeats(spark, tmp_path):
    schema = "snapshot_id int, hostname_port string, captured_at timestamp, body string"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    line = lambda s: f"E0101 00:00:{s:02d}.000000 1 a.cc:1] m{s}\n"
    for poll in (1, 2):  # the second page repeats the first
        spark.createDataFrame([(poll, "h:1", dt.datetime(2024, 1, 2), "".join(line(s) for s in range(poll * 2)))], schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = T.follow_logs(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start(out)
    q.awaitTermination(120)
    assert sorted(r.message for r in spark.read.parquet(out).collect()) == ["m0", "m1", "m2", "m3"]


@pytest.fixture(autouse=True)
def one_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def run(df, out, checkpoint):
    q = df.writeStream.format("parquet").option("checkpointLocation", str(checkpoint)).outputMode("append").trigger(availableNow=True).start(str(out))
    q.awaitTermination(120)
    assert q.exception() is None


def polls(spark, path, schema, batches):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def minute(m):
    return dt.datetime(2024, 1, 1, 0, m)


def test_live_latencies_go_on_after_a_restart(spark, tmp_path):
    schema = "hostname_port string, metric_type string, metric_id string, name string, captured_at timestamp, total_count long, total_sum long"
    row = lambda m, n, s: [("h", "server", "1", "n", minute(m), n, s)]
    stream = polls(spark, tmp_path / "in", schema, [row(0, 10, 100), row(1, 14, 121)])
    run(T.live_countsum(stream, ttl=None), tmp_path / "out", tmp_path / "ck")
    polls(spark, tmp_path / "in", schema, [row(1, 99, 999), row(2, 15, 90), row(3, 3, 900)])  # a late capture, a fallen sum, a fallen count
    run(T.live_countsum(stream, ttl=None), tmp_path / "out", tmp_path / "ck")
    got = [(r["count"], r["sum"], r.avg, r.reset) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("captured_at").collect()]
    assert got == [(4.0, 21.0, 5, False), (15.0, 90.0, 6, True), (3.0, 900.0, 300, True)]


def test_a_stream_begun_from_a_stored_snapshot_equals_batch(spark, tmp_path):
    schema = "hostname_port string, metric_type string, metric_id string, name string, captured_at timestamp, value long"
    row = lambda m, k, v: ("h", "server", str(k), "n", minute(m), v)
    stored = spark.createDataFrame([row(0, k, 10 * k) for k in range(4)] + [row(0, 9, 5)], schema)
    own = [[row(m, k, (10 * k + 7 * m * (k + 1)) % 40) for k in range(5)] for m in (1, 2)]
    stream = polls(spark, tmp_path / "in", schema, own)
    run(T.live_diff(stream, ttl=None, initial=stored), tmp_path / "out", tmp_path / "ck")
    polls(spark, tmp_path / "in", schema, [[row(3, k, 50 + k) for k in (0, 1, 9)]])
    run(T.live_diff(stream, ttl=None, initial=stored), tmp_path / "out", tmp_path / "ck")  # goes on; the snapshot counts once
    got = sorted((r.metric_id, r.captured_at, r.delta, r.reset) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    batch = N.series_rates(stored.unionByName(spark.read.parquet(str(tmp_path / "in"))))
    assert got == sorted((r.metric_id, r.captured_at, float(r.delta), r.reset) for r in batch.collect())
    assert ("0", minute(1), 7.0, False) in got and any(g[3] for g in got) and ("9", minute(3), 54.0, False) in got


def test_series_that_are_not_seen_leave_the_state(spark, tmp_path):
    import time

    schema = "hostname_port string, metric_type string, metric_id string, name string, captured_at timestamp, value long"
    row = lambda m, k, v: ("h", "server", str(k), "n", minute(m), v)
    stream = polls(spark, tmp_path / "in", schema, [[row(0, 1, 5), row(0, 2, 5)]])
    run(T.live_diff(stream, ttl="5 seconds"), tmp_path / "out", tmp_path / "ck")
    time.sleep(8)
    polls(spark, tmp_path / "in", schema, [[row(1, 1, 9)], [row(2, 1, 10)]])
    run(T.live_diff(stream, ttl="5 seconds"), tmp_path / "out", tmp_path / "ck")
    assert [(r.metric_id, r.delta) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("1", 1.0)]  # 5 to 9 is not known any more


def test_live_changes_classify(spark, tmp_path):
    schema = "server string, status string, zone string, captured_at timestamp"
    batches = [[("a", "up", "z", minute(0)), ("b", "up", "z", minute(0))], [("a", "down", "z", minute(1)), ("b", "up", "z", minute(1))], [("a", "down", "z", minute(30))], [("a", "up", None, minute(31))]]
    run(T.live_changes(polls(spark, tmp_path / "in", schema, batches), ["server"], ["status", "zone"]), tmp_path / "out", tmp_path / "ck")
    got = {(r.server, r.change, r.after) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {("a", "+", '{"status":"up","zone":"z"}'), ("b", "+", '{"status":"up","zone":"z"}'), ("a", "=", '{"status":"down","zone":"z"}'), ("a", "=", '{"status":"up"}'), ("b", "-", None)} <= got


def test_windowed_rates_of_a_stream_equal_batch_and_drop_late_rows(spark, tmp_path):
    schema = "hostname_port string, metric_type string, metric_id string, name string, captured_at timestamp, delta double"
    row = lambda m, k, v: ("h", "server", str(k), "n", minute(m), float(v))
    batches = [[row(1, 1, 5), row(2, 1, 6), row(3, 2, 1)], [row(7, 1, 2)], [row(40, 1, 1)], [row(41, 1, 1)], [row(4, 1, 1000)], [row(59, 2, 3)]]
    run(T.windowed_rates(polls(spark, tmp_path / "in", schema, batches)), tmp_path / "out", tmp_path / "ck")
    got = sorted((r.window_start, r.metric_id, r.delta, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    in_time = spark.read.parquet(str(tmp_path / "in")).where("delta < 1000 AND captured_at < '2024-01-01 00:45:00'")
    want = sorted((r.window_start, r.metric_id, r.delta, r.n) for r in N.windowed_rates(in_time, "5 minutes").collect())
    assert got == want


def round_of(spark, n, led="h1"):
    """A round in which names, states, leaders and servers differ by its number; two hosts see it, one of them wrong."""
    made = {
        "keyspaces": [("k1", "one" if n < 2 else "uno", "ycql"), ("k2", "two", "ysql")],
        "tables": [("t1", "k1", f"a{n}", "RUNNING"), *([("t2", "k2", "b", "RUNNING")] if n != 1 else [])],
        "tablets": [("l1", "t1", "RUNNING", f"s{n % 2}"), *([("l2", "t2", "RUNNING" if n else "CREATING", "s1")] if n != 1 else [])],
        "replicas": [("l1", s, "VOTER", f"{s}:9100") for s in ("s0", "s1")] + [("l2", "s1", "VOTER" if n else "OBSERVER", "s1:9100")] * (n != 1),
        "health": [([f"d{n}"], ["l1"] if n == 2 else [])],
    }
    schemas = {
        "keyspaces": "keyspace_id string, keyspace_name string, keyspace_type string", "tables": "table_id string, keyspace_id string, table_name string, state string", "tablets": "tablet_id string, table_id string, state string, leader string",
        "replicas": "tablet_id string, server_uuid string, type string, addr string", "health": "dead_nodes array<string>, under_replicated_tablets array<string>",
    }
    out = {k: spark.createDataFrame(v, schemas[k]).withColumn("hostname_port", F.lit(led)) for k, v in made.items()}
    out["tables"] = out["tables"].unionByName(out["tables"].withColumns({"hostname_port": F.lit("h9"), "table_name": F.lit(f"wrong{n}")}))
    out["leaders"] = spark.createDataFrame([(led, "OK", 0), ("h9", "", 1)], "hostname_port string, status string, pos int")
    return out


def test_live_reports_equal_batch_with_a_late_round_and_a_restart(spark, tmp_path):
    from snapdiff.plans import reports as R
    from snapdiff.sources import store as S
    from snapdiff.streaming import rounds as Z

    path, out, ck = (str(tmp_path / n) for n in ("s", "out", "ck"))
    go = lambda: Z.live_reports(spark, path, out, needs=("tables", "leaders")).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination(300)
    S.write_snapshot(spark, round_of(spark, 0, "h0"), path, ts="2024-01-01 00:00:00")
    S.write_snapshot(spark, round_of(spark, 2), path, ts="2024-01-01 00:04:00")
    go()  # nothing is closed yet
    S.write_snapshot(spark, round_of(spark, 1), path, ts="2024-01-01 00:02:00")  # late, but within the delay
    S.write_snapshot(spark, {"tables": round_of(spark, 7)["tables"]}, path, ts="2024-01-01 00:03:00")  # not whole
    S.write_snapshot(spark, round_of(spark, 3), path, ts="2024-01-01 01:00:00")
    go()
    got = spark.read.parquet(out)
    assert {(r.begin_id, r.end_id) for r in got.select("begin_id", "end_id").distinct().collect()} == {(0, 2), (2, 1)}
    for b, e in ((0, 2), (2, 1)):
        want = R.diff_report(Z.stored_tables(spark, path, b, e), b, e).collect()
        mine = got.where((F.col("begin_id") == b) & (F.col("end_id") == e)).collect()
        assert sorted((r.section, r.change, r.key, r.detail) for r in mine) == sorted((r.section, r.change, r.key, r.detail) for r in want)
        assert not any("wrong" in r.detail for r in mine)
    first = {(r.section, r.change, r.key) for r in got.where("end_id = 2").collect()}
    assert {("tables", "-", "t2"), ("tablets", "=", "l1"), ("replicas", "-", "l2|s1"), ("keyspaces", "-", "k2"), ("health", "+", "dead_nodes|d1")} <= first
    assert ("keyspaces", "=", "k1") in {(r.section, r.change, r.key) for r in got.where("end_id = 1").collect()}
