"""Rows read one by one, capture times, tables in SQL, configurations by path, leaders and reports by uuid."""

from __future__ import annotations

import datetime as dt
import os
import shutil

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from snapdiff.operators import catalog as K
from snapdiff.operators import change as G
from snapdiff.operators import entities as E
from snapdiff.operators import numeric as N
from snapdiff.plans import reports as R
from snapdiff.sources import html_pages as H
from snapdiff.sources import json_pages as J
from snapdiff.sources import page_specs as P
from snapdiff.sources import payloads as L
from snapdiff.sources import rows as Q
from snapdiff.sources import store as S
from snapdiff.sources import table_function as T

AT = dt.datetime(2024, 1, 2, 12)
METRIC = "snapshot_id int, hostname_port string, metric_type string, metric_id string, namespace string, table_name string, name string, kind string, pos int, captured_at timestamp_ntz, value long, total_count long, total_sum long, rows_ long"


def payload(spark, *bodies):
    return spark.createDataFrame([(0, "x", f"h{i}:7000", AT, b) for i, b in enumerate(bodies)], "snapshot_id int, dataset string, hostname_port string, captured_at timestamp, body string")


def test_one_bad_row_does_not_empty_a_payload(spark):
    body = '{"flags":[{"name":"a","n":1},{"name":"b","n":"x"},{"name":null,"n":2},7,{"name":"a","n":3},{"name":"c","n":null},{"name":"d"}]}'
    seen = Observation()
    parsed = Q.parsed_rows(payload(spark, body, "<html>", '{"no":1}', "", None, '{"flags":[]}'), "$.flags", "name string, n bigint", keys=("name",), needs=("name",), seen=seen)
    rows = parsed.collect()
    assert [(r.row.name, r.row.n) for r in sorted(rows, key=lambda r: r.pos or 0) if r.reason is None] == [("a", 1), ("c", None), ("d", None)]
    assert sorted(r.reason for r in rows if r.reason) == ["bad n", "duplicate", "no array", "no json", "no name", "not a row"]
    assert seen.get == {"good": 3, "bad": 5, "duplicate": 1}
    good, bad = Q.stored_rows(payload(spark, body, "<html>"), "$.flags", "name string, n bigint", keys=("name",), needs=("name",))
    assert good.columns == ["snapshot_id", "hostname_port", "captured_at", "pos", "name", "n"] and good.count() == 3
    assert {r.element for r in bad.where("reason IN ('no json', 'not a row')").collect()} == {"<html>", "7"}
    assert len(good.inputFiles()) == len(bad.inputFiles()) and set(good.inputFiles()) == set(bad.inputFiles())  # one stored parse


def land(root, n, host, value, stamp=None):
    folder = f"{root}/snapshot_id={n}/dataset=metrics"
    os.makedirs(folder, exist_ok=True)
    name = f"{folder}/{host}_7000" + (f"@{stamp}" if stamp else "") + ".json"
    with open(name, "w") as f:
        f.write('[{"type":"server","id":"i","metrics":[{"name":"a","value":%d}]}]' % value)
    os.utime(name, (1.7e9 + 1000 * n, 1.7e9 + 1000 * n))


def rates(payloads):
    return sorted((r.hostname_port, str(r.captured_at), r.delta, r.rate) for r in N.series_rates(J.metrics_long(payloads)).collect())


@pytest.mark.parametrize("named", [True, False])
def test_rates_are_the_same_after_copying(spark, tmp_path, named):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    for n in range(3):
        for host in ("a", "b"):
            land(one, n, host, 10 * n * n + len(host), f"20240101T0000{n}0" if named else None)
    shutil.copytree(one, two, copy_function=shutil.copyfile)  # files get new times
    manifest = None if named else spark.createDataFrame([(n, "metrics", f"{h}:7000", dt.datetime(2024, 1, 1, 0, 0, 10 * n)) for n in range(3) for h in "ab"], "snapshot_id int, dataset string, hostname_port string, captured_at timestamp")
    got = [rates(L.read_payloads(spark, p, "metrics", manifest=manifest)) for p in (one, two)]
    assert got[0] == got[1] == [(f"{h}:7000", f"2024-01-01 00:00:{10 * n}", 20 * n - 10, (20 * n - 10) / 10) for h in "ab" for n in (1, 2)]
    assert rates(L.read_payloads(spark, one, "metrics"))[0][1][:4] == ("2024" if named else "2023")


def test_html_table_in_sql(spark):
    T.register(spark)
    page = "<table><tr><th>Path<th>Used Space<th>Total Space<tr><td>/a&gt;b<td>1.5G</table><table><tr><th>Path</th></tr><tr><td>x</td></tr></table>"
    payload(spark, page, "", "<p>").createOrReplaceTempView("own_pages")
    df = spark.sql("SELECT p.hostname_port, t.* FROM own_pages p, LATERAL html_table(p.body, 'Path|Used Space|Total Space') t")
    assert df.columns == ["hostname_port", "table_pos", "row_pos", "path", "used_space", "total_space"]
    assert [tuple(r) for r in df.collect()] == [("h0:7000", 0, 0, "/a>b", "1.5G", None)]
    with pytest.raises(Exception, match="constant"):
        spark.sql("SELECT t.* FROM own_pages p, LATERAL html_table(p.body, p.body) t").collect()


def test_configurations_by_path(spark):
    deep = '{"a":' * 30 + "1" + "}" * 30
    body = '{"cluster_uuid":"u","version":3,"x":{"y":[1,{"z":null},[true]],"e":{},"f":[]},"d":%s}' % deep
    rows = J.config_paths(J.cluster_config(payload(spark, body, "no"))).collect()
    assert {(r.path, r.value) for r in rows} == {("$.cluster_uuid", "u"), ("$.version", "3"), ("$.x.y[0]", "1"), ("$.x.y[1].z", None), ("$.x.y[2][0]", "true"), ("$.d" + ".a" * 30, "1")}


def test_a_conflicting_catalog_fails_and_equal_rows_do_not_double(spark):
    m = spark.createDataFrame([(s, "h", "server", "1", "", "", "a", "value", 0, dt.datetime(2024, 1, 1 + s), 5 + s, None, None, None) for s in (0, 1)], METRIC)
    snaps = spark.createDataFrame([(0, dt.datetime(2024, 1, 1), ""), (1, dt.datetime(2024, 1, 2), "")], S.CATALOG)
    same = spark.createDataFrame([("a", "u", "s", "counter", 1)] * 2, K.CATALOG)
    assert N.value_diff(m, snaps, 0, 1, same).count() == 1
    with pytest.raises(Exception, match="catalog rows differ for a"):
        N.value_diff(m, snaps, 0, 1, same.unionByName(spark.createDataFrame([("a", "v", "s", "counter", 1)], K.CATALOG))).collect()


def test_tablet_servers_are_as_the_leader_sees_them(spark):
    row = lambda s, host, up: (s, host, "t1", "ALIVE", up)
    servers = spark.createDataFrame([row(0, "m1", 100), row(1, "m1", 200), row(0, "m2", 900), row(1, "m2", 50)], "snapshot_id int, hostname_port string, server string, status string, uptime_seconds long")
    leaders = spark.createDataFrame([(s, h, "OK" if h == "m1" else "") for s in (0, 1) for h in ("m1", "m2")], "snapshot_id int, hostname_port string, status string")
    report = lambda led: R.diff_report({"tablet_servers": servers, "leaders": led}, 0, 1).count()
    assert report(leaders) == 0 and G.tserver_diff(servers, 0, 1, leaders).count() == 0
    assert G.tserver_diff(servers.where("hostname_port = 'm2'"), 0, 1).first().restart
    assert report(leaders.where("snapshot_id = 0")) == 0  # a side without a leader


def stored(spark, tmp_path):
    """Two listed snapshots of everything that the full report reads."""
    from snapdiff.demo import stored as D

    path, sf = str(tmp_path / "s"), "/root/testdata/sf0.001"
    t = D.tables(spark, sf)
    plain = {k: v for k, v in t.items() if k not in ("snapshots", "catalog")}
    for n in (0, 1):
        S.write_snapshot(spark, {k: v.where(F.col("snapshot_id") == n) for k, v in plain.items()}, path, ts=f"2024-01-{10 * n + 10}")
    return path, {k: S.read_snapshot(spark, path, k, [0, 1]) for k in plain} | {"snapshots": S.snapshot_list(spark, path), "catalog": t["catalog"]}


def test_the_full_report_reads_every_table_once(spark, tmp_path, monkeypatch):
    path, t = stored(spark, tmp_path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    read, real = [], R.settled_all
    monkeypatch.setattr(R, "settled_all", lambda x: read.extend(v._jdf.queryExecution().optimizedPlan().toString() for v in x.values()) or real(x))
    report = R.diff_report(t, 0, 1)
    plan = report._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    scans = lambda name: plan.count(f"{path}/{name}]")
    for name in ("metrics", "statements", "samples", "masters", "tablet_servers", "vars", "versions"):
        assert scans(name) == 1, name
    assert all(scans(name) == 0 for name in R.HIERARCHY) and len(read) == 4  # written once, cut to the pair
    by_metrics = R.diff_report({k: t[k] for k in ("metrics", "catalog", "snapshots")}, 0, 1, gauges=True)
    assert by_metrics._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(shape") == 1
    assert report.where("section = 'values'").count() > 0 and by_metrics.select("section").distinct().count() == 4


def test_system_keyspaces_can_be_left_out(spark):
    from snapdiff.functions.columns import SYSTEM_KEYSPACES

    row = lambda rows, schema: spark.createDataFrame(rows, schema)
    ks = row([(0, SYSTEM_KEYSPACES[0], "system", "ycql"), (0, "k", "own", "ysql"), (0, "gone", "gone", "ysql")], "snapshot_id int, keyspace_id string, keyspace_name string, keyspace_type string")
    tables = row([(0, "t0", SYSTEM_KEYSPACES[0], "peers", "RUNNING"), (0, "t1", "k", "a", "RUNNING")], "snapshot_id int, table_id string, keyspace_id string, table_name string, state string")
    tablets = row([(0, "l0", "t0", "RUNNING", "s"), (0, "l1", "t1", "RUNNING", "s")], "snapshot_id int, tablet_id string, table_id string, state string, leader string")
    replicas = row([(0, x, "s", "VOTER", "s:9100") for x in ("l0", "l1")], "snapshot_id int, tablet_id string, server_uuid string, type string, addr string")
    health = row([(0, ["s:9100"], [])], "snapshot_id int, dead_nodes array<string>, under_replicated_tablets array<string>")
    tree = lambda **o: sorted((r.kind, r.keyspace_name, r.marks) for r in E.entities_tree(ks, tables, tablets, replicas, health, **o).collect())
    own = [("keyspace", "own", ""), ("replica", "own", "VOTER LEADER DEAD"), ("table", "own", ""), ("tablet", "own", "RUNNING")]
    assert tree(system=False) == own and len(tree()) == 8 and ("keyspace", "system", "SYSTEM") in tree()


def test_tables_of_all_panels_and_stores_without_files(spark):
    head = "".join(f"<th>{h}</th>" for h in P.SPECS["tables"][0])
    panel = lambda kind, n: f"<h2>{kind} tables</h2><table><tr>{head}</tr><tr><td>k</td><td>{kind}{n}</td><td>Running</td><td></td><td>u{n}</td><td></td><td>false</td></tr></table>"
    pages = H.html_tables(payload(spark, "".join(panel(k, i) for i, k in enumerate(("User", "Index", "System", "Parent")))))
    assert sorted((r.object_type, r.table_name) for r in P.table_pages(pages).collect()) == [("index", "Index1"), ("parent", "Parent3"), ("system", "System2"), ("user", "User0")]
    blocks = P.pre_blocks(H.html_tables(payload(spark, "<h2>Regular</h2><h3>Options</h3><pre>a=1\nb=2</pre><h3>Files</h3><pre>\n</pre><h2>Intents</h2><h3>Options</h3><pre>c=3</pre><h3>Files</h3><pre></pre>")))
    assert P.sst_files(blocks).count() == 0
    assert sorted((r.store, r.item, r.text) for r in P.store_parts(blocks).collect()) == [("intents", "options", "c=3"), ("regular", "options", "a=1\nb=2")]
    assert P.transactions(H.html_tables(payload(spark, "<p>none</p>"))).count() == 0


def test_health_rows_in_blocks_compare_as_one_list(spark):
    h = spark.createDataFrame([(0, ["a"], ["x"]), (0, ["b"], None), (1, ["b", "c"], []), (1, None, ["y"])], "snapshot_id int, dead_nodes array<string>, under_replicated_tablets array<string>")
    assert sorted(tuple(r) for r in G.health_diff(h, 0, 1).collect()) == [("+", "dead_nodes", "c"), ("+", "under_replicated_tablets", "y"), ("-", "dead_nodes", "a"), ("-", "under_replicated_tablets", "x")]
    assert G.health_diff(h.where("snapshot_id = 0"), 0, 1).count() == G.health_diff(h.where("false"), 0, 1).count() == 0


def test_bucketed_hierarchies_are_compared_without_moving_rows(spark, sf):
    from snapdiff.demo import adapters as A

    h = {k: v for k, v in A.hierarchy(spark, sf).items() if k != "lines"}
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        b = S.write_bucketed(h, "own", 4)
        led = E.with_leader_addr(G.pair(b["tablets"], 0, 1), G.pair(b["replicas"], 0, 1))
        tablets = E._classified(led, ["tablet_id"], ["table_id"], ["state", "leader_addr"], 0, 1)
        replicas = E._classified(G.pair(b["replicas"], 0, 1), ["tablet_id", "server_uuid"], [], ["type", "addr"], 0, 1)
        tabled = replicas.join(b["tablets"].select(F.col("snapshot_id").alias("side"), "tablet_id", "table_id"), ["side", "tablet_id"], "left")
        for df in (tablets, tabled):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        full = E.replica_diff(b["replicas"], b["tablets"], b["tables"], b["keyspaces"], 0, 1)
        assert full._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(tablet_id") == 0
        plain = E.replica_diff(h["replicas"], h["tablets"], h["tables"], h["keyspaces"], 0, 1)
        assert sorted(map(tuple, full.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str) and full.count() > 0
        moves = lambda t: sorted(map(tuple, E.tablet_diff(t["tablets"], t["replicas"], t["tables"], t["keyspaces"], 0, 1).collect()), key=str)
        assert moves(b) == moves(h)
    finally:
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
