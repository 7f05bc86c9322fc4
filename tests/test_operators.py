"""Properties and edge cases of diffs, ingests and reports."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from snapdiff.demo import adapters as A
from snapdiff.functions import columns as C
from snapdiff.operators import catalog as K
from snapdiff.operators import change as G
from snapdiff.operators import entities as E
from snapdiff.operators import numeric as N
from snapdiff.sources import html_pages as H
from snapdiff.sources import json_pages as J
from snapdiff.sources import page_specs as P
from snapdiff.sources import payloads as L
from snapdiff.sources import store as S
from snapdiff.sources import text_pages as X

AT = dt.datetime(2024, 1, 2, 12)


def payload(spark, *bodies, host="h1:7000"):
    return spark.createDataFrame([(0, "x", host, AT, b) for b in bodies], "snapshot_id int, dataset string, hostname_port string, captured_at timestamp, body string")


def test_diff_with_itself_is_empty(spark, sf):
    m, s, c = A.counters(spark, sf), A.snapshots(spark), A.catalog(spark)
    assert N.value_diff(m, s, 0, 0, c).count() == 0
    assert N.countsum_diff(m, s, 1, 1).count() == 0
    assert G.change_diff(A.last_events(spark, sf), ["hostname_port"], ["status"], 1, 1).count() == 0


def test_swapped_sides_swap_signs(spark, sf):
    le = A.last_events(spark, sf)
    count = lambda b, e: {r[0]: r[1] for r in G.change_diff(le, ["hostname_port"], ["status"], b, e).groupBy("change").count().collect()}
    a, b = count(0, 1), count(1, 0)
    assert a.get("+", 0) == b.get("-", 0) and a.get("-", 0) == b.get("+", 0) and a["="] == b["="]


def test_rolled_up_delta_is_sum_of_details(spark, sf):
    m, s, c = A.counters(spark, sf), A.snapshots(spark), A.catalog(spark)
    total = lambda d: N.value_diff(m, s, 0, 1, c, details=d).where("metric_type = 'table'").agg(F.sum("delta")).first()[0]
    assert total(False) == total(True)


def test_adjacent_rates_add_up_and_resets_show(spark):
    rows = [("h", "t", "1", "n", dt.datetime(2024, 1, d), v) for d, v in ((1, 5), (2, 9), (3, 4), (4, 10))]
    m = spark.createDataFrame(rows, "hostname_port string, metric_type string, metric_id string, name string, captured_at timestamp_ntz, value long")
    got = [(r.delta, r.reset) for r in N.series_rates(m).orderBy("captured_at").collect()]
    assert got == [(4, False), (4, True), (6, False)]


def test_countsum_reset_has_no_average(spark):
    row = lambda s, c, t: (s, "h", "server", "1", "ns", "t", "n", "countsum", 0, dt.datetime(2024, 1, 1 + s), c, t)
    m = spark.createDataFrame([row(0, 5, 100), row(1, 7, 50)], "snapshot_id int, hostname_port string, metric_type string, metric_id string, namespace string, table_name string, name string, kind string, pos int, captured_at timestamp_ntz, total_count long, total_sum long")
    s = A.snapshots(spark)
    r = N.countsum_diff(m, s, 0, 1).first()
    assert (r["count"], r.reset, r.avg) == (2, True, None)


def test_catalog_conflict_fails(spark):
    c = spark.createDataFrame([("a", "u", "s", "counter", 1), ("a", "v", "s", "counter", 1)], K.CATALOG)
    with pytest.raises(Exception, match="catalog rows differ"):
        K.checked(c).collect()


def test_metric_shapes(spark):
    body = '[{"type":"server","id":"i","metrics":[{"name":"a","value":5},{"name":"b","value":18446744073709551615},{"name":"c","value":true},{"name":"d","count":1,"sum":2,"rows":3},{"name":"e","value":1.5}]}]'
    got = {r.name: (r.kind, r.value, r.total_count) for r in J.metrics_long(payload(spark, body, "not json", "", None)).collect()}
    assert got == {"a": ("value", 5, None), "b": ("rejected_u64", None, None), "c": ("rejected_bool", None, None), "d": ("countsumrows", None, 1), "e": ("unknown", None, None)}
    assert L.quarantine(L.parsed(payload(spark, body, "not json", ""), J.METRICS), F.col("doc").isNotNull()).count() == 1


def test_leader_and_health_pages(spark):
    p = payload(spark, '{"STATUS":"OK"}', "{}", "<html>no</html>")
    assert [r.status for r in J.leaders(p).collect()] == ["OK"]
    assert J.health(payload(spark, '{"dead_nodes":["a"]}')).first().dead_nodes == ["a"]


def test_log_records(spark):
    body = "<pre>\nlost\nI0102 10:00:00.000001 7 a.cc:1] one\n  at x\n  at y\nE1231 23:00:00.5 bad\nW0103 10:00:00.000002 8 b.cc:22] two &lt;3\n</pre>"
    got = [(r.severity, r.message, str(r.ts)) for r in X.log_lines(payload(spark, body)).orderBy("record").collect()]
    # a time after the capture is of the year before
    assert got == [("I", "one  at x\n  at y\nE1231 23:00:00.5 bad", "2024-01-02 10:00:00.000001"), ("W", "two <3", "2023-01-03 10:00:00.000002")]


def test_prometheus_types(spark):
    body = '# HELP a x\n# TYPE a gauge\na{z="1",b="2"} 3.5 1700000000000\n# TYPE h histogram\nh_bucket{le="1"} 4\nh_sum 4\n# TYPE u untyped\nu 1e3\nv_count 2\n<html>\n'
    got = sorted((r.name, r.labels, r.exporter_type, r.value) for r in X.prometheus_samples(payload(spark, body)).collect())
    assert got == [("a", "_1_2", "gauge", 3.5), ("u", "", "counter", 1000.0)]


def test_gflags_last_line_needs_newline(spark):
    assert [(r.name, r.value) for r in X.gflags(payload(spark, "--a=1\n--b=\n--c=x=y\n--d=2")).collect()] == [("a", "1"), ("b", ""), ("c", "x=y")]


def test_html_tables_forgive_open_tags(spark):
    pages = H.html_tables(payload(spark, "<table><tr><th>Path<th>Used Space<th>Total Space<tr><td>/a&gt;b<td>1.5G<td>2G</table>", "", "<p>no"))
    r = P.drives(pages).first()
    assert (r.path, r.used_bytes) == ("/a>b", 1.5 * 2**30)


def test_columns(spark):
    r = spark.range(1).select(C.reverse_path(F.lit("a->b->c")).alias("p"), C.stack_frames(F.lit("@ 0x1 f @ 0x2 main")).alias("s"), C.human_bytes(F.lit("x")).alias("h"), C.object_oid(F.lit("short")).alias("o"), C.cut_text(F.lit("a\n'b'"), 3).alias("t"), C.pct_used(F.lit(1), F.lit(0)).alias("z"), C.is_colocation_parent(F.lit("k.colocated.parent.uuid"), F.lit("k")).alias("c")).first()
    assert tuple(r) == ("c->b->a", "main;f", None, 0, "a\\n\\'", None, True)


def test_leader_rows_take_the_first_ok(spark):
    leaders = spark.createDataFrame([(0, "b", "OK"), (0, "a", "OK"), (1, "c", "")], "snapshot_id int, hostname_port string, status string")
    facts = spark.createDataFrame([(0, "a", 1), (0, "b", 2), (1, "c", 3)], "snapshot_id int, hostname_port string, x int")
    assert [r.x for r in E.leader_rows(facts, leaders).collect()] == [1]


def test_store_allots_ids(spark, tmp_path):
    path = str(tmp_path / "s")
    t = spark.createDataFrame([("h", 1)], "hostname_port string, x int")
    assert S.write_snapshot(spark, {"t": t}, path, "a") == 0
    assert S.write_snapshot(spark, {"t": t}, path, "b") == 1
    assert S.read_snapshot(spark, path, "t", [1]).count() == 1
    with pytest.raises(ValueError, match="no snapshot"):
        S.resolve_pair(S.snapshot_list(spark, path), 0, 7)
