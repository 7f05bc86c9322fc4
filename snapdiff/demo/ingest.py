"""Round trips: demo rows are written as payload text, and read back; the SQL says the rows themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import human_bytes, human_seconds, object_oid, pct_used
from ..functions.filters import backend_label, call_label, severity_filter, text_filter
from ..sources import html_pages as H
from ..sources import json_pages as J
from ..sources import page_specs as P
from ..sources import payloads as L
from ..sources import text_pages as X
from . import adapters as A
from .numeric import EV
from .registry import query

def at() -> Column:
    """When every demo payload was captured."""
    return F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")


def bodies(df: DataFrame, keys: list[Column], row: Column, wrap) -> DataFrame:
    """One payload per key, host and capture: its rows, in order, wrapped to a body.

    The last of ``keys`` numbers the captures of a host, so that a payload has a bounded number of rows.
    """
    g = df.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    when = at() + F.make_dt_interval(secs=F.col("capture"))
    return g.select(F.lit(0).alias("snapshot_id"), F.lit("demo").alias("dataset"), "hostname_port", when.alias("captured_at"), wrap(F.col("rows")).alias("body"))


BLOCK = 7000  # keys a capture spans: 1,000 rows for each of seven hosts


def captured(key: str, host: Column | None = None) -> list[Column]:
    """The host and the capture of the row with this key; rows of different keys are in different captures when ``BLOCK`` apart."""
    return [by_host(key) if host is None else host, F.floor(F.col(key).cast("long") / BLOCK).alias("capture")]


def by_host(n: str, m: int = 7) -> Column:
    return F.concat(F.lit("h"), (F.col(n) % m).cast("string"), F.lit(":7000")).alias("hostname_port")


def host_sql(n: str, m: int = 7) -> str:
    return f"'h' || CAST({n} % {m} AS VARCHAR) || ':7000' AS hostname_port"


def as_json(col: Column) -> Column:
    return F.to_json(col)


def lines(rows: Column) -> Column:
    return F.concat(F.array_join(F.transform(rows, lambda r: r["line"]), "\n"), F.lit("\n"))


# ---- JSON


def metric_payloads(s, d) -> DataFrame:
    m = A.counters(s, d).where("snapshot_id = 1 AND kind = 'value'").join(A.counters(s, d).where("snapshot_id = 1 AND kind = 'countsumrows'").select("hostname_port", "metric_type", "metric_id", "name", F.col("total_sum").alias("cents"), F.col("rows_").alias("k")), ["hostname_port", "metric_type", "metric_id", "name"])
    q, n = F.lit('"'), lambda c: F.col(c).cast("string")
    same = lambda *names: [x for k in names for x in (F.lit(f',"{k}":'), n("value"))]
    head = F.concat(F.lit('{"name":'), q, F.col("name"), q)
    shapes = [
        F.concat(head, F.lit(',"value":'), n("value"), F.lit("}")),
        F.concat(head, F.lit(',"total_count":'), n("value"), F.lit(',"min":1,"mean":1.5'), *same("percentile_75", "percentile_95", "percentile_99", "percentile_99_9", "percentile_99_99", "max"), F.lit(',"total_sum":'), n("cents"), F.lit("}")),
        F.concat(head, F.lit(',"count":'), n("value"), F.lit(',"sum":'), n("cents"), F.lit(',"rows":'), n("k"), F.lit("}")),
        F.concat(head, F.lit(',"value":18446744073709551615}')),
        F.concat(head, F.lit(',"value":true}')),
    ]
    row = F.concat(F.lit('{"type":"'), F.col("metric_type"), F.lit('","id":"'), F.col("metric_id"), F.lit('","attributes":{"namespace_name":"ns"},"metrics":['), F.concat_ws(",", *shapes), F.lit("]}"))
    return bodies(m, captured("metric_id", F.col("hostname_port")), row, lambda r: F.concat(F.lit("["), F.array_join(r, ","), F.lit("]")))


@query("metrics_ingest", f"""WITH {EV}, k(kind) AS (VALUES ('value'), ('countsum'), ('countsumrows'), ('rejected_u64'), ('rejected_bool'))
SELECT hostname_port, metric_type, metric_id, 'ns' AS namespace, name, kind, CASE WHEN kind = 'value' THEN n ELSE 0 END AS value, CASE WHEN kind LIKE 'count%' THEN n ELSE 0 END AS total_count, CASE WHEN kind LIKE 'count%' THEN cents ELSE 0 END AS total_sum, CASE WHEN kind = 'countsumrows' THEN k ELSE 0 END AS rows_ FROM ev, k WHERE snapshot_id = 1""")
def metrics_ingest(s, d):
    return J.metrics_long(metric_payloads(s, d)).select("hostname_port", "metric_type", "metric_id", "namespace", "name", "kind", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("value", "total_count", "total_sum", "rows_")])


def order_payloads(s, d, row: Column, wrap) -> DataFrame:
    return bodies(A.table(s, d, "orders"), captured("o_orderkey"), row, wrap)


@query("statements_ingest", f"SELECT {host_sql('o_orderkey')}, o_orderkey AS query_id, o_orderpriority || chr(10) || '\"x\"' AS query, o_custkey AS calls, o_totalprice AS total_time, o_custkey * 2 AS rows_ FROM orders")
def statements_ingest(s, d):
    row = F.struct(F.col("o_orderkey").alias("query_id"), F.concat("o_orderpriority", F.lit('\n"x"')).alias("query"), F.col("o_custkey").alias("calls"), F.col("o_totalprice").alias("total_time"), (F.col("o_custkey") * 2).alias("rows"))
    return J.statements_long(order_payloads(s, d, row, lambda r: as_json(F.struct(r.alias("statements"))))).select("hostname_port", "query_id", "query", "calls", "total_time", "rows_")


@query("entities_ingest", f"SELECT {host_sql('o_orderkey')}, CAST(o_custkey AS VARCHAR) AS table_id, CAST(o_orderkey AS VARCHAR) AS tablet_id, 'VOTER' AS type, 's' || r AS server_uuid FROM orders, (VALUES ('0'), ('1')) v(r) WHERE o_orderkey % 2 = 0")
def entities_ingest(s, d):
    o = A.table(s, d, "orders").withColumn("own", F.when(F.col("o_orderkey") % 2 == 0, F.array(*[F.struct(F.lit("VOTER").alias("type"), F.lit(f"s{i}").alias("server_uuid"), F.lit("a").alias("addr")) for i in range(2)])))
    tablet = F.struct(F.col("o_custkey").cast("string").alias("table_id"), F.col("o_orderkey").cast("string").alias("tablet_id"), F.lit("RUNNING").alias("state"), F.col("own").alias("replicas"))
    ks = F.array(F.struct(F.lit("k1").alias("keyspace_id"), F.lit("db").alias("keyspace_name"), F.lit("ysql").alias("keyspace_type")))
    wrap = lambda r: as_json(F.struct(ks.alias("keyspaces"), F.transform(r, lambda x: F.struct(x["table_id"].alias("table_id"), F.lit("k1").alias("keyspace_id"))).alias("tables"), r.alias("tablets")))
    e = J.entities(bodies(o, captured("o_orderkey"), tablet, wrap))
    return e["replicas"].join(e["tablets"].select("hostname_port", "tablet_id", "table_id"), ["hostname_port", "tablet_id"]).select("hostname_port", "table_id", "tablet_id", "type", "server_uuid")


@query("masters_ingest", f"SELECT {host_sql('c_custkey')}, c_name AS permanent_uuid, c_custkey AS instance_seqno, CASE WHEN c_custkey % 3 = 0 THEN '-' ELSE 'z' || CAST(c_nationkey AS VARCHAR) END AS zone, CASE WHEN c_custkey % 2 = 0 THEN 'UNKNOWN_ROLE' ELSE c_mktsegment END AS role, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name || ':7100,b:' || CAST(c_nationkey AS VARCHAR) || ',' END AS rpc_addresses FROM customer WHERE c_custkey % 5 <> 0")
def masters_ingest(s, d):
    c = A.table(s, d, "customer")
    at = lambda h, p: F.struct(h.alias("host"), p.alias("port"))
    reg = F.when(F.col("c_custkey") % 3 != 0, F.struct(F.array(at(F.col("c_name"), F.lit(7100)), at(F.lit("b"), F.col("c_nationkey"))).alias("private_rpc_addresses"), F.struct(F.concat(F.lit("z"), F.col("c_nationkey").cast("string")).alias("placement_zone")).alias("cloud_info")))
    row = F.struct(F.struct(F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.col("c_name")).alias("permanent_uuid"), F.col("c_custkey").alias("instance_seqno")).alias("instance_id"), reg.alias("registration"), F.when(F.col("c_custkey") % 2 != 0, F.col("c_mktsegment")).alias("role"))
    return J.masters(bodies(c, captured("c_custkey"), row, lambda r: as_json(F.struct(r.alias("masters"))))).select("hostname_port", "permanent_uuid", "instance_seqno", "zone", "role", "rpc_addresses")


def server_payloads(s, d) -> DataFrame:
    path = F.struct(F.concat(F.lit("/d"), F.col("c_nationkey").cast("string")).alias("path"), (F.col("c_custkey") + 1).alias("space_used"), ((F.col("c_custkey") % 4) * (F.col("c_custkey") + F.col("c_nationkey") + 1)).alias("total_space_size"))
    row = F.struct(F.col("c_name").alias("k"), F.struct(F.col("c_mktsegment").alias("status"), F.col("c_custkey").alias("uptime_seconds"), F.array(path).alias("path_metrics")).alias("v"))
    wrap = lambda r: F.concat(F.lit('{"":'), as_json(F.map_from_arrays(F.transform(r, lambda x: x["k"]), F.transform(r, lambda x: x["v"]))), F.lit("}"))
    return bodies(A.table(s, d, "customer"), captured("c_custkey"), row, wrap)


@query("tserver_ingest", f"SELECT {host_sql('c_custkey')}, c_name AS server, c_mktsegment AS status, c_custkey AS uptime_seconds FROM customer")
def tserver_ingest(s, d):
    return J.tablet_servers(server_payloads(s, d)).select("hostname_port", "server", "status", "uptime_seconds")


@query("path_usage", f"SELECT {host_sql('c_custkey')}, c_name AS server, '/d' || CAST(c_nationkey AS VARCHAR) AS path, round(100 * (c_custkey + 1)::DOUBLE / total, 2) AS pct FROM (SELECT *, nullif((c_custkey % 4) * (c_custkey + c_nationkey + 1), 0)::DOUBLE AS total FROM customer)")
def path_usage(s, d):
    paths = J.tablet_server_paths(J.tablet_servers(server_payloads(s, d)))
    return paths.select("hostname_port", "server", "path", pct_used(F.col("space_used"), F.col("total_space_size")).alias("pct"))


@query("vars_ingest", f"SELECT {host_sql('p_partkey')}, p_name AS name, p_type AS value, p_brand AS var_type FROM part")
def vars_ingest(s, d):
    row = F.struct(F.col("p_name").alias("name"), F.col("p_type").alias("value"), F.col("p_brand").alias("type"))
    return J.vars_(bodies(A.table(s, d, "part"), captured("p_partkey"), row, lambda r: as_json(F.struct(r.alias("flags"))))).select("hostname_port", "name", "value", "var_type")


def single(df: DataFrame, host: Column, body: Column) -> DataFrame:
    return df.select(F.lit(0).alias("snapshot_id"), F.lit("demo").alias("dataset"), host.alias("hostname_port"), at().alias("captured_at"), body.alias("body"))


@query("versions_ingest", "SELECT c_name AS hostname_port, c_mktsegment AS git_hash, CAST(c_custkey AS VARCHAR) AS build_number, c_custkey % 2 = 0 AS build_clean_repo FROM customer WHERE c_custkey % 4 <> 0")
def versions_ingest(s, d):
    body = as_json(F.struct(F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).otherwise("").alias("git_hash"), F.col("c_custkey").cast("string").alias("build_number"), (F.col("c_custkey") % 2 == 0).alias("build_clean_repo")))
    return J.versions(single(A.table(s, d, "customer"), F.col("c_name"), body)).select("hostname_port", "git_hash", "build_number", "build_clean_repo")


@query("health_ingest", "SELECT s_name AS hostname_port, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '' END AS dead, s_suppkey AS most_recent_uptime FROM supplier")
def health_ingest(s, d):
    body = F.when(F.col("s_suppkey") % 2 == 0, as_json(F.struct(F.array("s_name").alias("dead_nodes"), F.col("s_suppkey").alias("most_recent_uptime")))).otherwise(as_json(F.struct(F.col("s_suppkey").alias("most_recent_uptime"))))
    return J.health(single(A.table(s, d, "supplier"), F.col("s_name"), body)).select("hostname_port", F.array_join("dead_nodes", ",").alias("dead"), "most_recent_uptime")


@query("cluster_config_ingest", "SELECT s_name AS hostname_port, CAST(s_suppkey AS INTEGER) AS version, 'u' || CAST(s_suppkey AS VARCHAR) AS cluster_uuid, 'z' || CAST(s_nationkey AS VARCHAR) AS zone FROM supplier WHERE s_suppkey % 3 <> 0")
def cluster_config_ingest(s, d):
    body = as_json(F.struct(F.col("s_suppkey").alias("version"), F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit("u"), F.col("s_suppkey").cast("string"))).alias("cluster_uuid"), F.struct(F.array(F.struct(F.concat(F.lit("z"), F.col("s_nationkey").cast("string")).alias("zone"))).alias("live")).alias("replication_info")))
    return J.cluster_config(single(A.table(s, d, "supplier"), F.col("s_name"), body)).select("hostname_port", "version", "cluster_uuid", F.try_variant_get("doc", "$.replication_info.live[0].zone", "string").alias("zone"))


def rpc_payloads(s, d) -> DataFrame:
    """Orders as backends (even keys) or as inbound connections with a call in flight for urgent ones."""
    o = A.table(s, d, "orders")
    back = F.struct(F.lit("client").alias("backend_type"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("idle").alias("backend_status"), F.when(F.col("o_orderkey") % 4 == 0, "").otherwise("c1").alias("host"), F.lit("5433").alias("port"), F.concat(F.lit("select "), F.col("o_custkey").cast("string")).alias("query"), F.col("o_orderkey").alias("query_running_for_ms"))
    statement = lambda i: F.struct(F.concat(F.lit("q"), F.col("o_custkey").cast("string"), F.lit(f"_{i}")).alias("sql_string"))
    detail = F.struct(F.when(F.col("o_custkey") % 2 == 0, F.array(statement(0), statement(1))).otherwise(F.array(statement(0))).alias("call_details"))
    call = F.struct(F.col("o_orderkey").alias("elapsed_millis"), detail.alias("cql_details"))
    peer = F.struct(F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("remote_ip"), F.lit("OPEN").alias("state"), F.when(F.col("o_orderpriority") == "1-URGENT", F.array(call)).alias("calls_in_flight"))
    even = bodies(o.where("o_orderkey % 2 = 0"), captured("o_orderkey"), back, lambda r: as_json(F.struct(r.alias("connections"))))
    odd = bodies(o.where("o_orderkey % 2 <> 0"), captured("o_orderkey", F.concat(F.lit("t"), by_host("o_orderkey")).alias("hostname_port")), peer, lambda r: as_json(F.struct(r.alias("inbound_connections"))))
    return even.unionByName(odd)


_RPC = """c AS (SELECT 'h' || CAST(o_orderkey % 7 AS VARCHAR) || ':7000' AS hostname_port, 'ysql' AS direction, CASE WHEN o_orderkey % 4 = 0 THEN 'background:client' ELSE 'c1:5433' END AS peer, o_orderstatus = 'O' AS active, 'select ' || o_custkey AS label, o_orderkey AS elapsed_ms FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT 'th' || CAST(o_orderkey % 7 AS VARCHAR) || ':7000', 'inbound', 'p' || o_custkey, o_orderpriority = '1-URGENT', CASE WHEN o_custkey % 2 = 0 THEN 'BATCH (2)' ELSE 'q' || o_custkey || '_0' END, o_orderkey FROM orders WHERE o_orderkey % 2 <> 0)"""


@query("rpc_ingest", f"WITH {_RPC} SELECT hostname_port, direction, peer, active FROM c")
def rpc_ingest(s, d):
    return backend_label(J.connections(rpc_payloads(s, d))).select("hostname_port", "direction", "peer", "active")


@query("rpc_activity", f"WITH {_RPC} SELECT split_part(hostname_port, ':', 1) AS host, CAST(split_part(hostname_port, ':', 2) AS INTEGER) AS port, count(*) FILTER (active) AS active, count(*) AS total FROM c GROUP BY ALL")
def rpc_activity(s, d):
    from ..functions.columns import host_of, port_of

    return J.connection_activity(J.connections(rpc_payloads(s, d))).select(host_of(F.col("hostname_port")).alias("host"), port_of(F.col("hostname_port")).alias("port"), "active", "total")


@query("rpc_calls", f"WITH {_RPC} SELECT hostname_port, direction, label, elapsed_ms FROM c WHERE active")
def rpc_calls(s, d):
    return call_label(J.calls(rpc_payloads(s, d))).select("hostname_port", "direction", "label", "elapsed_ms")


# ---- text


@query("prometheus_ingest", "SELECT CASE c_custkey % 4 WHEN 0 THEN 'node_a_total' WHEN 1 THEN 'node_g' ELSE 'node_u' END AS name, '_' || CAST(c_custkey AS VARCHAR) || '_' || 'z' || c_mktsegment AS labels, CASE WHEN c_custkey % 4 = 1 THEN 'gauge' ELSE 'counter' END AS exporter_type, CAST(c_custkey AS DOUBLE) AS value FROM customer WHERE c_custkey % 4 <> 3")
def prometheus_ingest(s, d):
    n = F.col("c_custkey") % 4
    name = F.when(n == 0, "node_a_total").when(n == 1, "node_g").when(n == 2, "node_u").otherwise("node_s_sum")
    head = F.when(n == 0, "# TYPE node_a_total counter\n").when(n == 1, "# TYPE node_g gauge\n").when(n == 2, "# TYPE node_u untyped\n").otherwise("# TYPE node_s summary\n")
    k = F.col("c_custkey").cast("string")
    line = F.struct(F.col("c_custkey").alias("k"), F.concat(head, name, F.lit('{seg="z'), F.col("c_mktsegment"), F.lit('",id="'), k, F.lit('"} '), k).alias("line"))
    p = bodies(A.table(s, d, "customer"), captured("c_custkey"), line, lines)
    return X.prometheus_samples(p).select("name", "labels", "exporter_type", "value")


@query("gflags_ingest", f"SELECT {host_sql('p_partkey')}, 'flag_' || CAST(p_partkey AS VARCHAR) AS name, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type || '=' || p_brand END AS value FROM part")
def gflags_ingest(s, d):
    k = F.col("p_partkey").cast("string")
    line = F.struct(F.concat(F.lit("--flag_"), k, F.lit("="), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat("p_type", F.lit("="), "p_brand"))).alias("line"))
    return X.gflags(bodies(A.table(s, d, "part"), captured("p_partkey"), line, lines)).select("hostname_port", "name", "value")


def log_payloads(s, d, odd: bool = True) -> DataFrame:
    ev = A.table(s, d, "events")
    sev = F.when(F.col("event_type") == "error", "E").when(F.col("event_type") == "purchase", "W").when(F.col("event_type") == "signup", "F").otherwise("I")
    head = F.concat(sev, F.date_format("ts", "MMdd HH:mm:ss.SSSSSS"), F.lit(" "), (F.col("event_id") % 9).cast("string"), F.lit(" f"), (F.col("user_id") % 3).cast("string"), F.lit(".cc:1] "), F.col("event_type"), F.lit(" &amp; "), F.col("event_id").cast("string"))
    line = F.struct("event_id", F.when(F.col("event_id") % 2 == 1, F.concat(head, F.lit("\n  at more"))).otherwise(head).alias("line"))
    return bodies(ev, captured("event_id", by_host("user_id")), line, lambda r: F.concat(F.lit("<div class='main'><pre>\n"), lines(r), F.lit("</pre></div>")))


_LOG = f"""log AS (SELECT {host_sql('user_id')}, CASE event_type WHEN 'error' THEN 'E' WHEN 'purchase' THEN 'W' WHEN 'signup' THEN 'F' ELSE 'I' END AS severity, ts, event_id % 9 AS tid, 'f' || CAST(user_id % 3 AS VARCHAR) || '.cc:1' AS source,
 event_type || ' & ' || CAST(event_id AS VARCHAR) || CASE WHEN event_id % 2 = 1 THEN '  at more' ELSE '' END AS message FROM events)"""


def log(s, d) -> DataFrame:
    return X.log_lines(log_payloads(s, d)).select("hostname_port", "severity", F.col("ts").cast("timestamp_ntz").alias("ts"), "tid", "source", "message")


query("log_ingest", f"WITH {_LOG} SELECT * FROM log")(log)


@query("log_filter", f"WITH {_LOG} SELECT * FROM log WHERE severity IN ('W', 'E', 'F') AND (regexp_matches(message, 'e.*7') OR regexp_matches(source, 'f1')) ORDER BY ts")
def log_filter(s, d):
    return text_filter(severity_filter(log(s, d)), "e.*7|f1").orderBy("ts")


@query("log_new_lines", f"WITH {_LOG}, old AS (SELECT * FROM log WHERE ts < TIMESTAMP '2024-01-20') SELECT * FROM log WHERE (ts, hostname_port, source) NOT IN (SELECT (ts, hostname_port, source) FROM old)")
def log_new_lines(s, d):
    rows = log(s, d)
    return X.new_log_lines(rows, rows.where(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")))


@query("raw_dumps", "SELECT 'd' || CAST(doc_id AS VARCHAR) AS hostname_port, 'heap profile' || chr(10) || text AS body FROM documents WHERE doc_id % 3 = 0")
def raw_dumps(s, d):
    docs = A.table(s, d, "documents")
    p = single(docs, F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("heap profile\n"), "text")).otherwise(F.concat(F.lit("x"), "text")))
    return L.raw_dumps(p).select("hostname_port", "body")


@query("object_oid", "SELECT p_partkey, p_partkey AS oid, p_partkey < 16384 AS catalog FROM part")
def object_oid_(s, d):
    k = F.lpad(F.hex("p_partkey"), 32, "0")
    return A.table(s, d, "part").select("p_partkey", object_oid(k).alias("oid"), (object_oid(k) < 16384).alias("catalog"))


@query("human_units", "SELECT p_partkey, p_size * 1048576::DOUBLE AS bytes, p_size * 0.001::DOUBLE AS seconds FROM part")
def human_units(s, d):
    n = F.col("p_size").cast("string")
    return A.table(s, d, "part").select("p_partkey", human_bytes(F.concat(n, F.lit(".0M"))).alias("bytes"), human_seconds(F.concat(n, F.lit("ms"))).alias("seconds"))


# ---- HTML


def html(rows: Column, header: list[str], cells, tag: str = "td", title: str = "") -> Column:
    """A table of rows; some tags stay open and ``>`` is a reference, as on real pages."""
    head = "".join(f"<th>{h.replace('&', '&amp;')}</th>" for h in header)
    safe = lambda c: F.replace(c, F.lit(">"), F.lit("&gt;"))
    row = lambda r: F.concat(F.lit("<tr>"), *[x for c in cells(r) for x in (F.lit(f"<{tag}>"), safe(c), F.lit(f"</{tag}>"))])
    return F.concat(F.lit(f"<h3>{title}</h3><table><tr>{head}</tr>"), F.array_join(F.transform(rows, row), "\n"), F.lit("</table>"))


def page_bodies(s, d, name: str, key: str, cells: dict[str, Column], kind: str, tag: str = "td", title: str = "", extra=None) -> DataFrame:
    header = P.SPECS[kind][0]
    row = F.struct(F.col(key).alias("_k"), *[c.alias(f"c{i}") for i, c in enumerate(cells.values())])
    body = lambda r: F.concat(F.lit("<html><body><table><tr><th>other</th></tr><tr><td>1</td></tr></table>"), html(r, header, lambda x: [x[f"c{i}"] for i in range(len(cells))], tag, title), extra(r) if extra else F.lit(""))
    return bodies(A.table(s, d, name), captured(key), row, body)


def page_of(*a, **k) -> DataFrame:
    return H.html_tables(page_bodies(*a, **k))


def text(c: str) -> Column:
    return F.col(c).cast("string")


def part_pages(s, d, body: Column) -> DataFrame:
    """The parsed page of each part, on a host named by its key."""
    return H.html_tables(single(L.spread(A.table(s, d, "part"), "p_partkey"), text("p_partkey"), body))


@query("html_table_ingest", f"SELECT {host_sql('o_orderkey')}, CAST(o_orderkey AS VARCHAR) AS path, o_orderpriority AS used, o_orderstatus AS total FROM orders")
def html_table_ingest(s, d):
    p = page_of(s, d, "orders", "o_orderkey", {"a": text("o_orderkey"), "b": F.col("o_orderpriority"), "c": F.col("o_orderstatus")}, "drives")
    none = H.html_tables(A.table(s, d, "pages").select(F.lit(0).alias("snapshot_id"), F.col("url").alias("hostname_port"), at().alias("captured_at"), F.col("html").alias("body")))
    return P.page(p.unionByName(none), "drives").select("hostname_port", "path", "used", "total")


@query("drives", f"SELECT {host_sql('p_partkey')}, p_name AS path, p_size * 1073741824::DOUBLE AS used_bytes, (p_size + 1) * 1048576::DOUBLE AS total_bytes FROM part")
def drives(s, d):
    cells = {"a": F.col("p_name"), "b": F.concat(text("p_size"), F.lit("G")), "c": F.concat((F.col("p_size") + 1).cast("string"), F.lit("M"))}
    return P.drives(page_of(s, d, "part", "p_partkey", cells, "drives")).select("hostname_port", "path", "used_bytes", "total_bytes")


@query("memtrackers", f"SELECT {host_sql('p_partkey')}, p_type || '->' || p_brand || '->root' AS id, p_size * 1048576::DOUBLE AS current_bytes FROM part")
def memtrackers(s, d):
    cells = {"a": F.concat(F.lit("root->"), "p_brand", F.lit("->"), "p_type"), "b": F.concat(text("p_size"), F.lit(".0M")), "c": F.lit("1K"), "d": F.lit("none")}
    return P.memtrackers(page_of(s, d, "part", "p_partkey", cells, "memtrackers")).select("hostname_port", "id", "current_bytes")


@query("threads_fill", f"SELECT {host_sql('p_partkey')}, p_name AS thread_name, last_value(CASE WHEN p_partkey % 3 = 0 OR p_partkey = lo THEN 'main;f' || CAST(p_partkey AS VARCHAR) END IGNORE NULLS) OVER (PARTITION BY p_partkey % 7, p_partkey // 7000 ORDER BY p_partkey) AS stack FROM (SELECT *, min(p_partkey) OVER (PARTITION BY p_partkey % 7, p_partkey // 7000) AS lo FROM part)")
def threads_fill(s, d):
    block = F.floor(F.col("p_partkey") / BLOCK)
    lo = A.table(s, d, "part").groupBy((F.col("p_partkey") % 7).alias("g"), block.alias("b")).agg(F.min("p_partkey").alias("lo"))
    t = A.table(s, d, "part").join(lo, (F.col("p_partkey") % 7 == F.col("g")) & (block == F.col("b")))
    stack = F.when((F.col("p_partkey") % 3 == 0) | (F.col("p_partkey") == F.col("lo")), F.concat(F.lit("<td rowspan=3>@ 0x1f f"), text("p_partkey"), F.lit(" @ 0x2a main</td>"))).otherwise("")
    row = F.struct("p_partkey", F.concat(F.lit("<tr><td>"), "p_name", F.lit("</td><td>1s</td><td>2s</td><td>3s</td>"), stack, F.lit("</tr>")).alias("line"))
    head = "".join(f"<th>{h}</th>" for h in P.SPECS["threads"][0])
    body = bodies(t, captured("p_partkey"), row, lambda r: F.concat(F.lit(f"<table><tr>{head}<th>Stack</th></tr>"), lines(r), F.lit("</table>")))
    return P.threads(H.html_tables(body)).select("hostname_port", "thread_name", "stack")


def clock_pages(s, d) -> DataFrame:
    cells = {"a": F.col("p_name"), "b": F.concat(text("p_size"), F.lit("ms")), "c": F.lit("ALIVE: 1:00"), "d": F.lit("now"), "e": F.lit("now"), "f": F.concat(text("p_size"), F.lit("s")), "g": F.col("p_brand"), "h": F.lit("r"), "i": F.col("p_type")}
    return P.clocks(page_of(s, d, "part", "p_partkey", cells, "clocks"))


@query("clocks", f"SELECT {host_sql('p_partkey')}, p_name AS server, p_brand AS cloud, p_type AS zone FROM part")
def clocks(s, d):
    return clock_pages(s, d).select("hostname_port", "server", "cloud", "zone")


@query("latencies", f"SELECT * FROM (SELECT {host_sql('p_partkey')}, p_name AS server, p_size * 0.001::DOUBLE AS since_heartbeat_s, p_size * 1::DOUBLE AS rtt_s FROM part) WHERE hostname_port = 'h3:7000'")
def latencies(s, d):
    from ..plans.reports import latency_report

    leaders = s.createDataFrame([(0, "h5:7000", ""), (0, "h3:7000", "OK")], "snapshot_id int, hostname_port string, status string")
    return latency_report(clock_pages(s, d), leaders).select("hostname_port", "server", "since_heartbeat_s", "rtt_s")


@query("tasks", f"SELECT {host_sql('o_orderkey')}, 'task ' || CAST(o_orderkey AS VARCHAR) AS task_name, o_orderpriority AS description, t.type, t.status FROM orders, (VALUES ('task', 'active'), ('user job', 'done'), ('task', 'done')) t(type, status)")
def tasks(s, d):
    cells = {"a": F.concat(F.lit("task "), text("o_orderkey")), "b": F.lit("kRunning"), "c": F.lit("1 s ago"), "d": F.lit("1ms"), "e": F.col("o_orderpriority")}
    again = lambda r: html(r, P.SPECS["tasks"][0], lambda x: [x[f"c{i}"] for i in range(5)])
    return P.tasks(page_of(s, d, "orders", "o_orderkey", cells, "tasks", extra=lambda r: F.concat(again(r), again(r)))).select("hostname_port", "task_name", "description", "type", "status")


@query("operations", f"SELECT {host_sql('o_orderkey')}, CAST(o_custkey AS VARCHAR) AS tablet_id, CAST(o_orderkey AS VARCHAR) AS op_id, left(repeat(o_orderpriority, 20), 80) AS description FROM orders")
def operations(s, d):
    cells = {"a": text("o_custkey"), "b": text("o_orderkey"), "c": F.lit("WRITE"), "d": F.lit("1 us"), "e": F.repeat("o_orderpriority", F.lit(20))}
    return P.operations(page_of(s, d, "orders", "o_orderkey", cells, "operations", tag="th")).select("hostname_port", "tablet_id", "op_id", "description")


@query("replication_issues", f"SELECT {host_sql('p_partkey')}, p_type AS table_name, CAST(p_partkey AS VARCHAR) AS tablet_id, i.issue FROM part, (VALUES ('leaderless'), ('under_replicated')) i(issue)")
def replication_issues(s, d):
    few = {"a": F.col("p_type"), "b": F.col("p_brand"), "c": text("p_partkey"), "d": F.lit("2")}
    none = lambda r: html(r, P.SPECS["leaderless"][0], lambda x: [x[f"c{i}"] for i in range(3)])
    return P.replication_issues(page_of(s, d, "part", "p_partkey", few, "under_replicated", extra=none)).select("hostname_port", "table_name", "tablet_id", "issue")


def list_page(s, d) -> DataFrame:
    cells = {"a": F.col("p_brand"), "b": F.col("p_type"), "c": F.lit("Running"), "d": F.lit(""), "e": text("p_partkey"), "f": text("p_size"), "g": F.lit("false"), "h": F.concat(text("p_size"), F.lit(".00M"))}
    return P.table_pages(page_of(s, d, "part", "p_partkey", cells, "tables", title="Index tables"))


@query("table_pages", f"SELECT {host_sql('p_partkey')}, p_brand AS keyspace, p_type AS table_name, CAST(p_partkey AS VARCHAR) AS table_id, 'index' AS object_type, p_size * 1048576::DOUBLE AS on_disk_bytes FROM part")
def table_pages(s, d):
    return list_page(s, d).select("hostname_port", "keyspace", "table_name", "table_id", "object_type", "on_disk_bytes")


@query("table_detail", "SELECT CAST(p_partkey AS VARCHAR) AS table_id, p_brand AS keyspace, 'Version' AS key, CAST(p_size AS VARCHAR) AS value FROM part")
def table_detail(s, d):
    body = F.concat(F.lit("<table><tr><td>Version</td><td>"), text("p_size"), F.lit("</td></tr></table><table><tr><th>Column</th><th>ID</th><th>Type</th></tr><tr><td>k</td><td>0</td><td>int</td></tr></table>"))
    detail = P.keyed_values(part_pages(s, d, body)).withColumnRenamed("hostname_port", "table_id").drop("snapshot_id", "captured_at")
    return P.page_with_detail(list_page(s, d), detail, "table_id").select("table_id", "keyspace", "key", "value")


@query("tablet_pages", f"SELECT {host_sql('p_partkey')}, p_type AS table_name, CAST(p_partkey AS VARCHAR) AS tablet_id, p_size * 1024::DOUBLE AS on_disk_bytes FROM part")
def tablet_pages(s, d):
    cells = {"a": F.col("p_brand"), "b": F.col("p_type"), "c": F.lit("u"), "d": text("p_partkey"), "e": F.lit("hash"), "f": F.lit("RUNNING"), "g": F.lit("false"), "h": F.lit("1"), "i": F.concat(text("p_size"), F.lit("K")), "j": F.lit("LEADER"), "k": F.lit("ok")}
    return P.tablet_pages(page_of(s, d, "part", "p_partkey", cells, "tablets")).select("hostname_port", "table_name", "tablet_id", "on_disk_bytes")


def tablet_detail_pages(s, d) -> DataFrame:
    one = lambda k: F.concat(F.lit("<h3>Options</h3><pre>o</pre><h3>Files</h3><pre>"), text("p_partkey"), F.lit(f".sst {k} "), text("p_size"), F.lit("\n</pre>"))
    return part_pages(s, d, F.concat(F.lit("<h2>Tablet</h2><table><tr><th>Column</th><th>ID</th><th>Type</th></tr><tr><td>"), F.col("p_brand"), F.lit("</td><td>0</td><td>int</td></tr></table>"), one(10), one(20)))


@query("tablet_detail", "SELECT CAST(p_partkey AS VARCHAR) AS tablet_id, p_brand AS \"column\", 2 AS options FROM part")
def tablet_detail(s, d):
    p = tablet_detail_pages(s, d)
    n = P.pre_blocks(p).where("heading = 'Options'").groupBy(F.col("hostname_port").alias("t")).agg(F.count("*").alias("options"))
    return P.page(p, "columns").join(n, F.col("hostname_port") == F.col("t")).select(F.col("hostname_port").alias("tablet_id"), "column", "options")


@query("sst_files", "SELECT CAST(p_partkey AS VARCHAR) AS tablet_id, s.store, p_partkey || '.sst' AS name, s.n AS total_size, CAST(p_size AS BIGINT) AS base_size FROM part, (VALUES ('regular', 10::BIGINT), ('intents', 20::BIGINT)) s(store, n)")
def sst_files(s, d):
    return P.sst_files(P.pre_blocks(tablet_detail_pages(s, d))).select(F.col("hostname_port").alias("tablet_id"), "store", "name", "total_size", "base_size")


# ---- parts of table and tablet pages, and reports


def raft_body() -> Column:
    """A consensus page per part: state, queue, one watermark and one message."""
    k = text("p_partkey")
    return F.concat(F.lit("<h1>Raft</h1><h2>State</h2><pre>term "), k, F.lit("</pre><h2>Queue overview</h2><pre>ops "), text("p_size"), F.lit("</pre><h3>Watermarks</h3><table><tr><th>Peer</th><th>Watermark</th></tr><tr><td>"), F.col("p_brand"), F.lit("</td><td>{ last: "), k, F.lit(" }</td></tr></table><h3>Messages:</h3><table><tr><th>Entry</th><th>OpId</th><th>Type</th><th>Size</th><th>Status</th></tr><tr><th>0</th><th>1."), k, F.lit("</th><td>WRITE</td><td>"), text("p_size"), F.lit("</td><td>"), F.col("p_type"), F.lit("</td></tr></table>"))


def raft_pages(s, d) -> DataFrame:
    return part_pages(s, d, raft_body())


@query("tablet_consensus", "SELECT CAST(p_partkey AS VARCHAR) AS tablet_id, i.item, CASE i.item WHEN 'state' THEN 'term ' || p_partkey ELSE 'ops ' || p_size END AS text FROM part, (VALUES ('state'), ('queue_overview')) i(item)")
def tablet_consensus(s, d):
    return P.consensus_state(raft_pages(s, d)).select(F.col("hostname_port").alias("tablet_id"), "item", "text")


@query("tablet_watermarks", "SELECT CAST(p_partkey AS VARCHAR) AS tablet_id, p_brand AS peer, '{ last: ' || p_partkey || ' }' AS watermark FROM part")
def tablet_watermarks(s, d):
    return P.page(raft_pages(s, d), "watermarks").select(F.col("hostname_port").alias("tablet_id"), "peer", "watermark")


@query("tablet_messages", "SELECT CAST(p_partkey AS VARCHAR) AS tablet_id, '0' AS entry, '1.' || p_partkey AS op_id, 'WRITE' AS type, CAST(p_size AS VARCHAR) AS size, p_type AS status FROM part")
def tablet_messages(s, d):
    return P.page(raft_pages(s, d), "messages").select(F.col("hostname_port").alias("tablet_id"), "entry", "op_id", "type", "size", "status")


@query("tablet_log_anchors", "SELECT CAST(p_partkey AS VARCHAR) AS tablet_id, l.line, CASE l.line WHEN 0 THEN 'anchor ' || p_partkey ELSE p_brand END AS text FROM part, (VALUES (0), (1)) l(line)")
def tablet_log_anchors(s, d):
    body = F.concat(F.lit("<div><pre>anchor "), text("p_partkey"), F.lit("\n"), F.col("p_brand"), F.lit("\n</pre></div>"))
    return P.pre_lines(part_pages(s, d, body)).select(F.col("hostname_port").alias("tablet_id"), "line", "text")


def table_body() -> Column:
    """A table's page per part: properties, columns, one tablet and one task."""
    head = lambda kind: F.lit("<table><tr>" + "".join(f"<th>{h}</th>" for h in P.SPECS[kind][0]) + "</tr><tr>")
    cells = lambda *c: F.concat(*[x for v in c for x in (F.lit("<td>"), v, F.lit("</td>"))], F.lit("</tr></table>"))
    return F.concat(F.lit("<table><tr><td>Version:</td><td>1</td></tr></table>"), head("columns"), F.lit("<th>k</th>"), cells(F.lit("0"), F.lit("int")), head("tablets_of_table"), cells(F.lit("x"), F.lit("hash"), text("p_size"), F.lit("Running"), F.lit("false"), F.lit(""), F.lit("LEADER: a")), head("tasks_of_table"), cells(F.lit("Alter"), F.lit("kComplete"), F.lit("1 s ago"), F.lit("2 ms"), F.col("p_type")))


def table_parts(s, d) -> DataFrame:
    return part_pages(s, d, table_body())


@query("table_tablets", "SELECT CAST(p_partkey AS VARCHAR) AS table_id, 'x' AS tablet_id, CAST(p_size AS VARCHAR) AS split_depth, 'LEADER: a' AS raft_config FROM part")
def table_tablets(s, d):
    return P.page(table_parts(s, d), "tablets_of_table").select(F.col("hostname_port").alias("table_id"), "tablet_id", "split_depth", "raft_config")


@query("table_tasks", "SELECT CAST(p_partkey AS VARCHAR) AS table_id, 'Alter' AS task_name, 'kComplete' AS state, p_type AS description FROM part")
def table_tasks(s, d):
    return P.page(table_parts(s, d), "tasks_of_table").select(F.col("hostname_port").alias("table_id"), "task_name", "state", "description")


@query("rpc_report", f"WITH {_RPC} SELECT hostname_port, direction, label, CASE WHEN active THEN elapsed_ms ELSE -1 END AS elapsed_ms FROM (SELECT hostname_port, direction, active, CASE WHEN active THEN label ELSE '' END AS label, elapsed_ms FROM c)")
def rpc_report(s, d):
    from ..plans.reports import rpc_report as report

    p = rpc_payloads(s, d)
    return report(J.connections(p), J.calls(p), details=True).select("hostname_port", "direction", "label", F.coalesce("elapsed_ms", F.lit(-1)).alias("elapsed_ms"))


def _lead(s, d) -> DataFrame:
    names = A.table(s, d, "supplier").where("s_suppkey IN (1, 2)")
    return names.select(F.lit(0).alias("snapshot_id"), F.col("s_name").alias("hostname_port"), F.lit("OK").alias("status"), (-F.col("s_suppkey")).alias("pos"))


@query("health_report", "SELECT s_name AS hostname_port, s_suppkey AS most_recent_uptime FROM supplier WHERE s_suppkey = 2")
def health_report(s, d):
    from ..plans.reports import health_report as report

    body = as_json(F.struct(F.col("s_suppkey").alias("most_recent_uptime")))
    return report(J.health(single(A.table(s, d, "supplier"), F.col("s_name"), body)), _lead(s, d)).select("hostname_port", "most_recent_uptime")


@query("config_report", "SELECT s_name AS hostname_port, CAST(s_suppkey AS INTEGER) AS version, '{\"cluster_uuid\":\"u' || s_suppkey || '\",\"version\":' || s_suppkey || '}' AS doc FROM supplier WHERE s_suppkey = 2")
def config_report(s, d):
    from ..plans.reports import config_report as report

    body = as_json(F.struct(F.concat(F.lit("u"), F.col("s_suppkey").cast("string")).alias("cluster_uuid"), F.col("s_suppkey").alias("version")))
    return report(J.cluster_config(single(A.table(s, d, "supplier"), F.col("s_name"), body)), _lead(s, d)).select("hostname_port", "version", "doc")


@query("tservers_report", "SELECT s_name AS hostname_port, c_name AS server, c_mktsegment AS status FROM customer JOIN supplier ON s_suppkey = 2 WHERE c_custkey % 2 = 0")
def tservers_report(s, d):
    from ..plans.reports import tservers_report as report

    views = A.table(s, d, "customer").withColumn("n", (2 - F.col("c_custkey") % 2).cast("long")).join(A.table(s, d, "supplier").select(F.col("s_suppkey").alias("n"), "s_name"), "n")
    return report(views.select(F.lit(0).alias("snapshot_id"), F.col("s_name").alias("hostname_port"), F.col("c_name").alias("server"), F.col("c_mktsegment").alias("status")), _lead(s, d)).select("hostname_port", "server", "status")
