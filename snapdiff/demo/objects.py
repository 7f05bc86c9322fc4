"""Pages of single objects, rows read one by one, configurations by path, and tables of pages in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import change as G
from ..plans import reports as R
from ..sources import html_pages as H
from ..sources import json_pages as J
from ..sources import page_specs as P
from ..sources import payloads as L
from ..sources import rows as Q
from ..sources import table_function as T
from ..sources import text_pages as X
from . import adapters as A
from . import ingest as I
from .registry import query


def named(detail):
    """The JSON of a detail as ``name=value`` in the order of names."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(F.from_json(detail, "map<string,string>"))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def parts(s, d, body, key: str = "p_partkey") -> DataFrame:
    """A page for each part, which names it."""
    rows = L.spread(A.table(s, d, "part"), "p_partkey")
    return H.html_tables(rows.select(F.lit(0).alias("snapshot_id"), F.lit("h:7000").alias("hostname_port"), I.text(key).alias("object_id"), I.at().alias("captured_at"), body.alias("body")))


def pre(*lines) -> Column:
    return F.concat(F.lit("<div><pre>"), *[x for c in lines for x in (c, F.lit("\n"))], F.lit("</pre></div>"))


def transaction_pages(s, d):
    return parts(s, d, pre(F.concat(F.lit("txn "), I.text("p_partkey")), F.lit(""), F.col("p_brand")))


@query("tablet_transactions", "SELECT CAST(p_partkey AS VARCHAR) AS tablet_id, l.line, CASE l.line WHEN 0 THEN 'txn ' || p_partkey ELSE p_brand END AS text FROM part, (VALUES (0), (2)) l(line)")
def tablet_transactions(s, d):
    return P.transactions(transaction_pages(s, d)).select(F.col("object_id").alias("tablet_id"), "line", "text")


def store_pages(s, d):
    k = I.text("p_partkey")
    one = lambda name: F.concat(F.lit(f"<h3>Options</h3><pre>{name} "), k, F.lit("</pre><h3>Files</h3><pre>"), k, F.lit(".sst 10 "), I.text("p_size"), F.lit("\n</pre><h3>"), k, F.lit(f".sst more</h3><pre>{name} of "), F.col("p_type"), F.lit("</pre>"))
    return parts(s, d, F.concat(F.lit("<h1>Stores</h1><h2>Regular</h2>"), one("first"), F.lit("<h2>Intents</h2>"), one("second")))


_STORES = "(VALUES ('regular', 'first'), ('intents', 'second')) w(store, name)"


@query("store_details", f"SELECT CAST(p_partkey AS VARCHAR) AS tablet_id, store, 'options' AS item, '' AS name, w.name || ' ' || p_partkey AS text FROM part, {_STORES} UNION ALL SELECT CAST(p_partkey AS VARCHAR), store, 'file', p_partkey || '.sst', w.name || ' of ' || p_type FROM part, {_STORES}")
def store_details(s, d):
    return P.store_parts(P.pre_blocks(store_pages(s, d))).select(F.col("object_id").alias("tablet_id"), "store", "item", "name", "text")


def tablet_rows(s, d) -> DataFrame:
    """The list of tablets: every third does not run."""
    state = F.when(F.col("p_partkey") % 3 == 0, "NOT_STARTED").otherwise("RUNNING")
    return A.table(s, d, "part").select(F.lit(0).alias("snapshot_id"), F.lit("h:7000").alias("hostname_port"), I.text("p_partkey").alias("tablet_id"), F.col("p_brand").alias("namespace"), F.col("p_type").alias("table_name"), state.alias("state"))


_RUNS = "part WHERE p_partkey % 3 <> 0"
_TABLET_REPORT = f"""SELECT p_partkey, 'general' AS part, 'namespace=' || p_brand || ';state=' || CASE WHEN p_partkey % 3 = 0 THEN 'NOT_STARTED' ELSE 'RUNNING' END || ';table_name=' || p_type AS detail FROM part
UNION ALL SELECT p_partkey, 'consensus', 'item=state;text=term ' || p_partkey FROM {_RUNS} UNION ALL SELECT p_partkey, 'consensus', 'item=queue_overview;text=ops ' || p_size FROM {_RUNS}
UNION ALL SELECT p_partkey, 'watermark', 'peer=' || p_brand || ';row=0;watermark={{ last: ' || p_partkey || ' }}' FROM {_RUNS}
UNION ALL SELECT p_partkey, 'message', 'entry=0;op_id=1.' || p_partkey || ';row=0;size=' || p_size || ';status=' || p_type || ';type=WRITE' FROM {_RUNS}
UNION ALL SELECT p_partkey, 'transaction', 'block=0;line=0;text=txn ' || p_partkey FROM {_RUNS} UNION ALL SELECT p_partkey, 'transaction', 'block=0;line=2;text=' || p_brand FROM {_RUNS}
UNION ALL SELECT p_partkey, 'file', 'base_size=' || p_size || ';name=' || p_partkey || '.sst;store=' || store || ';total_size=10' FROM part, {_STORES} WHERE p_partkey % 3 <> 0
UNION ALL SELECT p_partkey, 'store', 'item=options;name=;store=' || store || ';text=' || w.name || ' ' || p_partkey FROM part, {_STORES} WHERE p_partkey % 3 <> 0
UNION ALL SELECT p_partkey, 'store', 'item=file;name=' || p_partkey || '.sst;store=' || store || ';text=' || w.name || ' of ' || p_type FROM part, {_STORES} WHERE p_partkey % 3 <> 0"""


def _tablet_report(s, d, uuid=None):
    raft = parts(s, d, I.raft_body())
    pages = {"consensus": raft, "transactions": transaction_pages(s, d), "stores": store_pages(s, d)}
    return R.tablet_report(tablet_rows(s, d), pages, uuid).select("tablet_id", "part", named(F.col("detail")).alias("detail"))


query("tablet_report", f"SELECT CAST(p_partkey AS VARCHAR) AS tablet_id, part, detail FROM ({_TABLET_REPORT})")(_tablet_report)
query("tablet_report_uuid", f"SELECT CAST(p_partkey AS VARCHAR) AS tablet_id, part, detail FROM ({_TABLET_REPORT}) WHERE p_partkey = 7")(lambda s, d: _tablet_report(s, d, "7"))

_TABLE_REPORT = """SELECT p_partkey, 'general' AS part, 'keyspace=' || p_brand || ';object_type=user;state=Running;table_name=' || p_type AS detail FROM part
UNION ALL SELECT p_partkey, 'property', 'key=Version:;value=1' FROM part UNION ALL SELECT p_partkey, 'column', 'column=k;column_id=0;row=0;type=int' FROM part
UNION ALL SELECT p_partkey, 'tablet', 'hidden=false;message=;partition=hash;raft_config=LEADER: a;row=0;split_depth=' || p_size || ';state=Running;tablet_id=x' FROM part
UNION ALL SELECT p_partkey, 'task', 'description=' || p_type || ';duration=2 ms;row=0;start_time=1 s ago;state=kComplete;task_name=Alter' FROM part"""


def _table_report(s, d, uuid=None):
    """Two hosts list the tables; the leader's rows count."""
    rows = A.table(s, d, "part").select(F.lit(0).alias("snapshot_id"), F.explode(F.array(F.lit("h:7000"), F.lit("h:7001"))).alias("hostname_port"), I.text("p_partkey").alias("table_id"), F.col("p_brand").alias("keyspace"), F.col("p_type").alias("table_name"), F.lit("Running").alias("state"), F.lit("user").alias("object_type"))
    rows = rows.withColumn("keyspace", F.when(F.col("hostname_port") == "h:7001", "old").otherwise(F.col("keyspace")))
    leaders = A.table(s, d, "region").where("r_regionkey < 2").select(F.lit(0).alias("snapshot_id"), F.concat(F.lit("h:700"), F.col("r_regionkey").cast("string")).alias("hostname_port"), F.when(F.col("r_regionkey") == 0, "OK").otherwise("").alias("status"))
    return R.table_report(rows, parts(s, d, I.table_body()), uuid, leaders).select("table_id", "part", named(F.col("detail")).alias("detail"))


query("table_page_report", f"SELECT CAST(p_partkey AS VARCHAR) AS table_id, part, detail FROM ({_TABLE_REPORT})")(_table_report)
query("table_page_report_uuid", f"SELECT CAST(p_partkey AS VARCHAR) AS table_id, part, detail FROM ({_TABLE_REPORT}) WHERE p_partkey = 7")(lambda s, d: _table_report(s, d, "7"))


@query("gflags_report", f"SELECT * FROM (SELECT {I.host_sql('p_partkey')}, 'flag_' || p_partkey AS name, p_type AS value FROM part) WHERE regexp_matches(hostname_port, 'h[12]') AND regexp_matches(name, '5')")
def gflags_report(s, d):
    line = F.struct(F.concat(F.lit("--flag_"), I.text("p_partkey"), F.lit("="), "p_type").alias("line"))
    return R.gflags_report(X.gflags(I.bodies(A.table(s, d, "part"), I.captured("p_partkey"), line, I.lines)), "h[12]", "5").select("hostname_port", "name", "value")


@query("versions_report", "SELECT c_name AS hostname_port, '2.' || c_nationkey AS version_number, CAST(c_custkey AS VARCHAR) AS build_number, 'RELEASE' AS build_type, 'on ' || c_mktsegment AS build_timestamp, 'g' || c_custkey AS git_hash FROM customer WHERE regexp_matches(c_name, '3')")
def versions_report(s, d):
    c = A.table(s, d, "customer")
    body = F.to_json(F.struct(F.concat(F.lit("g"), I.text("c_custkey")).alias("git_hash"), F.concat(F.lit("2."), I.text("c_nationkey")).alias("version_number"), I.text("c_custkey").alias("build_number"), F.lit("RELEASE").alias("build_type"), F.concat(F.lit("on "), "c_mktsegment").alias("build_timestamp")))
    return R.versions_report(J.versions(I.single(c, F.col("c_name"), body)), "3").drop("snapshot_id", "captured_at")


# ---- rows one by one


def flag_payloads(s, d):
    """Parts as flags: some have text for a number, some no name, some come twice; customers' bodies are no JSON or have no flags."""
    k = F.col("p_partkey")
    value = F.when(k % 5 == 1, F.concat(F.lit('"'), "p_type", F.lit('"'))).otherwise(I.text("p_size"))
    one = F.concat(F.lit('{"name":'), F.when(k % 5 == 2, F.lit("null")).otherwise(F.concat(F.lit('"'), I.text("p_partkey"), F.lit('"'))), F.lit(',"n":'), value, F.lit("}"))
    row = F.struct(k.alias("k"), F.when(k % 5 == 3, F.concat(one, F.lit(","), one)).otherwise(one).alias("t"))
    good = I.bodies(A.table(s, d, "part"), I.captured("p_partkey"), row, lambda r: F.concat(F.lit('{"flags":['), F.array_join(F.transform(r, lambda x: x["t"]), ","), F.lit("]}")))
    broken = I.single(A.table(s, d, "customer"), F.col("c_name"), F.when(F.col("c_custkey") % 2 == 0, "<html>").otherwise('{"other":1}'))
    return good.unionByName(broken)


def _flags(s, d):
    return Q.stored_rows(flag_payloads(s, d), "$.flags", "name string, n bigint", keys=("name",), needs=("name",))


@query("good_rows", f"SELECT {I.host_sql('p_partkey')}, CAST(p_partkey AS VARCHAR) AS name, CAST(p_size AS BIGINT) AS n FROM part WHERE p_partkey % 5 NOT IN (1, 2)")
def good_rows(s, d):
    return _flags(s, d)[0].select("hostname_port", "name", "n")


@query("bad_rows", f"""SELECT {I.host_sql('p_partkey')}, CASE p_partkey % 5 WHEN 1 THEN 'bad n' WHEN 2 THEN 'no name' ELSE 'duplicate' END AS reason, CASE p_partkey % 5 WHEN 1 THEN '{{"n":"' || p_type || '","name":"' || p_partkey || '"}}'
  WHEN 2 THEN '{{"n":' || p_size || ',"name":null}}' ELSE '{{"n":' || p_size || ',"name":"' || p_partkey || '"}}' END AS element FROM part WHERE p_partkey % 5 IN (1, 2, 3)
UNION ALL SELECT c_name, CASE WHEN c_custkey % 2 = 0 THEN 'no json' ELSE 'no array' END, CASE WHEN c_custkey % 2 = 0 THEN '<html>' ELSE '{{"other":1}}' END FROM customer""")
def bad_rows(s, d):
    return _flags(s, d)[1].select("hostname_port", "reason", "element")


# ---- configurations


def configs(s, d) -> DataFrame:
    """A configuration per supplier and snapshot: nation and balance are in it, at the end with a zone more."""
    rows = A.table(s, d, "supplier").select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("n"))
    zone = lambda c: F.struct(F.concat(F.lit("z"), c.cast("string")).alias("zone"), F.array(F.lit(1), F.lit(2)).alias("ports"))
    zones = F.when(F.col("n") == 0, F.array(zone(F.col("s_nationkey")))).otherwise(F.array(zone(F.col("s_nationkey") % 20), zone(F.col("s_suppkey") % 3)))
    body = F.to_json(F.struct((F.col("n") + 1).alias("version"), F.concat(F.lit("u"), I.text("s_suppkey")).alias("cluster_uuid"), F.struct(zones.alias("live"), F.struct((F.col("s_suppkey") % 2 == 0).alias("on")).alias("deep")).alias("replication")))
    return J.cluster_config(rows.select(F.col("n").alias("snapshot_id"), F.col("s_name").alias("hostname_port"), I.at().alias("captured_at"), body.alias("body")))


_PATHS = """cp AS (SELECT n AS snapshot_id, s_name AS hostname_port, path, value FROM supplier, (VALUES (0), (1)) v(n), LATERAL (VALUES
 ('$.version', CAST(n + 1 AS VARCHAR), true), ('$.cluster_uuid', 'u' || s_suppkey, true), ('$.replication.deep.on', CASE WHEN s_suppkey % 2 = 0 THEN 'true' ELSE 'false' END, true),
 ('$.replication.live[0].zone', 'z' || CASE WHEN n = 0 THEN s_nationkey ELSE s_nationkey % 20 END, true), ('$.replication.live[0].ports[0]', '1', true), ('$.replication.live[0].ports[1]', '2', true),
 ('$.replication.live[1].zone', 'z' || s_suppkey % 3, n = 1), ('$.replication.live[1].ports[0]', '1', n = 1), ('$.replication.live[1].ports[1]', '2', n = 1)) p(path, value, here) WHERE here)"""


@query("config_paths", f"WITH {_PATHS} SELECT * FROM cp")
def config_paths(s, d):
    return J.config_paths(configs(s, d)).select("snapshot_id", "hostname_port", "path", "value")


@query("config_diff", f"WITH {_PATHS} SELECT CASE WHEN b.path IS NULL THEN '+' ELSE '=' END AS change, hostname_port, path, 'value:' || coalesce(b.value, '') || '->' || e.value AS changes FROM (SELECT * FROM cp WHERE snapshot_id = 0) b FULL JOIN (SELECT * FROM cp WHERE snapshot_id = 1) e USING (hostname_port, path) WHERE b.value IS DISTINCT FROM e.value")
def config_diff(s, d):
    return G.change_diff(J.config_paths(configs(s, d)), ["hostname_port", "path"], ["value"], 0, 1).withColumn("changes", G.spelled(F.col("changes")))


# ---- tables of pages in SQL


@query("html_table_sql", f"SELECT {I.host_sql('o_orderkey')}, CAST(o_orderkey AS VARCHAR) AS path, o_orderpriority AS used_space, o_orderstatus AS total_space FROM orders")
def html_table_sql(s, d):
    """As html_table_ingest, by the table function."""
    T.register(s)
    cells = {"a": I.text("o_orderkey"), "b": F.col("o_orderpriority"), "c": F.col("o_orderstatus")}
    I.page_bodies(s, d, "orders", "o_orderkey", cells, "drives").createOrReplaceTempView("demo_pages")
    return s.sql("SELECT p.hostname_port, t.path, t.used_space, t.total_space FROM demo_pages p, LATERAL html_table(p.body, 'Path|Used Space|Total Space') t")
