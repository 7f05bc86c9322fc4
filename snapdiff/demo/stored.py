"""Stored snapshots, landing files, and the full reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import change as G
from ..plans import reports as R
from ..sources import payloads as L
from ..sources import store as S
from . import adapters as A
from . import changes as C
from .numeric import EV, summarised
from .registry import ORACLE_SQL, query


def _store(s, d) -> str:
    path = S.scratch_dir(s)
    m = A.counters(s, d)
    last = A.at_cuts(A.table(s, d, "events"), "ts", A.CUTS).groupBy("snapshot_id").agg(F.max("ts").cast("string").alias("ts"), F.count("*").alias("n"))
    for r in last.orderBy("snapshot_id").collect():  # a row per snapshot
        S.write_snapshot(s, {"metrics": m.where(F.col("snapshot_id") == r.snapshot_id)}, path, f"{r.n} events", r.ts)
    return path


_LIST = f"(SELECT snapshot_id, max(ts) AS ts, count(*) || ' events' AS comment FROM events JOIN (VALUES {', '.join(f"({i}, TIMESTAMP '{c}')" for i, c in enumerate(A.CUTS))}) v(snapshot_id, cut) ON ts < cut GROUP BY 1)"


@query("snapshot_list", f"SELECT *, CAST(max(snapshot_id) OVER () + 1 AS INTEGER) AS next_id FROM {_LIST}")
def snapshot_list(s, d):
    snaps = S.snapshot_list(s, _store(s, d))
    return S.resolve_pair(snaps, 0, 1).withColumn("next_id", F.lit(S.next_snapshot_id(snaps)))


@query("snapshot_roundtrip", f"WITH {EV} SELECT snapshot_id, hostname_port, metric_type, metric_id, name, n AS value FROM ev WHERE snapshot_id = 1")
def snapshot_roundtrip(s, d):
    return S.read_snapshot(s, _store(s, d), "metrics", [1]).where("kind = 'value'").select("snapshot_id", "hostname_port", "metric_type", "metric_id", "name", "value")


@query("payload_scan", "SELECT CAST(doc_id % 2 AS INTEGER) AS snapshot_id, 'd' || CAST(doc_id % 3 AS VARCHAR) AS dataset, CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS n_lines, CAST(sum(length(replace(text, chr(10), ''))) AS BIGINT) AS n_chars FROM documents GROUP BY ALL")
def payload_scan(s, d):
    path = S.scratch_dir(s)
    docs = A.table(s, d, "documents").select((F.col("doc_id") % 2).cast("int").alias("snapshot_id"), F.concat(F.lit("d"), (F.col("doc_id") % 3).cast("string")).alias("dataset"), "text")
    docs.write.partitionBy("snapshot_id", "dataset").text(path)
    p = L.read_payloads(s, path)
    rows = p.select("snapshot_id", "dataset", F.explode(F.split(F.regexp_replace("body", r"\n\z", ""), "\n")).alias("line"))
    return rows.groupBy("snapshot_id", "dataset").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


def tables(s, d) -> dict:
    last, h, m = A.last_events(s, d), A.hierarchy(s, d), A.counters(s, d)
    versions = last.select("snapshot_id", "hostname_port", F.when(F.col("status") == "view", "").otherwise(F.col("status")).alias("git_hash"), F.col("zone").alias("build_number"))
    own = {"snapshots": A.snapshots(s), "metrics": m, "catalog": A.catalog(s), "statements": A.statements(s, d, m), "samples": summarised(s, d, m), **{k: h[k] for k in R.HIERARCHY}}
    return own | {"masters": C.masters(s, d, last), "tablet_servers": last.withColumnRenamed("hostname_port", "server"), "vars": C.vars_(s, d, last), "versions": versions, "health": A.health(s, d, h)}


OWN = {"values": "value_diff", "countsums": "countsum_diff", "countsumrows": "countsumrows_diff", "statements": "statements_diff", "samples": "sample_counter_diff", "keyspaces": "keyspace_diff", "tables": "table_diff", "tablets": "tablet_diff", "replicas": "replica_diff", "masters": "masters_diff", "tablet_servers": "tserver_restarts", "vars": "vars_diff", "versions": "versions_diff", "health": "health_diff", "gauges": "gauge_diff", "sample_gauges": "sample_gauge_diff"}
#: What a section's detail holds; a star marks doubles, in SQL as in Spark spelled with six places.
DETAIL = {
    "values": "delta namespace rate* table_name unit", "gauges": "delta unit value", "countsums": "avg count rate* reset sum", "countsumrows": "avg_ms* avg_rows count rows total_ms*", "statements": "avg_rows avg_time* calls rows total_time", "samples": "delta* rate*", "sample_gauges": "delta* value*",
    "keyspaces": "colocated name tables_after tables_before", "tables": "colocated keyspace_name state_after state_before table_name_after table_name_before", "tablets": "keyspace_name leader_addr_after leader_addr_before state_after state_before table_name",
    "replicas": "addr_after addr_before keyspace_name table_name type_after type_before", "tablet_servers": "restart status_after status_before uptime_seconds", "vars": "after before type_after type_before",
}
_SERIES = "concat_ws('|', hostname_port, metric_type, metric_id, name)"
_SAMPLE = "concat_ws('|', hostname_port, name, labels)"
_KEY = {"values": _SERIES, "gauges": _SERIES, "countsums": _SERIES, "countsumrows": _SERIES, "statements": "hostname_port || '|' || replace(query, '\\''', '''')", "samples": _SAMPLE, "sample_gauges": _SAMPLE, "keyspaces": "keyspace_id", "tables": "table_id", "tablets": "tablet_id", "replicas": "tablet_id || '|' || server_uuid", "masters": "permanent_uuid", "tablet_servers": "server", "vars": "hostname_port || '|' || name", "versions": "hostname_port", "health": "item || '|' || value"}
_PLAIN = ("values", "gauges", "countsums", "countsumrows", "statements", "samples", "sample_gauges", "vars")


def _detail_sql(section: str, details: bool) -> str:
    if section in ("masters", "versions"):
        return "changes"
    if section == "health":
        return "'x='"
    rolled = "metric_type = 'table'" if not details else "false"
    made = {"namespace": f"CASE WHEN {rolled} THEN '-' ELSE 'ns' END", "uptime_seconds": "nullif(uptime_seconds, -1)"}
    if section == "values":
        made["table_name"] = f"CASE WHEN {rolled} THEN '-' ELSE 't' || metric_id END"
    each = [(f.rstrip("*"), f"CAST({f[:-1]} AS DECIMAL(38, 6))" if f.endswith("*") else made.get(f, f'"{f}"')) for f in DETAIL[section].split()]
    return f"concat_ws(';', {', '.join(f"'{n}=' || CAST({c} AS VARCHAR)" for n, c in each)})"


def _sections(names: tuple[str, ...], change=lambda sql: sql, details: bool = False, own: dict[str, str] = {}) -> str:  # noqa: B006
    """The sections' own queries as one report; ``change`` is applied to each query, ``own`` names others."""
    return " UNION ALL ".join(f"SELECT '{k}' AS section, {"'='" if k in _PLAIN else 'change'} AS change, {_KEY[k]} AS key, {_detail_sql(k, details)} AS detail FROM ({change(ORACLE_SQL[own.get(k, OWN[k])])})" for k in names)


def shown(report):
    """(section, change, key, detail): the JSON of details as ``name=value`` in the order of names, doubles with six places."""
    number = F.when(F.col("detail").isNotNull(), F.from_json("detail", "map<string,string>"))
    spelled = lambda v: F.when(v.rlike("[.E]"), F.coalesce(v.try_cast("double").try_cast("decimal(38,6)").cast("string"), v)).otherwise(v)
    each = F.transform(F.array_sort(F.map_entries(number)), lambda e: F.concat(e["key"], F.lit("="), spelled(e["value"])))
    changes = G.spelled(F.from_json("detail", "changes array<struct<field string, before string, after string>>")["changes"])
    return report.select("section", "change", "key", F.when(F.col("section").isin("masters", "versions"), changes).otherwise(F.array_join(each, ";")).alias("detail"))


@query("full_report", _sections(R.SECTIONS))
def full_report(s, d):
    return shown(R.diff_report(tables(s, d), 0, 1))


@query("nonmetrics_report", _sections(R.NONMETRICS))
def nonmetrics_report(s, d):
    return shown(R.diff_report(tables(s, d), 0, 1, R.NONMETRICS))


@query("json_snapshot", "SELECT s_name AS server, s_nationkey AS value, 7 AS snapshot_id, 'kept' AS comment FROM supplier")
def json_snapshot(s, d):
    """A dataset kept as JSON arrays of at most ``A.BLOCK`` rows, a folder for each snapshot, and the CSV list beside it."""
    path = S.scratch_dir(s)
    block = F.floor(F.col("s_suppkey") / A.BLOCK).alias("part")
    rows = A.table(s, d, "supplier").groupBy(block).agg(F.to_json(F.collect_list(F.struct(F.col("s_name").alias("server"), F.col("s_nationkey").alias("value")))).alias("value"))
    rows.withColumn("snapshot_id", F.lit(7)).write.partitionBy("snapshot_id", "part").text(f"{path}/json")  # a file for each array
    A.table(s, d, "region").limit(1).select(F.lit(7).alias("snapshot_id"), F.lit("2024-01-10 00:00:00").alias("ts"), F.lit("kept").alias("comment")).write.csv(f"{path}/index", header=True)
    files = S.read_json_snapshot(s, f"{path}/json", "server string, value long, snapshot_id int")
    return files.join(S.read_index(s, f"{path}/index").select("snapshot_id", "comment"), "snapshot_id").select("server", "value", "snapshot_id", "comment")


def _matching(*where: str):
    """The queries on the matching rows alone."""
    keep = " AND ".join(f"regexp_matches({w})" for w in where)
    return lambda sql: sql.replace("FROM ev GROUP", f"FROM (SELECT * FROM ev WHERE {keep}) ev GROUP")


def _some(s, d, *names):
    return {k: v for k, v in tables(s, d).items() if k in names}


_METRICS = ("values", "countsums", "gauges")


@query("filtered_report", _sections(_METRICS, _matching("hostname_port, '[12]'", "name, 'i'")))
def filtered_report(s, d):
    return shown(R.diff_report(_some(s, d, "snapshots", "metrics", "catalog"), 0, 1, ("values", "countsums"), gauges=True, host="[12]", stat="i"))


_STATEMENTS = rf"SELECT * REPLACE (replace(left(replace(query, '\''', ''''), 12), '''', '\\''') AS query) FROM ({ORACLE_SQL['statements_diff'].replace('FROM ev GROUP', "FROM (SELECT * FROM ev WHERE regexp_matches(hostname_port, '[12]')) ev GROUP")})"
_VERSIONS = f"SELECT * FROM ({ORACLE_SQL['versions_diff']}) WHERE regexp_matches(hostname_port, '[12]')"


@query("host_report", _sections(("statements",), lambda _: _STATEMENTS) + " UNION ALL " + _sections(("versions",), lambda _: _VERSIONS))
def host_report(s, d):
    """Statements, their text cut, and versions of some hosts; masters are not asked for a host."""
    return shown(R.diff_report(_some(s, d, "snapshots", "statements", "versions"), 0, 1, ("statements", "versions"), host="[12]", statement_length=12))


@query("detail_report", _sections(("values", "samples"), details=True, own={"values": "value_diff_detail", "samples": "sample_detail_diff"}))
def detail_report(s, d):
    """Every object and every CPU on its own row."""
    return shown(R.diff_report(_some(s, d, "snapshots", "metrics", "catalog", "samples"), 0, 1, ("values", "samples"), details=True))


_NAMED = {"tables": "keyspace_name || '.' || coalesce(table_name_after, table_name_before)", "tablets": "keyspace_name || '.' || table_name", "replicas": "keyspace_name || '.' || table_name"}


@query("table_report_diff", " UNION ALL ".join([_sections(("values",), _matching("'ns.t' || metric_id, 't1|#2.*PROMO'")), *[_sections((k,), lambda sql, k=k: f"SELECT * FROM ({sql}) WHERE regexp_matches({_NAMED[k]}, 't1|#2.*PROMO')") for k in _NAMED]]))
def table_report_diff(s, d):
    """Metrics of some tables, and the tables, tablets and replicas of that name."""
    return shown(R.diff_report(_some(s, d, "snapshots", "metrics", "catalog", *R.HIERARCHY), 0, 1, ("values", *_NAMED), table="t1|#2.*PROMO"))


def _led_servers(s, d):
    """Tablet servers as two masters see them: h1 as they are, h0 with a status and an uptime of its own."""
    own = A.last_events(s, d).withColumnRenamed("hostname_port", "server").withColumn("hostname_port", F.lit("h1"))
    return own.unionByName(own.withColumns({"hostname_port": F.lit("h0"), "status": F.lit("odd"), "uptime_seconds": F.lit(1000) - F.col("snapshot_id") * 900}))


@query("led_report", f"WITH {C.VIEWS} SELECT 'masters' AS section, change, permanent_uuid AS key FROM ({C.LED}) UNION ALL SELECT 'tablet_servers', change, server FROM ({ORACLE_SQL['tserver_restarts']}) UNION ALL SELECT 'health', change, item || '|' || value FROM ({ORACLE_SQL['health_diff']})")
def led_report(s, d):
    """Masters, tablet servers and health from several views of each snapshot: the leaders' count."""
    h = A.health(s, d).withColumn("hostname_port", F.lit("h1"))
    odd = h.select("snapshot_id", F.lit("h0").alias("hostname_port"), F.lit(None).cast("array<string>").alias("dead_nodes"), F.array(F.lit("odd")).alias("under_replicated_tablets"))
    t = {"masters": C.views(s, d), "tablet_servers": _led_servers(s, d), "health": h.unionByName(odd), "leaders": C.view_leaders(s, d), "snapshots": A.snapshots(s)}
    return R.diff_report(t, 0, 1).select("section", "change", "key")


@query("tserver_diff_led", ORACLE_SQL["tserver_restarts"])
def tserver_diff_led(s, d):
    return G.tserver_diff(_led_servers(s, d), 0, 1, C.view_leaders(s, d)).withColumn("uptime_seconds", F.coalesce("uptime_seconds", F.lit(-1)))
