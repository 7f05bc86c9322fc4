"""Changes of servers, settings, versions, health and the hierarchy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.filters import apply_visibility
from ..operators import change as G
from ..operators import entities as E
from . import adapters as A
from .registry import query

_CUT = ", ".join(f"({i}, TIMESTAMP '{c}')" for i, c in enumerate(A.CUTS))
LAST = f"""cuts(snapshot_id, cut) AS (VALUES {_CUT}),
le AS (SELECT snapshot_id, cut, 'u' || CAST(user_id AS VARCHAR) AS hostname_port, arg_max(event_type, (ts, event_id)) AS status, arg_max(json_extract_string(props, '$.k'), (ts, event_id)) AS value,
  CAST(arg_max(event_id, (ts, event_id)) % 3 AS VARCHAR) AS zone, CAST(epoch(cut) - epoch(coalesce(max(ts) FILTER (event_type = 'error'), TIMESTAMP '2024-01-01')) AS BIGINT) AS uptime_raw,
  CAST(floor(epoch(cut)) - floor(epoch(coalesce(max(ts) FILTER (event_type = 'error'), TIMESTAMP '2024-01-01'))) AS BIGINT) AS uptime_seconds
  FROM events JOIN cuts ON ts < cut GROUP BY snapshot_id, cut, user_id)"""
B, EE = "(SELECT * FROM {0} WHERE snapshot_id = 0) b", "(SELECT * FROM {0} WHERE snapshot_id = 1) e"


def full(source: str, keys: str) -> str:
    return f"{B.format(source)} FULL JOIN {EE.format(source)} USING ({keys})"


def kind(same: str, probe: str) -> str:
    return f"CASE WHEN b.{probe} IS NULL THEN '+' WHEN e.{probe} IS NULL THEN '-' WHEN NOT ({same}) THEN '=' END"


def spelled_sql(*fields: str) -> str:
    """Differing fields as text, in order."""
    each = ", ".join(f"CASE WHEN CAST(b.{c} AS VARCHAR) IS DISTINCT FROM CAST(e.{c} AS VARCHAR) THEN '{f}:' || coalesce(CAST(b.{c} AS VARCHAR), '') || '->' || coalesce(CAST(e.{c} AS VARCHAR), '') END" for f, c in ((x.split("=") * 2)[:2] for x in fields))
    return f"concat_ws(';', {each})"


def masters(s, d, le=None):
    le = le or A.last_events(s, d)
    return le.select("snapshot_id", F.col("hostname_port").alias("permanent_uuid"), F.when(F.col("status") == "error", 0).otherwise(F.length("status")).cast("long").alias("instance_seqno"), F.lit(1).cast("long").alias("start_time_us"), F.lit("c1").alias("cloud"), F.lit("r1").alias("region"), "zone", F.col("status").alias("role"), F.concat("hostname_port", F.lit(":7100,")).alias("rpc_addresses"), F.lit("").alias("http_addresses"))


_M = LAST + ", m AS (SELECT snapshot_id, hostname_port AS permanent_uuid, status AS role, zone, length(status) AS instance_seqno, hostname_port || ':7100,' AS rpc_addresses FROM le WHERE status <> 'error')"
_SAME_FIELDS = {"cloud": "c1", "region": "r1", "start_time_us": "1", "http_addresses": ""}  # differ only where a side is absent


def _masters_sql() -> str:
    both = f"(SELECT *, {', '.join(f"'{v}' AS {k}" for k, v in _SAME_FIELDS.items())} FROM m)"
    fields = spelled_sql("role", "cloud", "region", "zone", "instance_seqno", "start_time_us", "rpc_addresses", "http_addresses")
    return f"WITH {_M}, x AS (SELECT {kind('b.role = e.role AND b.zone = e.zone', 'role')} AS change, permanent_uuid, {fields} AS changes FROM {full(both, 'permanent_uuid')}) SELECT * FROM x WHERE change IS NOT NULL"


@query("masters_diff", _masters_sql())
def masters_diff(s, d):
    return G.masters_diff(masters(s, d), 0, 1).withColumn("changes", G.spelled(F.col("changes")))


@query("versions_diff", f"WITH {LAST}, v AS (SELECT snapshot_id, hostname_port, status AS git_hash, zone AS build FROM le WHERE status <> 'view'), x AS (SELECT {kind('b.git_hash = e.git_hash AND b.build = e.build', 'git_hash')} AS change, hostname_port, {spelled_sql('git_hash', 'build_number=build')} AS changes FROM {full('v', 'hostname_port')}) SELECT * FROM x WHERE change IS NOT NULL")
def versions_diff(s, d):
    v = A.last_events(s, d).select("snapshot_id", "hostname_port", F.when(F.col("status") == "view", "").otherwise(F.col("status")).alias("git_hash"), F.col("zone").alias("build_number"))
    return G.versions_diff(v, 0, 1).withColumn("changes", G.spelled(F.col("changes")))


def vars_(s, d, le=None):
    return (le or A.last_events(s, d)).select("snapshot_id", "hostname_port", F.col("zone").alias("name"), F.when(F.col("status") == "signup", "").otherwise(F.col("value")).alias("value"), F.when(F.col("status") == "view", "Default").otherwise("Custom").alias("var_type"))


_V = LAST + ", v AS (SELECT snapshot_id, hostname_port, zone AS name, CASE WHEN status = 'signup' THEN '' ELSE value END AS value, CASE WHEN status = 'view' THEN 'Default' ELSE 'Custom' END AS var_type FROM le)"


@query("vars_diff", f"WITH {_V} SELECT hostname_port, name, b.value AS before, e.value AS after, b.var_type AS type_before, e.var_type AS type_after FROM {B.format('v')} JOIN {EE.format('v')} USING (hostname_port, name) WHERE b.value <> '' AND e.value <> '' AND (b.value <> e.value OR b.var_type <> e.var_type)")
def vars_diff(s, d):
    return G.vars_diff(vars_(s, d), 0, 1)


@query("vars_report", f"WITH {_V} SELECT * FROM v WHERE var_type <> 'Default'")
def vars_report(s, d):
    return apply_visibility(vars_(s, d))


@query("tserver_restarts", f"WITH {LAST}, x AS (SELECT {kind('b.status = e.status AND e.uptime_seconds >= b.uptime_seconds', 'status')} AS change, hostname_port AS server, b.status AS status_before, e.status AS status_after, coalesce(e.uptime_seconds < b.uptime_seconds, false) AS restart, coalesce(e.uptime_seconds, -1) AS uptime_seconds FROM {full('le', 'hostname_port')}) SELECT * FROM x WHERE change IS NOT NULL")
def tserver_restarts(s, d):
    rows = A.last_events(s, d).withColumnRenamed("hostname_port", "server")
    return G.tserver_diff(rows, 0, 1).withColumn("uptime_seconds", F.coalesce("uptime_seconds", F.lit(-1)))


@query("generic_change", f"WITH {LAST}, x AS (SELECT {kind('b.status = e.status AND b.value IS NOT DISTINCT FROM e.value', 'status')} AS change, hostname_port, {spelled_sql('status', 'value')} AS changes FROM {full('le', 'hostname_port')}) SELECT * FROM x WHERE change IS NOT NULL")
def generic_change(s, d):
    return G.change_diff(A.last_events(s, d), ["hostname_port"], ["status", "value"], 0, 1).withColumn("changes", G.spelled(F.col("changes")))


def leaders(s, d):
    return A.last_events(s, d).select("snapshot_id", "hostname_port", F.when(F.col("status") == "purchase", "OK").otherwise("").alias("status"))


_L = LAST + ", lead AS (SELECT snapshot_id, min(hostname_port) AS hostname_port FROM le WHERE status = 'purchase' GROUP BY 1)"


@query("leader_resolve", f"WITH {_L} SELECT * FROM lead")
def leader_resolve(s, d):
    return E.leader_rows(leaders(s, d).select("snapshot_id", "hostname_port"), leaders(s, d))


@query("leader_rows", f"WITH {_L} SELECT snapshot_id, hostname_port, status, value, zone FROM le JOIN lead USING (snapshot_id, hostname_port)")
def leader_rows(s, d):
    return E.leader_rows(A.last_events(s, d), leaders(s, d)).select("snapshot_id", "hostname_port", "status", "value", "zone")


@query("masters_report", f"WITH {_L} SELECT snapshot_id, hostname_port AS permanent_uuid, status AS role, zone FROM le JOIN lead USING (snapshot_id, hostname_port)")
def masters_report(s, d):
    m = masters(s, d).withColumn("hostname_port", F.col("permanent_uuid"))
    return E.leader_rows(m, leaders(s, d)).select("snapshot_id", "permanent_uuid", "role", "zone")


_LINE = "max({'d': l_shipdate, 'o': l_orderkey, 'n': l_linenumber, 's': l_suppkey, 'f': l_returnflag, 'u': l_linestatus})"
ENT = f"""dts(snapshot_id, t) AS (VALUES {', '.join(f"({i}, TIMESTAMP '{c}')" for i, c in enumerate(A.DATES))}),
pr AS (SELECT snapshot_id, l_partkey, l_suppkey, {_LINE} AS z FROM lineitem JOIN dts ON l_shipdate < t GROUP BY ALL),
pt AS (SELECT snapshot_id, l_partkey, max(z) AS z FROM pr GROUP BY ALL),
pn AS (SELECT p_partkey, p_brand || '.' || p_size AS keyspace_id, p_brand || '.' || p_size || '.' || p_type AS table_id, p_type AS table_name FROM part),
tl AS (SELECT snapshot_id, CAST(l_partkey AS VARCHAR) AS tablet_id, table_id, table_name, keyspace_id, CASE WHEN z.u = 'O' THEN 'RUNNING' ELSE 'CREATING' END AS state, CAST(z.s AS VARCHAR) AS leader FROM pt JOIN pn ON l_partkey = p_partkey WHERE z.f <> 'R'),
tb AS (SELECT snapshot_id, table_id, keyspace_id, table_name, max(state) AS state FROM tl GROUP BY ALL),
ks AS (SELECT snapshot_id, keyspace_id FROM (SELECT DISTINCT keyspace_id FROM pn), dts),
rp AS (SELECT snapshot_id, CAST(l_partkey AS VARCHAR) AS tablet_id, CAST(l_suppkey AS VARCHAR) AS server_uuid, CASE WHEN z.u = 'F' THEN 'VOTER' ELSE 'OBSERVER' END AS type, 's' || l_suppkey || ':9100' AS addr
  FROM pr WHERE z.f <> 'R' AND EXISTS (SELECT 1 FROM tl WHERE tl.snapshot_id = pr.snapshot_id AND tl.tablet_id = CAST(l_partkey AS VARCHAR))),
tla AS (SELECT tl.*, coalesce(addr, '') AS la FROM tl LEFT JOIN rp ON rp.snapshot_id = tl.snapshot_id AND rp.tablet_id = tl.tablet_id AND rp.server_uuid = tl.leader)"""
HEALTH = f"""dead AS (SELECT snapshot_id, 's' || l_suppkey || ':9100' AS addr FROM (SELECT snapshot_id, l_suppkey, {_LINE} AS z FROM lineitem JOIN dts ON l_shipdate < t GROUP BY ALL) WHERE z.f = 'R'),
few AS (SELECT tl.snapshot_id, tl.tablet_id FROM tl LEFT JOIN rp ON rp.snapshot_id = tl.snapshot_id AND rp.tablet_id = tl.tablet_id GROUP BY ALL HAVING count(server_uuid) < 2)"""


@query("health_diff", f"""WITH {ENT}, {HEALTH}, u AS (SELECT snapshot_id, 'dead_nodes' AS item, addr AS value FROM dead UNION ALL SELECT snapshot_id, 'under_replicated_tablets', tablet_id FROM few)
SELECT '+' AS change, item, value FROM (SELECT item, value FROM u WHERE snapshot_id = 1 EXCEPT SELECT item, value FROM u WHERE snapshot_id = 0)
UNION ALL SELECT '-', item, value FROM (SELECT item, value FROM u WHERE snapshot_id = 0 EXCEPT SELECT item, value FROM u WHERE snapshot_id = 1)""")
def health_diff(s, d):
    return G.health_diff(A.health(s, d), 0, 1)


@query("keyspace_diff", f"WITH {ENT}, n AS (SELECT snapshot_id, keyspace_id, count(*) AS n FROM tb GROUP BY ALL), x AS (SELECT {kind('true', 'n')} AS change, keyspace_id, keyspace_id AS name, false AS colocated, coalesce(b.n, 0) AS tables_before, coalesce(e.n, 0) AS tables_after FROM {full('n', 'keyspace_id')}) SELECT * FROM x WHERE change IS NOT NULL")
def keyspace_diff(s, d):
    h = A.hierarchy(s, d)
    return E.keyspace_diff(h["keyspaces"], h["tables"], 0, 1)


@query("table_diff", f"WITH {ENT}, x AS (SELECT {kind('b.state = e.state', 'table_name')} AS change, table_id, coalesce(e.keyspace_id, b.keyspace_id) AS keyspace_name, b.table_name AS table_name_before, e.table_name AS table_name_after, b.state AS state_before, e.state AS state_after, false AS colocated FROM {full('tb', 'table_id')}) SELECT * FROM x WHERE change IS NOT NULL")
def table_diff(s, d):
    h = A.hierarchy(s, d)
    return E.table_diff(h["tables"], h["keyspaces"], h["tablets"], 0, 1)


_TABLETS = f"""{ENT}, x AS (SELECT {kind('b.state = e.state AND b.la = e.la', 'state')} AS change, tablet_id, coalesce(e.table_id, b.table_id) AS table_id, b.state AS state_before, e.state AS state_after, b.la AS leader_addr_before, e.la AS leader_addr_after FROM {full('tla', 'tablet_id')}),
nm AS (SELECT DISTINCT table_id, table_name, keyspace_id AS keyspace_name FROM pn), y AS (SELECT change, tablet_id, keyspace_name, table_name, state_before, state_after, leader_addr_before, leader_addr_after FROM x JOIN nm USING (table_id) WHERE change IS NOT NULL)"""


@query("tablet_diff", f"WITH {_TABLETS} SELECT * FROM y")
def tablet_diff(s, d):
    h = A.hierarchy(s, d)
    return E.tablet_diff(h["tablets"], h["replicas"], h["tables"], h["keyspaces"], 0, 1)


@query("leader_moves", f"WITH {_TABLETS} SELECT tablet_id, keyspace_name, table_name, leader_addr_before AS before, leader_addr_after AS after FROM y WHERE change = '=' AND leader_addr_before <> leader_addr_after")
def leader_moves(s, d):
    return E.leader_moves(tablet_diff(s, d))


@query("replica_diff", f"""WITH {ENT}, x AS (SELECT {kind('b.type = e.type', 'type')} AS change, tablet_id, server_uuid, b.type AS type_before, e.type AS type_after, b.addr AS addr_before, e.addr AS addr_after FROM {full('rp', 'tablet_id, server_uuid')}),
nm AS (SELECT CAST(p_partkey AS VARCHAR) AS tablet_id, table_name, keyspace_id AS keyspace_name FROM pn) SELECT change, tablet_id, server_uuid, keyspace_name, table_name, type_before, type_after, addr_before, addr_after FROM x JOIN nm USING (tablet_id) WHERE change IS NOT NULL""")
def replica_diff(s, d):
    h = A.hierarchy(s, d)
    return E.replica_diff(h["replicas"], h["tablets"], h["tables"], h["keyspaces"], 0, 1)


_MARKED = f"""{ENT}, {HEALTH},
mk AS (SELECT rp.*, dead.addr IS NOT NULL AS is_dead, few.tablet_id IS NOT NULL AS is_few FROM rp LEFT JOIN dead ON dead.snapshot_id = rp.snapshot_id AND dead.addr = rp.addr LEFT JOIN few ON few.snapshot_id = rp.snapshot_id AND few.tablet_id = rp.tablet_id)"""


@query("replica_liveness", f"WITH {_MARKED} SELECT snapshot_id, tablet_id, server_uuid, is_dead AS dead, is_few AS under_replicated FROM mk")
def replica_liveness(s, d):
    return E.mark_liveness((h := A.hierarchy(s, d))["replicas"], A.health(s, d, h)).select("snapshot_id", "tablet_id", "server_uuid", "dead", "under_replicated")


@query("entities_report", f"""WITH {_MARKED} SELECT mk.snapshot_id, keyspace_id AS keyspace_name, table_name, mk.tablet_id, tl.state AS tablet_state, server_uuid, type, addr,
 concat_ws(' ', CASE WHEN server_uuid = leader THEN 'LEADER' END, CASE WHEN is_dead THEN 'DEAD' END, CASE WHEN is_few THEN 'UNDER REPLICATED' END) AS marks
 FROM mk JOIN tl ON tl.snapshot_id = mk.snapshot_id AND tl.tablet_id = mk.tablet_id""")
def entities_report(s, d):
    h = A.hierarchy(s, d)
    return E.entities_report(h["keyspaces"], h["tables"], h["tablets"], h["replicas"], A.health(s, d, h))


def all_tables(s, d):
    """Every table that parts name, live or not, in both snapshots."""
    part = A.part_names(s, d).select("keyspace_id", "table_id", "table_name").distinct()
    return part.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("snapshot_id"), "table_id", "keyspace_id", "table_name", F.lit("RUNNING").alias("state"))


@query("colocated_tables", f"WITH {ENT} SELECT snapshot_id, table_id, keyspace_id FROM (SELECT DISTINCT table_id, keyspace_id FROM pn) p, dts WHERE NOT EXISTS (SELECT 1 FROM tl WHERE tl.snapshot_id = dts.snapshot_id AND tl.table_id = p.table_id)")
def colocated_tables(s, d):
    h = A.hierarchy(s, d)
    return E.colocated_tables(all_tables(s, d), h["keyspaces"], h["tablets"]).select("snapshot_id", "table_id", "keyspace_id")


def _colocated(s, d):
    """Brands as keyspaces with 32-digit ids; even ones have a parent table, of one of the two forms, and a tablet."""
    part = A.table(s, d, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("k"))
    n = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("long")
    ks = part.select(F.lit(0).alias("snapshot_id"), F.lpad(F.lower(F.hex(n * F.lit(1 << 44))), 32, "0").alias("keyspace_id"), F.col("p_brand").alias("keyspace_name"), F.lit("ysql").alias("keyspace_type"), n.alias("n"), F.col("k").cast("string").alias("tablet_id"))
    even = ks.where("n % 2 = 0")
    form = F.when(F.col("n") % 4 == 0, F.concat("keyspace_id", F.lit(".colocated.parent.uuid"))).otherwise(F.concat(F.left("keyspace_id", F.lit(22)), F.lit("00004100.colocation.parent.uuid")))
    tables = even.select("snapshot_id", form.alias("table_id"), "keyspace_id", F.lit("parent").alias("table_name"), F.lit("RUNNING").alias("state"))
    tablets = even.select("snapshot_id", "tablet_id", form.alias("table_id"), F.lit("RUNNING").alias("state"), (F.col("n") % 3).cast("string").alias("leader"))
    replicas = even.select("snapshot_id", "tablet_id", F.explode(F.array(*[F.lit(str(i)) for i in range(3)])).alias("server_uuid")).select("*", F.lit("VOTER").alias("type"), F.concat(F.lit("s"), "server_uuid").alias("addr"))
    return ks, tables, tablets, replicas


_N = "CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT)"


@query("colocation_flag", f"SELECT DISTINCT p_brand AS keyspace_name, {_N} % 2 = 0 AS colocated FROM part")
def colocation_flag(s, d):
    ks, tables, _, _ = _colocated(s, d)
    return ks.select("snapshot_id", "keyspace_id", "keyspace_name").join(E.colocation_flags(ks, tables), ["snapshot_id", "keyspace_id"]).select("keyspace_name", "colocated")


@query("coloc_leader", f"SELECT p_brand AS keyspace_name, CAST(min(p_partkey) AS VARCHAR) AS tablet_id, 's' || CAST({_N} % 3 AS VARCHAR) AS leader_addr FROM part WHERE {_N} % 2 = 0 GROUP BY p_brand")
def coloc_leader(s, d):
    return E.coloc_leader(*_colocated(s, d)).select("keyspace_name", "tablet_id", "leader_addr")


def views(s, d):
    """Masters as two hosts see them: h1 as they are, h2 all of them as followers at first and at last as they are."""
    m = masters(s, d)
    one = m.withColumn("hostname_port", F.lit("h1"))
    two = m.withColumns({"hostname_port": F.lit("h0"), "role": F.when(F.col("snapshot_id") == 0, "FOLLOWER").otherwise(F.col("role"))})
    return one.unionByName(two)


def view_leaders(s, d):
    """Both hosts answer; h1 comes first where there are events, which is everywhere."""
    seen = A.last_events(s, d).groupBy("snapshot_id").agg(F.count("*").alias("n"))
    each = F.explode(F.array(F.struct(F.lit("h1").alias("h"), F.lit(0).alias("pos")), F.struct(F.lit("h0").alias("h"), F.lit(1).alias("pos"))))
    return seen.select("snapshot_id", each.alias("l")).select("snapshot_id", F.col("l.h").alias("hostname_port"), F.lit("OK").alias("status"), F.col("l.pos").alias("pos"))


def health_leaders(s):
    return s.createDataFrame([(0, "m1:7000", "OK"), (1, "m1:7000", "OK"), (1, "u_other", "")], "snapshot_id int, hostname_port string, status string")


VIEWS = _M
LED = f"SELECT * FROM (SELECT {kind('b.role = e.role AND b.zone = e.zone', 'role')} AS change, permanent_uuid FROM {full('m', 'permanent_uuid')}) WHERE change IS NOT NULL"


@query("masters_diff_led", f"WITH {VIEWS} {LED}")
def masters_diff_led(s, d):
    return G.masters_diff(views(s, d), 0, 1, view_leaders(s, d)).select("change", "permanent_uuid")


_RENAMED = f"{LAST}, kn AS (SELECT snapshot_id, hostname_port AS keyspace_id, CASE WHEN status <> 'error' THEN status END AS name FROM le)"


@query("keyspace_renames", f"WITH {_RENAMED} SELECT CASE WHEN b.keyspace_id IS NULL THEN '+' WHEN e.keyspace_id IS NULL THEN '-' ELSE '=' END AS change, coalesce(b.keyspace_id, e.keyspace_id) AS keyspace_id, CASE WHEN b.keyspace_id IS NULL OR e.keyspace_id IS NULL THEN coalesce(e.name, b.name) ELSE coalesce(b.name, '') || '->' || coalesce(e.name, '') END AS name FROM (SELECT * FROM kn WHERE snapshot_id = 0) b FULL JOIN (SELECT * FROM kn WHERE snapshot_id = 1) e ON b.keyspace_id = e.keyspace_id WHERE b.keyspace_id IS NULL OR e.keyspace_id IS NULL OR b.name IS DISTINCT FROM e.name")
def keyspace_renames(s, d):
    """Names of keyspaces that come, go and change, nulls included."""
    le = A.last_events(s, d)
    ks = le.select("snapshot_id", F.col("hostname_port").alias("keyspace_id"), F.when(F.col("status") != "error", F.col("status")).alias("keyspace_name"), F.lit("ycql").alias("keyspace_type"))
    none = ks.select("snapshot_id", F.concat("keyspace_id", F.lit("t")).alias("table_id"), "keyspace_id", F.lit("t").alias("table_name"), F.lit("RUNNING").alias("state"))
    return E.keyspace_diff(ks, none, 0, 1).select("change", "keyspace_id", "name")


_TREE = f"""{ENT}, {HEALTH}, alltb AS (SELECT snapshot_id, table_id, keyspace_id, table_name FROM (SELECT DISTINCT table_id, keyspace_id, table_name FROM pn), dts)"""


@query("entities_tree", f"""WITH {_TREE} SELECT DISTINCT snapshot_id, 'keyspace' AS kind, keyspace_id AS keyspace_name, '' AS table_name, '' AS tablet_id, '' AS server_uuid, '' AS marks FROM alltb
UNION ALL SELECT snapshot_id, 'table', keyspace_id, table_name, '', '', CASE WHEN EXISTS (SELECT 1 FROM tl WHERE tl.snapshot_id = alltb.snapshot_id AND tl.table_id = alltb.table_id) THEN '' ELSE 'COLOCATED' END FROM alltb
UNION ALL SELECT tl.snapshot_id, 'tablet', tl.keyspace_id, tl.table_name, tl.tablet_id, '', concat_ws(' ', tl.state, CASE WHEN few.tablet_id IS NOT NULL THEN 'UNDER REPLICATED' END) FROM tl LEFT JOIN few ON few.snapshot_id = tl.snapshot_id AND few.tablet_id = tl.tablet_id
UNION ALL SELECT rp.snapshot_id, 'replica', tl.keyspace_id, tl.table_name, rp.tablet_id, server_uuid, concat_ws(' ', type, CASE WHEN server_uuid = leader THEN 'LEADER' END, CASE WHEN dead.addr IS NOT NULL THEN 'DEAD' END) FROM rp JOIN tl USING (snapshot_id, tablet_id) LEFT JOIN dead ON dead.snapshot_id = rp.snapshot_id AND dead.addr = rp.addr""")
def entities_tree(s, d):
    """All tables that parts name; those whose parts were all returned have no tablets."""
    h = A.hierarchy(s, d)
    return E.entities_tree(h["keyspaces"], all_tables(s, d), h["tablets"], h["replicas"], A.health(s, d, h))


@query("system_keyspaces", "SELECT r_name AS keyspace_name, r_regionkey < 3 AS system FROM region")
def system_keyspaces(s, d):
    from ..functions.columns import SYSTEM_KEYSPACES, is_system_keyspace

    ids = F.array(*[F.lit(x) for x in SYSTEM_KEYSPACES])
    key = F.when(F.col("r_regionkey") < 3, F.get(ids, F.col("r_regionkey").cast("int"))).otherwise(F.lpad(F.hex("r_regionkey"), 32, "0a"))
    return A.table(s, d, "region").select(F.col("r_name").alias("keyspace_name"), is_system_keyspace(key).alias("system"))
