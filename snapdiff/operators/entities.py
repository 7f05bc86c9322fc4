"""Keyspaces, tables, tablets and replicas: look-ups along the hierarchy, and its diffs.

Names come from the side that a change is seen on: the end for ``+`` and ``=``, the begin for ``-``.
Look-ups are equi-joins with a side in their key, so both sides take one join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_catalog_object, is_colocation_parent, is_system_keyspace
from ..sources.store import settled
from .change import changed_fields, kind_of, leader_of, pair, sides


def leader_rows(df: DataFrame, leaders: DataFrame) -> DataFrame:
    """Rows that the leader of their snapshot reported."""
    return df.join(leader_of(leaders), ["snapshot_id", "hostname_port"], "left_semi")


def tables_per_keyspace(tables: DataFrame) -> DataFrame:
    return tables.groupBy("snapshot_id", "keyspace_id").agg(F.count("*").alias("n_tables"))


def with_names(df: DataFrame, tables: DataFrame, keyspaces: DataFrame, side: str) -> DataFrame:
    """Adds table_name and keyspace_name of ``df (table_id, <side>)``, a snapshot id; missing names are empty."""
    t = tables.select(F.col("snapshot_id").alias("_s"), F.col("table_id").alias("_t"), "table_name", F.col("keyspace_id").alias("_k"))
    k = keyspaces.select(F.col("snapshot_id").alias("_ks"), F.col("keyspace_id").alias("_ki"), "keyspace_name")
    out = df.join(t, (F.col("table_id") == F.col("_t")) & (F.col(side) == F.col("_s")), "left").join(k, (F.col("_k") == F.col("_ki")) & (F.col(side) == F.col("_ks")), "left")
    return out.drop("_s", "_t", "_k", "_ks", "_ki").withColumns({c: F.coalesce(c, F.lit("")) for c in ("table_name", "keyspace_name")})


def with_leader_addr(tablets: DataFrame, replicas: DataFrame) -> DataFrame:
    """Adds leader_addr, the address of the replica on the tablet's leader; empty without one."""
    r = replicas.select(F.col("snapshot_id").alias("_s"), F.col("tablet_id").alias("_t"), F.col("server_uuid").alias("_u"), F.col("addr").alias("leader_addr"))
    out = tablets.join(r, (F.col("snapshot_id") == F.col("_s")) & (F.col("tablet_id") == F.col("_t")) & (F.col("leader") == F.col("_u")), "left")
    return out.drop("_s", "_t", "_u").withColumn("leader_addr", F.coalesce("leader_addr", F.lit("")))


def mark_liveness(replicas: DataFrame, health: DataFrame) -> DataFrame:
    """Adds dead (the server is on the health list) and under_replicated (the tablet is)."""
    dead = health.select(F.col("snapshot_id").alias("_s"), F.explode("dead_nodes").alias("_a")).distinct().withColumn("_dead", F.lit(True))
    few = health.select(F.col("snapshot_id").alias("_fs"), F.explode("under_replicated_tablets").alias("_t")).distinct().withColumn("_few", F.lit(True))
    out = replicas.join(dead, (F.col("snapshot_id") == F.col("_s")) & (F.col("addr") == F.col("_a")), "left").join(few, (F.col("snapshot_id") == F.col("_fs")) & (F.col("tablet_id") == F.col("_t")), "left")
    return out.withColumns({"dead": F.col("_dead").isNotNull(), "under_replicated": F.col("_few").isNotNull()}).drop("_s", "_a", "_dead", "_fs", "_t", "_few")


def colocated_tables(tables: DataFrame, keyspaces: DataFrame, tablets: DataFrame) -> DataFrame:
    """User tables of YSQL keyspaces without a tablet of their own."""
    ysql = keyspaces.where("keyspace_type = 'ysql'").select("snapshot_id", "keyspace_id")
    own = tablets.select("snapshot_id", "table_id").distinct()
    return tables.where(~is_catalog_object(F.col("table_id")) | (F.length("table_id") != 32)).join(ysql, ["snapshot_id", "keyspace_id"], "left_semi").join(own, ["snapshot_id", "table_id"], "left_anti")


def colocation_flags(keyspaces: DataFrame, tables: DataFrame) -> DataFrame:
    """(snapshot_id, keyspace_id, colocated): does the keyspace have a parent table, in either form?"""
    t = tables.where(F.endswith("table_id", F.lit(".colocated.parent.uuid")) | F.endswith("table_id", F.lit(".colocation.parent.uuid")))
    t = t.select(F.col("snapshot_id").alias("_s"), F.col("table_id").alias("_t"), F.left("table_id", F.lit(22)).alias("_p"))
    k = keyspaces.select("snapshot_id", "keyspace_id", F.left("keyspace_id", F.lit(22)).alias("_k"))
    hit = k.join(t, (F.col("snapshot_id") == F.col("_s")) & (F.col("_k") == F.col("_p"))).where(is_colocation_parent(F.col("_t"), F.col("keyspace_id"))).select("snapshot_id", "keyspace_id").distinct().withColumn("colocated", F.lit(True))
    return keyspaces.select("snapshot_id", "keyspace_id").join(hit, ["snapshot_id", "keyspace_id"], "left").withColumn("colocated", F.coalesce("colocated", F.lit(False)))


def coloc_leader(keyspaces: DataFrame, tables: DataFrame, tablets: DataFrame, replicas: DataFrame, database: str | None = None) -> DataFrame:
    """Where a colocated database's parent tablet is led: keyspace, parent table, tablet, leader's address."""
    k = keyspaces if database is None else keyspaces.where(F.col("keyspace_name") == database)
    t = tables.join(k.select("snapshot_id", "keyspace_id", "keyspace_name"), ["snapshot_id", "keyspace_id"]).where(is_colocation_parent(F.col("table_id"), F.col("keyspace_id")))
    led = with_leader_addr(tablets.join(t.select("snapshot_id", "table_id", "keyspace_name"), ["snapshot_id", "table_id"]), replicas).where("leader_addr <> ''")
    return led.select("snapshot_id", "keyspace_name", "table_id", "tablet_id", "leader_addr")


def keyspace_diff(keyspaces: DataFrame, tables: DataFrame, begin: int, end: int) -> DataFrame:
    """YSQL keyspaces never vanish from the list: one counts as present while it has tables."""
    keyspaces, tables = pair(keyspaces, begin, end), pair(tables, begin, end)
    n = tables_per_keyspace(tables).withColumnsRenamed({"snapshot_id": "_s", "keyspace_id": "_k"})
    k = keyspaces.join(n, (F.col("snapshot_id") == F.col("_s")) & (F.col("keyspace_id") == F.col("_k")), "left").join(colocation_flags(keyspaces, tables), ["snapshot_id", "keyspace_id"])
    k = k.withColumn("n_tables", F.coalesce("n_tables", F.lit(0)))
    a = sides(k, ["keyspace_id"], ["keyspace_name", "keyspace_type", "colocated", "n_tables"], begin, end, (F.col("keyspace_type") != "ysql") | (F.col("n_tables") > 0))
    named = lambda side: F.coalesce(f"{side}.keyspace_name", F.lit(""))
    both = F.col("b").isNotNull() & F.col("e").isNotNull()
    name = F.when(both & (named("b") != named("e")), F.concat(named("b"), F.lit("->"), named("e"))).otherwise(F.coalesce("e.keyspace_name", "b.keyspace_name"))
    same = F.lit(True)
    for c in ("keyspace_name", "keyspace_type", "colocated"):
        same = same & F.col(f"b.{c}").eqNullSafe(F.col(f"e.{c}"))
    return a.select(kind_of(F.col("b"), F.col("e"), same).alias("change"), "keyspace_id", name.alias("name"), F.coalesce("e.colocated", "b.colocated").alias("colocated"), F.coalesce("b.n_tables", F.lit(0)).alias("tables_before"), F.coalesce("e.n_tables", F.lit(0)).alias("tables_after")).where("change IS NOT NULL")


def _classified(facts: DataFrame, keys: list[str], carried: list[str], compared: list[str], begin: int, end: int) -> DataFrame:
    """Changes with what each side carries, and ``side``: the snapshot that names come from."""
    a = sides(facts, keys, [*carried, *compared], begin, end).withColumn("changes", changed_fields(compared))
    a = a.withColumn("change", kind_of(F.col("b"), F.col("e"), F.size("changes") == 0)).where("change IS NOT NULL")
    out = {c: F.coalesce(f"e.{c}", f"b.{c}") for c in carried}
    out |= {f"{c}_{w}": F.col(f"{s}.{c}") for c in compared for w, s in (("before", "b"), ("after", "e"))}
    return a.withColumns(out | {"side": F.when(F.col("change") == "-", begin).otherwise(end)}).drop("b", "e", "changes")


def table_diff(tables: DataFrame, keyspaces: DataFrame, tablets: DataFrame, begin: int, end: int) -> DataFrame:
    """Tables; the catalog's objects show only when changed. ``colocated``: a YSQL table without tablets."""
    tables, keyspaces, tablets = (pair(x, begin, end) for x in (tables, keyspaces, tablets))
    a = _classified(tables, ["table_id"], ["keyspace_id"], ["table_name", "state"], begin, end)
    a = a.where((F.col("change") == "=") | (F.length("table_id") != 32) | ~is_catalog_object(F.col("table_id")))
    k = keyspaces.select(F.col("snapshot_id").alias("_s"), F.col("keyspace_id").alias("_k"), "keyspace_name")
    c = colocated_tables(tables, keyspaces, tablets).select(F.col("snapshot_id").alias("_cs"), F.col("table_id").alias("_ct"), F.lit(True).alias("_c"))
    out = a.join(k, (F.col("side") == F.col("_s")) & (F.col("keyspace_id") == F.col("_k")), "left").join(c, (F.col("side") == F.col("_cs")) & (F.col("table_id") == F.col("_ct")), "left")
    return out.select("change", "table_id", F.coalesce("keyspace_name", F.lit("")).alias("keyspace_name"), "table_name_before", "table_name_after", "state_before", "state_after", F.col("_c").isNotNull().alias("colocated"))


def tablet_diff(tablets: DataFrame, replicas: DataFrame, tables: DataFrame, keyspaces: DataFrame, begin: int, end: int) -> DataFrame:
    """Tablets whose state or leader's address changed, with the names of their side."""
    tablets, replicas, tables, keyspaces = (pair(x, begin, end) for x in (tablets, replicas, tables, keyspaces))
    a = _classified(with_leader_addr(tablets, replicas), ["tablet_id"], ["table_id"], ["state", "leader_addr"], begin, end)
    return with_names(a, tables, keyspaces, "side").select("change", "tablet_id", "keyspace_name", "table_name", "state_before", "state_after", "leader_addr_before", "leader_addr_after")


def leader_moves(diff: DataFrame) -> DataFrame:
    """Of a tablet diff, the tablets on both sides whose leader is another."""
    return diff.where("change = '=' AND leader_addr_before <> leader_addr_after").select("tablet_id", "keyspace_name", "table_name", F.col("leader_addr_before").alias("before"), F.col("leader_addr_after").alias("after"))


def replica_diff(replicas: DataFrame, tablets: DataFrame, tables: DataFrame, keyspaces: DataFrame, begin: int, end: int) -> DataFrame:
    """Replicas by tablet and server: added, removed, or of another type or address."""
    replicas, tablets, tables, keyspaces = (pair(x, begin, end) for x in (replicas, tablets, tables, keyspaces))
    a = _classified(replicas, ["tablet_id", "server_uuid"], [], ["type", "addr"], begin, end)
    t = tablets.select(F.col("snapshot_id").alias("side"), "tablet_id", "table_id")
    named = with_names(a.join(t, ["side", "tablet_id"], "left"), tables, keyspaces, "side")
    return named.select("change", "tablet_id", "server_uuid", "keyspace_name", "table_name", "type_before", "type_after", "addr_before", "addr_after")


def entities_report(keyspaces: DataFrame, tables: DataFrame, tablets: DataFrame, replicas: DataFrame, health: DataFrame) -> DataFrame:
    """One row per replica with its names and marks; dropped YSQL keyspaces do not show."""
    n = tables_per_keyspace(tables)
    seen = keyspaces.join(n, ["snapshot_id", "keyspace_id"], "left").where("keyspace_type <> 'ysql' OR n_tables > 0").drop("n_tables")
    t = tablets.select("snapshot_id", "tablet_id", "table_id", "leader", F.col("state").alias("tablet_state"))
    r = mark_liveness(replicas, health).join(t, ["snapshot_id", "tablet_id"])
    r = r.join(tables.select("snapshot_id", "table_id", "table_name", "keyspace_id"), ["snapshot_id", "table_id"]).join(seen, ["snapshot_id", "keyspace_id"])
    marks = F.concat_ws(" ", F.when(F.col("server_uuid") == F.col("leader"), "LEADER"), F.when(F.col("dead"), "DEAD"), F.when(F.col("under_replicated"), "UNDER REPLICATED"))
    return r.select("snapshot_id", "keyspace_name", "table_name", "tablet_id", "tablet_state", "server_uuid", "type", "addr", marks.alias("marks"))


def visible_keyspaces(keyspaces: DataFrame, tables: DataFrame, system: bool = True) -> DataFrame:
    """(snapshot_id, keyspace_id, keyspace_name, ks_marks) of keyspaces that show: no dropped YSQL ones, no system ones unless ``system``."""
    ks = keyspaces.join(tables_per_keyspace(tables), ["snapshot_id", "keyspace_id"], "left").where("keyspace_type <> 'ysql' OR n_tables > 0")
    own = is_system_keyspace(F.col("keyspace_id"))
    ks = ks if system else ks.where(~own)
    return ks.select("snapshot_id", "keyspace_id", "keyspace_name", F.when(own, "SYSTEM").otherwise("").alias("ks_marks"))


def entities_tree(keyspaces: DataFrame, tables: DataFrame, tablets: DataFrame, replicas: DataFrame, health: DataFrame, system: bool = True) -> DataFrame:
    """(snapshot_id, kind, keyspace_name, table_name, tablet_id, server_uuid, marks): each level on its own rows.

    A keyspace without tables, a table without tablets and a tablet without replicas have their row;
    YSQL keyspaces that were dropped (no tables) do not show, nor do system keyspaces unless
    ``system``. Marks: of keyspaces SYSTEM; of tables COLOCATED; of tablets their state and UNDER
    REPLICATED; of replicas their type, LEADER and DEAD. Names go down level by level: those of tables and
    of tablets are joined once and written to the shared folder, where the level below reads them.
    """
    ks = visible_keyspaces(keyspaces, tables, system)
    coloc = colocated_tables(tables, keyspaces, tablets).select("snapshot_id", "table_id", F.lit("COLOCATED").alias("t_marks"))
    tb = tables.join(ks.drop("ks_marks"), ["snapshot_id", "keyspace_id"]).join(coloc, ["snapshot_id", "table_id"], "left").select("snapshot_id", "table_id", "keyspace_name", "table_name", F.coalesce("t_marks", F.lit("")).alias("t_marks"))
    tb = settled(tb, "tables")
    few = health.select("snapshot_id", F.explode("under_replicated_tablets").alias("tablet_id"), F.lit("UNDER REPLICATED").alias("few")).distinct()
    tl = tablets.select("snapshot_id", "tablet_id", "table_id", "state", "leader").join(tb.drop("t_marks"), ["snapshot_id", "table_id"]).join(few, ["snapshot_id", "tablet_id"], "left")
    tl = settled(tl, "tablets")
    dead = health.select("snapshot_id", F.explode("dead_nodes").alias("addr"), F.lit("DEAD").alias("dead")).distinct()
    re = replicas.join(tl.select("snapshot_id", "tablet_id", "keyspace_name", "table_name", "leader"), ["snapshot_id", "tablet_id"]).join(dead, ["snapshot_id", "addr"], "left")
    none = F.lit("")
    row = lambda df, kind, table, tablet, server, marks: df.select("snapshot_id", F.lit(kind).alias("kind"), "keyspace_name", table.alias("table_name"), tablet.alias("tablet_id"), server.alias("server_uuid"), marks.alias("marks"))
    parts = [
        row(ks, "keyspace", none, none, none, F.col("ks_marks")),
        row(tb, "table", F.col("table_name"), none, none, F.col("t_marks")),
        row(tl, "tablet", F.col("table_name"), F.col("tablet_id"), none, F.concat_ws(" ", "state", "few")),
        row(re, "replica", F.col("table_name"), F.col("tablet_id"), F.col("server_uuid"), F.concat_ws(" ", "type", F.when(F.col("server_uuid") == F.col("leader"), "LEADER"), "dead")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
