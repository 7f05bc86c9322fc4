"""Classified changes between two snapshots: ``+`` only at the end, ``-`` only at the begin, ``=`` changed.

All are one scan and one aggregate on the key: ``change_diff``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sides(facts: DataFrame, keys: list[str], fields: list[str], begin: int, end: int, presence: Column | None = None) -> DataFrame:
    """One row per key with structs ``b`` and ``e`` of the fields (null where absent).

    ``presence`` says which rows count as present. Of rows that share a key and a side, the least counts.
    """
    here = F.lit(True) if presence is None else presence
    row = F.struct(*fields)
    side = lambda n, name: F.min(F.when((F.col("snapshot_id") == n) & here, row)).alias(name)
    return facts.where(F.col("snapshot_id").isin(begin, end)).groupBy(*keys).agg(side(begin, "b"), side(end, "e"))


def pair(df: DataFrame, begin: int, end: int) -> DataFrame:
    """Rows of both snapshots; a filter by value, so that no other partition is read."""
    return df.where(F.col("snapshot_id").isin(begin, end))


def leader_of(leaders: DataFrame) -> DataFrame:
    """(snapshot_id, hostname_port): per snapshot the first host whose status is ``OK``, by ``pos``, or by name where there is none."""
    first = F.min_by("hostname_port", "pos") if "pos" in leaders.columns else F.min("hostname_port")
    return leaders.where("status = 'OK'").groupBy("snapshot_id").agg(first.alias("hostname_port"))


def leaders_of_pair(leaders: DataFrame, begin: int, end: int) -> dict[int, str]:
    """The leader's host of each of the two snapshots; looked up once for a report (two rows at most come to the driver)."""
    return {r.snapshot_id: r.hostname_port for r in leader_of(pair(leaders, begin, end)).collect()}


def leader_view(df: DataFrame, leaders: DataFrame | dict[int, str] | None, begin: int, end: int) -> DataFrame:
    """Rows of both snapshots as the leader of each reported them; none if a side has no leader.

    With leaders that were looked up the view is a filter by values, which reaches the scan.
    """
    rows = pair(df, begin, end)
    if leaders is None or "hostname_port" not in df.columns:
        return rows
    if isinstance(leaders, dict):
        here = F.lit(False)
        for n in {begin, end} if {begin, end} <= leaders.keys() else ():
            here = here | ((F.col("snapshot_id") == n) & (F.col("hostname_port") == leaders[n]))
        return rows.where(here)
    both = leader_of(pair(leaders, begin, end)).groupBy().agg(F.collect_list(F.struct("snapshot_id", "hostname_port")).alias("l"))  # two rows at most
    both = both.where(F.size("l") == len({begin, end})).select(F.inline("l"))
    return rows.join(both, ["snapshot_id", "hostname_port"], "left_semi")


def kind_of(before: Column, after: Column, same: Column) -> Column:
    """``+``, ``-``, ``=``, or null for what is unchanged or on neither side."""
    return F.when(before.isNull() & after.isNotNull(), "+").when(before.isNotNull() & after.isNull(), "-").when(before.isNotNull() & ~same, "=")


def changed_fields(fields: list[str], before: str = "b", after: str = "e") -> Column:
    """``array<struct<field, before, after>>`` of the fields that differ, nulls being values."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{before}.{f}").cast("string").alias("before"), F.col(f"{after}.{f}").cast("string").alias("after")) for f in fields])
    return F.filter(each, lambda x: ~x["before"].eqNullSafe(x["after"]))


def change_diff(facts: DataFrame, keys: list[str], fields: list[str], begin: int, end: int, presence: Column | None = None) -> DataFrame:
    """(change, keys, changes): changes are the differing fields of ``=`` rows, and all of ``+`` and ``-`` rows."""
    a = sides(facts, keys, fields, begin, end, presence).withColumn("changes", changed_fields(fields))
    a = a.withColumn("change", kind_of(F.col("b"), F.col("e"), F.size("changes") == 0))
    return a.where("change IS NOT NULL").select("change", *keys, "changes")


def spelled(changes: Column) -> Column:
    """Changes as text, ``field:before->after``, in the order of the fields."""
    none = lambda c: F.coalesce(c, F.lit(""))
    return F.array_join(F.transform(changes, lambda x: F.concat(x["field"], F.lit(":"), none(x["before"]), F.lit("->"), none(x["after"]))), ";")


def masters_diff(masters: DataFrame, begin: int, end: int, leaders: DataFrame | None = None) -> DataFrame:
    """By permanent uuid, as the leader of each side sees them; a sequence number of 0 means absent."""
    masters = leader_view(masters, leaders, begin, end)
    fields = ["role", "cloud", "region", "zone", "instance_seqno", "start_time_us", "rpc_addresses", "http_addresses"]
    return change_diff(masters, ["permanent_uuid"], fields, begin, end, F.col("instance_seqno") != 0)


def versions_diff(versions: DataFrame, begin: int, end: int) -> DataFrame:
    """By host; an empty git hash means absent."""
    fields = [c for c in versions.columns if c not in ("cluster_id", "snapshot_id", "hostname_port", "captured_at")]
    return change_diff(versions, ["hostname_port"], fields, begin, end, F.coalesce("git_hash", F.lit("")) != "")


def vars_diff(vars_: DataFrame, begin: int, end: int, include_empty: bool = False) -> DataFrame:
    """Settings whose value or type changed, on both sides and, by default, neither empty."""
    a = sides(vars_, ["hostname_port", "name"], ["value", "var_type"], begin, end)
    both = F.col("b").isNotNull() & F.col("e").isNotNull()
    if not include_empty:
        both = both & (F.col("b.value") != "") & (F.col("e.value") != "")
    return a.where(both & ~F.col("b").eqNullSafe(F.col("e"))).select("hostname_port", "name", F.col("b.value").alias("before"), F.col("e.value").alias("after"), F.col("b.var_type").alias("type_before"), F.col("e.var_type").alias("type_after"))


def tserver_diff(servers: DataFrame, begin: int, end: int, leaders: DataFrame | None = None) -> DataFrame:
    """Tablet servers whose status changed, or whose uptime went down (a restart), as the leader of each side sees them."""
    servers = leader_view(servers, leaders, begin, end)
    a = sides(servers, ["server"], ["status", "uptime_seconds"], begin, end)
    restart = F.coalesce(F.col("e.uptime_seconds") < F.col("b.uptime_seconds"), F.lit(False))
    change = kind_of(F.col("b"), F.col("e"), (F.col("b.status").eqNullSafe(F.col("e.status"))) & ~restart)
    return a.select(change.alias("change"), "server", F.col("b.status").alias("status_before"), F.col("e.status").alias("status_after"), restart.alias("restart"), F.col("e.uptime_seconds").alias("uptime_seconds")).where("change IS NOT NULL")


def health_diff(health: DataFrame, begin: int, end: int, leaders: DataFrame | None = None) -> DataFrame:
    """(change, item, value): list members that came (+) and went (-) in the leaders' reports; nothing if a side has no report.

    A side's lists may come in several rows; members are compared by one aggregate, never gathered.
    """
    health = leader_view(health, leaders, begin, end)
    both = health.agg(F.coalesce(F.max(F.col("snapshot_id") == begin) & F.max(F.col("snapshot_id") == end), F.lit(False))).scalar()
    none = F.array().cast("array<struct<item:string,value:string>>")

    def members(item: str) -> Column:
        return F.coalesce(F.transform(F.col(item), lambda v: F.struct(F.lit(item).alias("item"), v.alias("value"))), none)

    each = health.select("snapshot_id", F.inline(F.concat(members("dead_nodes"), members("under_replicated_tablets"))))
    a = each.groupBy("item", "value").agg(F.max(F.col("snapshot_id") == begin).alias("b"), F.max(F.col("snapshot_id") == end).alias("e"))
    return a.where((F.col("b") != F.col("e")) & both).select(F.when(F.col("e"), "+").otherwise("-").alias("change"), "item", "value")
