"""The demo tables seen as telemetry: events as counters and states, order lines as a hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import settled

CUTS = ("2024-01-10", "2024-01-20")
DAILY = tuple(f"2024-01-{d:02d}" for d in (5, 9, 13, 17, 21, 25))
CATALOG_ROWS = [("click", "requests", "reqs", "counter", 1), ("view", "requests", "reqs", "counter", 1), ("purchase", "bytes", "B", "counter", 1024), ("signup", "milliseconds", "ms", "gauge", 1000)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stamp(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def snapshots(spark: SparkSession, cuts: tuple[str, ...] = CUTS) -> DataFrame:
    rows = spark.createDataFrame([(i, c, f"cut {i}") for i, c in enumerate(cuts)], "snapshot_id int, t string, comment string")
    return rows.select("snapshot_id", F.col("t").cast("timestamp_ntz").alias("ts"), "comment")


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOG_ROWS, "name string, unit string, suffix string, kind string, divisor long")


def at_cuts(df: DataFrame, time: str, cuts: tuple[str, ...]) -> DataFrame:
    """Each row once per cut that it lies before; no join."""
    each = F.array(*[F.struct(F.lit(i).alias("i"), stamp(c).alias("t")) for i, c in enumerate(cuts)])
    return df.withColumn("cut", F.explode(F.filter(each, lambda c: F.col(time) < c["t"]))).withColumns({"snapshot_id": F.col("cut.i"), "captured_at": F.col("cut.t")}).drop("cut")


def counters(spark: SparkSession, sf_dir: str, cuts: tuple[str, ...] = CUTS) -> DataFrame:
    """Events before each cut as three kinds of metrics of (host, type, user, event type)."""
    ev = table(spark, sf_dir, "events")
    own = ev.select(
        "ts", F.concat(F.lit("h"), (F.col("user_id") % 5).cast("string")).alias("hostname_port"), F.when(F.col("user_id") % 2 == 0, "table").otherwise("server").alias("metric_type"),
        F.col("user_id").cast("string").alias("metric_id"), F.col("event_type").alias("name"), F.round(F.col("value") * 100).cast("long").alias("cents"), F.get_json_object("props", "$.k").cast("long").alias("k"),
    )
    a = at_cuts(own, "ts", cuts).groupBy("snapshot_id", "captured_at", "hostname_port", "metric_type", "metric_id", "name").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"), F.sum("k").alias("k"))
    kinds = F.array(*[F.lit(k) for k in ("value", "countsum", "countsumrows")])
    return a.withColumn("kind", F.explode(kinds)).select(
        "snapshot_id", "captured_at", "hostname_port", "metric_type", "metric_id", F.lit("ns").alias("namespace"), F.concat(F.lit("t"), "metric_id").alias("table_name"), "name", "kind", F.lit(0).alias("pos"),
        F.when(F.col("kind") == "value", F.col("n")).alias("value"), F.when(F.col("kind") != "value", F.col("n")).alias("total_count"), F.when(F.col("kind") != "value", F.col("cents")).alias("total_sum"), F.when(F.col("kind") == "countsumrows", F.col("k")).alias("rows_"),
    )


def doubled(metrics: DataFrame) -> DataFrame:
    """Series of users divisible by 3 appear twice, the second time with one more."""
    again = metrics.where("CAST(metric_id AS BIGINT) % 3 = 0").withColumns({"value": F.col("value") + 1, "pos": F.lit(1)})
    return metrics.unionByName(again)


def statements(spark: SparkSession, sf_dir: str, metrics: DataFrame | None = None) -> DataFrame:
    m = (metrics or counters(spark, sf_dir)).where("kind = 'countsumrows'")
    return m.select("snapshot_id", "captured_at", "hostname_port", F.col("metric_id").cast("long").alias("query_id"), F.concat(F.lit("select '"), "name", F.lit("'")).alias("query"), F.col("total_count").alias("calls"), F.col("total_sum").alias("total_time"), "rows_")


def samples(spark: SparkSession, sf_dir: str, metrics: DataFrame | None = None) -> DataFrame:
    """Events as exporter samples: one per user (a CPU) and event type (a CPU state)."""
    names = {"view": "idle", "click": "user", "purchase": "system", "signup": "iowait", "error": "steal"}
    state = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("name"))
    m = (metrics or counters(spark, sf_dir)).where("kind = 'value'")
    base = m.select("snapshot_id", "captured_at", "hostname_port", "metric_id", state.alias("state"), F.col("value").cast("double").alias("value"), F.lit(0).alias("pos"), F.col("captured_at").alias("exporter_ts"))
    cpu = base.select("*", F.lit("node_cpu_seconds_total").alias("name"), F.concat(F.lit("_"), "metric_id", F.lit("_"), "state").alias("labels"), F.lit("counter").alias("exporter_type"))
    other = F.when(F.col("state") == "idle", "node_softnet_processed_total").when(F.col("state") == "user", "node_softnet_dropped_total").when(F.col("state") == "system", "node_schedstat_running_seconds_total").when(F.col("state") == "iowait", "node_schedstat_timeslices_total").otherwise("go_threads")
    rest = base.select("*", other.alias("name"), F.concat(F.lit("_"), "metric_id").alias("labels"), F.when(other == "go_threads", "gauge").otherwise("counter").alias("exporter_type"))
    return cpu.unionByName(rest).drop("metric_id", "state")


def last_events(spark: SparkSession, sf_dir: str, cuts: tuple[str, ...] = CUTS) -> DataFrame:
    """A user's last event before each cut, as a server's state; uptime runs from the last error."""
    ev = at_cuts(table(spark, sf_dir, "events"), "ts", cuts)
    key = F.struct("ts", "event_id")
    g = ev.groupBy("snapshot_id", "captured_at", "user_id").agg(F.max_by(F.struct("event_type", "props", "event_id"), key).alias("l"), F.max(F.when(F.col("event_type") == "error", F.col("ts"))).alias("err"))
    up = (F.unix_seconds(F.col("captured_at").cast("timestamp")) - F.unix_seconds(F.coalesce("err", stamp("2024-01-01")).cast("timestamp"))).alias("uptime_seconds")
    return g.select("snapshot_id", "captured_at", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("hostname_port"), F.col("l.event_type").alias("status"), F.get_json_object("l.props", "$.k").alias("value"), (F.col("l.event_id") % 3).cast("string").alias("zone"), up)


DATES = ("1997-01-01", "1998-01-01")


def _last_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(snapshot_id, l_partkey, l_suppkey, z): the newest of all order lines before each date; z orders lines and holds what is read of one."""
    each = F.array(*[F.struct(F.lit(i).alias("i"), stamp(d).alias("t")) for i, d in enumerate(DATES)])
    lines = table(spark, sf_dir, "lineitem").withColumn("i", F.explode(F.transform(F.filter(each, lambda c: F.col("l_shipdate") < c["t"]), lambda c: c["i"])))
    return lines.groupBy(F.col("i").alias("snapshot_id"), "l_partkey", "l_suppkey").agg(F.max(F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus")).alias("z"))


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tablets: brand and size make a keyspace, the type in it a table."""
    space = F.concat_ws(".", "p_brand", F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), space.alias("keyspace_id"), F.concat_ws(".", space, F.col("p_type")).alias("table_id"), F.col("p_type").alias("table_name"))


def hierarchy(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All order lines before two dates as keyspaces, tables, tablets and replicas.

    A part is a tablet, and its suppliers are replicas, unless the last line of the part, or of part and supplier, was returned.
    The newest lines and the tablets are made once, for all tables.
    """
    lines = settled(_last_lines(spark, sf_dir), "lines")
    kept = F.col("z.l_returnflag") != "R"
    state = F.when(F.col("z.l_linestatus") == "O", "RUNNING").otherwise("CREATING")
    names = part_names(spark, sf_dir)
    tablets = lines.groupBy("snapshot_id", "l_partkey").agg(F.max("z").alias("z")).where(kept).join(names, "l_partkey").select("snapshot_id", F.col("l_partkey").cast("string").alias("tablet_id"), "table_id", "table_name", "keyspace_id", state.alias("state"), F.col("z.l_suppkey").cast("string").alias("leader"))
    tablets = settled(tablets, "tablets")
    tables = tablets.groupBy("snapshot_id", "table_id", "keyspace_id", "table_name").agg(F.max("state").alias("state"))
    replicas = lines.where(kept).select("snapshot_id", F.col("l_partkey").cast("string").alias("tablet_id"), F.col("l_suppkey").cast("string").alias("server_uuid"), F.when(F.col("z.l_linestatus") == "F", "VOTER").otherwise("OBSERVER").alias("type"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), F.lit(":9100")).alias("addr"))
    brands = names.select("keyspace_id").distinct().select(F.explode(F.array(F.lit(0), F.lit(1))).alias("snapshot_id"), "keyspace_id", F.col("keyspace_id").alias("keyspace_name"), F.lit("ysql").alias("keyspace_type"))
    live = replicas.join(tablets.select("snapshot_id", "tablet_id"), ["snapshot_id", "tablet_id"], "left_semi")
    return {"keyspaces": brands, "tables": tables, "tablets": tablets.drop("table_name", "keyspace_id"), "replicas": live, "lines": lines}


BLOCK = 1000  # keys that one health row lists


def health(spark: SparkSession, sf_dir: str, h: dict[str, DataFrame] | None = None) -> DataFrame:
    """Per snapshot: suppliers whose last line was returned are dead; tablets with fewer than two replicas are under-replicated.

    A leader's lists come in rows of at most ``BLOCK`` keys each.
    """
    h = h or hierarchy(spark, sf_dir)
    empty = F.array().cast("array<string>")
    suppliers = h["lines"].groupBy("snapshot_id", F.col("l_suppkey").alias("k")).agg(F.max("z").alias("z")).where("z.l_returnflag = 'R'").groupBy("snapshot_id", F.floor(F.col("k") / BLOCK).alias("block"))
    dead = suppliers.agg(F.array_sort(F.collect_list(F.concat(F.lit("s"), F.col("k").cast("string"), F.lit(":9100")))).alias("dead_nodes")).withColumn("under_replicated_tablets", empty)
    n = h["replicas"].groupBy("snapshot_id", "tablet_id").agg(F.count("*").alias("n")).where("n > 1")
    few = h["tablets"].join(n, ["snapshot_id", "tablet_id"], "left_anti").groupBy("snapshot_id", F.floor(F.col("tablet_id").cast("long") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list("tablet_id")).alias("under_replicated_tablets")).withColumn("dead_nodes", empty)
    return dead.unionByName(few).select("snapshot_id", F.lit("m1:7000").alias("hostname_port"), "dead_nodes", "under_replicated_tablets")
