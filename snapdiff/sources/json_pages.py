"""JSON payloads to typed rows. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .payloads import parsed, stamp_of

_NUMBER = "decimal(20,0)"  # unsigned 64-bit values occur
METRICS = f"""array<struct<type string, id string, attributes struct<stream_id string, namespace_name string, table_name string, table_id string>,
 metrics array<struct<name string, value variant, total_count {_NUMBER}, min {_NUMBER}, mean double, percentile_75 {_NUMBER}, percentile_95 {_NUMBER}, percentile_99 {_NUMBER},
 percentile_99_9 {_NUMBER}, percentile_99_99 {_NUMBER}, max {_NUMBER}, total_sum {_NUMBER}, count {_NUMBER}, sum {_NUMBER}, rows {_NUMBER}>>>>"""


def _inline(payloads: DataFrame, schema: str, array: Column | str) -> DataFrame:
    rows = parsed(payloads, schema)
    return rows.select(*stamp_of(payloads), F.inline(F.expr(array) if isinstance(array, str) else array))


def metrics_long(payloads: DataFrame) -> DataFrame:
    """One row per metric with its kind: the first shape that fits, in a fixed order; others are ``unknown``."""
    stamp = stamp_of(payloads)
    rows = parsed(payloads, METRICS).select(*stamp, F.explode("doc").alias("e")).select(*stamp, "e", F.posexplode("e.metrics").alias("pos", "m"))
    shape = F.schema_of_variant("m.value")
    has = lambda *names: F.forall(F.array(*[F.col(f"m.{n}").isNotNull() for n in names]), lambda x: x)
    kind = (
        F.when(shape == "BIGINT", "value")
        .when(has("total_count", "min", "mean", "percentile_75", "percentile_95", "percentile_99", "percentile_99_9", "percentile_99_99", "max", "total_sum"), "countsum")
        .when(has("count", "sum", "rows"), "countsumrows")
        .when(shape == "DECIMAL(20,0)", "rejected_u64")
        .when(shape == "BOOLEAN", "rejected_bool")
        .otherwise("unknown")
    )
    empty = lambda c: F.coalesce(F.col(f"e.attributes.{c}"), F.lit(""))
    long_ = lambda *names: F.coalesce(*[F.col(f"m.{n}") for n in names]).try_cast("long")
    return rows.select(
        *stamp, F.col("e.type").alias("metric_type"), F.col("e.id").alias("metric_id"), empty("namespace_name").alias("namespace"), empty("table_name").alias("table_name"), empty("table_id").alias("table_id"), empty("stream_id").alias("stream_id"),
        "pos", F.col("m.name").alias("name"), kind.alias("kind"), F.when(shape == "BIGINT", F.try_variant_get("m.value", "$", "bigint")).alias("value"), long_("total_count", "count").alias("total_count"), long_("total_sum", "sum").alias("total_sum"), long_("rows").alias("rows_"),
        long_("min").alias("min_"), F.col("m.mean").alias("mean"), *[long_(f"percentile_{p}").alias(f"p{p}") for p in ("75", "95", "99", "99_9", "99_99")], long_("max").alias("max_"),
    )


def statements_long(payloads: DataFrame) -> DataFrame:
    schema = "struct<statements array<struct<query_id bigint, query string, calls bigint, total_time double, min_time double, max_time double, mean_time double, stddev_time double, rows bigint>>>"
    return _inline(payloads, schema, "doc.statements").withColumnRenamed("rows", "rows_")


def entities(payloads: DataFrame) -> dict[str, DataFrame]:
    """keyspaces, tables, tablets, replicas of dumps whose three arrays all have members."""
    schema = """struct<keyspaces array<struct<keyspace_id string, keyspace_name string, keyspace_type string>>, tables array<struct<table_id string, keyspace_id string, table_name string, state string>>,
 tablets array<struct<table_id string, tablet_id string, state string, replicas array<struct<type string, server_uuid string, addr string>>, leader string>>>"""
    full = parsed(payloads, schema).where("size(doc.keyspaces) > 0 AND size(doc.tables) > 0 AND size(doc.tablets) > 0")
    stamp = stamp_of(payloads)
    tablets = full.select(*stamp, F.inline("doc.tablets"))
    return {
        "keyspaces": full.select(*stamp, F.inline("doc.keyspaces")),
        "tables": full.select(*stamp, F.inline("doc.tables")),
        "tablets": tablets.drop("replicas"),
        "replicas": tablets.select(*stamp, "tablet_id", F.inline("replicas")),
    }


def masters(payloads: DataFrame) -> DataFrame:
    """Rows without a uuid are dropped; missing placement is ``-``, a missing role ``UNKNOWN_ROLE``."""
    address = "array<struct<host string, port int>>"
    schema = f"""struct<masters array<struct<instance_id struct<permanent_uuid string, instance_seqno bigint, start_time_us bigint>, registration struct<private_rpc_addresses {address}, http_addresses {address},
 cloud_info struct<placement_cloud string, placement_region string, placement_zone string>, placement_uuid string>, role string, error struct<code string, message string>>>>"""
    stamp = stamp_of(payloads)
    m = parsed(payloads, schema).select(*stamp, F.explode("doc.masters").alias("m")).where("coalesce(m.instance_id.permanent_uuid, '') <> ''")
    dash = lambda c: F.coalesce(F.col(f"m.registration.{c}"), F.lit("-"))
    spelled = lambda c: F.coalesce(F.array_join(F.transform(F.col(f"m.registration.{c}"), lambda a: F.concat(a["host"], F.lit(":"), a["port"].cast("string"), F.lit(","))), ""), F.lit(""))
    return m.select(
        *stamp, "m.instance_id.permanent_uuid", "m.instance_id.instance_seqno", F.coalesce("m.instance_id.start_time_us", F.lit(0)).cast("long").alias("start_time_us"), dash("cloud_info.placement_cloud").alias("cloud"), dash("cloud_info.placement_region").alias("region"),
        dash("cloud_info.placement_zone").alias("zone"), dash("placement_uuid").alias("placement_uuid"), F.coalesce("m.role", F.lit("UNKNOWN_ROLE")).alias("role"), spelled("private_rpc_addresses").alias("rpc_addresses"), spelled("http_addresses").alias("http_addresses"), F.col("m.error.code").alias("error"),
    )


def tablet_servers(payloads: DataFrame) -> DataFrame:
    """One row per server, its paths as an array (``tablet_server_paths`` makes rows of them)."""
    fields = "time_since_hb string, time_since_hb_sec double, status string, uptime_seconds bigint, ram_used string, ram_used_bytes bigint, num_sst_files bigint, total_sst_file_size string, total_sst_file_size_bytes bigint, uncompressed_sst_file_size string, uncompressed_sst_file_size_bytes bigint, path_metrics array<struct<path string, space_used bigint, total_space_size bigint>>, read_ops_per_sec double, write_ops_per_sec double, user_tablets_total bigint, user_tablets_leaders bigint, system_tablets_total bigint, system_tablets_leaders bigint, active_tablets int, cloud string, region string, zone string"
    stamp = stamp_of(payloads)
    rows = parsed(payloads, f"map<string,map<string,struct<{fields}>>>").select(*stamp, F.explode(F.try_element_at("doc", F.lit(""))).alias("server", "s"))
    return rows.select(*stamp, "server", "s.*")


def tablet_server_paths(servers: DataFrame) -> DataFrame:
    return servers.select(*stamp_of(servers), "server", F.inline("path_metrics"))


def vars_(payloads: DataFrame) -> DataFrame:
    return _inline(payloads, "struct<flags array<struct<name string, value string, type string>>>", "doc.flags").withColumnRenamed("type", "var_type")


def versions(payloads: DataFrame) -> DataFrame:
    """Rows without a git hash are dropped."""
    fields = ("git_hash", "build_hostname", "build_timestamp", "build_username", "build_id", "build_type", "version_number", "build_number")
    schema = f"struct<{', '.join(f'{f} string' for f in fields)}, build_clean_repo boolean>"
    return parsed(payloads, schema).where("coalesce(doc.git_hash, '') <> ''").select(*stamp_of(payloads), "doc.*")


def health(payloads: DataFrame) -> DataFrame:
    schema = "struct<dead_nodes array<string>, most_recent_uptime bigint, under_replicated_tablets array<string>, failed_tablets array<string>>"
    empty = lambda c: F.coalesce(F.col(f"doc.{c}"), F.array().cast("array<string>")).alias(c)
    return parsed(payloads, schema).where("doc IS NOT NULL").select(*stamp_of(payloads), empty("dead_nodes"), F.col("doc.most_recent_uptime"), empty("under_replicated_tablets"), empty("failed_tablets"))


def leaders(payloads: DataFrame) -> DataFrame:
    """Rows without a status are dropped."""
    return parsed(payloads, "struct<STATUS: string>").where("coalesce(doc.STATUS, '') <> ''").select(*stamp_of(payloads), F.col("doc.STATUS").alias("status"))


_CALL = "struct<header struct<call_id bigint, remote_method struct<service_name string, method_name string>, timeout_millis bigint>, elapsed_millis bigint, cql_details struct<type string, call_details array<struct<sql_id string, sql_string string, params string>>>, state string>"
_CONNECTION = f"struct<remote_ip string, state string, processed_call_count bigint, sending_bytes bigint, calls_in_flight array<{_CALL}>>"
_BACKEND = "struct<process_start_time string, application_name string, backend_type string, backend_status string, db_oid bigint, db_name string, host string, port string, query string, query_start_time string, query_running_for_ms bigint>"
RPC = f"struct<connections array<{_BACKEND}>, inbound_connections array<{_CONNECTION}>, outbound_connections array<{_CONNECTION}>>"


def _backends(payloads: DataFrame) -> DataFrame:
    return parsed(payloads, RPC).select(*stamp_of(payloads), F.posexplode("doc.connections").alias("pos", "c"))


def _peers(payloads: DataFrame) -> DataFrame:
    rows = parsed(payloads, RPC)
    each = [rows.select(*stamp_of(payloads), F.lit(d).alias("direction"), F.posexplode(f"doc.{d}_connections").alias("pos", "c")) for d in ("inbound", "outbound")]
    return each[0].unionByName(each[1])


def connections(payloads: DataFrame) -> DataFrame:
    """SQL backends, inbound and outbound connections; ``active``: a backend's status, or any call in flight."""
    stamp = stamp_of(payloads)
    sql = _backends(payloads).select(
        *stamp, F.lit("ysql").alias("direction"), "pos", F.when(F.coalesce("c.host", F.lit("")) != "", F.concat("c.host", F.lit(":"), "c.port")).alias("remote"), F.col("c.backend_status").alias("state"), F.col("c.backend_type").alias("backend_type"),
        F.col("c.db_name").alias("db_name"), F.lit(None).cast("long").alias("processed_call_count"), F.coalesce(F.col("c.backend_status") == "active", F.lit(False)).alias("active"),
    )
    busy = F.coalesce(F.exists("c.calls_in_flight", lambda x: x["header"].isNotNull() | x["cql_details"].isNotNull()), F.lit(False))
    other = _peers(payloads).select(*stamp, "direction", "pos", F.col("c.remote_ip").alias("remote"), F.col("c.state").alias("state"), F.lit(None).cast("string").alias("backend_type"), F.lit(None).cast("string").alias("db_name"), F.col("c.processed_call_count").alias("processed_call_count"), busy.alias("active"))
    return sql.unionByName(other)


def calls(payloads: DataFrame) -> DataFrame:
    """Running statements and calls in flight: statements, or service and method, with elapsed time."""
    stamp = stamp_of(payloads)
    sql = _backends(payloads).where("coalesce(c.query, '') <> '' AND c.backend_status = 'active'").select(
        *stamp, F.lit("ysql").alias("direction"), F.when(F.coalesce("c.host", F.lit("")) != "", F.concat("c.host", F.lit(":"), "c.port")).alias("remote"), F.array("c.query").alias("statements"), F.lit(None).cast("string").alias("service"), F.lit(None).cast("string").alias("method"),
        F.col("c.query_running_for_ms").alias("elapsed_ms"), F.lit(None).cast("long").alias("timeout_ms"), F.col("c.backend_status").alias("state"),
    )
    flight = _peers(payloads).select(*stamp, "direction", F.col("c.remote_ip").alias("remote"), F.explode("c.calls_in_flight").alias("k"))
    other = flight.select(
        *stamp, "direction", "remote", F.coalesce("k.cql_details.call_details.sql_string", F.array().cast("array<string>")).alias("statements"), F.col("k.header.remote_method.service_name").alias("service"), F.col("k.header.remote_method.method_name").alias("method"),
        F.col("k.elapsed_millis").alias("elapsed_ms"), F.col("k.header.timeout_millis").alias("timeout_ms"), F.col("k.state").alias("state"),
    )
    return sql.unionByName(other)


def cluster_config(payloads: DataFrame) -> DataFrame:
    """The document as a VARIANT, with its version and uuid; rows without a uuid are dropped."""
    rows = payloads.withColumn("doc", F.try_parse_json("body"))
    uuid = F.try_variant_get("doc", "$.cluster_uuid", "string")
    return rows.where(F.coalesce(uuid, F.lit("")) != "").select(*stamp_of(payloads), F.try_variant_get("doc", "$.version", "int").alias("version"), uuid.alias("cluster_uuid"), "doc")


def connection_activity(connections_: DataFrame) -> DataFrame:
    """Active and total connections per endpoint."""
    return connections_.groupBy(*stamp_of(connections_)[:-1]).agg(F.count_if("active").alias("active"), F.count("*").alias("total"))


def config_paths(configs: DataFrame, doc: str = "doc") -> DataFrame:
    """(stamp, path, kind, value): every scalar of the documents with its path, ``$.a.b[0].c``; empty objects and arrays are left out.

    A recursive query takes documents apart one level a step, so any depth is read; its limit of rows is lifted for the session.
    """
    spark, stamp = configs.sparkSession, stamp_of(configs)
    spark.conf.set("spark.sql.cteRecursionRowLimit", -1)
    name, own = f"configs_{uuid.uuid4().hex}", ", ".join(stamp)
    configs.select(*stamp, F.col(doc).alias("doc")).createOrReplaceTempView(name)
    walked = spark.sql(f"""WITH RECURSIVE walk AS (
      SELECT {own}, '$' AS path, doc AS v FROM {name}
      UNION ALL
      SELECT {own}, concat(path, CASE WHEN e.key IS NULL THEN concat('[', e.pos, ']') ELSE concat('.', e.key) END), e.value
      FROM walk, LATERAL variant_explode(v) e)
    SELECT {own}, path, schema_of_variant(v) AS kind, v FROM walk""")
    leaf = ~F.startswith("kind", F.lit("OBJECT")) & ~F.startswith("kind", F.lit("ARRAY"))
    return walked.where(leaf).select(*stamp, "path", "kind", F.try_variant_get("v", "$", "string").alias("value"))
