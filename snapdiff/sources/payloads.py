"""Captured bodies: reading a landing directory, and setting aside what does not parse.

Layout: ``snapshot_id=<n>/dataset=<name>/<host>_<port>[@<time>].<ext>``; one row per file with host, port and time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BODY = T.StructType([T.StructField("value", T.StringType()), T.StructField("snapshot_id", T.IntegerType()), T.StructField("dataset", T.StringType())])


def read_payloads(spark: SparkSession, path: str, dataset: str | None = None, streaming: bool = False, manifest: DataFrame | None = None) -> DataFrame:
    """(snapshot_id, dataset, hostname_port, captured_at, body); partitions are pruned by dataset.

    The time of capture is the one in the file's name (``<host>_<port>@20240110T120000.ext``, UTC), else that of
    ``manifest (snapshot_id, dataset, hostname_port, captured_at)``, else the file's own, which copying changes.
    """
    reader = (spark.readStream if streaming else spark.read).schema(BODY).option("wholetext", True)
    rows = reader.format("text").load(path)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:@[0-9]{8}T[0-9]{6})?(?:\.[^.]*)?$", 1)
    host = F.regexp_replace(stem, "_([0-9]+)$", ":$1")
    named = F.try_to_timestamp(F.regexp_extract(F.col("_metadata.file_name"), r"@([0-9]{8}T[0-9]{6})(?:\.[^.]*)?$", 1), F.lit("yyyyMMdd'T'HHmmss"))
    out = rows.select("snapshot_id", "dataset", host.alias("hostname_port"), named.alias("named"), F.col("_metadata.file_modification_time").cast("timestamp").alias("written"), F.col("value").alias("body"))
    times = [F.col("named"), F.col("written")]
    if dataset is not None:
        out = out.where(F.col("dataset") == dataset)
    if manifest is not None:
        keys = ["snapshot_id", "dataset", "hostname_port"]
        known = manifest.groupBy(*keys).agg(F.min(F.col("captured_at").cast("timestamp")).alias("listed"))
        out, times = out.join(known, keys, "left"), [F.col("named"), F.col("listed"), F.col("written")]
    return out.select("snapshot_id", "dataset", "hostname_port", F.coalesce(*times).alias("captured_at"), "body")


STAMP = ("snapshot_id", "hostname_port", "object_id", "captured_at")


def stamp_of(payloads: DataFrame) -> list[str]:
    """The columns that say where a payload is from; cluster_id, and object_id for pages of one object, are optional."""
    return [c for c in ("cluster_id", *STAMP) if c in payloads.columns]


def spread(rows: DataFrame, key: str) -> DataFrame:
    """The rows dealt out by ``key`` to tasks for all cores: rows of a few bytes lie in few splits of a file, however costly the pages made of them are."""
    spark = rows.sparkSession
    return rows.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def parsed(payloads: DataFrame, schema: str) -> DataFrame:
    """Adds ``doc``: the body under the schema, null where it is no such JSON."""
    return payloads.withColumn("doc", F.from_json("body", schema, {"mode": "PERMISSIVE"}))


def quarantine(payloads: DataFrame, good: Column) -> DataFrame:
    """Payloads with a body that the reader of their dataset cannot use."""
    return payloads.where((F.coalesce(F.trim("body"), F.lit("")) != "") & ~F.coalesce(good, F.lit(False)))


#: How the plain dumps that are kept begin.
DUMPS = ("------------------------------------------------", "heap profile")


def raw_dumps(payloads: DataFrame, prefixes: tuple[str, ...] = DUMPS) -> DataFrame:
    """Bodies that begin with one of the prefixes, as they are."""
    known = F.lit(False)
    for p in prefixes:
        known = known | F.startswith("body", F.lit(p))
    return payloads.where(known).select(*stamp_of(payloads), "dataset", "body")
