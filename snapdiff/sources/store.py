"""Snapshots on disk: Parquet by snapshot, and the list of them.

A snapshot is its row in the list, which is written last and says how many rows each dataset has.
Readers see the datasets of listed snapshots only, so a write that failed half way is not seen by
anyone; the next write of its number replaces the partitions that it left (dynamic partition overwrite).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CATALOG = "snapshot_id int, ts timestamp_ntz, comment string"
LISTED = f"{CATALOG}, datasets map<string,bigint>"


def listed(spark: SparkSession, path: str) -> DataFrame:
    """The list with ``datasets``, rows by dataset; null in lists that were kept otherwise."""
    return spark.read.schema(LISTED).parquet(f"{path}/snapshots")


def snapshot_list(spark: SparkSession, path: str) -> DataFrame:
    """The list that ``write_snapshot`` appends to."""
    return listed(spark, path).drop("datasets")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """A list kept as CSV (number, timestamp, comment)."""
    return spark.read.schema(CATALOG).csv(path, header=True)


def next_snapshot_id(snapshots: DataFrame) -> int:
    """One more than the highest; the first is 0."""
    top = snapshots.agg(F.max("snapshot_id")).first()[0]
    return 0 if top is None else top + 1


def resolve_pair(snapshots: DataFrame, begin: int, end: int) -> DataFrame:
    """The rows of both snapshots; ValueError if one is missing."""
    pair = snapshots.where(F.col("snapshot_id").isin(begin, end))
    found = {r[0] for r in pair.select("snapshot_id").distinct().collect()}  # at most two rows
    if missing := {begin, end} - found:
        raise ValueError(f"no snapshot {sorted(missing)}")
    return pair


def _file(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path, as Spark's writers see them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _known(spark: SparkSession, path: str) -> DataFrame:
    """The list, empty where nothing was written yet."""
    files, at = _file(spark, f"{path}/snapshots")
    return listed(spark, path) if files.exists(at) else spark.createDataFrame([], LISTED)


def _claim(spark: SparkSession, path: str, number: int) -> bool:
    """Take a number, so that of two writers at once each has its own; False if it is taken."""
    files, at = _file(spark, f"{path}/_claims/{number}")
    return files.createNewFile(at)


def _release(spark: SparkSession, path: str, number: int) -> None:
    files, at = _file(spark, f"{path}/_claims/{number}")
    files.delete(at, False)


def write_snapshot(spark: SparkSession, tables: dict[str, DataFrame], path: str, comment: str = "", ts: str | None = None, number: int | None = None) -> int:
    """Store each dataset under one number, sorted for pruning, and list the snapshot last, all or nothing.

    The number is the next one that no other writer holds; with ``number`` (a batch of a stream) a snapshot that
    is listed already is left as it is, so that a repeated batch changes nothing. If a dataset fails, the number is given back and the
    list is untouched: what was written is not seen, and is replaced by the next snapshot of that number.
    """
    known = _known(spark, path)
    if number is None:
        number = next_snapshot_id(known)
        while not _claim(spark, path, number):
            number += 1
    elif not known.where(F.col("snapshot_id") == number).isEmpty():
        return number
    counts = {}
    try:
        for name, df in tables.items():
            order = [c for c in ("metric_type", "name", "hostname_port") if c in df.columns]
            seen = Observation()
            rows = df.drop("snapshot_id").withColumn("snapshot_id", F.lit(number)).observe(seen, F.count(F.lit(1)).alias("n"))
            if order:
                rows = rows.sortWithinPartitions(*order)
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(f"{path}/{name}")
            counts[name] = seen.get["n"]
        when = F.lit(ts).cast("timestamp_ntz") if ts else F.localtimestamp()
        own = F.create_map(*[x for k, v in counts.items() for x in (F.lit(k), F.lit(v).cast("bigint"))]) if counts else F.create_map().cast("map<string,bigint>")
        line = spark.range(1).select(F.lit(number).alias("snapshot_id"), when.alias("ts"), F.lit(comment).alias("comment"), own.alias("datasets"))
        line.write.mode("append").parquet(f"{path}/snapshots")
    except BaseException:
        _release(spark, path, number)
        raise
    return number


def read_snapshot(spark: SparkSession, path: str, dataset: str, ids: list[int] | None = None) -> DataFrame:
    """A dataset of listed snapshots, all or some; a partition filter, so other snapshots are not read."""
    shown = listed(spark, path).where(F.col("datasets").isNull() | (F.try_element_at("datasets", F.lit(dataset)) > 0))
    df = spark.read.parquet(f"{path}/{dataset}")
    if ids is None:
        return df.join(shown.select("snapshot_id"), "snapshot_id", "left_semi")
    found = [r[0] for r in shown.where(F.col("snapshot_id").isin(*ids)).select("snapshot_id").distinct().collect()]  # of the few asked for
    return df.where(F.col("snapshot_id").isin(*found))


def snapshot_sink(path: str, tables: Callable[[DataFrame], dict[str, DataFrame]], comment: str = "") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: files each micro-batch of payloads as the snapshot of the batch's number.

    ``tables`` makes the datasets of the batch's payloads; one stream of payloads feeds them all. A batch that a killed run left half
    written is written again whole by the next run, and one that was listed is left alone: each row is there once.
    The snapshot's time is the batch's last capture.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # a batch's payloads are read once for all datasets
        try:
            at = batch.agg(F.max("captured_at").cast("timestamp_ntz").cast("string")).first()[0]
            write_snapshot(batch.sparkSession, tables(batch), path, comment, at, number)
        finally:
            batch.unpersist()

    return put


def read_json_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A dataset stored as one JSON array per file."""
    return spark.read.schema(schema).json(path, multiLine=True)


#: What the tables of a hierarchy are bucketed by: rows that are joined or compared lie in the same bucket.
BUCKETED = {"tables": "table_id", "tablets": "tablet_id", "replicas": "tablet_id"}


def write_bucketed(tables: dict[str, DataFrame], name: str, buckets: int = 64) -> dict[str, DataFrame]:
    """The hierarchy as tables ``<name>_<dataset>`` of the session's catalog, each in ``buckets`` sorted buckets by tablet (or table).

    Diffs of tablets and replicas over them join and compare without moving rows of tablets and replicas: set
    ``spark.sql.requireAllClusterKeysForCoPartition`` to false, so that a join on snapshot and tablet is served by buckets of the tablet.
    """
    out = {}
    for dataset, df in tables.items():
        writer = df.write.mode("overwrite").format("parquet")
        if dataset in BUCKETED:
            key = BUCKETED[dataset]
            writer = writer.bucketBy(buckets, key).sortBy(key)
        writer.saveAsTable(f"{name}_{dataset}")
        out[dataset] = df.sparkSession.table(f"{name}_{dataset}")
    return out


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark is local."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-store-")
    return f"{base.rstrip('/')}/store-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """The rows written to a new folder of ``scratch_dir`` and read back: what several branches of a plan use is made once."""
    path = f"{scratch_dir(df.sparkSession)}-{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled_all(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``settled`` for several tables, whose jobs run side by side."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target

    spark = next(iter(tables.values())).sparkSession
    with ThreadPoolExecutor(max(1, len(tables))) as pool:
        each = {k: pool.submit(inheritable_thread_target(spark)(settled), v, k) for k, v in tables.items()}
        return {k: f.result() for k, f in each.items()}
