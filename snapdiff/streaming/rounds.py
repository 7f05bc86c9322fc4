"""Live diffs of whole rounds: every dataset of two neighbour snapshots, as soon as both are whole.

Captures are filed as snapshots (``sources.store.snapshot_sink``); a snapshot is a row of the list, written last, so a round that is
listed is whole. The list is read as a stream. One processor keeps the open rounds of each cluster in map state
and closes them in the order of their times when the watermark has passed them, so a round that comes late, but within the delay, takes its
place between its neighbours. A closed round and the one before it are compared by the batch operators, so names come from the right side,
each side has its own leader, and state stays a few bytes a round however large the hierarchy is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from ..plans import reports as R
from ..sources import store as S


class _Rounds(StatefulProcessor):
    """Map state: the times of open rounds by number. Value state: the round that was closed last."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "round int", "at long")
        self.last = handle.getValueState("last", "round int")

    def _pairs(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["cluster_id", "begin", "end", "at"]).astype({"begin": "int32", "end": "int32", "at": "int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        for pdf in rows:
            for number, at in zip(pdf["round"].tolist(), pdf["at_ms"].tolist(), strict=True):
                self.open.updateValue((number,), (at,))
                self.handle.registerTimer(at)
        yield self._pairs([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        due = sorted((at, number) for (number,), (at,) in self.open.iterator() if at <= expiredTimerInfo.getExpiryTimeInMs())
        out = []
        for at, number in due:
            if self.last.exists():
                out.append((*key, self.last.get()[0], number, at))
            self.last.update((number,))
            self.open.removeKey((number,))
        yield self._pairs(out)

    def close(self) -> None:
        pass


def round_pairs(listed: DataFrame, delay: str = "10 minutes", needs: tuple[str, ...] = ()) -> DataFrame:
    """(cluster_id, begin, end, at) of neighbour rounds of a stream of list rows; ``needs`` names datasets that a round must have.

    Rounds that come more than ``delay`` behind the newest are dropped. Needs the RocksDB state store.
    """
    own = listed
    for name in needs:
        own = own.where(F.coalesce(F.map_contains_key("datasets", F.lit(name)), F.lit(False)))
    cluster = F.col("cluster_id") if "cluster_id" in listed.columns else F.lit("")
    at = F.col("ts").cast("timestamp")
    rows = own.select(cluster.alias("cluster_id"), F.col("snapshot_id").alias("round"), at.alias("at"), F.unix_millis(at).alias("at_ms")).withWatermark("at", delay)
    return rows.groupBy("cluster_id").transformWithStateInPandas(_Rounds(), "cluster_id string, begin int, end int, at long", "Append", "EventTime")


def stored_tables(spark: SparkSession, path: str, begin: int, end: int) -> dict[str, DataFrame]:
    """The datasets that either snapshot has, cut to the two, and the list of snapshots."""
    rows = S.listed(spark, path).where(F.col("snapshot_id").isin(begin, end)).select(F.explode(F.map_keys("datasets")).alias("d")).distinct()
    return {r.d: S.read_snapshot(spark, path, r.d, [begin, end]) for r in rows.collect()} | {"snapshots": S.snapshot_list(spark, path)}


def report_sink(path: str, out: str, tables: Callable[..., dict[str, DataFrame]] = stored_tables, **options) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` over ``round_pairs``: the diff report of each pair, under its end; a repeated batch writes the same partitions again."""

    def put(pairs: DataFrame, batch: int) -> None:
        spark = pairs.sparkSession
        for r in sorted(pairs.collect(), key=lambda r: (r["at"], r.end)):  # a row for each closed round
            report = R.diff_report(tables(spark, path, r.begin, r.end), r.begin, r.end, **options)
            rows = report.withColumns({"begin_id": F.lit(r.begin), "end_id": F.lit(r.end)})
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("end_id").parquet(out)

    return put


def live_reports(spark: SparkSession, path: str, out: str, delay: str = "10 minutes", needs: tuple[str, ...] = (), files: int | None = None, **options) -> DataStreamWriter:
    """A writer that follows the list of the store at ``path`` and adds each pair's report to ``out``; start it with a checkpoint and a trigger."""
    reader = spark.readStream.schema(S.LISTED)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    pairs = round_pairs(reader.parquet(f"{path}/snapshots"), delay, needs)
    return pairs.writeStream.foreachBatch(report_sink(path, out, **options)).outputMode("append")
