"""Live twins: following logs, and diffs of a stream of captures."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.filters import severity_filter, text_filter
from ..sources.text_pages import log_lines

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def follow_logs(payloads: DataFrame, delay: str = "10 minutes", levels: str = "WEF", pattern: str | None = None, year: int | None = None) -> DataFrame:
    """New log records of a stream of captured pages: one for each time, host and source.

    Records that come later than ``delay`` behind the newest are dropped, and so is their state.
    """
    rows = text_filter(severity_filter(log_lines(payloads, year), levels), pattern)
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["ts", "hostname_port", "source"])


SERIES = ["hostname_port", "metric_type", "metric_id", "name"]


class _Deltas(StatefulProcessor):
    """State: the last time and values of a series. Rows of one key and batch come in any order."""

    def __init__(self, keys: list[str], values: list[str], ttl_ms: int | None):
        self.keys, self.values, self.ttl_ms = keys, values, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at timestamp, " + ", ".join(f"{v} double" for v in self.values), ttlDurationMs=self.ttl_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        row = initialState.sort_values("at").iloc[-1]
        self.last.update((row["at"], *[float(row[v]) for v in self.values]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        pdf = pd.concat(list(rows)).drop_duplicates("at").sort_values("at")
        before = tuple(self.last.get()) if self.last.exists() else None
        out = []
        for at, *now in pdf[["at", *self.values]].itertuples(index=False, name=None):
            if before is not None:
                if at <= before[0]:
                    continue
                fell = any(x < y for x, y in zip(now, before[1:], strict=True))
                deltas = now if fell else [x - y for x, y in zip(now, before[1:], strict=True)]
                out.append((*key, at, *deltas, (at - before[0]).total_seconds(), fell))
            before = (at, *now)
        if before is not None:
            self.last.update(before)
        yield pd.DataFrame(out, columns=[*self.keys, "captured_at", *self.values, "seconds", "reset"])

    def close(self) -> None:
        pass


def live_deltas(facts: DataFrame, keys: list[str], values: list[str], ttl: str | None = "1 hour", initial: DataFrame | None = None) -> DataFrame:
    """Per key and capture what was added to each value since the capture before it, and the seconds between.

    If any value of a series fell, it was restarted: all its values count from 0, and ``reset`` says so. ``initial`` holds facts of a
    stored snapshot, which a new stream starts from, so that the first poll has differences already; a stream that goes on from a
    checkpoint has its own state. Keys that are not seen for ``ttl`` leave the state; late captures (not newer than the state)
    are ignored. Needs the RocksDB state store.
    """
    shaped = lambda df: df.select(*keys, F.col("captured_at").cast("timestamp").alias("at"), *[F.col(v).cast("double").alias(v) for v in values]).dropna(subset=values)
    ttl_ms = int(pd.Timedelta(ttl).total_seconds() * 1000) if ttl else None
    schema = ", ".join([*[f"{k} string" for k in keys], "captured_at timestamp", *[f"{v} double" for v in values], "seconds double, reset boolean"])
    begun = None if initial is None else shaped(initial).groupBy(*keys)
    return shaped(facts).groupBy(*keys).transformWithStateInPandas(_Deltas(keys, values, ttl_ms), schema, "Append", "ProcessingTime" if ttl else "None", initialState=begun)


def live_diff(metrics: DataFrame, ttl: str | None = "1 hour", initial: DataFrame | None = None) -> DataFrame:
    """Counters: delta and rate of each series at each capture."""
    return live_deltas(metrics, SERIES, ["value"], ttl, initial).select(*SERIES, "captured_at", F.col("value").alias("delta"), (F.col("value") / F.col("seconds")).alias("rate"), "reset")


def live_countsum(metrics: DataFrame, ttl: str | None = "1 hour", initial: DataFrame | None = None) -> DataFrame:
    """Latencies: added count, per second, added sum, and the average, also after a restart, where both count from 0."""
    d = live_deltas(metrics, SERIES, ["total_count", "total_sum"], ttl, initial).where("total_count <> 0")
    average = F.floor(F.col("total_sum") / F.col("total_count")).cast("long")
    return d.select(*SERIES, "captured_at", F.col("total_count").alias("count"), (F.col("total_count") / F.col("seconds")).alias("rate"), F.col("total_sum").alias("sum"), average.alias("avg"), "reset")


def live_samples(samples: DataFrame, ttl: str | None = "1 hour", initial: DataFrame | None = None) -> DataFrame:
    """Exporter counters: change of each sample, and per second."""
    keys = ["hostname_port", "name", "labels"]
    counters = lambda df: df.where("exporter_type = 'counter'")
    d = live_deltas(counters(samples), keys, ["value"], ttl, None if initial is None else counters(initial)).where("value <> 0")
    return d.select(*keys, "captured_at", F.col("value").alias("delta"), (F.col("value") / F.col("seconds")).alias("rate"), "reset")


class _Changes(StatefulProcessor):
    """State: the last time and row of a key; a timer says when it counts as gone."""

    def __init__(self, keys: list[str], gone_ms: int):
        self.keys, self.gone_ms = keys, gone_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at timestamp, row string")

    def _rows(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[*self.keys, "captured_at", "change", "before", "after"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        pdf = pd.concat(list(rows)).sort_values(["at", "row"]).drop_duplicates("at")
        before = tuple(self.last.get()) if self.last.exists() else None
        out = []
        for at, row in zip(pdf["at"], pdf["row"], strict=True):
            if before is None:
                out.append((*key, at, "+", None, row))
            elif at <= before[0]:
                continue
            elif row != before[1]:
                out.append((*key, at, "=", before[1], row))
            before = (at, row)
        self.last.update(before)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(pd.Timestamp(before[0]).timestamp() * 1000) + self.gone_ms)
        yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        out = []
        if self.last.exists():
            at, row = self.last.get()
            out.append((*key, at, "-", row, None))
            self.last.clear()
        yield self._rows(out)

    def close(self) -> None:
        pass


def live_changes(facts: DataFrame, keys: list[str], fields: list[str], gone_after: str = "10 minutes", delay: str = "1 minute") -> DataFrame:
    """Live twin of ``change_diff``: ``+`` for a key that was not there, ``=`` for other fields, ``-`` for one not seen for ``gone_after``.

    ``before`` and ``after`` are the fields as JSON; of rows of one key and time the least counts.
    Time is that of the captures; a ``-`` has the time of the last capture that had the key.
    """
    rows = facts.select(*[F.col(k).cast("string").alias(k) for k in keys], F.col("captured_at").cast("timestamp").alias("at"), F.to_json(F.struct(*fields)).alias("row")).withWatermark("at", delay)
    schema = ", ".join([*[f"{k} string" for k in keys], "captured_at timestamp, change string, before string, after string"])
    gone = int(pd.Timedelta(gone_after).total_seconds() * 1000)
    return rows.groupBy(*keys).transformWithStateInPandas(_Changes(keys, gone), schema, "Append", "EventTime")


def windowed_rates(deltas: DataFrame, width: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sums of a stream of deltas per tumbling window and series."""
    keys = ["hostname_port", "metric_type", "metric_id", "name"]
    out = deltas.withWatermark("captured_at", delay).groupBy(F.window("captured_at", width).alias("w"), *keys).agg(F.sum("delta").alias("delta"), F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "delta", "n")
