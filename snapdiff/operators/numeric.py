"""Diffs of counters, gauges, latencies, statements and samples between two snapshots.

A diff is one scan of the two snapshots and one conditional aggregate: no self-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import table_label
from ..functions.filters import match_filters
from .catalog import with_catalog

ROLLED = ("table", "tablet", "cdc", "cdcsdk")
SERIES = ("hostname_port", "metric_type", "metric_id", "name")


def begin_time(snapshots: DataFrame, begin: int) -> Column:
    """The begin snapshot's time, for keys that only the end has; a scalar subquery, so that no job runs while a plan is made."""
    return snapshots.where(F.col("snapshot_id") == begin).agg(F.min("ts")).scalar()


def roll_up_scope(metrics: DataFrame, details: bool = False) -> DataFrame:
    """Without details the objects of a host lose their id, so that they are summed per host."""
    if details:
        return metrics
    gone = F.col("metric_type").isin(*ROLLED)
    none = lambda c: F.when(gone, F.lit("-")).otherwise(F.col(c)).alias(c)
    return metrics.withColumns({c: none(c) for c in ("metric_id", "namespace", "table_name")})


def align(df: DataFrame, keys: list[str], values: list[str], begin: int, end: int, dup: str = "reference", keep: list[str] = ()) -> DataFrame:
    """One row per key with ``b_<value>``, ``e_<value>``, ``b_at``, ``e_at`` and ``dup_count``.

    ``dup="reference"``: of rows that share a key the begin side keeps the first (by ``pos``) unless
    their type is rolled up, the end side sums; ``dup="sum"``: both sum.
    """
    at_b, at_e = F.col("snapshot_id") == begin, F.col("snapshot_id") == end
    aggs = []
    for v in values:
        total = F.sum(F.when(at_b, F.col(v)))
        first = F.min_by(F.when(at_b, F.col(v)), F.when(at_b, F.col("pos"))) if dup == "reference" else total
        if dup == "reference" and "metric_type" in keys:
            first = F.when(F.first("metric_type").isin(*ROLLED), total).otherwise(first)
        aggs += [first.alias(f"b_{v}"), F.sum(F.when(at_e, F.col(v))).alias(f"e_{v}")]
    aggs += [F.min(F.when(at_b, F.col("captured_at"))).alias("b_at"), F.min(F.when(at_e, F.col("captured_at"))).alias("e_at")]
    aggs += [F.greatest(F.count_if(at_b), F.count_if(at_e)).alias("dup_count")]
    aggs += [F.max(c).alias(c) for c in keep]
    return df.where(at_b | at_e).groupBy(*keys).agg(*aggs)


def millis(begin: Column, end: Column) -> Column:
    return F.unix_millis(end.cast("timestamp")) - F.unix_millis(begin.cast("timestamp"))


def per_second(delta: Column, ms: Column) -> Column:
    return F.try_divide(delta.cast("double"), ms.cast("double")) * 1000


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0)).cast("long")


#: What is compared of each kind of metric.
VALUES = {"value": ("value",), "countsum": ("total_count", "total_sum"), "countsumrows": ("total_count", "total_sum", "rows_")}


def metric_pairs(metrics: DataFrame, snapshots: DataFrame, begin: int, end: int, kinds: tuple[str, ...] = tuple(VALUES), details: bool = False, host: str | None = None, stat: str | None = None, table: str | None = None) -> DataFrame:
    """One row per kind (``shape``) and series with ``b_`` and ``e_`` of its values, and ``ms`` between: one scan and one aggregate for all kinds.

    Of rows that share a key the begin side keeps the first (by ``pos``) unless their type is rolled up, the end side
    sums; statement statistics (``countsumrows``) are never rolled up nor filtered by table, and their end side keeps the last.
    """
    rows = match_filters(metrics.where(F.col("snapshot_id").isin(begin, end) & F.col("kind").isin(*kinds)), host, stat).withColumnRenamed("kind", "shape")
    plain = F.col("shape") == "countsumrows"
    if table is not None:
        rows = rows.where(plain | table_label(F.col("namespace"), F.col("table_name")).rlike(table))
    gone = ~plain & F.col("metric_type").isin(*(() if details else ROLLED))
    rows = rows.withColumns({c: F.when(gone, F.lit("-")).otherwise(F.col(c)) for c in ("metric_id", "namespace", "table_name")})
    at_b, at_e = F.col("snapshot_id") == begin, F.col("snapshot_id") == end
    summed = F.first("metric_type").isin(*ROLLED) & (F.first("shape") != "countsumrows")
    aggs = []
    for v in dict.fromkeys(v for k in kinds for v in VALUES[k]):
        here, there = F.when(at_b, F.col(v)), F.when(at_e, F.col(v))
        aggs += [F.when(summed, F.sum(here)).otherwise(F.min_by(here, F.when(at_b, F.col("pos")))).alias(f"b_{v}")]
        aggs += [F.when(F.first("shape") == "countsumrows", F.max_by(there, F.when(at_e, F.col("pos")))).otherwise(F.sum(there)).alias(f"e_{v}")]
    aggs += [F.min(F.when(at_b, F.col("captured_at"))).alias("b_at"), F.min(F.when(at_e, F.col("captured_at"))).alias("e_at"), F.max("namespace").alias("namespace"), F.max("table_name").alias("table_name")]
    out = rows.groupBy("shape", *SERIES).agg(*aggs)
    return out.withColumn("ms", millis(F.coalesce("b_at", begin_time(snapshots, begin)), F.col("e_at")))


Rule = tuple[Column, dict[str, Column]]


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _counter() -> Rule:
    """What shows of a pair, and as what; so for the other rules."""
    delta = _zero("e_value") - _zero("b_value")
    return (_zero("e_value") > 0) & (F.col("kind") != "gauge") & (delta != 0), {"namespace": F.col("namespace"), "table_name": F.col("table_name"), "delta": delta, "unit": F.col("unit"), "rate": per_second(delta, F.col("ms"))}


def _gauge() -> Rule:
    return (_zero("e_value") > 0) & (F.col("kind") == "gauge"), {"value": _zero("e_value"), "delta": _zero("e_value") - _zero("b_value"), "unit": F.col("unit")}


def _latency() -> Rule:
    count = F.greatest(_zero("e_total_count") - _zero("b_total_count"), F.lit(0))
    total = _zero("e_total_sum") - _zero("b_total_sum")
    return (_zero("e_total_count") > 0) & (count != 0), {"count": count, "rate": per_second(count, F.col("ms")), "sum": total, "reset": total < 0, "avg": F.when((total >= 0) & (count != 0), _div(total, F.nullif(count, F.lit(0))))}


def _statement() -> Rule:
    count, total, rows = (_zero(f"e_{v}") - _zero(f"b_{v}") for v in VALUES["countsumrows"])
    ms = total / F.lit(1000.0)
    return count > 0, {"count": count, "avg_ms": F.try_divide(ms, count), "total_ms": ms, "avg_rows": _div(rows, F.nullif(count, F.lit(0))), "rows": rows}


def _shown(pairs: DataFrame, rule: Rule) -> DataFrame:
    return pairs.where(rule[0]).select(*SERIES, *[c.alias(n) for n, c in rule[1].items()])


def value_diff(metrics: DataFrame, snapshots: DataFrame, begin: int, end: int, catalog: DataFrame, details: bool = False, small_catalog: bool = True, **filters) -> DataFrame:
    """Counters: what was added, and per second."""
    return _shown(with_catalog(metric_pairs(metrics, snapshots, begin, end, ("value",), details, **filters), catalog, small_catalog), _counter())


def gauge_diff(metrics: DataFrame, snapshots: DataFrame, begin: int, end: int, catalog: DataFrame, details: bool = False, small_catalog: bool = True, **filters) -> DataFrame:
    """Gauges: the value at the end, and its signed change, also if 0."""
    return _shown(with_catalog(metric_pairs(metrics, snapshots, begin, end, ("value",), details, **filters), catalog, small_catalog), _gauge())


def countsum_diff(metrics: DataFrame, snapshots: DataFrame, begin: int, end: int, details: bool = False, **filters) -> DataFrame:
    """Latencies: added count, per second, whole average and added sum; a fallen sum is a reset."""
    return _shown(metric_pairs(metrics, snapshots, begin, end, ("countsum",), details, **filters), _latency())


def countsumrows_diff(metrics: DataFrame, snapshots: DataFrame, begin: int, end: int, host: str | None = None, stat: str | None = None) -> DataFrame:
    """Statement statistics: never rolled up; of end rows that share a key the last (by ``pos``) counts."""
    return _shown(metric_pairs(metrics, snapshots, begin, end, ("countsumrows",), host=host, stat=stat), _statement())


#: Sections of a report that metrics make: the kind of metric, and the rule.
SECTIONS = {"values": ("value", _counter), "gauges": ("value", _gauge), "countsums": ("countsum", _latency), "countsumrows": ("countsumrows", _statement)}


def metric_sections(metrics: DataFrame, snapshots: DataFrame, begin: int, end: int, sections: tuple[str, ...] = tuple(SECTIONS), catalog: DataFrame | None = None, details: bool = False, small_catalog: bool = True, **filters) -> DataFrame:
    """(section, series, detail): all metric diffs from one scan and one aggregate; ``detail`` is JSON of what the section's own diff has."""
    pairs = metric_pairs(metrics, snapshots, begin, end, tuple(dict.fromkeys(SECTIONS[s][0] for s in sections)), details, **filters)
    if any(SECTIONS[s][0] == "value" for s in sections):
        pairs = with_catalog(pairs, catalog, small_catalog)
    section, detail = F.lit(None).cast("string"), F.lit(None).cast("string")
    for s in sections:
        kind, rule = SECTIONS[s]
        shown, fields = rule()
        own = (F.col("shape") == kind) & shown
        section = F.when(own, s).otherwise(section)
        detail = F.when(own, F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))).otherwise(detail)
    return pairs.select(section.alias("section"), *SERIES, detail.alias("detail")).where("section IS NOT NULL")


def statement_totals(statements: DataFrame, use_query_id: bool = False) -> DataFrame:
    """Calls, time and rows summed per snapshot, host and text."""
    keys = ["snapshot_id", "hostname_port", *(["query_id"] if use_query_id else []), "query"]
    return statements.groupBy(*keys).agg(F.sum("calls").alias("calls"), F.sum("total_time").alias("total_time"), F.sum("rows_").alias("rows_"), F.min("captured_at").alias("captured_at"))


def statements_diff(statements: DataFrame, snapshots: DataFrame, begin: int, end: int, use_query_id: bool = False) -> DataFrame:
    """Per statement: added calls, time and rows, signed; statements of a vanished host give negative rows."""
    keys = ["hostname_port", *(["query_id"] if use_query_id else []), "query"]
    a = align(statements.withColumn("pos", F.lit(0)), keys, ["calls", "total_time", "rows_"], begin, end, dup="sum")
    d = a.select(*keys, *[(F.coalesce(f"e_{v}", F.lit(0)) - F.coalesce(f"b_{v}", F.lit(0))).alias(n) for v, n in (("calls", "calls"), ("total_time", "total_time"), ("rows_", "rows"))]).where("calls <> 0")
    return d.select(*keys, "calls", (F.col("total_time") / F.col("calls")).alias("avg_time"), "total_time", F.expr("rows div calls").alias("avg_rows"), "rows")


def _samples(samples: DataFrame, begin: int, end: int, kind: str, host: str | None, stat: str | None) -> DataFrame:
    rows = match_filters(samples.where(F.col("exporter_type") == kind), host, stat)
    return align(rows, ["hostname_port", "name", "labels", "category"], ["value"], begin, end, dup="sum")


def sample_counter_diff(samples: DataFrame, snapshots: DataFrame, begin: int, end: int, details: bool = False, hide_summary: bool = False, host: str | None = None, stat: str | None = None) -> DataFrame:
    """Exporter counters: change, and change per whole second (null below one second)."""
    a = _samples(samples, begin, end, "counter", host, stat)
    a = a.where("category <> 'summary'" if details and hide_summary else "true" if details else "category <> 'detail'")
    delta = F.coalesce("e_value", F.lit(0.0)) - F.coalesce("b_value", F.lit(0.0))
    seconds = F.floor(millis(F.coalesce("b_at", begin_time(snapshots, begin)), F.col("e_at")) / 1000)
    return a.where(delta != 0).select("hostname_port", "name", "labels", delta.alias("delta"), F.try_divide(delta, seconds).alias("rate"))


def sample_gauge_diff(samples: DataFrame, snapshots: DataFrame, begin: int, end: int, host: str | None = None, stat: str | None = None) -> DataFrame:
    """Exporter gauges: value at the end and its change."""
    a = _samples(samples, begin, end, "gauge", host, stat)
    return a.select("hostname_port", "name", "labels", F.coalesce("e_value", F.lit(0.0)).alias("value"), (F.coalesce("e_value", F.lit(0.0)) - F.coalesce("b_value", F.lit(0.0))).alias("delta"))


def series_rates(metrics: DataFrame, keys: tuple[str, ...] = SERIES, value: str = "value", time: str = "captured_at") -> DataFrame:
    """Every series at every neighbour pair of snapshots: delta, rate, and reset where the counter fell."""
    w = Window.partitionBy(*keys).orderBy(time)
    rows = metrics.select(*keys, time, value).withColumns({"before": F.lag(value).over(w), "was": F.lag(time).over(w)}).where("was IS NOT NULL")
    reset = F.col(value) < F.col("before")
    delta = F.when(reset, F.col(value)).otherwise(F.col(value) - F.col("before"))
    return rows.select(*keys, time, delta.alias("delta"), per_second(delta, millis(F.col("was"), F.col(time))).alias("rate"), reset.alias("reset"))


def windowed_rates(rates: DataFrame, width: str, keys: tuple[str, ...] = SERIES, time: str = "captured_at") -> DataFrame:
    """Sums of deltas per tumbling window."""
    out = rates.groupBy(F.window(time, width).alias("w"), *keys).agg(F.sum("delta").alias("delta"), F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "delta", "n")


def top_series(diff: DataFrame, n: int = 20, by: str = "rate") -> DataFrame:
    return diff.orderBy(F.desc(by), *SERIES).limit(n)
