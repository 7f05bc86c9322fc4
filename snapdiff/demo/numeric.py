"""Counters, gauges, latencies, statements and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.filters import mark_category
from ..operators import catalog as C
from ..operators import numeric as N
from ..operators.summary import add_summaries
from . import adapters as A
from .registry import query


def ev_sql(cuts: tuple[str, ...] = A.CUTS) -> str:
    values = ", ".join(f"({i}, TIMESTAMP '{c}')" for i, c in enumerate(cuts))
    return f"""cuts(snapshot_id, cut) AS (VALUES {values}),
ev AS (SELECT snapshot_id, cut, 'h' || CAST(user_id % 5 AS VARCHAR) AS hostname_port, CASE WHEN user_id % 2 = 0 THEN 'table' ELSE 'server' END AS metric_type,
  CAST(user_id AS VARCHAR) AS metric_id, event_type AS name, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents,
  CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events JOIN cuts ON ts < cut GROUP BY ALL)"""


EV = ev_sql()
MS = "864000000"  # ten days
CAT = "cat(name, unit, suffix, kind, divisor) AS (VALUES " + ", ".join(str(r) for r in A.CATALOG_ROWS) + ")"
ROLL = "CASE WHEN metric_type = 'table' THEN '-' ELSE metric_id END"
KEYS = "hostname_port, metric_type, metric_id, name"


def _two(value: str, key: str = ROLL, extra: str = "", source: str = "ev") -> str:
    """Begin and end of each series, rolled up."""
    return f"two AS (SELECT hostname_port, metric_type, {key} AS metric_id, name, CAST(coalesce(sum({value}) FILTER (snapshot_id = 0), 0) AS BIGINT) AS b, CAST(coalesce(sum({value}) FILTER (snapshot_id = 1), 0) AS BIGINT) AS e{extra} FROM {source} GROUP BY ALL)"


_VALUE = f"SELECT {KEYS}, e - b AS delta, coalesce(unit, '?') AS unit, CAST(e - b AS DOUBLE) / CAST({MS} AS DOUBLE) * 1000 AS rate FROM two LEFT JOIN cat USING (name) WHERE e > 0 AND coalesce(kind, '?') <> 'gauge' AND e <> b"


def _value(s, d, **o):
    return N.value_diff(A.counters(s, d), A.snapshots(s), 0, 1, A.catalog(s), **o).drop("namespace", "table_name")


query("value_diff", f"WITH {EV}, {CAT}, {_two('n')} {_VALUE}")(lambda s, d: _value(s, d))
query("regex_filters", f"WITH {EV}, {CAT}, keep AS (SELECT * FROM ev WHERE regexp_matches(hostname_port, '[123]') AND regexp_matches(name, 'i') AND regexp_matches('ns.t' || metric_id, 't1')), {_two('n', source='keep')} {_VALUE}")(lambda s, d: _value(s, d, host="[123]", stat="i", table="t1"))


@query("value_diff_detail", f"WITH {EV}, {CAT}, {_two('n', 'metric_id')} SELECT *, 'ns.t' || metric_id AS label FROM ({_VALUE})")
def value_diff_detail(s, d):
    from ..functions.columns import table_label

    out = N.value_diff(A.counters(s, d), A.snapshots(s), 0, 1, A.catalog(s), details=True)
    return out.withColumn("label", table_label(F.col("namespace"), F.col("table_name"))).drop("namespace", "table_name")


@query("gauge_diff", f"WITH {EV}, {CAT}, {_two('n')} SELECT {KEYS}, e AS value, e - b AS delta, unit FROM two JOIN cat USING (name) WHERE e > 0 AND kind = 'gauge'")
def gauge_diff(s, d):
    return N.gauge_diff(A.counters(s, d), A.snapshots(s), 0, 1, A.catalog(s))


_COUNTSUM = f"""two AS (SELECT hostname_port, metric_type, {ROLL} AS metric_id, name,
  CAST(greatest(coalesce(sum(n) FILTER (snapshot_id = 1), 0) - coalesce(sum(n) FILTER (snapshot_id = 0), 0), 0) AS BIGINT) AS c,
  CAST(coalesce(sum(cents) FILTER (snapshot_id = 1), 0) - coalesce(sum(cents) FILTER (snapshot_id = 0), 0) AS BIGINT) AS t, coalesce(sum(n) FILTER (snapshot_id = 1), 0) AS e FROM ev GROUP BY ALL)"""


@query("countsum_diff", f'WITH {EV}, {_COUNTSUM} SELECT {KEYS}, c AS "count", CAST(c AS DOUBLE) / CAST({MS} AS DOUBLE) * 1000 AS rate, t AS "sum", t < 0 AS reset, CASE WHEN t >= 0 THEN t // c END AS avg FROM two WHERE e > 0 AND c <> 0')
def countsum_diff(s, d):
    return N.countsum_diff(A.counters(s, d), A.snapshots(s), 0, 1)


@query("countsumrows_diff", f"""WITH {EV}, d AS (SELECT {KEYS}, coalesce(sum(n) FILTER (snapshot_id = 1), 0) - coalesce(sum(n) FILTER (snapshot_id = 0), 0) AS c,
 coalesce(sum(cents) FILTER (snapshot_id = 1), 0) - coalesce(sum(cents) FILTER (snapshot_id = 0), 0) AS t, coalesce(sum(k) FILTER (snapshot_id = 1), 0) - coalesce(sum(k) FILTER (snapshot_id = 0), 0) AS r FROM ev GROUP BY ALL)
SELECT {KEYS}, CAST(c AS BIGINT) AS "count", CAST(t AS DOUBLE) / 1000.0::DOUBLE / CAST(c AS DOUBLE) AS avg_ms, CAST(t AS DOUBLE) / 1000.0::DOUBLE AS total_ms, CAST(CAST(r AS BIGINT) // CAST(c AS BIGINT) AS BIGINT) AS avg_rows, CAST(r AS BIGINT) AS "rows" FROM d WHERE c > 0""")
def countsumrows_diff(s, d):
    return N.countsumrows_diff(A.counters(s, d), A.snapshots(s), 0, 1)


@query("scope_rollup", f"WITH {EV} SELECT snapshot_id, hostname_port, metric_type, {ROLL} AS metric_id, name, CAST(sum(n) AS BIGINT) AS value, count(*) AS objects FROM ev GROUP BY ALL")
def scope_rollup(s, d):
    rolled = N.roll_up_scope(A.counters(s, d).where("kind = 'value'"))
    return rolled.groupBy("snapshot_id", *N.SERIES).agg(F.sum("value").alias("value"), F.count("*").alias("objects"))


@query("duplicate_keys", f"""WITH {EV}, dup AS (SELECT *, 0 AS pos FROM ev UNION ALL SELECT * REPLACE (n + 1 AS n), 1 AS pos FROM ev WHERE CAST(metric_id AS BIGINT) % 3 = 0)
SELECT hostname_port, metric_type, {ROLL} AS metric_id, name,
 CAST(coalesce(CASE WHEN metric_type = 'table' THEN sum(n) FILTER (snapshot_id = 0) ELSE arg_min(n, pos) FILTER (snapshot_id = 0) END, 0) AS BIGINT) AS b_value, CAST(coalesce(sum(n) FILTER (snapshot_id = 1), 0) AS BIGINT) AS e_value,
 greatest(count(*) FILTER (snapshot_id = 0), count(*) FILTER (snapshot_id = 1)) AS dup_count FROM dup GROUP BY hostname_port, metric_type, 3, name""")
def duplicate_keys(s, d):
    rows = N.roll_up_scope(A.doubled(A.counters(s, d).where("kind = 'value'")))
    return N.align(rows, list(N.SERIES), ["value"], 0, 1).drop("b_at", "e_at").na.fill(0, ["b_value", "e_value"])


@query("catalog_lookup", f"WITH {EV}, {CAT} SELECT DISTINCT name, coalesce(unit, '?') AS unit, coalesce(suffix, '?') AS suffix, coalesce(kind, '?') AS kind, coalesce(divisor, 1) AS divisor FROM ev LEFT JOIN cat USING (name)")
def catalog_lookup(s, d):
    return C.with_catalog(A.table(s, d, "events").select(F.col("event_type").alias("name")).distinct(), A.catalog(s))


_ST = f"""st AS (SELECT snapshot_id, hostname_port, 'select ''' || name || '''' AS query, sum(n) AS calls, sum(cents) AS total_time, sum(k) AS r FROM ev GROUP BY ALL),
two AS (SELECT hostname_port, query, CAST(coalesce(sum(calls) FILTER (snapshot_id = 1), 0) - coalesce(sum(calls) FILTER (snapshot_id = 0), 0) AS BIGINT) AS calls,
 CAST(coalesce(sum(total_time) FILTER (snapshot_id = 1), 0) - coalesce(sum(total_time) FILTER (snapshot_id = 0), 0) AS BIGINT) AS total_time, CAST(coalesce(sum(r) FILTER (snapshot_id = 1), 0) - coalesce(sum(r) FILTER (snapshot_id = 0), 0) AS BIGINT) AS r FROM st GROUP BY ALL)"""


@query("statements_diff", f"""WITH {EV}, {_ST} SELECT hostname_port, replace(query, '''', '\\''') AS query, calls, CAST(total_time AS DOUBLE) / CAST(calls AS DOUBLE) AS avg_time, total_time, r // calls AS avg_rows, r AS "rows" FROM two WHERE calls <> 0""")
def statements_diff(s, d):
    from ..functions.columns import cut_text

    return N.statements_diff(A.statements(s, d), A.snapshots(s), 0, 1).withColumn("query", cut_text(F.col("query")))


_SIX = ev_sql(A.DAILY)
_RATES = f"""{_SIX}, lagged AS (SELECT {KEYS}, cut AS captured_at, n, lag(n) OVER w AS p, lag(cut) OVER w AS q FROM ev WINDOW w AS (PARTITION BY {KEYS} ORDER BY cut)),
rates AS (SELECT {KEYS}, captured_at, CASE WHEN n < p THEN n ELSE n - p END AS delta, n < p AS reset, CAST(epoch_ms(captured_at) - epoch_ms(q) AS DOUBLE) AS ms FROM lagged WHERE q IS NOT NULL)"""


def rates(s, d):
    return N.series_rates(A.counters(s, d, A.DAILY).where("kind = 'value'"))


query("series_rates", f"WITH {_RATES} SELECT {KEYS}, captured_at, delta, CAST(delta AS DOUBLE) / ms * 1000 AS rate, reset FROM rates")(rates)


@query("windowed_rates", f"WITH {_RATES} SELECT time_bucket(INTERVAL 8 DAYS, captured_at, TIMESTAMP '1970-01-01') AS window_start, {KEYS}, CAST(sum(delta) AS BIGINT) AS delta, count(*) AS n FROM rates GROUP BY ALL")
def windowed_rates(s, d):
    return N.windowed_rates(rates(s, d), "8 days")


@query("top_series", f"WITH {EV}, {CAT}, {_two('n')} {_VALUE} ORDER BY rate DESC, {KEYS} LIMIT 20")
def top_series(s, d):
    return N.top_series(_value(s, d), 20)


# ---- samples

_SAMPLES = f"""{EV}, base AS (SELECT snapshot_id, cut, hostname_port, metric_id, CASE name WHEN 'view' THEN 'idle' WHEN 'click' THEN 'user' WHEN 'purchase' THEN 'system' WHEN 'signup' THEN 'iowait' WHEN 'error' THEN 'steal' END AS state, CAST(n AS DOUBLE) AS value FROM ev),
other AS (SELECT *, CASE state WHEN 'idle' THEN 'node_softnet_processed_total' WHEN 'user' THEN 'node_softnet_dropped_total' WHEN 'system' THEN 'node_schedstat_running_seconds_total' WHEN 'iowait' THEN 'node_schedstat_timeslices_total' ELSE 'go_threads' END AS name FROM base),
samples AS (SELECT snapshot_id, cut, hostname_port, 'node_cpu_seconds_total' AS name, '_' || metric_id || '_' || state AS labels, 'counter' AS exporter_type, value, state FROM base
 UNION ALL SELECT snapshot_id, cut, hostname_port, name, '_' || metric_id, CASE WHEN name = 'go_threads' THEN 'gauge' ELSE 'counter' END, value, NULL FROM other),
marked AS (SELECT *, CASE WHEN starts_with(name, 'process_') OR starts_with(name, 'promhttp_') OR starts_with(name, 'go_') OR starts_with(name, 'node_scrape_collector_') OR contains(name, 'dm-') OR contains(labels, 'dm-') THEN 'detail' ELSE 'all' END AS category FROM samples)"""


@query("sample_categories", f"WITH {_SAMPLES} SELECT snapshot_id, name, category, count(*) AS n FROM marked GROUP BY ALL")
def sample_categories(s, d):
    return mark_category(A.samples(s, d)).groupBy("snapshot_id", "name", "category").agg(F.count("*").alias("n"))


def summarised(s, d, metrics=None):
    return add_summaries(mark_category(A.samples(s, d, metrics)))


def _summary(prefix: str):
    return lambda s, d: summarised(s, d).where(F.startswith("name", F.lit(prefix)) & (F.col("category") == "summary")).select("snapshot_id", "hostname_port", "name", "labels", "value")


query("cpu_summary", f"WITH {_SAMPLES} SELECT snapshot_id, hostname_port, name, '_' || state AS labels, sum(value) AS value FROM samples WHERE name = 'node_cpu_seconds_total' GROUP BY ALL")(_summary("node_cpu"))
query("softnet_summary", f"WITH {_SAMPLES} SELECT snapshot_id, hostname_port, name, '' AS labels, sum(value) AS value FROM samples WHERE starts_with(name, 'node_softnet_') GROUP BY ALL")(_summary("node_softnet"))
query("schedstat_summary", f"WITH {_SAMPLES} SELECT snapshot_id, hostname_port, name, '' AS labels, sum(value) AS value FROM samples WHERE starts_with(name, 'node_schedstat_') GROUP BY ALL")(_summary("node_schedstat"))


@query("sample_counter_diff", f"""WITH {_SAMPLES}, s AS (SELECT snapshot_id, hostname_port, name, CASE WHEN state IS NULL THEN '' ELSE '_' || state END AS labels, sum(value) AS value FROM samples WHERE exporter_type = 'counter' GROUP BY ALL),
two AS (SELECT hostname_port, name, labels, coalesce(sum(value) FILTER (snapshot_id = 1), 0) - coalesce(sum(value) FILTER (snapshot_id = 0), 0) AS delta FROM s GROUP BY ALL)
SELECT *, delta / CAST(864000 AS DOUBLE) AS rate FROM two WHERE delta <> 0""")
def sample_counter_diff(s, d):
    return N.sample_counter_diff(summarised(s, d), A.snapshots(s), 0, 1)


@query("sample_detail_diff", f"""WITH {_SAMPLES}, s AS (SELECT snapshot_id, hostname_port, name, labels, value FROM samples WHERE exporter_type = 'counter'
 UNION ALL SELECT snapshot_id, hostname_port, name, CASE WHEN state IS NULL THEN '' ELSE '_' || state END, sum(value) FROM samples WHERE exporter_type = 'counter' GROUP BY ALL),
two AS (SELECT hostname_port, name, labels, coalesce(sum(value) FILTER (snapshot_id = 1), 0) - coalesce(sum(value) FILTER (snapshot_id = 0), 0) AS delta FROM s GROUP BY ALL)
SELECT *, delta / CAST(864000 AS DOUBLE) AS rate FROM two WHERE delta <> 0""")
def sample_detail_diff(s, d):
    """Sums and each CPU."""
    return N.sample_counter_diff(summarised(s, d), A.snapshots(s), 0, 1, details=True)


@query("sample_gauge_diff", f"WITH {_SAMPLES} SELECT hostname_port, name, labels, coalesce(sum(value) FILTER (snapshot_id = 1), 0) AS value, coalesce(sum(value) FILTER (snapshot_id = 1), 0) - coalesce(sum(value) FILTER (snapshot_id = 0), 0) AS delta FROM samples WHERE exporter_type = 'gauge' GROUP BY ALL")
def sample_gauge_diff(s, d):
    return N.sample_gauge_diff(mark_category(A.samples(s, d)), A.snapshots(s), 0, 1)




@query("statement_totals", f"WITH {EV} SELECT snapshot_id, hostname_port, 'select ' || chr(39) || name || chr(39) AS query, CAST(sum(n) AS BIGINT) AS calls, CAST(sum(cents) AS BIGINT) AS total_time, CAST(sum(k) AS BIGINT) AS rows_ FROM ev GROUP BY ALL")
def statement_totals(s, d):
    return N.statement_totals(A.statements(s, d)).drop("captured_at")


@query("inferred_units", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'us' WHEN 1 THEN 'bytes' WHEN 2 THEN 'count' ELSE '?' END AS unit FROM part")
def inferred_units(s, d):
    n = F.col("p_partkey") % 4
    name = F.concat("p_name", F.when(n == 0, "_us").when(n == 1, "_bytes").when(n == 2, "_count").otherwise("_x"))
    return A.table(s, d, "part").select("p_partkey", C.inferred_unit(name).alias("unit"))


@query("visible_samples", f"WITH {EV} SELECT hostname_port, name, kind FROM (SELECT DISTINCT hostname_port, name FROM ev), (VALUES ('gauge'), ('counter')) k(kind) WHERE name <> 'click' AND kind = 'counter'")
def visible_samples(s, d):
    """Without the switches no detail samples and no gauges show."""
    from ..functions.filters import apply_visibility

    m = A.counters(s, d).where("kind = 'value'").select("hostname_port", "name").distinct()
    kinds = m.select("*", F.explode(F.array(F.lit("gauge"), F.lit("counter"))).alias("kind"), F.when(F.col("name") == "click", "detail").otherwise("all").alias("category"))
    return apply_visibility(kinds).drop("category")
