"""Row filters and derived text columns of facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import table_label

#: Sample names that belong to the exporter itself.
DETAIL_PREFIXES = ("process_", "promhttp_", "go_", "node_scrape_collector_")


def match_filters(df: DataFrame, host: str | None = None, stat: str | None = None, table: str | None = None) -> DataFrame:
    """Rows whose host, statistic and table match; a pattern matches anywhere, None matches all."""
    for pattern, col in ((host, F.col("hostname_port")), (stat, F.col("name")), (table, table_label(F.col("namespace"), F.col("table_name")) if table else None)):
        if pattern is not None:
            df = df.where(col.rlike(pattern))
    return df


def severity_filter(lines: DataFrame, levels: str = "WEF") -> DataFrame:
    return lines.where(F.col("severity").isin(*levels))


def text_filter(lines: DataFrame, pattern: str | None) -> DataFrame:
    """Log lines whose message or source matches."""
    return lines if pattern is None else lines.where(F.col("message").rlike(pattern) | F.col("source").rlike(pattern))


def mark_category(samples: DataFrame) -> DataFrame:
    """Adds ``category``: ``detail`` for the exporter's own and for device-mapper samples, else ``all``."""
    own = F.lit(False)
    for prefix in DETAIL_PREFIXES:
        own = own | F.startswith("name", F.lit(prefix))
    return samples.withColumn("category", F.when(own | F.contains("name", F.lit("dm-")) | F.contains("labels", F.lit("dm-")), "detail").otherwise("all"))


def apply_visibility(df: DataFrame, details: bool = False, gauges: bool = False) -> DataFrame:
    """Without ``details``: no detail samples and no default settings; without ``gauges``: no gauges."""
    if not details:
        if "category" in df.columns:
            df = df.where("category <> 'detail'")
        if "var_type" in df.columns:
            df = df.where("var_type <> 'Default'")
    if not gauges and "kind" in df.columns:
        df = df.where("kind <> 'gauge'")
    return df


def call_label(calls: DataFrame) -> DataFrame:
    """Adds ``label``: the statement, or ``BATCH (n)`` for a batch of several."""
    n = F.size("statements")
    return calls.withColumn("label", F.when(n > 1, F.format_string("BATCH (%d)", n)).when(n == 1, F.element_at("statements", 1)).otherwise(F.lit("")))


def backend_label(connections: DataFrame) -> DataFrame:
    """Adds ``peer``: the remote address, or ``background:<type>`` of a backend without one."""
    bare = F.coalesce("remote", F.lit("")) == ""
    return connections.withColumn("peer", F.when(bare, F.concat(F.lit("background:"), F.coalesce("backend_type", F.lit("")))).otherwise(F.col("remote")))
