"""Text payloads: exporter samples, flag text and log pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .payloads import stamp_of

_SAMPLE = r"^([A-Za-z_:][A-Za-z0-9_:]*)(?:\{(.*)\})?\s+([-+]?(?:[0-9.]+(?:[eE][-+]?[0-9]+)?|Inf|NaN))(?:\s+([0-9]+))?\s*$"
_TYPE = r"^# TYPE ([A-Za-z_:][A-Za-z0-9_:]*) (counter|gauge|untyped|summary|histogram)\s*$"
_HEADER = r"([IWEF])([0-9]{4}) ([0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{6})\s+([0-9]+) ([^\s\]]+:[0-9]+)\]"
_RECORD = rf"(?s)\A{_HEADER} ?([^\n]*)(?:\n(.*))?\z"


def prometheus_samples(payloads: DataFrame) -> DataFrame:
    """Counters and gauges; untyped samples are counters unless they are a ``_sum`` or ``_count``; others are dropped.

    A sample's type is that of the last ``# TYPE`` line before it, if that names its family. Labels are
    the sorted label values, each with ``_`` before it.
    """
    stamp = stamp_of(payloads)
    # a section is a type line and what follows it, so no order has to be kept over rows
    sections = payloads.select(*stamp, F.explode(F.split("body", r"\n(?=# TYPE )")).alias("section"))
    head = F.split_part("section", F.lit("\n"), F.lit(1))
    kind = F.when(head.rlike(_TYPE), F.struct(F.regexp_extract(head, _TYPE, 1).alias("family"), F.regexp_extract(head, _TYPE, 2).alias("type")))
    rows = sections.select(*stamp, kind.alias("t"), F.explode(F.split("section", "\n")).alias("line")).where(~F.startswith("line", F.lit("#")) & F.col("line").rlike(_SAMPLE))
    name = F.regexp_extract("line", _SAMPLE, 1)
    declared = F.when(F.col("t.family") == name, F.col("t.type")).when(F.startswith(name, F.col("t.family")) & F.col("t.type").isin("summary", "histogram"), F.col("t.type")).otherwise("untyped")
    exporter = F.when(declared.isin("counter", "gauge"), declared).when((declared == "untyped") & ~name.rlike("_(sum|count)$"), "counter")
    values = F.regexp_extract_all(F.regexp_extract("line", _SAMPLE, 2), F.lit(r'="((?:[^"\\]|\\.)*)"'), F.lit(1))
    labels = F.array_join(F.transform(F.array_sort(values), lambda v: F.concat(F.lit("_"), v)), "")
    number = F.regexp_extract("line", _SAMPLE, 3)
    value = F.when(number.endswith("Inf"), F.when(F.startswith(number, F.lit("-")), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))).otherwise(number.try_cast("double"))
    ts = F.timestamp_millis(F.regexp_extract("line", _SAMPLE, 4).try_cast("long"))
    return rows.select(*stamp, name.alias("name"), labels.alias("labels"), exporter.alias("exporter_type"), value.alias("value"), ts.alias("exporter_ts")).where("exporter_type IS NOT NULL")


def gflags(payloads: DataFrame) -> DataFrame:
    """Every ``--name=value`` line that ends with a newline; values may be empty or hold ``=``."""
    pattern = r"--([A-Za-z_0-9]+)=(.*)\n"
    pairs = F.arrays_zip(F.regexp_extract_all("body", F.lit(pattern), F.lit(1)).alias("name"), F.regexp_extract_all("body", F.lit(pattern), F.lit(2)).alias("value"))
    return payloads.select(*stamp_of(payloads), F.inline(pairs)).toDF(*stamp_of(payloads), "name", "value")


def _body(col: Column) -> Column:
    """The text of a log page; a page without a frame is text itself."""
    inner = F.regexp_extract(col, r"(?s)<pre>\n?(.*?)(?:</pre>|\z)", 1)
    text = F.when(F.contains(col, F.lit("<pre>")), inner).otherwise(col)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def log_lines(payloads: DataFrame, year: int | None = None) -> DataFrame:
    """One row per record: severity, ts, tid, source, message; lines without a header belong to the record before.

    The year is not in the text: it is ``year``, or that of the capture, one less where the time would be
    after the capture. The header's line and the next are joined without a newline. Lines before the
    first header are dropped. A record is one split of its payload: no window and no shuffle.
    """
    stamp = stamp_of(payloads)
    records = payloads.select(*stamp, F.posexplode(F.split(_body(F.col("body")), rf"\n(?={_HEADER})")).alias("record", "text")).where(F.col("text").rlike(_RECORD))
    part = lambda i: F.regexp_extract("text", _RECORD, i)
    at = lambda y: F.try_to_timestamp(F.concat(y.cast("string"), part(2), F.lit(" "), part(3)), F.lit("yyyyMMdd HH:mm:ss.SSSSSS"))
    capture = F.col("captured_at").cast("timestamp")
    this = F.lit(year) if year else F.year(capture)
    ts = at(this) if year else F.when(at(this) > capture, at(this - 1)).otherwise(at(this))
    message = F.regexp_replace(F.concat(part(6), part(7)), r"\s+$", "")
    return records.select(*stamp, "record", part(1).alias("severity"), ts.alias("ts"), part(4).cast("long").alias("tid"), part(5).alias("source"), message.alias("message"))


def new_log_lines(now: DataFrame, before: DataFrame, keys: tuple[str, ...] = ("ts", "hostname_port", "source")) -> DataFrame:
    """Records whose key the poll before did not have."""
    return now.join(before.select(*keys).distinct(), list(keys), "left_anti")
