"""Rows of JSON arrays read one by one: good rows flow, bad ones are kept apart, and both are counted.

A reader of whole bodies loses a body for one bad row. Here an element of the array is a VARIANT of its own, which
is cast by itself; what does not fit, and bodies that are no JSON or lack the array, are rows too, with a reason. One parse
makes both outputs: ``parsed_rows`` is stored, ``good_rows`` and ``bad_rows`` are filters over it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .payloads import stamp_of
from .store import settled


def parsed_rows(payloads: DataFrame, array: str, schema: str, keys: tuple[str, ...] = (), needs: tuple[str, ...] = (), seen: Observation | None = None) -> DataFrame:
    """(stamp, pos, row, element, reason): the elements of ``array`` (a path as ``$.flags``) under ``schema``.

    ``reason`` is null for good rows; else ``no json``, ``no array``, ``not a row`` (the element is no object), ``bad <field>`` (its value
    does not fit the schema), ``no <field>`` (a field of ``needs`` is null), or ``duplicate`` (a row before it in the payload has the same ``keys``). Empty bodies have no
    rows. ``seen`` observes the counts good, bad and duplicate when the result is computed.
    """
    stamp = stamp_of(payloads)
    body = payloads.where(F.trim(F.coalesce("body", F.lit(""))) != "").withColumn("doc", F.try_parse_json("body"))
    body = body.withColumn("each", F.try_variant_get("doc", array, "array<variant>"))
    broken = F.when(F.col("doc").isNull(), "no json").when(F.col("each").isNull(), "no array")
    rows = body.select(*stamp, "body", broken.alias("broken"), F.posexplode_outer("each").alias("pos", "v")).where("broken IS NOT NULL OR pos IS NOT NULL")
    row = F.try_variant_get("v", "$", f"struct<{schema}>")
    fields = StructType.fromDDL(schema).names
    kind = lambda f: F.schema_of_variant(F.try_variant_get("v", f"$.{f}", "variant"))
    misfits = F.array(*[row[f].isNull() & F.coalesce(kind(f) != "VOID", F.lit(False)) for f in fields])
    rows = rows.select(*stamp, "pos", row.alias("row"), misfits.alias("misfits"), F.when(F.col("broken").isNull(), F.to_json("v")).otherwise(F.col("body")).alias("element"), "broken")
    reason = F.coalesce(F.col("broken"), F.when(F.col("row").isNull(), "not a row"), *[F.when(F.col("misfits")[i], f"bad {f}") for i, f in enumerate(fields)])
    for n in needs:
        reason = F.coalesce(reason, F.when(F.col(f"row.{n}").isNull(), f"no {n}"))
    rows = rows.withColumn("reason", reason).drop("broken", "misfits")
    if keys:
        before = F.row_number().over(Window.partitionBy(*stamp, *[F.col(f"row.{k}") for k in keys], F.col("reason").isNull()).orderBy("pos")) > 1
        rows = rows.withColumn("reason", F.coalesce("reason", F.when(before, "duplicate")))
    if seen is not None:
        rows = rows.observe(seen, F.count_if(F.col("reason").isNull()).alias("good"), F.count_if(F.col("reason") != "duplicate").alias("bad"), F.count_if(F.col("reason") == "duplicate").alias("duplicate"))
    return rows


def stored_rows(payloads: DataFrame, array: str, schema: str, **options) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows) over one stored parse."""
    rows = settled(parsed_rows(payloads, array, schema, **options), "rows")
    return good_rows(rows), bad_rows(rows)


def good_rows(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason IS NULL").select(*stamp_of(parsed), "pos", "row.*")


def bad_rows(parsed: DataFrame) -> DataFrame:
    return parsed.where("reason IS NOT NULL").select(*stamp_of(parsed), "pos", "reason", "element")
