"""The metric catalog: name to unit, suffix, kind and divisor, given by the user or inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CATALOG = "name string, unit string, suffix string, kind string, divisor long"
BROADCAST_ROWS = 100_000


def checked(catalog: DataFrame) -> DataFrame:
    """Equal rows once; an error where one name has different rows."""
    row = F.struct(*[c for c in catalog.columns if c != "name"])
    one = catalog.groupBy("name").agg(F.min(row).alias("low"), F.max(row).alias("high"))
    differ = F.raise_error(F.concat(F.lit("catalog rows differ for "), F.col("name")))
    return one.select("name", F.when(F.col("low").eqNullSafe(F.col("high")), F.col("low")).otherwise(differ).alias("row")).select("name", "row.*")


def inferred_unit(name: Column) -> Column:
    """Unit by the name's suffix, for statistics outside a catalog."""
    rules = (("_us", "us"), ("_ms", "ms"), ("_bytes", "bytes"), ("_micros", "us"), ("_count", "count"), ("_sum", "sum"))
    unit = F.lit("?")
    for suffix, value in reversed(rules):
        unit = F.when(F.endswith(name, F.lit(suffix)), value).otherwise(unit)
    return unit


def with_catalog(df: DataFrame, catalog: DataFrame, small: bool = True) -> DataFrame:
    """Left join with the checked catalog; what it lacks has unit, suffix and kind ``?`` and divisor 1.

    A ``small`` catalog is broadcast; it is an error if it has over ``BROADCAST_ROWS`` rows, which the query itself counts. Larger
    ones are joined by a shuffle.
    """
    side = checked(catalog)
    if small:
        rows = catalog.limit(BROADCAST_ROWS + 1).agg(F.count("*")).scalar()
        side = F.broadcast(side.where(F.assert_true(rows <= BROADCAST_ROWS, F.lit("the catalog is not small")).isNull()))
    out = df.join(side, "name", "left")
    for c in ("unit", "suffix", "kind"):
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit("?")))
    return out.withColumn("divisor", F.coalesce("divisor", F.lit(1)).cast("long"))
