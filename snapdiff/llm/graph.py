"""Connected components with DataFrame joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored


def _stamp(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, comp)`` for every node of ``edges (u, v)``: comp is the smallest node it reaches.

    Alternates large-star and small-star rounds, which need O(log^2 n) of them and move each
    edge a constant number of times; the minimum of a neighbourhood is an aggregate with
    map-side partials, so a node with a third of all links is no single task's list. Edges with
    a null end and self-loops are ignored; no edges give no rows.
    """
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _stamp(edges)
    for _ in range(rounds if before[0] else 0):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        # large star: neighbours above the centre go to its minimum
        large = both.join(low, F.col("u") == F.col("c")).where("v > c AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: the centre and its neighbours below go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c")
        small = large.join(least, F.col("u") == F.col("c")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = stored(small, "edges")
        after = _stamp(edges)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError("components did not settle")
    tops = edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(tops)
