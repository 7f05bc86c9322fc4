"""Each query on the smallest tables against its SQL in DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from snapdiff import demo

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)
    return sorted(tuple(repr(round(x, 9)) if isinstance(x, float) else repr(x) for x in r) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(demo.QUERIES))
def test_query_equals_sql(spark, sf, duck, name):
    got = demo.QUERIES[name](spark, sf).toPandas()
    want = duck.execute(demo.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_has_every_demo_query(spark):
    import __spark_entry__ as entry

    assert set(demo.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_value_diff_is_one_exchange(spark, sf):
    from snapdiff.demo import adapters as A
    from snapdiff.operators import numeric as N

    path = f"{spark.conf.get('spark.checkpoint.dir')}/plan-metrics"
    A.counters(spark, sf).write.partitionBy("snapshot_id").parquet(path)
    m = spark.read.parquet(path)
    full = N.value_diff(m, A.snapshots(spark), 0, 1, A.catalog(spark))._jdf.queryExecution().executedPlan().toString()
    assert full.count("Exchange hashpartitioning") == 2  # of the metrics, and of the catalog that is checked
    assert full.count("Exchange hashpartitioning(shape") == full.count("Exchange hashpartitioning(name") == 1
    assert "PartitionFilters: [snapshot_id" in full or "PartitionFilters: [isnotnull" in full
