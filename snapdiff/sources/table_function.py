"""``html_table`` for SQL: the rows of a page's tables with a given header, by lateral join.

    SELECT p.hostname_port, t.* FROM payloads p, LATERAL html_table(p.body, 'Path|Used Space|Total Space') t
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .html_pages import tables_of


def column_name(header: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", header.lower()).strip("_") or "column"


class HtmlTable:
    """A column for each header (a constant, parted by ``|``), after the table's and the row's place; parsed as ``html_tables`` does."""

    @staticmethod
    def analyze(body: AnalyzeArgument, headers: AnalyzeArgument) -> AnalyzeResult:
        if not headers.isConstantExpression or not headers.value:
            raise ValueError("html_table needs its headers as a constant")
        schema = StructType().add("table_pos", IntegerType()).add("row_pos", IntegerType())
        for h in headers.value.split("|"):
            schema = schema.add(column_name(h), StringType())
        return AnalyzeResult(schema)

    def eval(self, body: str, headers: str) -> Iterator[tuple]:
        wanted = headers.split("|")
        for t in tables_of(body):
            if t["header"] == wanted:
                for k, cells in enumerate(t["rows"]):
                    yield (t["pos"], k, *[cells[i] if i < len(cells) else None for i in range(len(wanted))])


def register(spark: SparkSession) -> None:
    """Make ``html_table`` known to the session's SQL."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("html_table", udtf(HtmlTable))
