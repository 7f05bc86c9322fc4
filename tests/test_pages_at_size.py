"""Pages of many objects: rows spread over tasks, pages parsed in slices, plain markup read as the parser reads it."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from snapdiff.demo import ingest as I
from snapdiff.demo import objects as O
from snapdiff.sources import html_pages as H

MARKUP = ["<table>", "</table>", "<tr>", "<tr data-depth=3>", "<TD>", "<td rowspan='2' a>", '<td rowspan="&#51;">', "<th>", "</th>", "</td>", "</tr>", "<pre>", "</pre>", "<h2>", "</h2>", "a&gt;b", " x ", "&amp", "&#x41;", '<b class="q r">', ">", "\n", "<caption>", "</caption >", "&"]
OTHER = ["<br/>", "<!-- <td> -->", "< ", "<script>a<b</script>", "<td x=1/>", "</td a>", "<td rowspan='>'>"]


@pytest.mark.parametrize("pages", [I.table_parts, I.raft_pages, I.tablet_detail_pages, lambda s, d: O.parts(s, d, I.table_body())])
def test_pages_of_a_small_file_are_parsed_in_many_tasks(spark, sf, pages):
    assert pages(spark, sf).select(F.spark_partition_id()).distinct().count() >= 4  # one, from the one split of the file


def test_slices_hold_few_bytes_and_every_page():
    bodies = ["x" * 10, None, "y" * 25, "", "z" * 3, "z" * 3, "w" * 100, "v"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(bodies)], ["id", "body"])
    some = [b.column(1).to_pylist() for b in H.few_pages(batch, 1, 30)]
    assert [x for s in some for x in s] == bodies
    assert all(sum(len(x or "") for x in s) <= 30 or len(s) == 1 for s in some) and len(some) == 5
    assert list(H.few_pages(batch.slice(0, 0), 1, 30)) == []


def test_plain_markup_gives_what_the_parser_gives(monkeypatch):
    rng = random.Random(3)
    bodies = [None, "", *("".join(rng.choices(MARKUP + OTHER * (k % 2), k=rng.randint(0, 25))) for k in range(4000))]
    got = [H.tables_of(b) for b in bodies]
    plain = sum(H._feed_plain(H._Tables(), b) for b in bodies[2:])
    assert 2000 <= plain < 4000
    monkeypatch.setattr(H, "_feed_plain", lambda parser, body: False)
    assert got == [H.tables_of(b) for b in bodies]
