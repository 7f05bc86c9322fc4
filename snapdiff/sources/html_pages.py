"""Tables out of HTML pages: one pass of a parser per payload, then column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .payloads import stamp_of

TABLE = "struct<pos: int, heading: string, header: array<string>, rows: array<array<string>>, depths: array<int>, spans: array<array<int>>>"
_TYPE = pa.struct([("pos", pa.int32()), ("heading", pa.string()), ("header", pa.list_(pa.string())), ("rows", pa.list_(pa.list_(pa.string()))), ("depths", pa.list_(pa.int32())), ("spans", pa.list_(pa.list_(pa.int32())))])


class _Tables(HTMLParser):
    """Collects tables and, as tables of one cell, ``<pre>`` blocks, with the heading above each."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.open: list[dict] = []
        self.cell: list[str] | None = None
        self.heading = ""
        self.text: list[str] | None = None  # of a heading

    def end_cell(self) -> None:
        if self.cell is not None and self.open and self.open[-1]["rows"]:
            self.open[-1]["rows"][-1].append(" ".join("".join(self.cell).split()))
        self.cell = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.end_cell()
            self.open.append({"pos": len(self.found), "heading": self.heading, "rows": [], "heads": [], "depths": [], "spans": []})
            self.found.append(self.open[-1])
        elif tag == "tr" and self.open:
            self.end_cell()
            t = self.open[-1]
            t["rows"].append([])
            t["heads"].append(True)
            t["spans"].append([])
            depth = dict(attrs).get("data-depth")
            t["depths"].append(int(depth) if depth and depth.isdigit() else None)
        elif tag in ("td", "th") and self.open:
            self.end_cell()
            t = self.open[-1]
            if not t["rows"]:
                self.handle_starttag("tr", [])
            t["heads"][-1] &= tag == "th"
            span = dict(attrs).get("rowspan")
            t["spans"][-1].append(int(span) if span and span.isdigit() else 1)
            self.cell = []
        elif tag in ("h1", "h2", "h3", "h4", "h5", "caption") or tag == "pre" and not self.open:
            self.text = []

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr"):
            self.end_cell()
        elif tag == "table" and self.open:
            self.end_cell()
            self.open.pop()
        elif tag == "pre" and self.text is not None and not self.open:
            self.found.append({"pos": len(self.found), "heading": self.heading, "rows": [["pre"], ["".join(self.text)]], "heads": [True, False], "depths": [None, None], "spans": [[1], [1]]})
            self.text = None
        elif tag in ("h1", "h2", "h3", "h4", "h5", "caption") and self.text is not None:
            self.heading = " ".join("".join(self.text).split())
            self.text = None

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)
        elif self.text is not None:
            self.text.append(data)


#: Elements whose content the parser reads in another way.
_RAW = frozenset(("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "noscript", "xmp", "plaintext", "math", "svg"))
_ATTRIBUTE = r"""[ \t\n\r\f]+([a-zA-Z][-a-zA-Z0-9]*)(?:=(?:"([^"<>]*)"|'([^'<>]*)'|([^ \t\n\r\f"'<>=`/]+)))?"""
_TAG = re.compile(rf"<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:{re.sub(r'[(](?![?])', '(?:', _ATTRIBUTE)})*)[ \t\n\r\f]*>")
_ATTRIBUTES = re.compile(_ATTRIBUTE)


def _feed_plain(parser: _Tables, body: str) -> bool:
    """Give a body of plain tags and text to the handlers as ``feed`` does, some times faster; False, with nothing given, for any other."""
    found = _TAG.split(body)
    names = [n.lower() for n in found[2::4]]
    if len(names) != body.count("<") or not _RAW.isdisjoint(names) or any(e and a for e, a in zip(found[1::4], found[3::4], strict=True)):
        return False
    start, end, data = parser.handle_starttag, parser.handle_endtag, parser.handle_data
    texts = found[4::4]
    if found[0]:
        data(unescape(found[0]))
    for closes, name, attrs, text in zip(found[1::4], names, found[3::4], texts, strict=True):
        if closes:
            end(name)
        else:
            start(name, [(m[1].lower(), unescape(m[2] or m[3] or m[4] or "") if m[0].find("=") >= 0 else None) for m in _ATTRIBUTES.finditer(attrs)] if attrs else [])
        if text and (parser.cell is not None or parser.text is not None):
            data(unescape(text) if "&" in text else text)
    return True


def tables_of(body: str | None) -> list[dict]:
    """The tables of a page: the first row of header cells is the header, the rest rows."""
    parser = _Tables()
    if not _feed_plain(parser, body or ""):
        parser.feed(body or "")
        parser.close()
    parser.end_cell()
    out = []
    for t in parser.found:
        head = t["rows"][0] if t["rows"] and t["heads"][0] else []
        k = 1 if head else 0
        out.append({"pos": t["pos"], "heading": t["heading"], "header": head, "rows": t["rows"][k:], "depths": t["depths"][k:], "spans": t["spans"][k:]})
    return out


def few_pages(batch: pa.RecordBatch, body: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of bodies and at least one page."""
    sizes = pc.fill_null(pc.binary_length(batch.column(body)), 0).to_numpy(zero_copy_only=False).cumsum()
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(sizes.searchsorted((sizes[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def html_tables(payloads: DataFrame, most: int = 1 << 20) -> DataFrame:
    """The payloads with ``tables``, parsed once for all specs of a page; Python runs here and nowhere else.

    Pages are parsed and handed on in slices of about ``most`` bytes, so that what is held of their cells does not grow with
    the Arrow batch (64 MB of bodies, by Spark's ``spark.sql.execution.arrow.maxBytesPerBatch``).
    """
    stamp = stamp_of(payloads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in few_pages(batch, len(stamp), most):
                found = [tables_of(b) for b in some.column(len(stamp)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*some.columns[: len(stamp)], pa.array(found, pa.list_(_TYPE))], [*stamp, "tables"])

    rows = payloads.select(*stamp, "body")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, tables array<{TABLE}>")


def table_rows(pages: DataFrame, header: list[str], columns: list[str], exact: bool = True) -> DataFrame:
    """Rows of the tables with this header list, as named string columns, with table, row, heading, depth."""
    stamp = stamp_of(pages)
    wanted = F.array(*[F.lit(h) for h in header])
    fits = lambda t: t["header"] == wanted if exact else F.slice(t["header"], 1, len(header)) == wanted
    each = pages.select(*stamp, F.explode(F.filter("tables", fits)).alias("t"))
    rows = each.select(*stamp, F.col("t.pos").alias("table"), "t.heading", "t.depths", F.posexplode("t.rows").alias("row", "cells"))
    return rows.select(*stamp, "table", "row", "heading", F.try_element_at("depths", F.col("row") + 1).alias("depth"), *[F.try_element_at("cells", F.lit(i + 1)).alias(c) for i, c in enumerate(columns)])
