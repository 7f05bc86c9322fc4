"""Main text of web pages by wrappers inferred per host (union-free regular expressions).

A page becomes a token stream, nested by its open tags. Streams of one host are aligned one by
one with the host's wrapper; a mismatch is resolved into an optional item, a run of like items
into a repeated group, and differing text into a slot. The result is a regular expression
without unions, kept as a small tree. Per task one wrapper per host is inferred from all of its
pages; those are merged per (host, salt), then per host, so a host with a third of all pages is
never in one task. A wrapper has a bounded size: beyond it, what the fewest pages have becomes a slot of
its length in the item around it. From a wrapper comes a short rule: where the main text is. It is the article
or main element, or else the part whose slots hold the most text that differs between pages and
is no link. Of several articles it is the first that stands once a page; repeated ones, as of
reader comments, count only where no article does. Pages are then read a second time with their host's rule. A form or
an element whose names mark noise is read as main all the same if it holds most of the text: more
than half, and at least ``LARGE`` times what the best part outside of noise has; never so what the names call comments or
adverts, article elements among them. A class or id marks noise only
if all of its words do, apart from words of structure (``comment-list``, ``site-footer``); beside
other words (``share-analysis``) it is a hint, and cuts only what is mostly links.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments in the
markup and reader comments go; what the wrapper shows to be the same text on all of at least
``SAME_PAGES`` different pages goes too, where a host has no article or main element and at least
as much text outside of noise differs between its pages; else they may be recrawls of one page,
and the text is kept. In articles, too, a block (not a heading) goes if all of at least ``SAME_PAGES`` different pages have it, wherever it
stands in them, and such blocks are less than half of a page; there, what only its name calls a menu or a notice stays, as
its text is the page's own. Equal pages of a host count as one in its wrapper. Character references
are decoded, white space in a block becomes one space, blocks are joined by one newline.

Nulls, ties and repeats: null or empty html gives an empty text; a null url or one without a
host shares the wrapper of the empty host; rows that repeat give equal rows; nesting below
``DEEPEST`` levels is read as flat, without loss of text; other columns are ignored.
"""

from __future__ import annotations

import html as _html
import json
import math
import pickle
import re
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

DEEPEST, SAME_PAGES, LARGE = 150, 5, 4
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|iframe|svg|textarea|select|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>|(?P<text>[^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
_ATTR = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SOFT_TAGS = frozenset({"form"})
_NOISE_TAGS = frozenset("nav footer aside form button dialog menu input head".split())
_NOISE_ROLES = frozenset("navigation banner complementary contentinfo search form alert dialog menu".split())
_NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent notice notices alert popup modal newsletter subscribe signup share sharing social related recommended menu nav navbar navigation breadcrumb breadcrumbs sidebar aside widget footer header masthead comment comments disqus respond reply replies form login search pager pagination".split()
)
_PLAIN_WORDS = frozenset(
    "area bar block body bottom box btn button buttons col column container content element entry fixed group heading holder icon icons inner item items label layout left link links list main module outer page panel post posts right row section site slot text title toggle top unit user view wrap wrapper zone".split()
)
_MAIN_WORDS = frozenset({"articlebody"})
_NEVER_WORDS = frozenset("ad ads advert adverts advertisement sponsor sponsored promo promotion comment comments disqus respond reply replies".split())
_SOFT_WORDS = frozenset("menu notice notices alert".split())
LARGEST = 20_000  # of a wrapper: its items, and the texts they keep in units of 64 characters


class Node:
    __slots__ = ("tag", "label", "noise", "hint", "kids")

    def __init__(self, tag: str, label: str, noise: bool, hint: bool):
        self.tag, self.label, self.noise, self.hint, self.kids = tag, label, noise, hint, []


def _words(value: str) -> list[str]:
    return re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower())


_seen: dict[tuple[str, str], tuple[str, bool, bool]] = {}


def _read_tag(tag: str, rest: str) -> tuple[str, bool, bool]:
    """A tag's label (tag, class and id without digits, marks), whether its names mark noise, and whether they hint at it."""
    if "=" not in rest:
        return tag, tag in _NOISE_TAGS, False
    if (tag, rest) not in _seen:
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(rest)}
        names = [_words(name) for name in f"{found.get('class', '')} {found.get('id', '')}".split()]
        met = [ws for ws in names if _NOISE_WORDS.intersection(ws)] if tag not in ("html", "body", "main") else []
        sure = [ws for ws in met if all(w in _NOISE_WORDS or w in _PLAIN_WORDS or len(w) == 1 for w in ws)]
        named, said = bool(sure), {w for ws in sure for w in ws if w in _NOISE_WORDS}
        kind = ["*never"] if said & _NEVER_WORDS else ["*soft"] if said and said <= _SOFT_WORDS else []
        noise = named or tag in _NOISE_TAGS or found.get("role", "").lower() in _NOISE_ROLES
        main = found.get("role", "").lower() == "main" or found.get("itemprop", "").lower() in _MAIN_WORDS
        if len(_seen) > 50_000:
            _seen.clear()
        label = " ".join([tag, *sorted({w for ws in names for w in ws}), *["*noise"] * named, *kind, *["*main"] * main])
        _seen[tag, rest] = (label, noise, bool(met) and not noise)
    return _seen[tag, rest]


def parse(page: str) -> Node:
    """The page as a tree; kids are nodes or strings. Unclosed and stray tags are forgiven."""
    root = Node("", "", False, False)
    stack = [root]
    for m in _TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            stack[-1].kids.append(text)
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in _BLOCK:  # a new block ends an open paragraph
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in _BLOCK:
                    break
        if tag in _CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in _CLOSES[tag]:
                    del stack[k:]
                    break
                if stack[k].tag in ("ul", "ol", "dl", "table"):
                    break
        node = Node(tag, *_read_tag(tag, m["rest"]))
        stack[-1].kids.append(node)
        if tag not in _VOID and not m["rest"].endswith("/") and len(stack) < DEEPEST:
            stack.append(node)
    return root


# ---- wrappers: [label, optional, repeated, pages, text, chars, link chars, kids]; text is None in a slot

LABEL, OPTIONAL, REPEATED, PAGES, TEXT, CHARS, LINKS, KIDS = range(8)


def wrapper_of(node: Node, link: bool = False) -> list:
    kids = []
    link = link or node.tag == "a"
    for kid in node.kids:
        if isinstance(kid, str):
            text = " ".join(kid.split())
            if text:
                kids.append(["#", False, False, 1, text, len(text), len(text) * link, []])
        else:
            kids.append(wrapper_of(kid, link))
    kids = fold(kids)
    own = [sum(k[i] for k in kids) for i in (CHARS, LINKS)]
    return [node.label, False, False, 1, None, *own, kids]


def digest(text: str) -> int:
    return int.from_bytes(blake2b(text.encode(errors="replace"), digest_size=8).digest(), "big", signed=True)


def page_wrapper(page: str) -> list:
    """The wrapper of one page; its root keeps digest and length of each block, of which merging leaves what all pages have."""
    root = parse(page)
    w = wrapper_of(root)
    blocks = {t for t, heading in _blocks([root], lambda item, region: item.noise and "*soft" not in item.label) if not heading}
    w[TEXT] = tuple(sorted((digest(t), len(t)) for t in blocks)[:LARGEST])
    return w


def fold(kids: list[list]) -> list[list]:
    """Runs of like items, of one to three labels, become repeated groups."""
    for period in (1, 2, 3):
        out: list[list] = []
        i = 0
        while i < len(kids):
            unit = kids[i : i + period]
            labels = [k[LABEL] for k in unit]
            j = i + period
            while len(unit) == period and [k[LABEL] for k in kids[j : j + period]] == labels and not (period > 1 and any(k[REPEATED] for k in unit)):
                for a, b in zip(unit, kids[j : j + period], strict=True):
                    merge(a, b, same_page=True)
                j += period
            if j > i + period:
                for k in unit:
                    k[REPEATED] = True
                if period == 1:
                    out += unit
                else:
                    out.append(["(" + " | ".join(labels) + ")", False, True, 1, None, sum(k[CHARS] for k in unit), sum(k[LINKS] for k in unit), unit])
                i = j
            else:
                out.append(kids[i])
                i += 1
        kids = out
    return kids


def merge(a: list, b: list, same_page: bool = False) -> list:
    """Align ``b`` with ``a``, in place: unmatched items become optional, differing texts slots."""
    if not same_page:
        a[PAGES] += b[PAGES]
    a[CHARS] += b[CHARS]
    a[LINKS] += b[LINKS]
    a[OPTIONAL] |= b[OPTIONAL]
    a[REPEATED] |= b[REPEATED]
    if isinstance(a[TEXT], tuple) and isinstance(b[TEXT], tuple):
        a[TEXT] = tuple(sorted(set(a[TEXT]) & set(b[TEXT])))
    elif a[TEXT] != b[TEXT]:
        a[TEXT] = None
    x, y = [k[LABEL] for k in a[KIDS]], [k[LABEL] for k in b[KIDS]]
    if x == y:
        for p, q in zip(a[KIDS], b[KIDS], strict=True):
            merge(p, q, same_page)
        return a
    kids: list[list] = []
    for op, i, j, k, n in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        if op == "equal":
            kids += [merge(p, q, same_page) for p, q in zip(a[KIDS][i:j], b[KIDS][k:n], strict=True)]
        else:
            for kid in a[KIDS][i:j] + b[KIDS][k:n]:
                kid[OPTIONAL] = True
                kids.append(kid)
    a[KIDS] = fold_labels(kids)
    return a


def fold_labels(kids: list[list]) -> list[list]:
    """After an alignment: neighbours of one label become one repeated item."""
    out: list[list] = []
    for kid in kids:
        if out and out[-1][LABEL] == kid[LABEL] and kid[LABEL] != "#":
            merge(out[-1], kid, same_page=True)
            out[-1][PAGES] = max(out[-1][PAGES], kid[PAGES])
            out[-1][REPEATED] = True
        else:
            out.append(kid)
    return out


def shrink(w: list, most: int = LARGEST) -> list:
    """A wrapper of at most ``most``, in place: beyond it, half of that is kept, by pages and then by length."""
    stack, items = [w], []
    while stack:
        item = stack.pop()
        items.append((item[PAGES], item[CHARS], 1 + len(item[TEXT] or "") // 64))
        stack += item[KIDS]
    if sum(x[2] for x in items) <= most:
        return w
    left, least = most // 2, (0, 0)
    for pages, chars, size in sorted(items, reverse=True):
        left -= size
        if left < 0:
            least = (pages, chars)
            break

    def cut(item: list) -> None:
        kids, lost = [], [0, 0]
        for kid in item[KIDS]:
            if (kid[PAGES], kid[CHARS]) > least:
                cut(kid)
                kids.append(kid)
            elif kid[LABEL].split(" ")[0] not in _NOISE_TAGS and "*noise" not in kid[LABEL]:
                lost = [lost[0] + kid[CHARS], lost[1] + kid[LINKS]]
        if lost[0]:
            kids.append(["#", True, True, 1, None, *lost, []])
        item[KIDS] = kids

    cut(w)
    return w


def expression(w: list) -> str:
    """The wrapper as a regular expression over tokens, for people."""
    inner = " ".join(expression(k) for k in w[KIDS])
    body = (w[TEXT] or "#PCDATA") if w[LABEL] == "#" else inner if w[LABEL][:1] in ("", "(") else f"<{w[LABEL]}> {inner} </>"
    return f"({body})+" if w[REPEATED] else f"({body})?" if w[OPTIONAL] else body


def _is_main(label: str) -> bool:
    return label.split(" ")[0] in ("article", "main") or label.endswith("*main")


def rule_of(w: list) -> dict:
    """``region``: labels from the root to the main part; ``same``: texts of the template outside an article."""
    mains: list[tuple[int, bool, int, int, list[str]]] = []
    loose: list[tuple[float, int, list[str]]] = []
    same: list[str] = []

    differs = [0, 0]  # text outside of noise: that of slots, that of the template

    def walk(node: list, path: list[str], noise: bool, large: float, trust: bool, repeated: bool = False) -> float:
        repeated |= node[REPEATED]
        place = len(places)
        places.append(0)
        tag = node[LABEL].split(" ")[0]
        names = set(node[LABEL].split(" ")[1:])
        named = tag in _SOFT_TAGS or "*noise" in names
        noise = noise or tag in _NOISE_TAGS - _SOFT_TAGS or tag == "header" or named and ("*never" in names or node[CHARS] - node[LINKS] <= large)
        if node[LABEL] == "#":
            template = node[TEXT] is not None and node[PAGES] >= SAME_PAGES and not node[REPEATED]
            if not noise:
                differs[template] += max(0, node[CHARS] - node[LINKS])
            if template and trust:
                same.append(node[TEXT])
                return 0
            return 0 if noise else node[CHARS] - 2 * node[LINKS]
        own = path + [node[LABEL]] if node[LABEL][:1] not in ("", "(") else path
        worth = sum(walk(k, own, noise, large, trust, repeated) for k in node[KIDS])
        if not noise and node[LABEL][:1] not in ("", "("):
            if _is_main(node[LABEL]):
                mains.append((place, repeated, node[PAGES], node[CHARS], own))
            elif tag in _BLOCK and tag != "p" and tag not in _HEADINGS:
                loose.append((worth, len(own), own))
        return worth

    places: list[int] = []
    walk(w, [], False, float("inf"), True)
    best = max([m[3] for m in mains] + [x[0] for x in loose] + [0])
    large = max((w[CHARS] - w[LINKS]) / 2, LARGE * best)
    for trust in (True, False):
        for found in (mains, loose, same, places):
            found.clear()
        differs[:] = 0, 0
        walk(w, [], False, large, trust)
        if differs[0] >= differs[1]:
            break
    own = {}
    if w[PAGES] >= SAME_PAGES and isinstance(w[TEXT], tuple) and 2 * sum(n for _, n in w[TEXT]) < (w[CHARS] - w[LINKS]) / w[PAGES]:
        own = {"template": [d for d, _ in w[TEXT]]}  # of pages that differ in most of their text
    if mains:
        inner = [m for m in mains if m[4][-1].startswith("article")] or mains
        inner = [m for m in inner if not m[1]] or inner
        inner = [m for m in inner if 2 * m[2] >= max(x[2] for x in inner)]
        inner = [m for m in inner if 5 * m[3] >= max(x[3] for x in inner)]
        return {"region": min(inner)[4], "same": [], **own}
    if loose:
        most = max(x[0] for x in loose)
        return {"region": max((x for x in loose if x[0] >= 0.85 * most), key=lambda x: x[1])[2], "same": sorted(set(same))}
    return {"region": [], "same": []}


# ---- extraction


def _regions(root: Node, region: list[str]) -> list[Node]:
    """Nodes at the region's path; else article or main elements, else the body, else the page."""
    at = [root]
    for label in region:
        at = [k for n in at for k in n.kids if not isinstance(k, str) and k.label == label]
    if at and region:
        return at
    found, body, stack = [], [], [root]
    while stack:
        node = stack.pop()
        if node.noise:
            continue
        if _is_main(node.label):
            found.append(node)
            continue
        if node.tag == "body":
            body.append(node)
        stack += [k for k in reversed(node.kids) if not isinstance(k, str)]
    found = found or body or [root]
    return _large(root, LARGE * sum(_chars(n, n) for n in found)) or found


def _chars(node: Node, region: Node | None = None) -> int:
    """Text of a node that is no link; without noise, if it is a region's."""
    total, stack = 0, [node]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            total += len(" ".join(item.split()))
        elif item.tag != "a" and not (region and item.noise and item is not region):
            stack += item.kids
    return total


def _is_links(node: Node) -> bool:
    """Whether at least half of a node's text is of links, or it has none."""
    total, stack = 0, [node]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            total += len(" ".join(item.split()))
        else:
            stack += item.kids
    return 2 * _chars(node) <= total


def _large(root: Node, least: int) -> list[Node]:
    """The noise-named part with over half of the page's text and over ``least``: its article or main elements, or itself."""
    least, stack = max(least, _chars(root) // 2), [root]
    while stack:
        node = stack.pop()
        if node.noise and node.tag not in _NOISE_TAGS - _SOFT_TAGS and "*never" not in node.label and _chars(node) > least:
            inner, found = list(reversed(node.kids)), []
            while inner:
                kid = inner.pop()
                if isinstance(kid, str):
                    continue
                if _is_main(kid.label):
                    found.append(kid)
                elif not kid.noise:
                    inner += reversed(kid.kids)
            return found or _large_in(node, least)
        if not node.noise:
            stack += [k for k in reversed(node.kids) if not isinstance(k, str)]
    return []


def _large_in(node: Node, least: int) -> list[Node]:
    """The innermost of such parts within each other."""
    for kid in node.kids:
        if not isinstance(kid, str):
            deep = _large(kid, least)
            if deep:
                return deep
    return [node]


def _blocks(regions: list[Node], skips: Callable[[Node, Node], bool]) -> Iterator[tuple[str, bool]]:
    """(text, whether it is a heading) of the blocks of the regions, without what ``skips(item, region)``."""
    for region in regions:
        article = _is_main(region.label)
        stack: list = [region]
        parts: list[str] = []
        heads = 0
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                parts.append(_html.unescape(item))
                continue
            if isinstance(item, int):  # the end of a block
                text = " ".join("".join(parts).split())
                parts.clear()
                if text:
                    yield text, heads > 0
                heads -= item
                continue
            if item is not region and skips(item, region):
                continue
            if item.tag == "header" and item is not region:
                if article:  # an article's own header gives its headings only
                    stack += [k for k in reversed(item.kids) if not isinstance(k, str) and k.tag in _HEADINGS]
                continue
            if item.tag == "br":
                parts.append(" ")
                continue
            if item.tag in _BLOCK:
                text = " ".join("".join(parts).split())
                parts.clear()
                if text:
                    yield text, heads > 0
                heads += item.tag in _HEADINGS
                stack.append(int(item.tag in _HEADINGS))
            stack += reversed(item.kids)
        text = " ".join("".join(parts).split())
        if text:
            yield text, heads > 0


def main_text(page: str | None, rule: dict | None = None) -> str:
    """The main text of a page under its host's rule."""
    if not page:
        return ""
    rule = rule or {}
    same, template = set(rule.get("same", ())), set(rule.get("template", ()))

    def skips(item: Node, region: Node) -> bool:
        if item.noise and "template" in rule and "*soft" in item.label and item.tag not in _NOISE_TAGS and _is_main(region.label):
            return _is_links(item)  # what all pages have of it is known
        return item.noise or item.hint and _is_links(item)

    out = []
    for text, heading in _blocks(_regions(parse(page), rule.get("region", [])), skips):
        if text not in same and (heading or not template or digest(text) not in template):
            out.append(text)
    return "\n".join(out)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^/?#]*?://([^/?#]*)", 1))


def infer_rules(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, rule): rules as JSON text, from the wrapper of all of the host's pages.

    A host has at most one wrapper of each task; they are merged in about the square root of as
    many salts, so that both groups of a host stay small beside the number of tasks.
    """
    salts = 1 + math.isqrt(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, list] = {}
        merged: Counter[str] = Counter()
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if page:
                    w = shrink(page_wrapper(page))
                    own[host] = merge(own[host], w) if host in own else w
                    merged[host] += 1
                    if merged[host] % 8 == 0:
                        shrink(own[host])
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array([pickle.dumps(shrink(w)) for w in own.values()], pa.binary())], ["host", "wrapper"])

    def join(pdf: pd.DataFrame) -> list:
        first, *rest = sorted(pdf["wrapper"])  # an order that does not depend on the shuffle
        w = pickle.loads(first)
        for x in rest:
            shrink(merge(w, pickle.loads(x)))
        return w

    def partial(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [pickle.dumps(join(pdf))]})

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "rule": [json.dumps(rule_of(join(pdf)), ensure_ascii=False)]})

    # equal pages once; sorted, so that the order does not depend on the shuffle
    once = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"), F.sha2(html_col, 256).alias("digest")).dropDuplicates(["host", "digest"])
    made = once.sortWithinPartitions("host", "digest").select("host", "html").mapInArrow(infer, "host string, wrapper binary")
    salted = made.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts)))
    merged = salted.groupBy("host", "salt").applyInPandas(partial, "host string, wrapper binary")
    return merged.groupBy("host").applyInPandas(last, "host string, rule string")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = 8_000_000) -> DataFrame:
    """Per page: page_id, url, text and n_chars. Rules are broadcast if they are small, else joined by shuffle."""
    rules = stored(infer_rules(pages, url_col, html_col), "rules")
    size = rules.agg(F.coalesce(F.sum(F.length("rule") + F.length("host") + 32), F.lit(0))).first()[0]
    side = rules.withColumnRenamed("host", "h")
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    ruled = own.join(F.broadcast(side) if size <= broadcast_bytes else side, F.col("host") == F.col("h"), "left").select("page_id", "url", "html", "rule")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, dict | None] = {None: None}
        for batch in batches:
            texts = []
            for page, rule in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if rule not in known:
                    if len(known) > 10_000:
                        known = {None: None}
                    known[rule] = json.loads(rule)
                texts.append(main_text(page, known[rule]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    return ruled.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
