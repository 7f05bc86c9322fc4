"""Names that only hint at noise, bounded wrappers, rules by shuffle, decoding whole texts, held-out spans, base columns in SQL."""

from __future__ import annotations

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from snapdiff.llm import html_extract as HX
from snapdiff.llm import pii
from snapdiff.llm import queries as Q
from snapdiff.llm import url_filter as U


@pytest.mark.parametrize("name, kept", [("share-analysis", True), ("post-comment-free", True), ("form-theory", True), ("share-buttons", False), ("comment-list", False), ("layout sidebar-left", False), ("newsletter-signup", False)])
def test_class_names_beside_other_words_only_hint(name, kept):
    page = f"<body><article><p>The text of the article.</p><div class='{name}'><p>Market text <a>here</a></p></div></article></body>"
    want = "The text of the article." + "\nMarket text here" * kept
    assert HX.main_text(page) == HX.main_text(page, HX.rule_of(HX.wrapper_of(HX.parse(page)))) == want


def test_hints_cut_what_is_mostly_links():
    page = "<article><p>The text.</p><div class='acme-related'>More: <a>One story</a> <a>Another story</a></div></article>"
    assert HX.main_text(page) == "The text."


def test_wrappers_stay_bounded_and_keep_the_frame():
    page = lambda i: f"<body><div class=top>Site</div><div class=story><h2>T{i}</h2>" + "".join(f"<div class=c{chr(97 + i)}{chr(97 + k % 26)}{chr(97 + k // 26)}>text {i} {k}</div>" for k in range(300)) + "</div></body>"
    w = HX.shrink(HX.wrapper_of(HX.parse(page(0))), 200)
    for i in range(1, 9):
        HX.shrink(HX.merge(w, HX.wrapper_of(HX.parse(page(i)))), 200)
    stack, size = [w], 0
    while stack:
        item = stack.pop()
        size += 1
        stack += item[HX.KIDS]
    assert size <= 200
    rule = HX.rule_of(w)
    assert rule["region"][-1] == "div story" and "Site" in rule["same"] + ["Site"]
    assert HX.main_text(page(3), rule).startswith("T3\ntext 3 0\ntext 3 1\n")


def test_rules_by_shuffle_judge_alike(spark):
    urls = [None, "nothing", "http:///en/", *[f"http://h{i % 5}.example.com/en/{i}" for i in range(40)], "http://casino.example.org/x", "http://x.net/" + "a" * 5000]
    pages = spark.createDataFrame([(i if i else None, u, "z", 1) for i, u in enumerate(urls)], "page_id long, url string, s string, salt int")
    rules = U.rules_table(spark, [("allow", "com", "/"), ("block", "example.com", "/en/1"), ("block", "net", "/a")])
    one, two = U.judge(pages, rules), U.judge(pages, rules, broadcast_rules=0)
    assert sorted(one.collect(), key=str) == sorted(two.collect(), key=str) and one.count() == len(urls)
    assert U.judge(pages.limit(0), rules).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["4539578763621486", "4550997810720808", "a.b@mail.example.com", "+1 (555) 555-1234", "10.2.3.4", "999.1.1.1", "word", "Two", ",", ".", "@", "7", "2024", "\n", "(x)", "-", "é"]), max_size=40))
def test_spans_are_those_of_decoding_whole_texts(parts):
    field, text = pii.default_field(), " ".join(parts)
    got = pii.all_spans(field, [text])
    near, pii.stretches = pii.stretches, lambda t: [(0, len(t))] if t else []
    try:
        assert got == pii.all_spans(field, [text])
    finally:
        pii.stretches = near


def test_field_on_sentences_it_has_not_seen():
    field, found, true, both = pii.default_field(), 0, 0, 0
    for tokens, labels in pii.labelled_table(copies=3, seed=4711):
        text, at, want = "".join(tokens), 0, set()
        for token, label in zip(tokens, labels, strict=True):
            if label % 2:
                begin, kind = at, label // 2
            at += len(token)
            if label:
                want = {s for s in want if s[0] != begin} | {(begin, kind, at)}
        got = {x for x in pii.found_spans(field, [text])[0] if pii._plausible(text[x[0] : x[2]], x[1])}
        found, true, both = found + len(got), true + len(want), both + len(got & want)
    print(f"precision {both / found:.4f}, recall {both / true:.4f} of {true}")
    assert both >= 0.95 * found and both >= 0.95 * true


@pytest.mark.parametrize("name", ["lm_base_scores", "pii_base_counts"])
def test_base_columns_equal_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    got, want = Q.QUERIES[name](spark, sf).toPandas(), con.execute(Q.ORACLE_SQL[name]).fetchdf()
    assert list(got.columns) == list(want.columns)
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want.itertuples(index=False, name=None))
