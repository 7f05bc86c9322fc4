"""Which part of a page is its article: comments and adverts as article elements, long comments, template text, menus and notices of the article."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from snapdiff.llm import html_extract as HX

STORY = "The story of page {i} goes on for a while and says what only this page says."


def texts(spark, bodies):
    rows = [(i, f"http://h.example/{i}", f"<html><body><nav><a>Home</a></nav>{b}<footer>All rights</footer></body></html>") for i, b in enumerate(bodies)]
    return [r.text for r in HX.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def story(i):
    return STORY.format(i=i)


@pytest.mark.parametrize("comments", [1, 3])
def test_comments_as_article_elements(spark, comments):
    talk = lambda i: "".join(f"<article class=c><p>Reader {k} of page {i} {'talks at length ' * 20}</p></article>" for k in range(comments))
    pages = [f"<main><article class=post><h1>Title {i}</h1><p>{story(i)}</p><p>And {i} ends here with some more words of its own.</p></article><section id=discussion>{talk(i)}</section></main>" for i in range(8)]
    got = texts(spark, pages)
    if comments > 1:  # one comment a page, far longer than the post, cannot be told from it
        assert got == [f"Title {i}\n{story(i)}\nAnd {i} ends here with some more words of its own." for i in range(8)]
    named = [p.replace("class=c>", "class=comment>") for p in pages]
    assert texts(spark, named) == [f"Title {i}\n{story(i)}\nAnd {i} ends here with some more words of its own." for i in range(8)]
    assert HX.main_text(named[0]) == f"Title 0\n{story(0)}\nAnd 0 ends here with some more words of its own."


def test_adverts_as_article_elements(spark):
    pages = [f"<article><p>{story(i)}</p></article><article class=sponsored><p>{f'Buy thing {i} now. ' * 20}</p></article>" for i in range(8)]
    assert texts(spark, pages) == [story(i) for i in range(8)]
    assert HX.main_text(pages[0]) == story(0)


def test_long_comments_are_never_the_article(spark):
    talk = lambda i: "".join(f"<div class=comment><p>Reader {k} of {i} {'says a lot ' * 30}</p></div>" for k in range(9))
    pages = [f"<div class=story><p>{story(i)}</p></div><div class=comments>{talk(i)}</div>" for i in range(8)]
    assert texts(spark, pages) == [story(i) for i in range(8)]
    assert HX.main_text(pages[0]) == story(0)


def test_text_of_the_template_in_articles_and_groups(spark):
    advert = "<div class=box><p>Our shop has everything.</p></div>"
    pages = [f"<article><h2>What happened</h2><p>{story(i)}</p>{advert}<p>A second thing of page {i} that is told here.</p><p>Write to us if you know more.</p></article>" for i in range(8)]
    want = [f"What happened\n{story(i)}\nA second thing of page {i} that is told here." for i in range(8)]
    assert texts(spark, pages) == want  # a heading that all pages have stays
    few = texts(spark, pages[:4])
    assert all("Our shop" in t and "Write to us" in t for t in few)  # of few pages nothing is known


def test_recrawls_with_many_paragraphs_keep_them(spark):
    body = "".join(f"<p>Paragraph {k} is the same on every copy of the page.</p>" for k in range(6))
    pages = [f"<article>{body}<p>Seen on day {i}.</p></article>" for i in range(8)]
    assert all(t.count("Paragraph") == 6 for t in texts(spark, pages))


def test_menus_and_notices_that_are_the_articles_own(spark):
    dishes = lambda i: "".join(f"<li>Dish {k} of house {i}, with its sauce</li>" for k in range(3))
    pages = [f"<article><p>{story(i)}</p><div class=notice>House {i} is closed on day {i}.</div><ul class=menu>{dishes(i)}</ul><div class=notice>We use cookies.</div><ul class=menu><li><a href=x>About {i}</a></li></ul></article>" for i in range(8)]
    want = [f"{story(i)}\nHouse {i} is closed on day {i}.\n" + "\n".join(f"Dish {k} of house {i}, with its sauce" for k in range(3)) for i in range(8)]
    assert texts(spark, pages) == want
    assert HX.main_text(pages[0]) == story(0)  # without a rule, names decide


def test_pages_of_several_articles_keep_all(spark):
    pages = ["".join(f"<article><p>{story(i)} Part {k}.</p></article>" for k in range(3)) for i in range(6)]
    assert texts(spark, pages) == ["\n".join(f"{story(i)} Part {k}." for k in range(3)) for i in range(6)]


def test_deep_and_long_pages(spark):
    deep = "<article>" + "<div>" * 400 + f"<p>{story(0)}</p>" + "</div>" * 400 + "</article>"
    long = "<article>" + "".join(f"<p>Line {k} of the long page.</p>" for k in range(20_000)) + "</article>"
    rows = spark.createDataFrame([(0, "http://d.example", f"<body>{deep}</body>"), (1, "http://l.example", f"<body>{long}</body>")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in HX.extract(rows.withColumn("text", F.lit("x"))).collect()}
    assert got[0] == story(0) and got[1].count("\n") == 19_999


def pattern(w: list) -> str:
    """The wrapper as a pattern over tokens."""
    inner = "".join(map(pattern, w[HX.KIDS]))
    body = "#" if w[HX.LABEL] == "#" else inner if w[HX.LABEL][:1] in ("", "(") else f"<{w[HX.LABEL]}>{inner}</>"
    return f"(?:{body}){'*' if w[HX.OPTIONAL] and w[HX.REPEATED] else '+' if w[HX.REPEATED] else '?' if w[HX.OPTIONAL] else ''}"


def tokens(node) -> str:
    return "#" if isinstance(node, str) else "".join(map(tokens, node.kids)) if not node.label else f"<{node.label}>{''.join(map(tokens, node.kids))}</>"


def test_a_wrapper_accepts_the_pages_it_was_made_of():
    rng = random.Random(8)

    def some(depth: int) -> str:
        return "".join(f"<{t}>{some(depth - 1) if depth and t in ('div', 'ul') else 'x' * rng.randint(0, 1)}</{t}>" for t in rng.choices(["p", "h2", "div", "ul", "section"], k=rng.randint(0, 4)))

    for _ in range(400):
        pages = [some(2) for _ in range(rng.randint(2, 5))]
        w = HX.wrapper_of(HX.parse(pages[0]))
        for page in pages[1:]:
            HX.merge(w, HX.wrapper_of(HX.parse(page)))
        assert all(re.fullmatch(pattern(w), tokens(HX.parse(p))) for p in pages), pages
