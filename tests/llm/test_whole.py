"""Inputs on which an operator once did less than the whole job."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from snapdiff.llm import html_extract as HX
from snapdiff.llm import lm_scoring as LM
from snapdiff.llm import packing as PK


@pytest.mark.parametrize("length", [700, 1100])
def test_pieces_that_close_no_bin_are_placed(spark, length):
    pieces = spark.range(5000).selectExpr("id AS pid", f"CAST({length} AS BIGINT) AS length")
    rows = PK.pack(pieces, population=2, generations=1).collect()
    assert sorted(r.pid for r in rows) == list(range(5000))
    used = {(r.sequence_id, r.offset) for r in rows}
    assert len(used) == 5000 and max(o for _, o in used) + length <= 2048


def test_scores_past_the_broadcast_bound_are_the_same(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 3000, 60))) for i in range(400)] + [(None, None), (500, ""), (501, "w1 w2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    small, large = ({r.doc_id: r.score for r in LM.score_documents(docs, max_bytes=n).collect()} for n in (10_000, 1 << 26))
    assert small.keys() == large.keys() and len(small) == len(rows)
    assert all(abs(small[i] - large[i]) < 1e-9 for i in large)
    unseen, seen = ([small[i] for i in range(400) if LM.is_held_out(i) == held] for held in (True, False))
    assert max(unseen) < min(seen)  # random words: nearly no pair of an unseen text was counted


def plain_score(text, pairs, singles, total, distinct, weight=0.7):
    """The mix of relative frequencies from exact counts, at the middle of each count's level."""
    middle = lambda c: 0.0 if not c else float(LM._MIDDLE[1 + int(c).bit_length() - 1])
    tokens, score, before = [*text.split(), None], 0.0, None
    for k, t in enumerate(tokens):
        first = middle(singles[None] if k == 0 else singles[tokens[k - 1]])
        both = middle(pairs["<", t] if k == 0 else pairs[before, t])
        score += math.log10(weight * min(both, first) / max(first, 1) + (1 - weight) * min((middle(singles[t]) + 1) / (total + distinct + 1), 1))
        before = t
    return score


@pytest.mark.parametrize(("n", "words", "most"), [(30, 40, 1 << 26), (400, 300, 1 << 26), (400, 300, 1000), (1500, 4000, 1000)])
def test_scores_equal_exact_counts_at_several_sizes(spark, n, words, most):
    rng = np.random.default_rng(n)
    texts = [(i, " ".join(f"w{k}" for k in rng.zipf(1.3, rng.integers(0, 40)) % words)) for i in range(n)]
    singles, pairs = Counter(), Counter()
    for i, t in texts:
        if not LM.is_held_out(i):
            tokens = [*t.split(), None]
            singles.update(tokens)
            pairs.update(zip(["<", *tokens], tokens))
    total = sum(singles.values())
    got = {r.doc_id: r for r in LM.score_documents(spark.createDataFrame(texts, "doc_id long, text string"), max_bytes=most, bits_per_gram=64, hashes=6).collect()}
    assert all(got[i].train_tokens == total for i, _ in texts)
    off = [abs(got[i].score - plain_score(t, pairs, singles, total, len(singles))) for i, t in texts]
    assert max(off) < 1e-6


def shuffled(spark):
    """Records and bytes that were written to shuffles so far."""
    from bench import shuffled as written

    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size())), written(spark)


@pytest.mark.parametrize("most", [0, 1 << 26])
def test_words_and_grams_are_sent_packed_and_once(spark, most):
    rng = np.random.default_rng(9)
    texts = [(i, " ".join(f"w{k:x}" for k in rng.zipf(1.2, 500) % 200_000)) for i in range(3000)]
    size, blocks = sum(len(t) for _, t in texts), 4
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(blocks)
    docs.count()
    before = shuffled(spark)
    assert len(LM.score_documents(docs, max_bytes=most).collect()) == len(texts)
    records, sent = (b - a for a, b in zip(before, shuffled(spark), strict=True))
    assert records < len(texts) + 4 * blocks * 64 + 100  # rows of the table; none is made of a single word
    assert sent < 2.5 * size


def test_a_range_without_training_rows_is_empty(spark):
    held = [i for i in range(100) if LM.is_held_out(i)][:5]
    docs = spark.createDataFrame([(i, f"only {i}") for i in held], "doc_id long, text string")
    got = [LM.score_documents(docs, max_bytes=n).collect() for n in (0, 1 << 26)]
    assert sorted(got[0]) == sorted(got[1]) and {(r.n_known, r.train_tokens, r.base_score, round(r.score, 9)) for r in got[0]} == {(0, 0, 0.0, round(3 * math.log10(0.3), 9))}


def test_ranges_that_are_sent_together_make_the_same_segments(spark):
    rng = np.random.default_rng(5)
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in rng.integers(0, 900, 60))) for i in range(300)], "doc_id long, text string")
    few, many = ({r.doc_id: r.score for r in LM.score_documents(docs, max_bytes=n, grams_per_range=60).collect()} for n in (0, 1 << 26))
    assert LM._ranges_for(2 * 300 * 50, 60) > 4 * 64 and few == many


def test_hashes_widen_with_the_tokens():
    assert [LM.width_for(n) for n in (0, 10**6, 10**9, 10**12, 10**20)] == [40, 40, 43, 53, 64]
    for width in (40, 53, 64):
        values = np.unique(LM._cut(np.random.default_rng(1).integers(0, 1 << 63, 5000, np.uint64) * np.uint64(2), width))
        times = np.arange(len(values))
        again = LM.unpacked(LM.packed(values, times, width))
        assert (again[0] == values).all() and (again[1] == times).all()


def texts_of(spark, pages):
    return [r.text for r in HX.extract(spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")).orderBy("page_id").collect()]


WRAPPERS = ["div class='layout has-sidebar'", "div class=with-comments", "div class=header-fixed", "div class=widget-area", "div class=content-form", "div class=search-results", "form"]


def test_articles_below_noise_named_wrappers(spark):
    pages, want = [], []
    for h, wrapper in enumerate(WRAPPERS):
        for i in range(6):
            for inner in ("article", "div"):
                body = f"<h1>Title {i}</h1><p>The text number {i} of the page, long enough to be one.</p><p>And {i} more words of it.</p>"
                pages.append((f"http://{inner}{h}.example/{i}", f"<html><body><nav><a>Home</a></nav><{wrapper}><{inner}>{body}</{inner}><div class=sidebar>Read also {i}</div></{wrapper.split()[0]}><footer>All rights</footer></body></html>"))
                want.append(f"Title {i}\nThe text number {i} of the page, long enough to be one.\nAnd {i} more words of it.")
    assert texts_of(spark, pages) == want
    assert [HX.main_text(h) for _, h in pages[::2]] == want[::2]  # without a rule


def test_comments_stay_noise():
    page = "<body><div class=post><p>The text of the post itself.</p></div><div id=comments><article>I say this of it</article><article>And I say that of it</article></div></body>"
    assert HX.main_text(page, HX.rule_of(HX.wrapper_of(HX.parse(page)))) == HX.main_text(page) == "The text of the post itself."


def test_copies_and_recrawls_keep_their_text(spark):
    page = lambda day, text: f"<html><body><div class=top>Site</div><div class=post><h2>The title</h2><p>{text}</p><div class=date>Seen on day {day}</div></div></body></html>"
    story = "One long paragraph that is the same in each copy of the page."
    copies = [("http://c.example/a", page(1, story))] * 6
    recrawls = [("http://r.example/a", page(i, story)) for i in range(6)]
    few = [("http://f.example/a", page(1, story))] * 4 + [("http://f.example/b", page(2, story + " With a longer end of its own."))]
    other = [(f"http://o.example/{i}", page(i, f"The text {i} has words of its own, {i} times more than the template.")) for i in range(6)]
    got = texts_of(spark, copies + recrawls + few + other)
    assert all(story in t and "The title" in t for t in got[:17])
    assert all("words of its own" in t and "Site" not in t and "The title" not in t for t in got[17:])


def test_the_row_left_of_an_id_is_always_the_same(spark):
    from snapdiff.llm import jaccard_join as JJ

    rows = [(1, f"one two three four five six seven eight nine ten {k}", k) for k in range(6)] + [(2, "other words", 0), (None, "x", 1), (3, None, 2), (3, None, 2)]
    left = []
    for order in (rows, rows[::-1]):
        out = JJ.drop_near_copies(spark.createDataFrame(order, "doc_id long, text string, n_chars int").repartition(3))
        left.append(sorted(out.collect(), key=str))
    assert left[0] == left[1] and sorted(str(r.doc_id) for r in left[0]) == ["1", "2", "3", "None"]
