"""Word hashing, decontamination, the Jaccard join and near copies, against brute force."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from snapdiff.llm import decontaminate as D
from snapdiff.llm import jaccard_join as J
from snapdiff.llm.graph import components
from snapdiff.llm.shingles import shingle_set, word_hashes

DOCS = "doc_id long, text string, wid int, start int, component_id long"


def docs(spark, rows):
    """Documents with extra columns whose names clash with ours."""
    return spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], DOCS)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB c\n\té.", max_size=40))
def test_word_hashes_tell_words_apart(text):
    words = text.encode().lower().split()
    h = word_hashes(text.encode()).tolist()
    assert len(h) == len(words)
    assert len(set(h)) == len(set(words))


def words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]


def brute_hits(rows, items):
    out = {}
    for key, text in rows:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            v = words(t)
            n = min(10, len(v))
            for i in range(len(v) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[i : i + n]:
                        hit |= set(range(p, p + n))
                        found.add(str(item))
        out[key] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    return out


def test_decontaminate_equals_brute_force(spark):
    base = " ".join(f"w{i}" for i in range(14))
    items = [(1, base), (2, "only three words"), (3, "one"), (4, ""), (5, None), (10, base.upper()), (7, "Été über alles")]
    rows = [(1, f"x {base} y {base} w3"), (2, "a ONLY, three-words b one"), (3, None), (4, ""), (5, "w0 w1 w2"), (6, " ".join(["w1"] * 5000)), (7, "l'Été über alles été"), (8, " ".join(base.split()[:9]))]
    bench = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id int, text string, doc_id int")
    for limit in (200_000, 0):  # broadcast, and the way without
        hits, _, _ = D.find_benchmark(docs(spark, rows), bench, broadcast_rows=limit)
        assert hits.count() == D.find_benchmark(docs(spark, rows), bench)[0].count()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in D.decontaminate(docs(spark, rows), bench).collect()}
    assert got == brute_hits(rows, items)


def test_decontaminate_edges(spark):
    bench = spark.createDataFrame([(1, "a b c d")], "item_id int, text string")
    none = bench.limit(0)
    two = docs(spark, [(1, "a b c d"), (1, "a b c d"), (1, "other"), (None, "a b c d")])
    got = sorted((r.doc_id or 0, r.n_hit) for r in D.decontaminate(two, bench).collect())
    assert got == [(0, 4), (1, 0), (1, 4), (1, 4)]
    assert D.decontaminate(two, none).where("n_hit > 0").count() == 0
    assert D.decontaminate(two.limit(0), bench).count() == 0
    assert [r.text for r in D.drop_contaminated(two, bench).collect()] == ["other"]
    assert D.drop_contaminated(two, bench).columns == two.columns


def test_decontaminate_is_native(spark, sf):
    from snapdiff.llm import queries

    plan = queries.op1_decontaminate(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def brute_components(rows, n, percent):
    sets, ids = [], []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
        ids.append(i)
    best = dict(zip(range(len(ids)), ids, strict=True))
    for _ in ids:
        for a in best:
            for b in best:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    best[a] = best[b] = min(best[a], best[b])
    return {i: (len(s), best[k]) for k, (i, s) in enumerate(zip(ids, sets, strict=True))}


@pytest.fixture(scope="module")
def near_copies():
    rng = np.random.default_rng(3)
    rows = []
    for g in range(12):
        base = [f"g{g}w{int(x)}" for x in rng.integers(0, 60, 80)]
        for k in range(int(rng.integers(1, 9))):
            own = list(base)
            for _ in range(int(rng.integers(0, 4))):
                own[int(rng.integers(0, 80))] = f"edit{k}_{rng.integers(0, 9)}"
            rows.append((len(rows), " ".join(own)))
    return rows + [(900, ""), (901, None), (902, "two words"), (903, "TWO  words"), (904, "one"), (905, " ".join(["z"] * 3000))]


@pytest.mark.parametrize("n, percent, block", [(3, 90, 2_000_000), (5, 80, 2_000_000), (3, 80, 120)])
def test_jaccard_components_equal_brute_force(spark, near_copies, n, percent, block):
    got = J.jaccard_components(docs(spark, near_copies), n, percent, block_items=block, order_buckets=1 << 12)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(near_copies, n, percent)


def test_sketches_bound_the_overlap():
    rng = np.random.default_rng(3)
    for n in [1, 7, 8, 63, 64, 500, 5000]:
        a = np.unique(rng.integers(0, 2**64, n, np.uint64))
        for kept, more in [(n, 0), (n, n), (n - n // 10, n // 8), (0, 2 * n)]:
            b = np.unique(np.concatenate([a[:kept], rng.integers(0, 2**64, more, np.uint64)]))
            most = J._most_shared(J._sketch(a), J._sketch(b))
            assert len(np.intersect1d(a, b)) <= most <= min(len(a), len(b))
    crowd = np.arange(300, dtype=np.uint64)  # one bucket holds all, past a byte
    assert J._sketch(crowd) is None and J._most_shared(None, J._sketch(crowd[:9])) is None
    assert J._sketch(np.empty(0, np.uint64)) == bytes(8)


def test_jaccard_edges(spark):
    same = "a b c d e f"
    got = sorted(((r.doc_id, r.component_id) for r in J.jaccard_components(docs(spark, [(5, same), (5, "x y z u v w"), (7, "x y z u v w"), (9, same), (None, same)]), order_buckets=1 << 12).collect()), key=str)
    assert got == [(5, 5), (5, 5), (7, 5), (9, 5), (None, None)]
    empty = docs(spark, [(1, "a")]).limit(0)
    assert J.jaccard_components(empty, order_buckets=1 << 12).count() == 0
    left = J.drop_near_copies(docs(spark, [(5, same), (9, same), (None, same), (4, "")]))
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 4, 5]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), min_size=1, max_size=25), min_size=1, max_size=14), st.sampled_from([60, 80, 90]))
def test_tree_links_equal_all_pairs(rows, percent):
    sets = [np.unique(np.array(r, np.uint64) * np.uint64(7919)) for r in rows]
    got = J.tree_links(sets, list(range(len(sets))), percent, len(sets))
    want = list(range(len(sets)))
    for _ in sets:
        for a in range(len(sets)):
            for b in range(len(sets)):
                o = len(np.intersect1d(sets[a], sets[b]))
                if 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
                    want[a] = want[b] = min(want[a], want[b])
    assert got == want


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_shingle_set_of_few_words():
    assert len(shingle_set(word_hashes(b"a b"), 3)) == 1
    assert len(shingle_set(word_hashes(b""), 3)) == 0
