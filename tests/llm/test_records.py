"""Packing, classifier, filters, formats, vectors, personal data and language model on small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from snapdiff.llm import chat_format as CF
from snapdiff.llm import embedding_dedup as ED
from snapdiff.llm import html_extract as HX
from snapdiff.llm import lm_scoring as LM
from snapdiff.llm import packing as PK
from snapdiff.llm import pii
from snapdiff.llm import quality as Q
from snapdiff.llm import url_filter as U

EDGES = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x"), (5, "word " * 30_000), (6, "It's Été <|endoftext|> ﬁn… 12,5")]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "y", 0.5, 7) for i, t in rows], "doc_id long, text string, piece int, label string, score double, n_chars long")


# ---- packing


def test_pieces_and_places(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PK.default_tokenizer())
    out = PK.pack_documents(docs(spark, EDGES)).collect()
    want = []
    for i, text in EDGES:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(i, k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out), key=key) == sorted(want, key=key)
    places: dict[int, list] = {}
    for r in out:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
    assert PK.pack_documents(docs(spark, EDGES).limit(0)).count() == 0


_PIECES = ["a", "B", "I", "K", "é", "Ü", "ß", "ÿ", "İ", "ı", "ſ", "ŉ", "ǅ", "\u212a", "\u0958", "\u0915\u093c", "\u0338", "\u0307", "\u0301", "\u200d", "!", ".", "'", "'s", "#", "0", "½", " ", "\t", "\x1c", "\x85", "\u00a0", "中", "한", "\U0001f600", "<|", "<|endoftext|>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(_PIECES), max_size=8).map("".join), min_size=1, max_size=20))
def test_ids_are_those_of_the_tokenizer(texts):
    import pyarrow as pa
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PK.default_tokenizer())
    assert [x.tolist() for x in PK.token_ids(pa.array(texts, pa.string()), PK.default_tokenizer())] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_another_tokenizer_gets_whole_texts():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Two  words, İ!", "", "a\nb"]
    assert [x.tolist() for x in PK.token_ids(pa.array(texts), path)] == [Tokenizer.from_file(path).encode(x, add_special_tokens=False).ids for x in texts]


def test_frequent_words_are_encoded_once(tmp_path, monkeypatch):
    import shutil

    import pyarrow as pa
    import tokenizers

    class Counted:
        def __init__(self, own):
            self.own, self.model, self.seen = own, self, []
            made.append(self)

        def __getattr__(self, name):
            return getattr(self.own, name)

        def tokenize(self, text):
            self.seen.append(text)
            return self.own.model.tokenize(text)

    made, real = [], tokenizers.Tokenizer
    monkeypatch.setattr(tokenizers, "Tokenizer", type("T", (), {"from_file": staticmethod(lambda path: Counted(real.from_file(path)))}))
    for kind in [c for c in vars(PK).values() if isinstance(c, type) and hasattr(c, "limit")]:
        monkeypatch.setattr(kind, "limit", 100)
    path = shutil.copy(PK.default_tokenizer(), tmp_path / "own.json")
    rare = ["".join(chr(97 + k // 26**p % 26) for p in range(4)) + "qx" for k in range(1000)]
    texts = [f"{' '.join(rare[k : k + 50])} the quick, the brown." for k in range(0, 1000, 50)]
    plain = real.from_file(str(path))
    for text in texts:
        assert PK.token_ids(pa.array([text]), str(path))[0].tolist() == plain.encode(text, add_special_tokens=False).ids
    seen = made[0].seen
    assert len(seen) == len(set(seen)) and {*rare, "the", "quick", "brown", ",", "."} == set(seen)  # though 100 others came in between, ten times
    own = getattr(PK, "_stems", {}).get(str(path))
    assert own is None or max(len(own.recent), len(own.older)) <= 100


def test_islands_pack_tightly(spark):
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 900, 3000).tolist()
    rows = spark.createDataFrame(list(enumerate(lengths)), "pid long, length long")
    out = PK.pack(rows, shard_items=500).collect()
    assert len(out) == 3000
    assert len({r.sequence_id for r in out}) <= 1.01 * math.ceil(sum(lengths) / 2048)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=2, max_size=40), st.integers(0, 5))
def test_crossover_keeps_every_piece_and_the_capacity(sizes, seed):
    s = np.array(sizes)
    a, b = (PK.evolve(s, [], 64, k, 2, 0) for k in (seed, seed + 1))
    child = PK.crossover(a, b, s, sizes, 64, np.random.default_rng(seed))
    assert len(child) == len(s) and np.bincount(child, weights=s).max() <= 64


# ---- quality


def test_classifier_learns_and_ignores_the_held_out(spark):
    rows = [(i, ("plain words in a row number %d " % i) * 5 if i % 2 else ("BAD!! TEXT$$ ### %d !! " % i) * 5) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2 if zlib.crc32(str(i).encode()) % 4 != 2 else 1 - i % 2) for i, _ in rows] + [(3, None), (None, 1), (9999, 1), (5, 7)], "doc_id long, quality int")
    got = {r.doc_id: r for r in Q.score_documents(docs(spark, rows), labels).collect()}
    assert all(got[i].predicted == i % 2 for i, _ in rows)  # wrong labels of the held-out fold teach nothing
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _ in rows)
    assert {r.doc_id for r in Q.keep_good(docs(spark, rows), labels).collect()} == {i for i, _ in rows if i % 2}
    edges = Q.score_documents(docs(spark, EDGES), labels).collect()
    assert len(edges) == len(EDGES) and all(0 <= r.score <= 1 for r in edges)
    assert {r.score for r in Q.score_documents(docs(spark, EDGES), labels.limit(0)).collect()} == {0.5}


def test_machine_equals_all_pairs():
    rng = np.random.default_rng(0)
    at, x = rng.choice(Q.SIZE, 9, replace=False), rng.random(9)
    m = Q.Machine(0.3, rng.normal(size=Q.SIZE), rng.normal(size=(Q.SIZE, Q.RANK)))
    pairs = sum(m.factors[at[i]] @ m.factors[at[j]] * x[i] * x[j] for i in range(9) for j in range(i))
    assert math.isclose(m.raw_score(at, x), 0.3 + m.linear[at] @ x + pairs)


# ---- pages


def test_wrappers_find_the_article(spark):
    page = lambda i: f"<html><body><div class=top>Site</div><nav><ul><li>a<li>b</ul></nav><div class=post><h2>T{i}</h2><p>Text {i} &amp; more<br>line</p><p>Second {i}</p></div><div class='ad'>Buy</div><form>x</form><script>var p='<p>';</script><div id=comments><p>I say {i}</p></div><footer>f</footer>"
    rows = [(i, "http://h.example/x", page(i)) for i in range(8)] + [(90, None, None), (91, "nonsense", ""), (92, "http://o.example/", "<article><header><a>m</a><h1>H</h1></header><p>a &lt;b&gt;</article>"), (0, "http://h.example/x", page(0)), (93, "http://d.example/", "<div>" * 3000 + "deep")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in HX.extract(pages).collect()}
    assert got[3][0] == "T3\nText 3 & more line\nSecond 3" and got[3][1] == len(got[3][0])
    assert (got[90][0], got[91][0], got[92][0], got[93][0]) == ("", "", "H\na <b>", "deep")
    assert HX.extract(pages).count() == len(rows)
    assert HX.extract(pages.limit(0)).count() == 0


def test_wrapper_is_a_union_free_expression():
    w = HX.wrapper_of(HX.parse("<ul><li>a</li><li>b</li></ul><p>x</p>"))
    HX.merge(w, HX.wrapper_of(HX.parse("<ul><li>c</li></ul><b>y</b><p>x</p>")))
    assert HX.expression(w) == "<ul> (<li> #PCDATA </>)+ </> (<b> y </>)? <p> x </>"


# ---- urls

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "org", "/a"), (None, "x", "/"), ("allow", None, "/")]


def test_urls_equal_brute_force(spark):
    urls = ["http://a.example.com/en/1?x", "https://WWW.example.com/en/", "http://example.com", "http://x.net/es/q#f", "http://net/es/", "ftp://a.org/abc", "http://a.org/b", None, "nothing", "http://spam-farm.example.info/", "http://notexample.com/en/", "http:///en/", "a://b://c/en/", "http://a.example.com/en/1?x"]
    pages = spark.createDataFrame([(i, u, "z", "q") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(pages, U.rules_table(spark, RULES), words=["spam"]).collect()}
    plain = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(pages, U.rules_table(spark, RULES)).collect()}
    many = [*RULES, *[("block", "long.example", "/" + "a" * k) for k in range(1, 80)]]  # more lengths of paths than are cut one by one
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(pages, U.rules_table(spark, many)).collect()} == plain
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0].lower()
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fits = [(len(h) + len(p), a, h + p) for a, h, p in RULES if a and h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits) if fits else None
        word = "block" if "spam" in re.split(r"[.\-]", host) else "allow"
        assert got[i] == (host, path, rule and rule[2], rule[1] if rule else word)
        assert plain[i] == (host, path, rule and rule[2], rule[1] if rule else "allow")
    assert U.judge(pages, U.rules_table(spark, [])).where("rule IS NOT NULL").count() == 0


def test_url_query_blocks_by_words_as_its_sql_does(spark, tmp_path):
    import duckdb

    from snapdiff.llm import queries

    urls = ["http://casino.example.info/a", "http://best-poker.org/", "http://pokers.org/", "http://casino.com/x", "http://casino.com", None]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in queries.op5_url_filters(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert {r[0]: r[1:] for r in con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({queries.ORACLE_SQL['op5_url_filters']})").fetchall()} == got
    assert [got[i][3] for i in range(len(urls))] == ["block", "block", "allow", "allow", "block", "allow"]


# ---- chats


@settings(max_examples=80, deadline=None)
@given(st.sampled_from(["system", "user", "assistant", "tool", "<|x|>", ""]), st.text(alphabet="a<>/s[]INSTY\\|\n ", max_size=30), st.booleans())
def test_turns_read_back(role, text, first):
    whole = "".join(t for t, _ in CF.segments(role, text, first))
    assert CF.read_turn(whole) == (role, text)


def test_conversations_read_back(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] ok [/INST]"), (2, 1, "assistant", None), (2, 0, None, "x\\"), (3, None, "system", "s"), (3, 1, "assistant", "a"), (None, 0, "user", "u"), (4, 0, "user", "d"), (4, 0, "user", "d")]
    given_ = spark.createDataFrame([(*r, 1, True) for r in rows], "conv_id long, turn long, role string, text string, place long, valid boolean")
    got = {r.conv_id: r for r in CF.read_back(CF.format_turns(given_)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        loss = "".join(t for _, _, role, t in own if role == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in own).encode()).hexdigest()
        assert (got[conv].n_turns, got[conv].loss_chars, got[conv].loss_sha256) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert [got[k].valid for k in (1, 2, 3, 4)] == [True, False, False, False]
    assert CF.read_back(CF.format_turns(given_.limit(0))).count() == 0


# ---- vectors


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = []
    for c in range(40):
        base = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 12))):
            rows.append((len(rows), (base + rng.normal(size=16) * rng.choice([0, 0.03, 0.06])).astype(np.float32).tolist(), int(c % 3)))
    rows += [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 16, 1), (1003, [float("nan")] * 16, 1), (1004, [None] * 16, 1), (1005, rows[0][1], None), (1006, [1.0, 2.0], 1), (0, rows[0][1], 0)]
    v = spark.createDataFrame([(*r, 9, True) for r in rows], "vec_id long, embedding array<float>, label int, rep long, kept boolean")
    for block in (3000, 25):
        out = ED.near_duplicates(v, shard_vectors=20, block_vectors=block)
        got = sorted((r.vec_id, r.n_links, r.component_id) for r in out.collect())
        best = list(range(len(rows)))
        n = [0] * len(rows)
        good = [k for k, r in enumerate(rows) if r[1] and r[2] is not None and all(e is not None and math.isfinite(e) for e in r[1]) and any(r[1])]
        unit = {k: np.array(rows[k][1]) / np.linalg.norm(np.array(rows[k][1])) for k in good}
        name = [r[0] for r in rows]
        for _ in range(8):
            for a in good:
                for b in good:
                    if a != b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98:
                        name[a] = name[b] = min(name[a], name[b])
        for a in good:
            n[a] = sum(a != b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98 for b in good)
        want = sorted((r[0], n[k], name[k]) for k, r in enumerate(rows))
        found, true = sum(g[1] for g in got), sum(w[1] for w in want)
        assert 0.97 * true <= found <= true
        assert sum(g[2] != w[2] for g, w in zip(got, want, strict=True)) <= 2
    audit = ED.audit(v, out, every=5).agg({"n_true": "sum", "n_links": "sum"}).first()
    assert audit["sum(n_links)"] >= 0.9 * audit["sum(n_true)"] > 0
    assert best and ED.near_duplicates(v.limit(0)).count() == 0
    assert ED.audit(v.limit(0), out).count() == 0


def test_large_group_of_near_copies_keeps_its_links(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=32)
    near = base + rng.normal(size=(2000, 32)) * 0.08 * np.linalg.norm(base) / math.sqrt(32)
    rest = rng.normal(size=(600, 32))
    x = np.concatenate([near, rest]).astype(np.float32)
    v = spark.createDataFrame([(i, a.tolist(), 1) for i, a in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in ED.near_duplicates(v, shard_vectors=50, block_vectors=500).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    true = (u @ u.T >= 0.98).sum(1) - 1
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= true).all() and found.sum() >= 0.99 * true.sum() > 10**6
    assert len({got[i].component_id for i in range(2000)}) == 1


# ---- personal data

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_spans(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 14 <= len(d) <= 19 and pii.luhn(d) or k == 3 and 10 <= len(d) <= 15:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a@.-+0159 (é\n_", max_size=40))
def test_base_spans_equal_patterns(text):
    assert pii.base_spans(text) == brute_spans(text)


def test_field_finds_what_neighbours_spoil(spark):
    text = "see 2353820953013749 4550997810720808 there, write a.b@mail.example.com or +1 (555) 555-1234 4539578763621486 now"
    rows = [*EDGES, (20, text), (21, "Licensed under CC BY-NC 4.0. page 12 of 300, 12:30"), (22, "1" * 20_000), (23, "@" * 5000)]
    got = {r.doc_id: r for r in pii.find_personal_data(docs(spark, rows)).collect()}
    assert got[20].base_sha256 == hashlib.sha256(pii.spelled(brute_spans(text)).encode()).hexdigest()
    kinds = Counter(s.split(":")[0] for s in got[20].spans.split(","))
    assert kinds["email"] == 1 and kinds["card"] == 2 and kinds["phone"] == 1
    assert got[21].spans == "" and got[1].spans == "" and len(got) == len({r[0] for r in rows})
    out = {r.doc_id: r for r in pii.redact(docs(spark, rows)).collect()}
    assert "4550997810720808" not in out[20].text and "[EMAIL]" in out[20].text and out[20].n_chars == len(out[20].text)
    assert out[3].text == "a b c" and out[1].text is None
    assert pii.redact(docs(spark, rows)).columns == docs(spark, rows).columns


def test_viterbi_is_the_best_path():
    field = pii.default_field()
    rng = np.random.default_rng(4)
    e = rng.normal(size=(3, len(pii.LABELS))) * 3
    paths = [(a, b, c) for a in range(9) for b in range(9) for c in range(9)]
    score = lambda p: e[0, p[0]] - (1e4 + e[0, p[0]]) * (p[0] > 0 and p[0] % 2 == 0) + e[1, p[1]] + e[2, p[2]] + field.move[p[0], p[1]] + field.move[p[1], p[2]]
    assert tuple(pii.viterbi(field, [e, e[:2]])[0]) == max(paths, key=score)


# ---- language model


def test_base_scores_equal_counts(spark):
    rows = [*EDGES, *[(i, f"the cat {i % 7} sat on THE mat\t{i % 5}") for i in range(100, 160)]]
    tokens = [[w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if w] + ["<end>"] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(w for ws, h in zip(tokens, held, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in LM.score_documents(docs(spark, rows)).collect())
    want = sorted((str(i), h, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for (i, _), h, ws in zip(rows, held, tokens, strict=True))
    assert got == want
    assert LM.score_documents(docs(spark, rows).limit(0)).count() == 0


def test_filter_counts_are_quantised_and_never_too_low(spark):
    rows = [(i, "a b " * (i % 4 + 1) + f"u{i}") for i in range(300)]
    model = LM.build_filter(docs(spark, rows).select("doc_id", "text"), 3000)
    one, two = zip(*[LM.grams(t.encode()) for i, t in rows if not LM.is_held_out(i)], strict=True)
    for part in (one, two):
        values, times = np.unique(LM._cut(np.concatenate(part), model.width), return_counts=True)
        found = model.counts(values)
        level = np.floor(np.log2(times))
        assert (found >= np.where(level == 0, 1, 1.5 * 2**level - 0.5)).all()
        assert np.mean(found <= 2 ** (level + 1)) > 0.97
    assert len(LM.unpacked(LM.packed(np.array([3, 9, 1 << 39], np.uint64), np.array([1, 2, 70_000])))[0]) == 3


def test_familiar_text_scores_higher(spark):
    rows = [(i, "the cat sat on the mat today") for i in range(80)] + [(1000 + i, "mat on today cat the sat the") for i in range(7)]
    got = {r.doc_id: r.score for r in LM.score_documents(docs(spark, rows)).collect()}
    assert got[0] > got[1000] and all(s < 0 for s in got.values())


@pytest.mark.parametrize("name", ["op2", "op4", "op6"])
def test_queries_run_whole_tables(spark, sf, name):
    from snapdiff.llm import queries

    table, key = {"op2": ("pages", "page_id"), "op4": ("documents", "doc_id"), "op6": ("conversations", "conv_id")}[name]
    f = next(f for k, f in queries.QUERIES.items() if k.startswith(name + "_"))
    ids = {r[0] for r in f(spark, sf).select(key).collect()}
    assert {r[0] for r in spark.read.parquet(f"{sf}/{table}.parquet").select(key).collect()} <= ids


def test_base_scores_need_no_model(spark, sf, monkeypatch):
    from snapdiff.llm import queries

    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens"]
    rows = lambda df: sorted((str(r.doc_id), *r[1:5], round(r.base_score, 4)) for r in df.select(*columns, "base_score").collect())
    want = rows(LM.score_documents(spark.read.parquet(f"{sf}/documents.parquet")))
    monkeypatch.setattr(LM, "filter_segments", None)
    assert rows(queries.lm_base_scores(spark, sf)) == want and len(want) > 0


def test_blocks_are_read_one_at_a_time():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([b"x", None], pa.binary())], ["block", "words"])
    rows = LM._rows(iter([batch, batch.slice(1)]))
    assert next(rows) == (1, b"x") and list(rows) == [(2, None), (2, None)]
