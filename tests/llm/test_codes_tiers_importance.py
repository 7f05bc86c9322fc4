"""Vector codes, tier packing and importance resampling against plain versions, and their odd inputs."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from snapdiff.llm import importance as IM
from snapdiff.llm import tier_packing as TP
from snapdiff.llm import vector_codes as VC

# ---- vector codes


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """(vec_id, code, error, label_error, digest) of rows whose vectors have one length."""
    rows = sorted((r for r in rows if r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])), key=lambda r: (r[0], r[2]))
    cut = lambda v: [v[p * len(v) // parts : (p + 1) * len(v) // parts] for p in range(parts)]
    own = [(i, label, cut([math.floor(256 * x) for x in v])) for i, label, v in rows]
    books = [[r[2][p] for r in own[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            sums = defaultdict(list)
            for r in own:
                sums[near(r[2][p], books[p])[1]].append(r[2][p])
            books[p] = [[sum(c) // len(c) for c in zip(*sums[k])] if k in sums else old for k, old in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out = []
    for i, label, x in own:
        found = [near(x[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
    total = Counter()
    for r in out:
        total[r[3]] += r[2]
    return sorted((i, c, e, total[label], digest) for i, c, e, label in out)


@pytest.mark.parametrize(("n", "width", "spread"), [(400, 32, 1.0), (40, 16, 3.0), (300, 48, 0.02), (1, 16, 1.0)])
def test_codes_equal_brute_force(spark, n, width, spread):
    rng = np.random.default_rng(n)
    rows = [(int(i), None if i % 7 == 0 else int(i % 3), [float(x) for x in rng.normal(0, spread, width)]) for i in rng.permutation(n)]
    rows += [(n + 1, 0, None), (n + 2, 0, [float("nan")] * width), (n + 3, 1, [None] + [1.0] * (width - 1)), (n + 4, 1, [float("inf")] * width)]
    rows += rows[:3]  # repeated rows
    got = VC.compress(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)).collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == plain_codes(rows)


def test_ball_search_equals_full_search_and_skips():
    rng = np.random.default_rng(1)
    for scale, n in ((2, 500), (30, 3000), (300, 3000), (1 << 30, 400)):
        x = rng.integers(-scale, scale + 1, (n, 4))
        entries = x[rng.integers(0, n, 64)]  # ties among them
        had, moved = VC.nearest(x, entries)[0], entries + rng.integers(-1, 2, entries.shape) * max(1, scale // 40)
        code, far = VC.nearest(x, moved)
        by_balls, near, taken = VC.nearest_by_balls(x, had, moved)
        assert (code == by_balls).all() and [int(a) for a in far] == [int(a) for a in near]
        assert taken < n * 64 * 0.6


def test_codes_of_odd_vectors(spark):
    good = [(i, "a", [0.5 * i] * 16) for i in range(5)]
    odd = [(10, "a", [1.0] * 15), (11, "a", []), (12, None, [1e300] * 16), (None, "b", [2.0] * 16)]
    rows = spark.createDataFrame(good + odd, "vec_id long, label string, embedding array<double>").selectExpr("*", "1 AS error", "2 AS code", "3 AS v")
    got = {r.vec_id: r for r in VC.compress(rows).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 10, 11, 12, None}
    assert [got[i].code for i in (10, 11, 12)] == [None] * 3 and got[12].label_error is None and got[None].code == "04" * 16  # a tie
    assert all(got[i].error == 0 and got[i].code == f"{i:02x}" * 16 for i in range(5))
    empty = VC.compress(rows.where("false"))
    assert empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and empty.count() == 0
    assert VC.compress(rows.where("vec_id = 11")).first().code is None


@pytest.mark.parametrize("most", [0, 1 << 23])
def test_label_sums_with_and_without_broadcast(spark, most):
    rows = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN -1 ELSE id END AS label", "id AS error")
    got = {r.label: r.label_error for r in VC.with_label_sums(rows, hot_labels=100, most_bytes=most).collect()}
    assert got[None] == sum(range(0, 3000, 3)) and got[-1] == sum(range(1, 3000, 3)) and got[5] == 5
    assert VC.with_label_sums(rows, hot_labels=100, most_bytes=most).count() == 3000


# ---- tiers


def texts_for_tiers():
    rng = random.Random(5)
    words = ["alpha", "it's", "we'll", "été", "中文字", "1234", "...", "\n\n", "  ", "x" * 90, "\U0001f600", " ", "don't", "'s", "<|endoftext|>"]
    out = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 40, 300, 1500]))) for _ in range(160)]
    return [(i, t) for i, t in enumerate(out)] + [(900, None), (None, "no id"), (7, out[7]), (901, "long text " * 30000)]


def test_token_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    own, rng = Tokenizer.from_file(TP.default_tokenizer()), random.Random(3)
    letters = list("abcst remvld'''  \n\t\r!?-12é中́　  ٠½ǅ\x00\x1c​<|>") + ["'s", "'re", "'ll", " '", "  ", "<|endoftext|>", "I'll"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    got = TP.token_ids(pa.array(texts, pa.string()), TP.default_tokenizer())
    assert [g.tolist() for g in got] == [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("block", [3_000, 2_000_000])
def test_tiers_hold_every_id_once_and_are_full(spark, block):
    from tokenizers import Tokenizer

    own, texts = Tokenizer.from_file(TP.default_tokenizer()), texts_for_tiers()
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "5 AS start", "6 AS sequence_id").repartition(3)
    rows = TP.pack_documents(docs, with_ids=True, block_bytes=block).collect()
    want = Counter()
    for i, t in texts:
        want[i, tuple(own.encode(t or "", add_special_tokens=False).ids) + (0,)] += 1
    pieces = defaultdict(list)
    for r in rows:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        pieces[r.doc_id, r.doc_tokens].append(r)
    for (i, n), own_rows in pieces.items():
        copies = sum(c for (j, ids), c in want.items() if j == i and len(ids) == n)
        starts = Counter(p for r in own_rows for p in range(r.start, r.start + r.length))
        assert len(starts) == n and set(starts.values()) == {copies}
        if copies == 1:
            assert (i, tuple(np.frombuffer(b"".join(bytes(r.ids) for r in sorted(own_rows, key=lambda r: r.start)), "<u4").tolist())) in want
    assert sum(len(ids) * c for (_, ids), c in want.items()) == sum(r.length for r in rows)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length, r.sequence_length))
    for s in sequences.values():
        at = 0
        for offset, length, size in sorted(s):
            assert offset == at
            at += length
        assert at == size and at & (at - 1) == 0 and at <= 1024
    if block > 10_000:  # few documents are cut for a gap, and few sequences are short
        assert sum(s[0][2] < 128 for s in sequences.values()) < 0.05 * len(sequences) + 30
    assert TP.pack_documents(docs.where("false")).count() == 0


def test_windows_and_step_groups():
    rng = np.random.default_rng(2)
    lengths = rng.lognormal(5.5, 1.0, 3000).astype(int).clip(1, 9000).tolist()
    made = list(TP.windows(lengths))
    seen = Counter()
    for size, window in made:
        assert sum(n for _, _, n in window) == size and size & (size - 1) == 0
        seen.update((d, p) for d, s, n in window for p in range(s, s + n))
    assert len(seen) == sum(lengths) and set(seen.values()) == {1}
    assert len(made) * 1024 < 1.6 * sum(lengths) and sum(len(w) for _, w in made) < 2 * len(lengths) + len(made)
    sizes = np.array([s for s, _ in made])
    costs = np.array([sum(n * n for _, _, n in w) for _, w in made])
    groups = TP.step_groups(sizes, costs, 65_536)
    top = [g for g in set(groups[sizes == 1024].tolist())]
    tokens = [int(sizes[groups == g].sum()) for g in top]
    assert max(tokens) - min(tokens) <= 1024 and all(len(set(sizes[groups == g])) == 1 for g in set(groups.tolist()))
    cost = [int(costs[groups == g].sum()) for g in top]
    assert max(cost) < 1.1 * min(cost)
    assert list(TP.windows([])) == [] and [s for s, _ in TP.windows([1024, 3])] == [1024, 2, 1]
    with pytest.raises(ValueError, match="powers of two"):
        TP.pack_documents(None, tiers=(1000,))


# ---- importance


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text, longest=2):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def plain_resample(docs, target):
    s, t = Counter(b for _, x in docs for b in plain_features(x)[1]), Counter(b for x in target for b in plain_features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
    rows = []
    for i, x in docs:
        n, f = plain_features(x)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    enough = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = [(r, k) for k, r in enumerate(enough[: 25 * len(enough) // 100], 1)]
    return sorted((*r[:4], next((k for q, k in ranks if q is r), None)) for r in rows if r[0] is not None), [r for r in rows if r[0] is None]


def test_resampling_equals_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["Été", "中", "A", "b-c", "x_y"]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([0, 3, 19, 20, 60])))) for i in range(300)] + [(301, None), (302, "q" * 70_000), (303, ""), (-5, "a b " * 20)]
    target = [" ".join(rng.choices(words[:9], k=40)) for _ in range(20)] + [None]
    frame = spark.createDataFrame(docs + [(None, "c d " * 20)], "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS n_words").repartition(4)
    got = IM.resample(frame, spark.createDataFrame([(t,) for t in target], "text string")).collect()
    want, none = plain_resample(docs + [(None, "c d " * 20)], target)
    assert sorted((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got if r.doc_id is not None) == want
    assert [(r.n_features, r.weight, r.score) for r in got if r.doc_id is None] == [tuple(x[1:4]) for x in none]
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 1 + sum(1 for r in want if r[4]) + sum(1 for r in got if r.doc_id is None and r["rank"])))


def test_resampling_of_nothing_and_of_repeats(spark):
    schema = "doc_id long, text string"
    empty = IM.resample(spark.createDataFrame([], schema), spark.createDataFrame([], schema))
    assert empty.columns == ["doc_id", "n_features", "weight", "score", "rank"] and empty.count() == 0
    same = spark.createDataFrame([(1, "one two " * 15)] * 8, schema)
    rows = IM.resample(same, spark.createDataFrame([], schema)).collect()
    assert len(rows) == 8 and sorted(r["rank"] for r in rows if r["rank"]) == [1, 2]


def test_crcs_in_matrices():
    rng = np.random.default_rng(0)
    buffer = rng.integers(0, 256, 300_000, np.uint8)
    starts, lengths = rng.integers(0, 1000, 500), np.concatenate([rng.integers(0, 40, 498), [200_000, 70_000]])
    assert IM.crcs(buffer, starts, lengths, most_bytes=1000).tolist() == [zlib.crc32(buffer[a : a + n].tobytes()) for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
