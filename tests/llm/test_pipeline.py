"""Each stage of the pipeline on what its predecessor kept, against a plain version."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from snapdiff.llm import packing, pii, quality
from snapdiff.llm.storage import stored

from .test_text import brute_hits


@pytest.fixture(scope="module")
def stages(spark, sf):
    """Stage name -> (rows in, rows out), as dictionaries by doc_id; the last one's rows as they are."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = stored(stage(spark, docs, sf), name)
        after = docs.collect() if name == "pack" else {r.doc_id: r for r in docs.collect()}
        assert name == "pack" or docs.columns == columns
        out[name] = (before, after)
        before = after
    return out


def test_quality_keeps_what_the_classifier_accepts(spark, sf, stages):
    before, after = stages["quality"]
    scores = quality.score_documents(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect()
    assert set(after) == {r.doc_id for r in scores if r.predicted == 1}
    assert 0 < len(after) < len(before)


def test_one_of_each_group_stays(stages):
    before, after = stages["near_copies"]
    ids = sorted(before)
    sets = {}
    for i in ids:
        w = before[i].text.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    top = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((top[a], top[b]))
                top = {k: x if v == y else v for k, v in top.items()}
    assert set(after) == {i for i in ids if top[i] == i}


def test_contaminated_documents_go(spark, sf, stages):
    before, after = stages["decontaminate"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hits = brute_hits([(i, r.text) for i, r in before.items()], items)
    assert set(after) == {i for i in before if not hits[i][1]}


def test_personal_data_is_replaced(stages):
    before, after = stages["personal_data"]
    assert set(after) == set(before)
    for i, r in before.items():
        ((_, every),) = pii.all_spans(pii.default_field(), [r.text])
        assert after[i].text == pii.redacted(r.text, every) and after[i].n_chars == len(after[i].text)


def test_all_tokens_are_packed(stages):
    from tokenizers import Tokenizer

    before, rows = stages["pack"]
    t = Tokenizer.from_file(packing.default_tokenizer())
    want = []
    for i, r in before.items():
        ids = np.array(t.encode(r.text, add_special_tokens=False).ids + [0], "<u4")
        want += [(i, k, zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in rows) == sorted(want)
    fill: dict[int, int] = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 2048


CLASHING = ("row_key", "score", "predicted", "label", "quality", "n_hit", "contaminated", "shard", "cluster", "id", "component_id", "spans", "piece", "pid", "start", "h")


def odd_documents(spark):
    rows = [(1, None), (None, "A text without an id, of several words."), (2, ""), (3, "one two three four five six seven. " * 3000), (4, "The same row comes twice here, as it is."), (4, "The same row comes twice here, as it is."), (5, "Write to ann@example.com now or never, please do."), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.selectExpr("*", *[f"'x' AS {c}" for c in CLASHING])


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_take_odd_and_empty_tables(spark, sf, name, stage):
    docs = odd_documents(spark)
    rows = stage(spark, docs, sf).collect()
    empty = stage(spark, docs.where("false"), sf)
    assert empty.count() == 0
    if name == "pack":
        assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5, None} and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
        return
    assert empty.columns == docs.columns and all(r[c] == "x" for r in rows for c in CLASHING)
    ids = sorted(str(r.doc_id) for r in rows)
    if name == "near_copies":
        assert ids == ["1", "2", "3", "4", "5", "None", "None"]  # one row of an id; rows without one stay
    elif name == "personal_data":
        assert ids == ["1", "2", "3", "4", "4", "5", "None", "None"] and not any("ann@" in (r.text or "") for r in rows)
    elif name == "decontaminate":
        assert ids == ["1", "2", "3", "4", "4", "5", "None", "None"]
    else:
        assert set(ids) <= {"1", "2", "3", "4", "5", "None"}


def test_registered():
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert {int(m[1]) for q in entry.queries() if (m := re.match(r"op(\d+)_", q))} == set(range(1, 14))
