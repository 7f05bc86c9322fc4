"""Importance resampling of documents towards a target text, over hashed word n-grams.

A feature is a run of 1 to n consecutive words, joined by one space; its bucket is the CRC-32 of its
UTF-8 bytes modulo the number of buckets. A bucket's gain is the scaled log ratio of its smoothed
shares in the target and in the documents; a document's weight is the floored mean of its features'
gains. Documents are drawn without replacement by weight plus Gumbel noise taken from a digest of
the id, so that the draw is the same on every run.

The words of a slice of texts are copied into one buffer with a space after each, in which every
feature is a stretch of bytes. Equal words get one number, and so do equal runs of them. Different features are
grouped by length into matrices of bytes, one row each; the CRCs of a matrix are updated together,
column by column, and the buckets are scattered back to all places of the feature.

Two scans: texts to buckets, which are stored (a few bits each), and buckets to counts and weights.
Counts of tasks are added by Spark. Ranks need no global sort: a score's first rank is the
number of higher scores, taken from a histogram over whole scores (bounded, as gains and noise are,
whatever the number of documents), and within one score documents are ordered by id.

Defined results: null and empty texts have no words, no features and weight 0; a null id has the noise
of the empty id and comes last among ties; rows that repeat are drawn each on their own; no documents give no
rows; an empty target has T = 0. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .packing import slices
from .storage import stored

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_POLYNOMIAL = 0xEDB88320  # fixed value: of CRC-32, its bits reversed


def _crc_table() -> np.ndarray:
    """What a byte adds to a CRC: eight steps of division for each."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(_POLYNOMIAL), t >> 1)
    return t


_CRC = _crc_table()


def crcs(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray, most_bytes: int = 1 << 22) -> np.ndarray:
    """CRC-32 of each stretch of ``buffer``, by matrices of stretches of equal length."""
    out = np.empty(len(starts), np.uint32)
    order = np.argsort(lengths, kind="stable")
    edges = [*np.flatnonzero(np.diff(lengths[order], prepend=-1)).tolist(), len(order)]
    for a, b in zip(edges, edges[1:], strict=False):
        size = int(lengths[order[a]])
        step = max(1, most_bytes // max(size, 1))
        for at in range(a, b, step):
            rows = order[at : min(at + step, b)]
            crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
            for first in range(0, size, 1 << 16):  # of very long features a stripe at a time
                matrix = buffer[starts[rows][:, None] + np.arange(first, min(first + (1 << 16), size))]
                for column in matrix.T:
                    crc = _CRC[(crc ^ column) & 0xFF] ^ (crc >> np.uint32(8))
            out[rows] = ~crc
    return out


def features(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, features of each text, buckets of all features by text)."""
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    cuts = ends - ends[0]
    inside = _IN_WORD[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    edges = cuts[(cuts > 0) & (cuts < len(raw))]  # a text's end parts words
    begins[edges] = inside[edges]
    stops[edges - 1] = inside[edges - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    n_words = np.diff(np.searchsorted(start, cuts))
    sizes = stop - start
    place = np.cumsum(sizes + 1) - sizes - 1  # where a word starts in the new buffer
    new = np.full(int(sizes.sum()) + len(sizes), 0x20, np.uint8)
    spot = np.repeat(place, sizes) + np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    new[spot] = _LOWER[raw[inside]]
    offsets = np.append(place, len(new)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(new)])
    number = words.dictionary_encode().indices.to_numpy() if len(sizes) else np.empty(0, np.int32)
    last = np.repeat(np.cumsum(n_words), n_words)  # of a word: the word after its text's last
    many = int(number.max()) + 1 if len(number) else 1
    n_features = sum((np.maximum(n_words - k, 0) for k in range(longest)), np.zeros(len(n_words), np.int64))
    first = np.cumsum(n_features) - n_features  # where a text's features start
    out = np.empty(int(n_features.sum()), np.int32)
    run = number.astype(np.int64)
    for k in range(longest):
        at = np.flatnonzero(np.arange(len(sizes)) + k < last)  # words that a run of k + 1 starts at
        if k:
            run = run[at] * many + number[at + k]
        ids, values = pd.factorize(run)
        own = np.empty(len(values), np.int64)
        own[ids[::-1]] = at[::-1]  # the first place of each different run
        bucket = (crcs(new, place[own], place[own + k] + sizes[own + k] - place[own]) % np.uint32(buckets)).astype(np.int32)
        here = np.maximum(n_words - k, 0)
        out[np.repeat(first - (np.cumsum(here) - here), here) + np.arange(len(at))] = bucket[ids]
        first = first + here
        full = np.full(len(sizes), -1, np.int64)  # run numbers by word, for the next length
        full[at] = ids
        run = full
    return n_words, n_features, out


def bucket_lists(docs: DataFrame, longest: int, buckets: int, id_col: str | None, text_col: str) -> DataFrame:
    """Per row: doc_id, n_words, and buckets, the bucket of every feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 1, 1_000_000):
                n_words, n_features, found = features(pc.fill_null(some.column(1), ""), longest, buckets)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n_features)]).astype(np.int32), found)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n_words, pa.int64()), lists], ["doc_id", "n_words", "buckets"])

    rows = docs.select((F.col(id_col) if id_col else F.lit(0)).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, buckets array<int>")


def bucket_counts(lists: DataFrame, buckets: int) -> np.ndarray:
    """Features of all rows in each bucket: counted in tasks, added by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in lists.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n  # a row for each bucket
    return out


def gains(source: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """floor(scale * ln of the ratio of smoothed shares) of each bucket."""
    s, t, n = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(scale * math.log((float(b) + 1) * (s + n) / ((float(a) + 1) * (t + n)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weights(lists: DataFrame, gain: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
            sums = np.concatenate([[0], np.cumsum(gain[batch.column(2).flatten().to_numpy()])])
            ends = np.cumsum(lengths)
            total = sums[ends] - sums[ends - lengths]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lengths), pa.array(np.where(lengths > 0, total // np.maximum(lengths, 1), 0))], ["doc_id", "n_words", "n_features", "weight"])

    return lists.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, longest: int = 2, buckets: int = 10_000, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_features, weight, score, rank (null if it was not drawn)."""
    lists = stored(bucket_lists(docs, longest, buckets, id_col, text_col), "buckets")
    aim = bucket_counts(bucket_lists(target, longest, buckets, None, target_text_col), buckets)
    gain = gains(bucket_counts(lists, buckets), aim)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.left(digest, F.lit(8)), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")
    scored = stored(_weights(lists, gain).withColumn("score", F.col("weight") + noise), "scores")
    enough = F.col("n_words") >= least_words
    histogram = sorted(((r.score, r.n) for r in scored.where(enough).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    draw, before, bases = sum(n for _, n in histogram) * percent // 100, 0, []
    for score, n in histogram:
        if before >= draw:
            break
        bases.append((score, before))
        before += n
    none = F.lit(None).cast("long")
    if not bases:
        return scored.select("doc_id", "n_features", "weight", "score", none.alias("rank"))
    base = F.broadcast(scored.sparkSession.createDataFrame(bases, "s long, base long"))  # a row for each whole score
    near = enough & (F.col("score") >= bases[-1][0])
    ordered = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"))
    rank = F.col("base") + F.row_number().over(ordered)
    drawn = scored.where(near).join(base, F.col("score") == F.col("s")).withColumn("rank", rank)
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    rest = scored.where(~near).withColumn("rank", none)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank").unionByName(rest.select("doc_id", "n_features", "weight", "score", "rank"))
