"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

Inputs of a score: word weights hashed to ``WORDS`` places, structure statistics of the text
(shares of character classes, line and word shapes, repetition) and the length as metadata,
each cut into steps and hashed as well. Pairwise interactions have rank ``RANK`` and cost
linear time: ``sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2) / 2``. Labels, language, source
and id are no inputs.

The machine is fitted on at most ``max_rows`` labelled rows (the lowest hashes of their ids,
a fixed sample) by minibatch gradient steps on the driver; features are made in tasks. Scoring
is one pass without shuffle over all rows, with a model of fixed size.

Nulls, ties and repeats: a null text is an empty one; labels other than 0 and 1, null labels and
labels of unknown ids are left out; an id that is labelled twice counts twice; without any usable
label every score is 0.5; rows that repeat score alike; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS, RANK, STEPS = 1 << 15, 8, 12


class _Places(dict):
    def __missing__(self, word: bytes) -> int:
        place = xxhash.xxh3_64_intdigest(word) % WORDS
        if len(word) <= 64:
            if len(self) >= 400_000:
                self.clear()
            self[word] = place
        return place


_places = _Places()
_KIND = np.full(256, 5, np.int64)  # 0 lower, 1 upper, 2 digit, 3 space, 4 punctuation, 5 beyond ASCII
for _k, _codes in enumerate((range(97, 123), range(65, 91), range(48, 58), (9, 10, 11, 12, 13, 32))):
    _KIND[list(_codes)] = _k
_KIND[[c for c in range(128) if _KIND[c] == 5]] = 4


def statistics(raw: bytes, words: list[bytes], distinct: int) -> np.ndarray:
    """Structure statistics of a text, each from 0 to 1."""
    n, w = max(len(raw), 1), max(len(words), 1)
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=6) / n
    lines = raw.split(b"\n")
    ends = Counter(x[-1:] for x in words)
    symbols = sum(c for e, c in ends.items() if _KIND[e[0]] == 4)
    marks = max((c for e, c in ends.items() if _KIND[e[0]] == 4), default=0)
    alone = sum(1 for x in words if len(x) == 1 and _KIND[x[0]] == 4)
    return np.array([
        *kinds, symbols / w, marks / w, alone / w, distinct / w, len(set(lines)) / len(lines),
        min(len(lines) / w * 4, 1), min(len(raw) / w / 16, 1), np.log2(n + 1) / 24, sum(1 for x in words if x.isupper()) / w,
    ])


N_STATS = 15


def features(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights) of a whole text."""
    words = raw.split()
    counts = Counter(words)
    places = np.fromiter((_places[x.lower()] for x in counts), np.int64, len(counts))
    weights = np.sqrt(np.fromiter(counts.values(), float, len(counts)))
    if len(weights):
        weights /= np.sqrt(np.square(weights).sum())
    stats = statistics(raw, words, len(counts))
    steps = np.minimum((np.sqrt(stats) * STEPS).astype(np.int64), STEPS - 1) + STEPS * np.arange(N_STATS)
    return np.concatenate([places, WORDS + steps, WORDS + N_STATS * STEPS + np.arange(N_STATS)]), np.concatenate([weights, np.full(N_STATS, 0.4), stats])


SIZE = WORDS + N_STATS * STEPS + N_STATS


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw_score(self, at: np.ndarray, x: np.ndarray) -> float:
        vx = self.factors[at] * x[:, None]
        return float(self.bias + self.linear[at] @ x + 0.5 * (np.square(vx.sum(0)).sum() - np.square(vx).sum()))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, rate: float = 0.08, decay: float = 1e-5, seed: int = 7) -> Machine:
    """Adaptive gradient steps, one row at a time; both classes weigh alike."""
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(SIZE), rng.normal(0, 0.02, (SIZE, RANK)))
    seen_w, seen_v, seen_b = np.full(SIZE, 1e-2), np.full((SIZE, RANK), 1e-2), 1e-2
    share = np.clip(labels.mean(), 0.01, 0.99)
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            v = m.factors[at]
            vx = v * x[:, None]
            total = vx.sum(0)
            z = m.bias + m.linear[at] @ x + 0.5 * (np.square(total).sum() - np.square(vx).sum())
            g = weight[i] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[i])
            gw = g * x + decay * m.linear[at]
            gv = g * x[:, None] * (total - vx) + decay * v
            seen_b += g * g
            np.add.at(seen_w, at, gw * gw)
            seen_v[at] += gv * gv
            m.bias -= rate * g / np.sqrt(seen_b)
            np.subtract.at(m.linear, at, rate * gw / np.sqrt(seen_w[at]))
            m.factors[at] -= rate * gv / np.sqrt(seen_v[at])
    return m


def in_training(doc_id: Column, modulus: int = 4, held_out: int = 2) -> Column:
    return F.crc32(doc_id.cast("string")) % modulus != held_out


def train(documents: DataFrame, labels: DataFrame, max_rows: int = 6000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Machine | None:
    """A machine from at most ``max_rows`` labelled rows outside the held-out fold; None without labels."""
    usable = labels.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1)).where(in_training(F.col("i")))
    sample = usable.orderBy(F.xxhash64("i"), "i", "y").limit(max_rows)  # a bounded table
    joined = documents.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).join(F.broadcast(sample), F.col("doc") == F.col("i")).select("doc", "text", "y")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [features(x or b"") for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([a.astype("<i4").tobytes() for a, _ in both], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x in both], pa.binary())], ["doc", "y", "at", "x"])

    rows = sorted(joined.mapInArrow(make, "doc long, y int, at binary, x binary").collect(), key=lambda r: (zlib.crc32(str(r.doc).encode()), r.doc, r.y, r.at))
    if not rows:
        return None
    made = [(np.frombuffer(r["at"], "<i4").astype(np.int64), np.frombuffer(r["x"], "<f4").astype(float)) for r in rows]
    return fit(made, np.array([r["y"] for r in rows], float))


def scorer(spark, machine: Machine | None):
    """A column function: text -> score from 0 to 1."""
    shared = spark.sparkContext.broadcast(machine and Machine(machine.bias, machine.linear.astype(np.float32), machine.factors.astype(np.float32)))

    def score(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[np.ndarray]:
        own = shared.value
        for batch in batches:
            z = np.array([own.raw_score(*features(x or b"")) if own else 0.0 for x in batch.column(text_at).cast(pa.binary()).to_pylist()], float)
            yield batch, 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    return score


def score_documents(documents: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: doc_id, held_out, score and predicted (score >= ``threshold``)."""
    score = scorer(documents.sparkSession, train(documents, labels, id_col=id_col, text_col=text_col, **options))
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, s in score(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], ["doc_id", "score"])

    out = docs.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(~in_training(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Documents, all columns, whose score reaches ``threshold``."""
    score = scorer(documents.sparkSession, train(documents, labels, id_col=id_col, text_col=text_col, **options))
    at = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, s in score(batches, at):
            yield batch.filter(pa.array(s >= threshold))

    return documents.mapInArrow(run, documents.schema)
