"""Product codes of vectors, their codebooks fitted by ball k-means.

A component x becomes the integer floor(256 x), so that distances, ties and means are exact. Vectors
are cut into equal parts; the codebook of a part position starts as that part of the vectors with the
smallest ids. A round assigns every part to its nearest entry and moves each entry to the floored
mean of its parts; after the last round parts are assigned once more.

The first round compares every part with every entry. Later rounds know the entry that each part
had (kept with the vectors in the shared folder) and work in balls: an entry's ball holds its parts,
and its radius is the distance of the farthest of them. Only entries within twice the radius are
neighbours of a ball. A part that is nearer to its entry than half the way to the closest neighbour
is in the stable core and keeps its entry unseen; the others lie in rings between half the ways to
one neighbour and the next, and are compared with the neighbours inside their ring only. Balls are
those of the rows of one Arrow batch: smaller balls have fewer neighbours, and the result is the same.

A round is one scan that writes vectors and codes, and a row of sums for each task; the sums are
added by Spark and only the codebooks (parts x entries rows) come to the driver. Rounds are written
to the shared folder, so a lost executor costs its tasks alone.

Defined results: rows whose vector is null or holds null or non-finite components are dropped. Of the
others, those that cannot be coded (of another length than the smallest id among vectors whose length
is a multiple of the parts, or with a component of 2^31 or more after scaling) have null code and
error and are in no codebook. Rows that repeat are rows of their own; among equal ids the smaller
vector comes first, a null id last. Fewer vectors than entries make a shorter codebook; no vectors
give no rows. An error or sum past 64 bits is null. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

SCALE = 256
MOST = 1 << 31


def exact(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles where their squared distances are exact in them, else as Python integers."""
    most = max((int(np.abs(a).max(initial=0)) for a in (x, entries)), default=0)
    kind = np.float64 if 16 * most * most * max(1, x.shape[1]) < 1 << 53 else object
    return x.astype(kind), entries.astype(kind)


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows by entries, exact for what ``exact`` returns."""
    return (x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, ties to the lower index, and its squared distance; all are compared."""
    x, entries = exact(x, entries)
    code, least = np.zeros(len(x), np.int64), np.zeros(len(x), x.dtype)
    for at in range(0, len(x), 4096):
        d = squared(x[at : at + 4096], entries)
        code[at : at + 4096] = d.argmin(1)
        least[at : at + 4096] = d[np.arange(len(d)), code[at : at + 4096]]
    return code, least


def nearest_by_balls(x: np.ndarray, had: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """As ``nearest``, from the entries ``had`` that the rows were at; and how many distances to others it took."""
    x, entries = exact(x, entries)
    between = squared(entries, entries)
    off = x - entries[had]
    least, code = (off * off).sum(1), had.astype(np.int64).copy()
    order = np.argsort(had, kind="stable")
    cuts = np.flatnonzero(np.diff(had[order])) + 1
    taken = 0
    for rows in np.split(order, cuts) if len(order) else ():
        k, reach = int(had[rows[0]]), 4 * least[rows]  # compared with squared distances between entries
        near = np.flatnonzero((between[k] <= reach.max()) & (np.arange(len(entries)) != k))
        near = near[np.argsort(between[k][near], kind="stable")]
        ring = np.searchsorted(between[k][near], reach, side="right")  # neighbours that can be as near as k
        inner, outer = 0, 1
        while inner < len(near):
            some = rows[(ring > inner) & (ring <= outer)]
            if len(some):
                among = np.sort(np.append(near[:outer], k))  # in order, so that ties go to the lower index
                d = squared(x[some], entries[among])
                best = d.argmin(1)
                code[some], least[some] = among[best], d[np.arange(len(some)), best]
                taken += d.size - len(some)
            inner, outer = outer, 2 * outer
    return code, least, taken


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _coded(x: np.ndarray, had: np.ndarray | None, books: np.ndarray) -> tuple[np.ndarray, list]:
    """Codes (rows by parts) and the squared distances of each part position."""
    codes, parts = np.zeros((len(x), len(books)), np.uint8), np.split(x, len(books), axis=1)
    far = []
    for p, (own, entries) in enumerate(zip(parts, books, strict=True)):
        codes[:, p], d = nearest(own, entries) if had is None else nearest_by_balls(own, had[:, p], entries)[:2]
        far.append(d)
    return codes, far


def _round(rows: DataFrame, books: np.ndarray, name: str) -> tuple[DataFrame, np.ndarray]:
    """Rows with their new codes, stored, and the codebooks after them."""
    parts, entries, width = books.shape
    first = "code" not in rows.columns
    schema = ", ".join(f"{f} {t}" for f, t in rows.dtypes if f != "code") + ", code binary, sums array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kinds = np.zeros((parts, entries, 1 + width), np.int64), None
        for batch in batches:
            kinds = [batch.schema.field(i).type for i in range(3)]
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(2), parts * width)
            had = None if first else np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, parts)
            codes, _ = _coded(x, had, books)
            for p in range(parts):
                np.add.at(total[p], codes[:, p], np.column_stack([np.ones(len(x), np.int64), x[:, p * width : (p + 1) * width]]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([c.tobytes() for c in codes], pa.binary()), pa.nulls(len(x), pa.list_(pa.int64()))], [*names, "code", "sums"])
        if kinds:
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, k) for k in kinds], pa.nulls(1, pa.binary()), pa.array([total.ravel().tolist()], pa.list_(pa.int64()))], [*names, "code", "sums"])

    names = rows.columns[:3]
    out = stored(rows.mapInArrow(run, schema), name)
    added = out.where("sums IS NOT NULL").select(F.posexplode("sums").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n"))
    total = np.zeros(books.size + parts * entries, np.int64)
    for r in added.collect():  # a row for each number in the codebooks
        total[r["at"]] = r["n"]
    total = total.reshape(parts, entries, 1 + width)
    count = total[:, :, :1]
    return out.where("code IS NOT NULL").drop("sums"), np.where(count > 0, total[:, :, 1:] // np.maximum(count, 1), books)


def spelled(books: np.ndarray) -> str:
    """Digest of all components in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def with_label_sums(rows: DataFrame, hot_labels: int = 1000, most_bytes: int = 1 << 23) -> DataFrame:
    """Adds label_error, the sum of ``error`` over equal labels (nulls together), to stored ``rows (label, error)``.

    At most ``hot_labels`` labels hold more than a ``hot_labels``-th of the rows; their sums are broadcast,
    if they take no more than ``most_bytes``, so that no label's rows meet in one task. The other labels are joined by a shuffle.
    """
    sums = stored(rows.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n")), "labels")
    total = sums.agg(F.sum("n")).first()[0] or 0
    hot = sums.where(F.col("n") > total // hot_labels)
    size = hot.agg(F.sum(F.coalesce(F.octet_length(F.col("label").cast("string")), F.lit(0)) + 32)).first()[0] or 0
    if size > most_bytes:
        hot = hot.limit(0)
    small = F.broadcast(hot.select(F.col("label").alias("l"), "label_error", F.lit(True).alias("is_hot")))
    first = rows.join(small, F.col("label").eqNullSafe(F.col("l")), "left").drop("l")
    cold = sums.where(F.lit(size > most_bytes) | (F.col("n") <= total // hot_labels)).select(F.col("label").alias("l"), "label_error")
    rest = first.where("is_hot IS NULL").drop("label_error").join(cold, F.col("label").eqNullSafe(F.col("l"))).drop("l")
    return first.where("is_hot").unionByName(rest).drop("is_hot")


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per kept vector: vec_id, code (two hex digits a part), error, label_error, codebooks_sha256. At most 256 entries."""
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte for each part")
    own = F.col(vector_col)
    kept = vectors.where(own.isNotNull() & F.forall(own, _finite))
    small = F.forall("v", lambda x: F.abs(x) < MOST)
    q = stored(kept.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.transform(own, lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v")), "vectors")
    fits = F.coalesce((F.size("v") > 0) & (F.size("v") % parts == 0) & small, F.lit(False))
    order = (F.asc_nulls_last("vec_id"), F.asc("v"))
    lead = q.where(fits).orderBy(*order).select(F.size("v").alias("n")).first()
    if lead is None:
        coded, digest = q.where("false").select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), spelled(np.empty(0))
        fits = F.lit(False)
    else:
        fits = fits & (F.size("v") == lead.n)
        first = q.where(fits).orderBy(*order).select("v").limit(entries).collect()
        books = np.array([r.v for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
        rows = q.where(fits)
        for k in range(rounds):
            rows, books = _round(rows, books, f"round{k}")
        digest, width = spelled(books), books.shape[2]

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                had = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, parts) if rounds else None
                codes, far = _coded(_matrix(batch.column(2), parts * width), had, books)
                error = [e if e < 1 << 63 else None for e in (sum(int(d[i]) for d in far) for i in range(len(codes)))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

        kinds = dict(rows.dtypes)
        coded = rows.mapInArrow(finish, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")
    other = q.where(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    out = with_label_sums(stored(coded.unionByName(other), "codes"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
