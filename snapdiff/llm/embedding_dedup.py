"""Embedding near-dedup: robust-pruned flat graphs on overlapping cluster shards.

1. Equal vectors of a label are one class with a count, so thousands of copies cost one vector.
2. Labels of more than ``shard_vectors`` classes are divided into overlapping shards: centres are drawn
   (the lowest hashes, one for each ``shard_vectors`` classes, ``fan_out`` at most), centres closer than
   ``apart`` to another are left out, and each vector goes to the shards of its ``overlap`` nearest, of
   those that a vector linked with it can have as its nearest. Shards that are still large are
   divided again in the same way, unless most of their vectors are that close to the centre: a
   group of near copies has one centre, so it stays together however large it is. Centres are
   joined to chunks of their shard, never broadcast.
3. Per shard a flat graph is built: nearest candidates, robust pruning (an edge is dropped if a kept
   neighbour is closer to its end by the factor ``alpha``), reverse edges, pruned again. A vector's
   adjacency lists of all its shards are united, and each shard is searched from its medoid: a
   greedy beam search to the query, then an expansion through everything within the range (and a
   little beyond). Each link found is verified by its cosine in double precision.
4. A shard of more than ``block_vectors`` (near copies, mostly) is cut into blocks, and each pair of
   blocks is a group of its own with a graph over both, so any size of shard is searched whole.

A pair that shares several shards is counted in the first of them only. Groups return counts and
local components, never pairs, so a large group of near copies makes one row per vector. Vectors
travel in the precision of the input column, and lists as numbers of classes.

Nulls, ties and repeats: vectors that are null, empty, zero or hold null or non-finite parts, and
rows with a null label, link with nothing; vectors of different lengths do not link; rows that
repeat link with each other; rows that share an id count each, but have one component; rows with a
null id count as links and are returned with a null component; other columns are ignored. Results
are approximate in recall only; ``audit`` measures it against all pairs of a stated query set.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components
from .storage import stored

NONE = np.int64(-1)
BROADCAST_ROWS = 500_000  # sides of a join with more counted rows are shuffled


def unit(raw: np.ndarray) -> np.ndarray:
    return raw / np.linalg.norm(raw, axis=-1, keepdims=True)


def _matrix(blobs, dim: int) -> np.ndarray:
    """Unit vectors in double precision of packed vectors, of four or eight bytes a part."""
    raw = b"".join(blobs)
    kind = "<f4" if len(raw) == 4 * dim * len(blobs) else "<f8"
    return unit(np.frombuffer(raw, kind).reshape(-1, dim).astype(np.float64))


# ---- graphs


def robust_prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each of ``nodes`` at most ``degree`` of its row of ``candidates``: the closest, without those that a kept one covers.

    Missing candidates and neighbours are -1.
    """
    kept = np.full((len(nodes), degree), NONE)
    for at in range(0, len(nodes), 256):
        own, c = nodes[at : at + 256], np.sort(candidates[at : at + 256], axis=1)
        here = x[c]
        near = 2 - 2 * np.einsum("rcd,rd->rc", here, x[own])  # squared distances of unit vectors
        between = 2 - 2 * here @ here.transpose(0, 2, 1)
        gone = (c == NONE) | (c == own[:, None])
        gone[:, 1:] |= c[:, 1:] == c[:, :-1]
        near[gone] = np.inf
        rows = np.arange(len(own))
        for k in range(min(degree, c.shape[1])):
            best = near.argmin(1)
            some = np.isfinite(near[rows, best])
            if not some.any():
                break
            kept[at : at + 256, k][some] = c[rows, best][some]
            near[alpha * between[rows, best] <= near] = np.inf
            near[rows, best] = np.inf
    return kept


def build_graph(x: np.ndarray, degree: int = 20, alpha: float = 1.2, width: int = 48) -> np.ndarray:
    """Adjacency lists of a flat graph over the rows of ``x`` (unit vectors), padded with -1."""
    n = len(x)
    width = min(width, n - 1)
    candidates = np.full((n, width + 8), NONE)
    for at in range(0, n, 512):
        s = x[at : at + 512] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        if width:
            candidates[at : at + 512, :width] = np.argpartition(-s, width - 1, axis=1)[:, :width]
        rng = np.random.default_rng(at)  # a few far candidates keep the graph in one piece
        candidates[at : at + 512, width:] = rng.integers(0, n, (len(s), 8))
    out = robust_prune(x, np.arange(n), candidates, degree, alpha)
    i, k = np.nonzero(out != NONE)
    j = out[i, k]
    both = padded(np.concatenate([i, j]), np.concatenate([j, i]), n)
    many = np.flatnonzero((both != NONE).sum(1) > 2 * degree)
    short = np.full((n, 2 * degree), NONE)
    short[:, : min(both.shape[1], 2 * degree)] = both[:, : 2 * degree]
    for at in range(0, len(many), 64):  # nodes that are a neighbour of many
        some = many[at : at + 64]
        short[some] = robust_prune(x, some, both[some, : int((both[some] != NONE).sum(1).max())], 2 * degree, alpha)
    return short


def padded(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Different ends ``j`` of each of ``n`` starts ``i``, as rows padded with -1."""
    pairs = np.unique(i * n + j)
    i, j = pairs // n, pairs % n
    begin = np.searchsorted(i, np.arange(n))
    place = np.arange(len(i)) - begin[i]
    out = np.full((n, int(place.max()) + 1 if len(place) else 0), NONE)
    out[i, place] = j
    return out


def range_search(x: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, least: float, slack: float = 0.03, beam: int = 16) -> np.ndarray:
    """For each query row of ``x`` which rows have cosine >= ``least``: greedy beam search from ``start``, then range expansion."""
    n, m = len(x), len(queries)
    graph = np.where(graph == NONE, np.arange(n)[:, None], graph)  # a node is its own filler
    rows, q = np.arange(m), x[queries]
    cosine = np.full((m, n), -2.0)  # of what was looked at
    cosine[:, start] = q @ x[start]
    pool, score, open_ = np.full((m, beam), start), np.full((m, beam), -np.inf), np.zeros((m, beam), bool)
    score[:, 0], open_[:, 0] = cosine[:, start], True
    while graph.shape[1]:
        best = np.where(open_, score, -np.inf).argmax(1)
        active = np.flatnonzero(open_[rows, best])
        if not len(active):
            break
        open_[active, best[active]] = False
        near = graph[pool[active, best[active]]]
        own = np.einsum("qjd,qd->qj", x[near], q[active])
        new = cosine[active[:, None], near] < -1.5
        cosine[active[:, None], near] = own
        own = np.where(new, own, -np.inf)
        ids, all_scores = np.concatenate([pool[active], near], 1), np.concatenate([score[active], own], 1)
        flags = np.concatenate([open_[active], new], 1)
        top = np.argpartition(-all_scores, beam - 1, axis=1)[:, :beam]
        pool[active], score[active], open_[active] = (np.take_along_axis(a, top, 1) for a in (ids, all_scores, flags))
    frontier = np.argwhere(cosine >= least - slack)
    while len(frontier) and graph.shape[1]:  # everything reachable inside the widened range
        found = []
        for at in range(0, len(frontier), 50_000):
            r, c = frontier[at : at + 50_000].T
            near = graph[c].reshape(-1)
            r = np.repeat(r, graph.shape[1])
            new = np.unique((r * n + near)[cosine[r, near] < -1.5])
            r, near = new // n, new % n
            own = np.einsum("pd,pd->p", x[near], q[r])
            cosine[r, near] = own
            found.append(np.stack([r, near], 1)[own >= least - slack])
        frontier = np.concatenate(found)
    hits = cosine >= least
    hits[rows, queries] = False
    return hits


def local_components(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of ``n`` nodes reaches by the edges (i, j), which go both ways."""
    low = np.arange(n)
    while True:
        before = low.copy()
        np.minimum.at(low, i, low[j])
        low = low[low]
        if (low == before).all():
            return low


# ---- classes and shards


def _classes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows (id, key) with a null key for vectors that link with nothing; classes (key, k, rep, times, label, dim, vec)."""
    single = vectors.schema[vector_col].dataType.elementType == T.FloatType()
    v = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("v"))
    names = ["id", "label", "dim", "key", "vec"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, keys, vecs = [], [], []
            labels, lists = batch.column(1).to_pylist(), batch.column(2)
            for label, raw in zip(labels, lists, strict=True):
                parts = raw.values if raw.is_valid else None
                x = None
                if label is not None and parts is not None and len(parts) and not parts.null_count:
                    x = parts.to_numpy(zero_copy_only=False) + 0.0  # one zero of both
                    x = x.astype("<f4" if single else "<f8") if np.isfinite(x).all() and x.any() else None
                blob = None if x is None else x.tobytes()
                dims.append(None if x is None else len(x))
                vecs.append(blob)
                keys.append(None if x is None else hashlib.blake2b(f"{label},{len(x)},".encode() + blob, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(keys, pa.binary()), pa.array(vecs, pa.binary())], names)

    rows = stored(given.mapInArrow(read, "id long, label long, dim int, key binary, vec binary"), "vectors")
    classes = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("times"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("vec").alias("vec"))
    return rows.select("id", "key"), stored(classes.withColumn("k", F.monotonically_increasing_id()), "classes")


def spread_out(c: np.ndarray, apart: float) -> np.ndarray:
    """Numbers of the centres that are not closer than ``apart`` to one before them."""
    kept: list[int] = []
    s = c @ c.T > apart
    for i in range(len(c)):
        if not s[i, kept].any():
            kept.append(i)
    return np.array(kept, np.int64)


_SHARD = ["label", "dim", "shard"]


def _side(shards: DataFrame) -> DataFrame:
    """One row per shard, for joins: broadcast while they are few, so that no shard's members are dealt by it."""
    kept = stored(shards, "sizes")
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept


def _divide(members: DataFrame, least: float, shard_vectors: int, overlap: int, fan_out: int, apart: float, chunk: int = 5_000) -> tuple[DataFrame, DataFrame]:
    """(small, divided): members of shards that are small enough or a group of near copies, and of the new shards of the others."""
    sizes = members.groupBy(*_SHARD).agg(F.count("*").alias("n"), F.count_if("tight").alias("t"))
    large = _side(sizes.where((F.col("n") > 5 * shard_vectors) & (2 * F.col("t") < F.col("n"))).drop("t"))
    own = members.join(large, _SHARD).withColumn("chunk", F.pmod(F.xxhash64("k", F.lit(1)), F.ceil(F.col("n") / chunk)).cast("int"))
    # a vector is a centre if its hash is in the lowest share
    share = F.pmod(F.xxhash64("k", F.lit(2)), F.lit(1 << 40)) / float(1 << 40)
    wanted = F.least(F.ceil(F.col("n") / shard_vectors), F.lit(fan_out))
    every = F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / chunk).cast("int") - 1))
    centres = own.where(share * F.col("n") < wanted).select(*[F.col(c).alias(f"c_{c}") for c in (*_SHARD, "k", "vec")], every.alias("c_chunk"))

    def assign(pdf: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({c: [] for c in (*_SHARD, "k", "times", "vec", "tight", "done")})
        dim, shard = int(pdf["dim"].iloc[0]), int(pdf["shard"].iloc[0])
        x, done = _matrix(pdf["vec"], dim), True
        each, names, tight = np.arange(len(x)), shard, False
        if len(centres):
            centres = centres.sort_values("c_k")
            c = _matrix(centres["c_vec"], dim)
            kept = spread_out(c, apart)
            if len(kept) > 1:
                done, some = False, min(overlap, len(kept))
                s = x @ c[kept].T
                which = np.argpartition(-s, some - 1, axis=1)[:, :some]
                s = np.take_along_axis(s, which, 1)
                angle = np.arccos(np.clip(s, -1, 1))
                # the nearest centre of a linked vector is not further off than this
                each, place = np.nonzero(angle <= angle.min(1, keepdims=True) + 2 * np.arccos(least) + 1e-6)
                new = [int.from_bytes(hashlib.blake2b(f"{shard},{k}".encode(), digest_size=8).digest(), "little", signed=True) for k in centres["c_k"].to_numpy()[kept].tolist()]
                names, tight = np.array(new, np.int64)[which[each, place]], s[each, place] > apart
        out = pdf[["label", "dim", "k", "times", "vec"]].iloc[each]
        return out.assign(shard=names, tight=tight, done=done)[[*_SHARD, "k", "times", "vec", "tight", "done"]]

    made = own.groupBy(*_SHARD, "chunk").cogroup(centres.groupBy(*[f"c_{c}" for c in (*_SHARD, "chunk")])).applyInPandas(assign, "label long, dim int, shard long, k long, times long, vec binary, tight boolean, done boolean")
    made = stored(made, "shards")
    whole = members.join(large.drop("n"), _SHARD, "left_anti").select(*_SHARD, "k", "times", "vec", "tight")
    return whole.unionByName(made.where("done").drop("done")), made.where("NOT done").drop("done")


def _shards(classes: DataFrame, least: float, shard_vectors: int, overlap: int, fan_out: int, apart: float, levels: int = 4) -> DataFrame:
    """Members (label, dim, shard, k, times, vec) of all shards."""
    members = classes.select("label", "dim", F.lit(0).cast("long").alias("shard"), "k", "times", "vec", F.lit(False).alias("tight"))
    ready = None
    for _ in range(levels):
        small, members = _divide(members, least, shard_vectors, overlap, fan_out, apart)
        ready = small if ready is None else ready.unionByName(small)
        if not members.limit(1).count():
            return ready
    return ready.unionByName(members)


def _groups(members: DataFrame, block_vectors: int) -> DataFrame:
    """Rows of the groups that are searched: one per shard, or one per pair of its blocks (i, j)."""
    subs = _side(members.groupBy(*_SHARD).agg(F.ceil(F.count("*") / block_vectors).cast("int").alias("subs")))
    lists = members.groupBy("k").agg(F.array_sort(F.collect_set("shard")).alias("shards"))
    each = members.join(subs, _SHARD).join(lists, "k").withColumn("sub", F.pmod(F.xxhash64("k", F.lit(3)), F.col("subs")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("subs") - 1), lambda o: F.struct(F.least("sub", o).alias("i"), F.greatest("sub", o).alias("j")))
    return each.withColumn("p", F.explode(pair)).select(*_SHARD, "p.i", "p.j", "sub", "k", "times", "vec", "shards")


def _adjacency(groups: DataFrame, degree: int, alpha: float) -> DataFrame:
    """(k, near): per vector and group its neighbours."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        k = pdf["k"].to_numpy()
        graph = build_graph(_matrix(pdf["vec"], int(pdf["dim"].iloc[0])), degree, alpha)
        return pd.DataFrame({"k": k, "near": [k[row[row != NONE]] for row in graph]})

    return groups.groupBy(*_SHARD, "i", "j").applyInPandas(run, "k long, near array<long>")


def _search(groups: DataFrame, near: DataFrame, least: float) -> DataFrame:
    """(k, n, low): links of each vector that this group counts, and the least member of its local component."""

    def run(pdf: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
        pdf, lists = pdf.sort_values("k"), lists.sort_values("l_k")
        shard, i, j = (int(pdf[c].iloc[0]) for c in ("shard", "i", "j"))
        k, sub, times = (pdf[c].to_numpy() for c in ("k", "sub", "times"))
        x = _matrix(pdf["vec"], int(pdf["dim"].iloc[0]))
        size = len(x)
        # lists united over shards; ends that are not here are followed where they are
        ends = np.concatenate([np.asarray(e, np.int64) for e in lists["near"]])
        begins = np.repeat(np.arange(size), [len(e) for e in lists["near"]])
        to = np.minimum(np.searchsorted(k, ends), size - 1)
        here = k[to] == ends
        graph = padded(begins[here], to[here], size)
        start = int(np.argmax(x @ x.mean(0)))
        hits = np.zeros((size, size), bool)
        for at in range(0, size, 256):
            queries = np.arange(at, min(at + 256, size))
            hits[queries] = range_search(x, graph, start, queries, least)
        a, b = np.nonzero(hits | hits.T)
        shards = padded_lists(pdf["shards"])
        first = np.full(len(a), np.iinfo(np.int64).max)  # the first shard that both are in
        for c in range(shards.shape[1]):
            own = shards[a, c]
            both = (shards[b] == own[:, None]).any(1) & (own != np.iinfo(np.int64).max)
            first = np.where(both, np.minimum(first, own), first)
        mine = (first == shard) & ((i == j) | (sub[a] != sub[b]))
        n = np.bincount(a[mine], weights=times[b[mine]], minlength=size).astype(np.int64)
        return pd.DataFrame({"k": k, "n": n, "low": k[local_components(a, b, size)]})

    key = [*_SHARD, "i", "j"]
    own = groups.select(*[F.col(c).alias(f"l_{c}") for c in (*key, "k")]).join(near, F.col("l_k") == F.col("k")).drop("k")
    return groups.groupBy(*key).cogroup(own.groupBy(*[f"l_{c}" for c in key])).applyInPandas(run, "k long, n long, low long")


def padded_lists(lists) -> np.ndarray:
    """Lists of numbers as rows, padded with the greatest number."""
    sizes = np.array([len(x) for x in lists])
    out = np.full((len(sizes), sizes.max()), np.iinfo(np.int64).max)
    out[np.arange(sizes.max()) < sizes[:, None]] = np.concatenate([np.asarray(x, np.int64) for x in lists])
    return out


def near_duplicates(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", shard_vectors: int = 100, overlap: int = 3, fan_out: int = 1024, apart: float = 0.9, block_vectors: int = 1500, degree: int = 20, alpha: float = 1.2) -> DataFrame:
    """Per row: vec_id, n_links, component_id and kept (vec_id = component_id)."""
    rows, classes = _classes(vectors, id_col, vector_col, label_col)
    members = _shards(classes, least, shard_vectors, overlap, fan_out, apart)
    groups = stored(_groups(members, block_vectors), "groups")
    near = stored(_adjacency(groups, degree, alpha), "graph")
    united = near.groupBy("k").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # at most 2 * degree per group it is in
    found = stored(_search(groups, united, least), "found")
    edges = found.where("k <> low").select(F.col("k").alias("u"), F.col("low").alias("v"))
    by_key = rows.where("id IS NOT NULL AND key IS NOT NULL").distinct().join(classes.select("key", "k"), "key")
    several = by_key.groupBy("id").agg(F.min("k").alias("v"), F.count("*").alias("c")).where("c > 1").select("id", "v")
    if several.limit(1).count():  # rows of one id with different vectors have one component
        edges = edges.unionByName(by_key.join(several, "id").where("k <> v").select(F.col("k").alias("u"), "v"))
    known = classes.select("key", "k", "rep", "times").join(components(edges), F.col("k") == F.col("node"), "left").withColumn("comp", F.coalesce("comp", "k"))
    top = known.groupBy("comp").agg(F.min("rep").alias("top"))
    counts = found.groupBy("k").agg(F.sum("n").alias("n"))
    known = known.join(top, "comp").join(counts, "k", "left").select(F.col("key").alias("c"), (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n"), "top")
    out = rows.join(known, F.col("key") == F.col("c"), "left")
    comp = F.when(F.col("id").isNotNull(), F.coalesce("top", "id"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"))


def audit(vectors: DataFrame, found: DataFrame, least: float = 0.98, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = 20_000) -> DataFrame:
    """(vec_id, n_true, n_links) of every row whose id is divisible by ``every``, against all rows, in blocks of queries."""
    spark = vectors.sparkSession
    rows, classes = _classes(vectors, id_col, vector_col, label_col)
    asked = stored(rows.where((F.col("id") % every == 0) & F.col("key").isNotNull()).join(classes, "key").select("id", "label", "dim", "vec"), "queries")
    blocks = -(-asked.count() // block)
    true = None
    for b in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toPandas()  # about `block` rows
        shared = spark.sparkContext.broadcast({key: (own["id"].to_numpy(), _matrix(own["vec"], key[1])) for key, own in some.groupby(["label", "dim"])})

        def count(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for key, own in batch.groupby(["label", "dim"]):
                    if key in shared.value:
                        ids, q = shared.value[key]
                        hits = q @ _matrix(own["vec"], key[1]).T >= least
                        yield pd.DataFrame({"id": ids, "n": (hits * own["times"].to_numpy()).sum(1)})

        part = classes.select("label", "dim", "vec", "times").mapInPandas(count, "id long, n long")
        true = part if true is None else true.unionByName(part)
    if true is None:
        return found.select("vec_id", F.lit(0).cast("long").alias("n_true"), "n_links").limit(0)
    true = true.groupBy("id").agg((F.sum("n") - 1).alias("n_true"))
    return true.join(found, F.col("id") == F.col("vec_id")).select("vec_id", "n_true", "n_links")
