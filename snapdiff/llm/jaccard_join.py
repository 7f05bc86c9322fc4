"""N-gram Jaccard join by prefix filtering and a prefix tree.

1. Every text becomes its set of word n-gram hashes (64 bits); rows with equal sets are one
   class, stood for by its smallest id, so exact copies cost one set.
2. One total order over all n-grams, rare ones first: a table of ``order_buckets`` counts over
   all texts gives each n-gram its level, ties go by hash. The table's size is fixed, so it
   can be broadcast at any input size; a coarser table changes the cost, never the result.
3. Sets with Jaccard >= t share an n-gram among the first ``n - ceil(t n) + 1`` of each, and are of
   like size. The sets of such an n-gram and size class are tied to the smallest of them (a star,
   not all pairs), or, where they are few, in pairs whose shared n-grams and remaining lengths can
   reach the threshold, and whose sketches (counts of n-grams by hash bucket, an upper bound of the
   overlap) can too. Connected components are *candidate clusters*: two linked sets are always
   in one.
4. Inside a cluster the sets are stored in a prefix tree under one order (shared n-grams first),
   and every set walks it: overlaps of a path are counted once for all sets below, and a subtree
   is left when its remaining lengths cannot reach the threshold, or when all sets in it already
   belong to the walker's component. Similarity is exact at the leaves.
5. A cluster over ``block_items`` n-grams is cut into blocks: trees per block, then a few pivots
   against all blocks, then every set outside the cluster's main component against all blocks.
   So no cluster is ever in one task, and no link between different components is lost.

Nulls, ties and repeats: texts without words are empty sets and linked with nothing; a text of
fewer than ``n`` words is one n-gram; rows with equal ids count as one document with the links of
all of them; rows with a null id are returned, with a null component; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shingles import shingle_set, shingles, word_hashes
from .storage import stored

RANGES = 64
BROADCAST_ROWS = 500_000  # sides of a join with more counted rows are shuffled


def _sets(batch: pa.RecordBatch, k: int) -> tuple[pa.Array, list[np.ndarray]]:
    raw = batch.column(1).cast(pa.binary()).to_pylist()
    return batch.column(0), [shingle_set(word_hashes(x or b""), k) for x in raw]


def _levels(docs: DataFrame, k: int, buckets: int) -> np.ndarray:
    """Level (0 to 255, rising with the count) of each bucket of n-gram hashes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            raw = batch.column(1).cast(pa.binary()).to_pylist()
            if raw:
                every = np.concatenate([shingles(word_hashes(x or b""), k) for x in raw])
                total += np.bincount((every & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
        if total.any():
            parts = np.minimum(total, 2**31 - 1).astype("<i4").reshape(RANGES, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(RANGES), pa.int32()), pa.array([pa.compress(p.tobytes(), "zstd", asbytes=True) for p in parts], pa.binary())], ["part", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(buckets // RANGES, np.int64)
        for x in pdf["counts"]:
            total += np.frombuffer(pa.decompress(x, buckets // RANGES * 4, "zstd", asbytes=True), "<i4")
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "levels": [np.minimum(np.rint(4 * np.log2(1 + total)), 255).astype(np.uint8).tobytes()]})

    rows = docs.mapInArrow(count, "part int, counts binary").groupBy("part").applyInPandas(add, "part int, levels binary").collect()  # RANGES rows, `buckets` bytes
    table = np.zeros((RANGES, buckets // RANGES), np.uint8)
    for r in rows:
        table[r.part] = np.frombuffer(r.levels, np.uint8)
    return table.reshape(-1)


def _sketch(s: np.ndarray) -> bytes | None:
    """How many n-grams of a set fall in each of n/8 to n/4 hash buckets; None if a count passes a byte."""
    buckets = 1 << max(3, (len(s) // 8).bit_length())
    counts = np.bincount(((s >> np.uint64(24)) & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def _most_shared(a: bytes | None, b: bytes | None) -> int | None:
    """The most n-grams that the sets of two sketches can share; None if one has no sketch."""
    if a is None or b is None:
        return None
    x, y = np.frombuffer(a, np.uint8).astype(np.int64), np.frombuffer(b, np.uint8).astype(np.int64)
    few = min(len(x), len(y))  # bucket numbers are low bits: the larger sketch folds onto the smaller
    return int(np.minimum(x.reshape(-1, few).sum(0), y.reshape(-1, few).sum(0)).sum())


def _prefixes(docs: DataFrame, k: int, percent: int, levels: np.ndarray) -> DataFrame:
    """Per row: id, n, digest of the set, its prefix under the global order, the place of the prefix's end in it, and its sketch."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            ids, sets = _sets(batch, k)
            firsts, digests, lasts = [], [], []
            for s in sets:
                n = len(s)
                p = n + (-percent * n // 100) + 1 if n else 0
                level = table[(s & np.uint64(len(table) - 1)).astype(np.int64)]
                order = np.argsort(level, kind="stable")[:p]  # ties stay in order of hash
                firsts.append(s[order].view(np.int64))
                lasts.append((int(level[order[-1]]) << 55) | (int(s[order[-1]]) >> 9) if p else 0)
                digests.append(_digest(s))
            lengths = np.array([len(x) for x in sets], np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in firsts])]).astype(np.int32)
            values = np.concatenate(firsts) if firsts else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(lengths), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), pa.array(lasts, pa.int64()), pa.array([_sketch(s) for s in sets], pa.binary())], ["id", "n", "digest", "prefix", "last", "sketch"])

    return docs.mapInArrow(make, "id long, n long, digest binary, prefix array<long>, last long, sketch binary")


def _shared_grams(first: DataFrame, classes: DataFrame, per_range: int = 1_000_000) -> DataFrame:
    """(gram): n-grams that the prefixes of at least two rows hold, found in packed hash ranges."""
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = max(6, int(total / per_range).bit_length())

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)]
        for batch in batches:
            held.append(batch.column(0).flatten().to_numpy())
        values, times = np.unique(np.concatenate(held).view(np.uint64), return_counts=True)
        values = np.repeat(values, np.minimum(times, 2))
        cuts = np.searchsorted(values, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
        parts = [(p, v.tobytes()) for p, v in enumerate(np.split(values, cuts)) if len(v)]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in parts], pa.int32()), pa.array([v for _, v in parts], pa.binary())], ["part", "grams"])

    def twice(pdf: pd.DataFrame) -> pd.DataFrame:
        values, times = np.unique(np.frombuffer(b"".join(pdf["grams"]), np.int64), return_counts=True)
        return pd.DataFrame({"gram": values[times > 1]})

    return first.select("prefix").mapInArrow(split, "part int, grams binary").groupBy("part").applyInPandas(twice, "gram long")


def _alike(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs (u, v, total)``, total being both sizes, those (u, v) whose sketches allow the threshold."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, a, b = (batch.column(i).to_pylist() for i in (2, 3, 4))
            most = [_most_shared(x, y) for x, y in zip(a, b, strict=True)]
            keep = [m is None or (100 + percent) * m >= percent * t for m, t in zip(most, totals, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    of = lambda c, name: sketches.select(F.col("id").alias(c), F.col("sketch").alias(name))
    both = pairs.join(of("u", "a"), "u", "left").join(of("v", "b"), "v", "left")
    return both.select("u", "v", "total", "a", "b").mapInArrow(check, "u long, v long")


def _candidates(common: DataFrame, sketches: DataFrame, percent: int, few: int = 16) -> DataFrame:
    """Edges (u, v) whose components hold all links.

    An n-gram of many sets (over ``few`` of a size class) ties them to the smallest, a star. One of
    few sets gives its pairs; a pair is an edge only if the n-grams it shares can be enough: all
    others that the sets may share come after the end of the prefix that ends first, and the
    sketches (``id, sketch``) bound the whole overlap. Star edges stay unchecked: they stand for
    pairs of their n-gram that are not listed.
    """
    counts = common.groupBy("gram", "size").agg(F.count("*").alias("c"), F.min("id").alias("low")).where("c > 1")
    held = stored(common.join(counts, ["gram", "size"]), "held")
    many = held.where(F.col("c") > few)
    star = many.where("id <> low").select(F.col("id").alias("u"), F.col("low").alias("v"))
    g = many.groupBy("id", "size").agg(F.count("*").alias("g"))
    own = held.where(F.col("c") <= few).join(g, ["id", "size"], "left")
    row = F.struct("id", "n", "last", "own", F.coalesce("g", F.lit(0)).alias("g"))
    lists = own.groupBy("gram", "size").agg(F.array_sort(F.collect_list(row)).alias("r"))  # at most `few` rows
    pairs = lists.select("size", F.explode(F.flatten(F.transform("r", lambda y: F.transform(F.filter("r", lambda x: x["id"] < y["id"]), lambda x: F.struct(x.alias("x"), y.alias("y")))))).alias("p"))
    # two sets of one class meet in two size classes, and count in the first
    pairs = pairs.where(F.col("size") == F.greatest("p.x.own", "p.y.own"))
    sums = pairs.groupBy(F.col("p.x").alias("x"), F.col("p.y").alias("y")).agg(F.count("*").alias("c"))
    after = lambda z: F.floor(F.lit(percent) * F.col(f"{z}.n") / 100.0 - 1e-9)  # noqa: E731  n-grams behind the prefix
    rest = F.when(F.col("x.last") < F.col("y.last"), after("x")).when(F.col("x.last") > F.col("y.last"), after("y")).otherwise(F.greatest(after("x"), after("y")))
    enough = (100 + percent) * (F.col("c") + F.least("x.g", "y.g") + rest) >= percent * (F.col("x.n") + F.col("y.n"))
    likely = sums.where(enough).select(F.col("y.id").alias("u"), F.col("x.id").alias("v"), (F.col("x.n") + F.col("y.n")).alias("total"))
    return star.unionByName(_alike(likely, sketches, percent)).distinct()


def _digest(s: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


class Tree:
    """Path-compressed prefix tree over integer sets that share one order.

    ``rows`` are sorted arrays of ranks, ``sizes`` the full set sizes: n-grams that only one set
    has are counted in ``sizes`` but not stored, since no overlap can use them.
    """

    def __init__(self, rows: list[np.ndarray], sizes: np.ndarray):
        order = sorted(range(len(rows)), key=lambda i: rows[i].astype(">i4").tobytes())
        self.order, self.rows, self.sizes = np.array(order, np.int64), [rows[i] for i in order], sizes[order]
        self.place = np.empty(len(order), np.int64)
        self.place[self.order] = np.arange(len(order))
        self.lengths = np.array([len(r) for r in self.rows], np.int64)
        self.common = [0] * (len(order) + 1)  # n-grams that a row shares with the one before it
        for i in range(1, len(order)):
            a, b = self.rows[i - 1], self.rows[i]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            self.common[i] = int(differ[0]) if len(differ) else m
        self.kids: dict[tuple[int, int, int], list[tuple[int, int, int]]] = {}

    def children(self, lo: int, hi: int, depth: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Subtrees (lo, hi, end depth) of rows lo..hi, which agree on their first ``depth`` ranks, and where they begin."""
        if (lo, hi, depth) not in self.kids:
            cuts = [lo, *(i for i in range(lo + 1, hi) if self.common[i] <= depth), hi]
            kids = [(a, b, min([int(self.lengths[a]), *self.common[a + 1 : b]])) for a, b in zip(cuts, cuts[1:], strict=False)]
            self.kids[lo, hi, depth] = np.array(cuts[:-1]), kids
        return self.kids[lo, hi, depth]

    def links(self, row: np.ndarray, size: int, percent: int, mask: np.ndarray, wanted: np.ndarray) -> list[int]:
        """Rows, as given, among ``wanted`` (sorted places) whose similarity with ``row`` reaches ``percent``."""
        mask[row] = True
        found: list[int] = []
        stack = [(0, len(self.rows), 0, 0, wanted)]
        while stack:
            lo, hi, depth, overlap, want = stack.pop()
            starts, kids = self.children(lo, hi, depth)
            which = np.searchsorted(starts, want, "right") - 1
            cuts = np.flatnonzero(np.diff(which)) + 1
            for own in np.split(want, cuts):
                a, b, end = kids[int(np.searchsorted(starts, own[0], "right")) - 1]
                path = self.rows[a][depth:end]
                o = overlap + int(np.count_nonzero(mask[path]))
                left = len(row) - int(np.searchsorted(row, self.rows[a][end - 1], "right")) if end else len(row)
                most = o + min(left, int(self.lengths[own].max()) - end)
                if (100 + percent) * most < percent * (size + int(self.sizes[own].min())):
                    continue
                whole = self.lengths[own] == end
                at = own[whole]
                found += self.order[at[(100 + percent) * o >= percent * (size + self.sizes[at])]].tolist()
                if len(at) < len(own):
                    ended = int(np.count_nonzero(self.lengths[a:b] == end))  # rows that end here sort first
                    stack.append((a + ended, b, end, o, own[~whole]))
        mask[row] = False
        return found


def tree_links(sets: list[np.ndarray], comps: list, percent: int, n_members: int) -> list:
    """Components after joining sets ``n_members:`` (or all, if there are no others) with the first ``n_members``.

    ``comps`` are the components so far; the result has, for each set, the least one reached.
    """
    if not n_members:  # a block that the hash left empty
        return comps
    flat = np.concatenate(sets)
    values, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int32)
    rank[np.lexsort((values, -counts))] = np.arange(len(values), dtype=np.int32)
    ranks, shared = rank[inverse], counts[inverse] > 1
    ends = np.cumsum([len(s) for s in sets])
    rows = [np.sort(r[m]) for r, m in zip(np.split(ranks, ends[:-1]), np.split(shared, ends[:-1]), strict=True)]
    sizes = np.array([len(s) for s in sets], np.int64)
    tree = Tree(rows[:n_members], sizes[:n_members])
    names = sorted(set(comps))
    number = {c: i for i, c in enumerate(names)}
    comp = np.array([number[c] for c in comps], np.int64)  # small numbers are small names
    mask = np.zeros(len(values), bool)
    at = comp[:n_members][tree.order]  # components in the tree's order
    # the rarest n-grams of a set, of which a link shares one: those of its own first, which nothing shares
    tails = []
    for row, n in zip(rows, sizes.tolist(), strict=True):
        k = max(0, n + (-percent * n // 100) + 1 - (n - len(row)))
        tails.append(row[len(row) - k :])
    held = np.concatenate(tails[:n_members])
    by = np.argsort(held, kind="stable")
    held, holder = held[by], tree.place[np.repeat(np.arange(n_members), [len(t) for t in tails[:n_members]])[by]]
    for q in range(n_members, len(sets)) if len(sets) > n_members else range(len(sets)):
        if not len(tails[q]) or (at == comp[q]).all():
            continue
        lo, hi = np.searchsorted(held, tails[q], "left"), np.searchsorted(held, tails[q], "right")
        wanted = np.unique(np.concatenate([holder[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]))
        wanted = wanted[at[wanted] != comp[q]]
        for hit in tree.links(rows[q], int(sizes[q]), percent, mask, wanted) if len(wanted) else ():
            if comp[hit] != comp[q]:
                low, high = sorted((int(comp[hit]), int(comp[q])))
                comp[comp == high] = low
                at[at == high] = low
    return [names[c] for c in comp]


def _join_blocks(blocks: DataFrame, percent: int) -> DataFrame:
    """Edges (u, v) that tie each set of a block to the least of its component there."""

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["member", "id"], ascending=[False, True]).drop_duplicates(["member", "id", "grams"])
        ids, comps = pdf["id"].tolist(), pdf["comp"].tolist()
        sets = [np.frombuffer(x, np.uint64) for x in pdf["grams"]]
        after = tree_links(sets, comps, percent, int(pdf["member"].sum()))
        # a node of each old component stands for it
        edges = {(i, c) for i, c in zip(ids, after, strict=True)} | {(o, c) for o, c in zip(comps, after, strict=True)}
        edges = [e for e in edges if e[0] != e[1]]
        return pd.DataFrame({"u": [e[0] for e in edges], "v": [e[1] for e in edges]}, dtype="int64")

    return blocks.groupBy("cluster", "sub", "chunk").applyInPandas(join, "u long, v long")


def _with_sets(docs: DataFrame, clusters: DataFrame, k: int) -> DataFrame:
    """(cluster, subs, id, grams) of the ids in ``clusters (id, cluster, subs)``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, sets = _sets(batch, k)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([_digest(s) for s in sets], pa.binary()), *batch.columns[2:]], ["id", "grams", "found", "cluster", "subs", "digest"])

    n = clusters.count()
    with_text = docs.join(F.broadcast(clusters) if n <= BROADCAST_ROWS else clusters, "id").select("id", "text", "cluster", "subs", "digest")
    made = with_text.mapInArrow(make, "id long, grams binary, found binary, cluster long, subs int, digest binary")
    return made.where("found = digest").select("cluster", "subs", "id", "grams")


def _join_large(large: DataFrame, links: DataFrame, percent: int, block_items: int) -> DataFrame:
    """Edges of clusters of several blocks: pivots against all blocks, then all outsiders against all blocks."""
    spread = F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub")

    def now(edges: DataFrame) -> DataFrame:
        labels = components(edges)
        return stored(large.join(labels, large["id"] == labels["node"], "left").select("cluster", "subs", "sub", "id", F.coalesce("comp", "id").alias("comp"), F.lit(True).alias("member"), "grams"), "members")

    columns = ["cluster", "sub", "chunk", "id", "comp", "member", "grams"]
    members = now(links)
    pivots = members.where("sub < 16").groupBy("cluster", "sub").agg(F.min(F.struct("id", "comp", "grams", "subs")).alias("p")).select("cluster", "p.*")
    asked = pivots.select("cluster", "id", "comp", "grams", spread).withColumn("member", F.lit(False))
    one = members.drop("subs").unionByName(asked).withColumn("chunk", F.lit(0))
    links = links.unionByName(stored(_join_blocks(one.select(*columns), percent), "links"))

    members = now(links)
    main = members.groupBy("cluster", "comp").agg(F.count("*").alias("c")).groupBy("cluster").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"))
    rest = members.join(main, "cluster").where("comp <> main")
    chunks = rest.groupBy("cluster").agg(F.greatest(F.ceil(F.sum(F.length("grams")) / (8 * block_items)), F.lit(1)).cast("int").alias("chunks"))
    asked = rest.drop("sub").join(chunks, "cluster").select("cluster", "id", "comp", "grams", spread, F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk")).withColumn("member", F.lit(False))
    held = members.join(chunks, "cluster").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return links.unionByName(stored(_join_blocks(held.select(*columns).unionByName(asked.select(*columns)), percent), "links"))


def jaccard_components(documents: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text", order_buckets: int = 1 << 22, block_items: int = 2_000_000) -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the smallest id reachable by links.

    Links: Jaccard similarity of the n-gram sets >= ``percent`` / 100.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    levels = _levels(docs, n, order_buckets)
    rows = stored(_prefixes(docs, n, percent, levels), "sets")
    known = rows.where("n > 0 AND id IS NOT NULL")
    # sets whose sizes allow the threshold are in the same class of sizes or in neighbouring ones
    size_class = F.floor(F.log("n") / F.lit(math.log(100 / percent) * (1 + 1e-9))).cast("int")
    classes = stored(known.groupBy("digest").agg(F.min("id").alias("rep"), F.first("n").alias("n")), "classes")
    first = known.join(classes.select(F.col("digest").alias("d"), "rep"), (F.col("digest") == F.col("d")) & (F.col("id") == F.col("rep")), "left_semi")
    grams = first.select("id", "n", "last", size_class.alias("own"), F.explode("prefix").alias("gram"))
    shared = stored(_shared_grams(first, classes), "shared")
    met = grams.join(F.broadcast(shared) if shared.count() <= 4 * BROADCAST_ROWS else shared, "gram")
    common = stored(met.select("id", "n", "last", "own", "gram", F.explode(F.array("own", F.col("own") + 1)).alias("size")), "grams")
    stars = _candidates(common, first.select("id", "sketch"), percent)
    near = components(stars)

    sized = near.join(classes.select(F.col("rep").alias("node"), "n", "digest"), "node")
    totals = sized.groupBy("comp").agg(F.greatest(F.ceil(F.sum("n") / block_items), F.lit(1)).cast("int").alias("subs"))
    clusters = stored(sized.join(totals, "comp").select(F.col("node").alias("id"), F.col("comp").alias("cluster"), "subs", "digest"), "clusters")
    blocks = _with_sets(docs, clusters, n).withColumn("sub", F.pmod(F.xxhash64("id"), F.col("subs")).cast("int"))
    base = blocks.select("cluster", "sub", F.lit(0).alias("chunk"), "id", F.col("id").alias("comp"), F.lit(True).alias("member"), "grams")
    links = stored(_join_blocks(base, percent), "links")
    if clusters.where("subs > 1").limit(1).count():
        large = stored(blocks.where("subs > 1").dropDuplicates(["id", "cluster", "grams"]), "large")
        links = links.unionByName(_join_large(large, links, percent, block_items))
        found = components(links)
    else:
        found = links.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    known_ids = known.select("id", "digest").distinct()
    several = known_ids.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id")
    if several.limit(1).count():  # rows of one id with different texts are one document
        tied = known_ids.join(several, "id").join(classes.select("digest", "rep"), "digest").where("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))
        found = components(links.unionByName(tied))
    comp_of = classes.select("digest", "rep").join(found, F.col("rep") == F.col("node"), "left").select(F.col("digest").alias("d"), F.coalesce("comp", "rep").alias("c"))
    out = rows.select("id", "n", "digest").join(comp_of, (F.col("digest") == F.col("d")) & F.col("id").isNotNull() & (F.col("n") > 0), "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("c", "id").alias("component_id"))


def drop_near_copies(documents: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents, all columns, with one row left of each component; rows with a null id stay.

    Of rows that share the id that stays, the one whose columns have the least hash is left.
    """
    found = jaccard_components(documents, n, percent, id_col, text_col)
    sums = found.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("__rows"), F.min(F.expr("doc_id = component_id")).alias("__kept"))
    away = stored(sums.where("NOT __kept OR __rows > 1"), "away")  # ids that go, and ids of which one row of several stays
    own = F.col(id_col).cast("long") == F.col("__id")
    out = documents.join(F.broadcast(away) if away.count() <= BROADCAST_ROWS else away, own, "left_anti")  # else the texts are shuffled
    several = away.where("__kept")
    if several.limit(1).count():
        row = F.struct(*[F.col(c) for c in documents.columns])
        least = documents.join(several, own, "left_semi").groupBy(F.col(id_col).alias("__id")).agg(F.min_by(row, F.sha2(F.to_json(row), 256)).alias("__row"))
        out = out.unionByName(least.select("__row.*"))
    return out
