"""Best-fit packing of token pieces into sequences with a grouping genetic algorithm.

Texts are tokenised in tasks; a document is its ids and a closing id, cut into pieces of at
most ``capacity`` ids only if it is longer. Packing works on (piece, length) rows:

* full pieces fill a sequence alone; the others are dealt by hash into shards of about
  ``shard_items`` pieces, so no task ever sees more;
* each shard is solved by ``islands`` populations. An individual is a grouping of the pieces;
  crossover injects whole well-filled bins of one parent into another, removes the bins that
  hold the same pieces, and best-fits what was displaced. Fitness is the mean squared fill;
* after an epoch each island's elite is sent to the next island of its shard (a shuffle), and
  a second epoch starts from both; the best island's elite is the shard's result;
* bins with more than ``slack`` free places are opened again and their pieces dealt into new
  shards, which mixes what is left of all shards; that is repeated ``levels`` times. A level that
  closes no bin is the last: its open bins are sequences as they are, as those of the last level.

Random numbers are seeded by shard, island and level, and each level's result is written to
the shared folder, so a lost executor's tasks give the same rows again.

Nulls, ties and repeats: a null text is an empty one, whose single piece is the closing id; a
null id is kept; rows that repeat are packed each on their own; no rows give no rows; other
columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored


# How the tokenizer whose texts can be cut at white space normalises and splits them.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_LETTERS, _MARKS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+", r"[!-&(-/:-@\[-^`{-~]+"  # no apostrophe: it starts contractions
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in a byte-level vocabulary
_ALPHABET = {**{b: b for b in _PLAIN}, **{b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PLAIN)}}


class Stems:
    """Piece of text -> its ids, as little-endian 32-bit bytes.

    Letters that are composed already and have one lower-case letter each, or ASCII punctuation,
    are one word of the model; everything else goes through the whole tokenizer. Pieces are kept in
    two generations of ``limit`` each: one that is used again passes to the recent one, so frequent
    pieces stay when the older generation goes.
    """

    limit = 150_000
    word = re.compile(f"{_LETTERS}|{_MARKS}")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        made = json.loads(self.tokenizer.to_str())
        first, *rest = (made["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        split = first.get("type") == "Split" and first.get("pattern") == {"Regex": SPLIT} and [r.get("type") for r in rest] == ["ByteLevel"]
        no_space = not any(set(t["content"]) & set(" \t\n\r\x0b\x0c") or t["lstrip"] or t["rstrip"] or t["normalized"] for t in made["added_tokens"])
        self.divides = split and no_space and made["normalizer"] == NORMALIZER and made["post_processor"] is None
        self.starts = {t["content"][:2] for t in made["added_tokens"]}  # their names have a case

    def encode(self, text: str) -> bytes:
        if self.word.fullmatch(text):
            text = text.lower()
            ids = [t.id for t in self.model.tokenize(text if text.isascii() else text.encode().decode("latin-1").translate(_ALPHABET))]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def look_up(self, texts: list[str]) -> list[bytes]:
        found, older = list(map(self.recent.get, texts)), self.older
        for k in [k for k, value in enumerate(found) if value is None]:
            text = texts[k]
            value = older.get(text)
            found[k] = value = self.encode(text) if value is None else value
            if len(text) <= 64:
                if len(self.recent) >= self.limit:
                    self.older, self.recent = self.recent, {}
                self.recent[text] = value
        return found


_stems: dict[str, Stems] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_ids(texts: pa.StringArray, path: str) -> list[np.ndarray]:
    """Ids of each text; each different stem of the texts is looked up once.

    The tokenizer cuts texts at white space and lower-cases them, so a text's ids are those of its
    chunks in a row. Letters with punctuation after them are looked up apart, as the tokenizer
    cuts there too: fewer different pieces, each encoded once.

    A tokenizer that cuts otherwise gets whole texts. Letters are lower-cased before the look-up,
    but in texts with combining marks, which compose first, or names of special tokens.
    """
    if path not in _stems:
        _stems[path] = Stems(path)
    own = _stems[path]
    if not own.divides:
        return [np.array(own.tokenizer.encode(t, add_special_tokens=False).ids, "<u4") for t in texts.to_pylist()]
    cased = pc.match_substring_regex(texts, "|".join(["[\u0300-\u036f]", *map(re.escape, sorted(own.starts))]))
    lists = pc.ascii_split_whitespace(pc.if_else(cased, texts, pc.ascii_lower(texts)))
    words = lists.flatten().dictionary_encode()
    chunks = words.dictionary
    parts = pc.extract_regex(chunks, f"^(?P<stem>{_LETTERS})(?P<mark>{_MARKS})$")
    stems, marks = pc.coalesce(pc.struct_field(parts, "stem"), chunks), pc.fill_null(pc.struct_field(parts, "mark"), "")
    pieces = pa.concat_arrays([stems, marks]).dictionary_encode()
    found = pa.array(own.look_up(pieces.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(pieces.indices)
    joined = pc.binary_join_element_wise(found[: len(chunks)], found[len(chunks) :], pa.scalar(b"", pa.large_binary()))
    spread = joined.take(words.indices)
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(spread).to_numpy())]) // 4
    ids = np.frombuffer(spread.buffers()[2] or b"", "<u4", int(ends[-1]))
    cuts = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Consecutive rows whose texts take about ``most_bytes``, one at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes) - sizes) // most_bytes
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    yield from (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False) if b > a)


def token_pieces(documents: DataFrame, tokenizer_path: str | None = None, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per piece: pid (unique once stored), doc_id, piece, start, length, ids_crc32, and ids (bytes) if asked."""
    path = tokenizer_path or default_tokenizer()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if with_ids else 5]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4")
        for batch in batches:
            for some in slices(batch, 1):  # a few documents at a time, so that their ids stay small in memory
                rows = []
                texts = pc.fill_null(some.column(1).cast(pa.string()), "")
                for doc, ids in zip(some.column(0).to_pylist(), token_ids(texts, path), strict=True):
                    for i, start in enumerate(range(0, len(ids) + 1, capacity)):
                        piece = ids[start : start + capacity]
                        last = len(piece) < capacity
                        size, raw = len(piece) + last, (np.concatenate([piece, end]) if last else piece).tobytes()
                        rows.append((doc, i, start, size, zlib.crc32(raw), raw)[: len(names)])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=False)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from cut(batches)
        pa.default_memory_pool().release_unused()  # the worker stays, beside those of later stages

    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    made = texts.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)
    return made.withColumn("pid", F.monotonically_increasing_id())


class Bins:
    """Open bins by free room, for best fit: the bits of ``open`` say which rooms there are."""

    def __init__(self, rooms: dict[int, list[int]]):
        self.rooms, self.open = rooms, 0
        for room in rooms:
            self.open |= 1 << room

    def take(self, size: int) -> tuple[int, int]:
        """(bin, room) of the tightest bin that fits; bin is -1 if there is none."""
        fits = self.open >> size
        if not fits:
            return -1, 0
        room = size + (fits & -fits).bit_length() - 1
        own = self.rooms[room]
        found = own.pop()
        if not own:
            self.open &= ~(1 << room)
        return found, room

    def put(self, b: int, room: int) -> None:
        if room:
            self.rooms.setdefault(room, []).append(b)
            self.open |= 1 << room


def best_fit(items: list[int], sizes: list[int], where: np.ndarray, bins: Bins, fresh: int, capacity: int) -> int:
    """Put ``items``, in their order, into the tightest bins; opens bins from ``fresh`` on."""
    for i in items:
        size = sizes[i]
        b, room = bins.take(size)
        if b < 0:
            b, room, fresh = fresh, capacity, fresh + 1
        where[i] = b
        bins.put(b, room - size)
    return fresh


def _compact(where: np.ndarray) -> np.ndarray:
    return np.unique(where, return_inverse=True)[1].astype(np.int64)


def fitness(where: np.ndarray, sizes: np.ndarray, capacity: int) -> float:
    """Mean squared fill, which is higher the fewer and the more uneven the bins."""
    fill = np.bincount(where, weights=sizes) / capacity
    return float(np.square(fill).mean()) if len(fill) else 1.0


def crossover(giver: np.ndarray, taker: np.ndarray, sizes: np.ndarray, plain: list[int], capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Inject some of the giver's best filled bins into the taker."""
    fill = np.bincount(giver, weights=sizes)
    good = np.argsort(-(fill + rng.random(len(fill)) * capacity / 64), kind="stable")[: max(1, len(fill) // 2)]
    chosen = rng.choice(good, max(1, len(good) // 3), replace=False)
    injected = np.isin(giver, chosen)
    n = int(taker.max()) + 1
    broken = np.zeros(n, bool)
    broken[taker[injected]] = True
    if rng.random() < 0.7:  # also open the emptiest bins, whose pieces may now fit elsewhere
        broken[np.argsort(np.bincount(taker, weights=sizes))[: max(1, n // 50)]] = True
    child = taker.copy()
    child[injected] = n + np.searchsorted(np.sort(chosen), giver[injected])
    displaced = np.flatnonzero(broken[taker] & ~injected)
    kept = np.ones(len(child), bool)
    kept[displaced] = False
    total = np.bincount(child[kept], weights=sizes[kept], minlength=n + len(chosen)).astype(np.int64)
    rooms: dict[int, list[int]] = {}
    for b in np.flatnonzero((total > 0) & (total < capacity)).tolist():
        rooms.setdefault(int(capacity - total[b]), []).append(b)
    order = displaced[np.argsort(-sizes[displaced], kind="stable")].tolist()
    best_fit(order, plain, child, Bins(rooms), n + len(chosen), capacity)
    return _compact(child)


def evolve(sizes: np.ndarray, elites: list[np.ndarray], capacity: int, seed: int, population: int, generations: int) -> np.ndarray:
    """The best grouping after some generations from ``elites`` and noisy best-fit starts."""
    rng = np.random.default_rng(seed)
    plain = sizes.tolist()
    people = [e for e in elites]
    while len(people) < population:
        noise = sizes * (1 + rng.normal(0, 0.02 * len(people), len(sizes)))
        where = np.zeros(len(sizes), np.int64)
        best_fit(np.argsort(-noise, kind="stable").tolist(), plain, where, Bins({}), 0, capacity)
        people.append(where)
    least = -(-int(sizes.sum()) // capacity)
    scored = sorted(((fitness(p, sizes, capacity), k, p) for k, p in enumerate(people)), key=lambda x: -x[0])
    for g in range(generations):
        if int(scored[0][2].max()) + 1 == least:
            break
        pairs = rng.integers(0, len(scored), (population, 2))
        kids = [crossover(scored[min(a, b)][2], scored[max(a, b) if a != b else (b + 1) % len(scored)][2], sizes, plain, capacity, rng) for a, b in pairs.tolist()]
        scored = sorted(scored + [(fitness(c, sizes, capacity), 100 * g + k + 100, c) for k, c in enumerate(kids)], key=lambda x: -x[0])[:population]
    return min(scored, key=lambda x: (int(x[2].max()), -x[0]))[2]


def _epoch(rows: DataFrame, capacity: int, level: int, epoch: int, population: int, generations: int) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shard, island = int(pdf["shard"].iloc[0]), int(pdf["island"].iloc[0])
        parts = {o: p.sort_values("pid") for o, p in pdf.groupby("origin")}
        own = parts[island] if island in parts else next(iter(parts.values()))
        sizes = own["length"].to_numpy(np.int64)
        elites = [_compact(p["bin"].to_numpy()) for o, p in sorted(parts.items()) if epoch]
        best = evolve(sizes, elites, capacity, hash((level, shard, island, epoch)) & 0xFFFFFFFF, population, generations)
        return pd.DataFrame({"shard": shard, "island": island, "pid": own["pid"].to_numpy(), "length": sizes, "bin": best, "bins": int(best.max()) + 1, "score": fitness(best, sizes, capacity)})

    return rows.groupBy("shard", "island").applyInPandas(run, "shard long, island int, pid long, length long, bin long, bins long, score double")


def pack(pieces: DataFrame, capacity: int = 2048, shard_items: int = 4096, islands: int = 2, population: int = 4, generations: int = 6, slack: int = 8, levels: int = 3) -> DataFrame:
    """``(pid, sequence_id, offset)`` for each row of ``pieces (pid, length)``; lengths are 1 to ``capacity``."""
    done = pieces.where(F.col("length") == capacity).select("pid", (-1 - F.col("pid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity).select("pid", "length")
    n = rest.count()
    for level in range(levels):
        if not n:
            break
        shards = -(-n // shard_items)
        dealt = rest.withColumn("shard", F.pmod(F.xxhash64("pid", F.lit(level)), F.lit(shards)))
        start = dealt.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "pid", "length", F.lit(0).cast("long").alias("bin")).withColumn("origin", F.col("island"))
        first = _epoch(start, capacity, level, 0, population, generations)
        moved = first.select("shard", F.explode(F.array("island", F.pmod(F.col("island") + 1, F.lit(islands)))).alias("to"), "pid", "length", "bin", F.col("island").alias("origin")).withColumnRenamed("to", "island").distinct()
        ran = stored(_epoch(moved, capacity, level, 1, population, generations), "islands")
        best = ran.groupBy("shard").agg(F.max_by("island", F.struct(-F.col("bins"), "score", -F.col("island"))).alias("island"))
        won = ran.join(best, ["shard", "island"], "left_semi")
        fill = won.groupBy("shard", "bin").agg(F.sum("length").alias("fill"))
        sums = won.join(fill, ["shard", "bin"])
        final = level == levels - 1 or shards == 1
        if not final:
            rest, before = stored(sums.where(F.col("fill") < capacity - slack).select("pid", "length"), "rest"), n
            n = rest.count()
            final = n == before  # no bin was closed: these bins are the result
        closed = sums if final else sums.where(F.col("fill") >= capacity - slack)
        placed = _places(closed, level)
        done = done.unionByName(placed)
        if final:
            break
    return done


def _places(rows: DataFrame, level: int) -> DataFrame:
    """Sequence numbers and places; a bin holds at most ``capacity`` pieces."""
    items = rows.groupBy("shard", "bin").agg(F.array_sort(F.collect_list(F.struct("pid", "length"))).alias("items"))
    name = ((F.lit(level) * (1 << 44) + F.col("shard")) * (1 << 15) + F.col("bin")).alias("sequence_id")
    ends = F.transform(F.sequence(F.lit(1), F.size("items")), lambda k: F.struct(F.element_at("items", k)["pid"].alias("pid"), F.aggregate(F.slice("items", 1, k - 1), F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("offset")))
    return items.select(name, F.explode(ends).alias("p")).select("p.pid", "sequence_id", "p.offset")


def pack_documents(documents: DataFrame, tokenizer_path: str | None = None, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, **options) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, as bytes, if asked)."""
    pieces = stored(token_pieces(documents, tokenizer_path, capacity, end_id, id_col, text_col, with_ids), "pieces")
    placed = pack(pieces.select("pid", "length"), capacity, **options).withColumnRenamed("pid", "p")
    out = pieces.join(placed, F.col("pid") == F.col("p"), "left")
    placed_id = F.when(F.col("sequence_id").isNull(), F.raise_error(F.lit("a piece was not placed"))).otherwise(F.col("sequence_id"))
    out = out.withColumn("sequence_id", placed_id)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))
