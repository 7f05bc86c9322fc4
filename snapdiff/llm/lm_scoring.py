"""Language-model scoring from a log-frequency Bloom filter.

Texts are kept in blocks of bounded size, as numbers of the block's distinct words in order, and all
that is counted is sent once: a block's distinct words, and its distinct words and word pairs as sorted
hashes, go in one packed row per hash range to the task of that range, and what is known of them comes back in the same
order. No row is made of a single word and no text is shuffled, so a frequent word is no hot key.

*Training* counts words and word pairs of the training rows, and each hash range becomes one segment of
a Bloom filter: an n-gram with count c is stored under the levels 1 .. 1 + floor(log2 c). A
segment has ``bits_per_gram`` bits for each n-gram and level that was counted in its range, and hashes are as wide as the
tokens are many (at most one probe in 4,096 meets another n-gram's hash, up to 64 bits), so
the error rate is the same at any size. If the whole filter has at most ``max_bytes`` it is
broadcast; else the task that makes a segment also looks up there the n-grams of the blocks that
it was made from, so no task holds more than a few segments, and n-grams are sent no second time.

*Scoring* probes the levels of a pair and of its words one after the other until one is absent,
which gives their counts up to the quantisation, and mixes the pair's relative frequency with
the add-one word frequency.

The *base score* is exact: words, not hashes, are summed over all blocks, their counts come back to the
blocks, and each block's documents are summed from its words. No vocabulary is ever broadcast or collected.

Nulls, ties and repeats: a null or empty text is the end token alone; a row with a null id is a
training row; rows that repeat are scored each and counted each; no rows, no result; with no
training rows N and V are 0; other columns are ignored.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import mixed, ngrams, word_hashes
from .storage import stored

END, START = np.uint64(0xE4D), np.uint64(0x57A27)  # hashes of the end token and of the place before a text
_BLOCK = "block long, n_words long, words binary, counts binary, documents binary"


def is_held_out(doc_id: int | None, modulus: int = 7, remainder: int = 2) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == remainder


def _texts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[tuple[list, list[bytes]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            some = batch.slice(at, rows)
            yield some.column(0).to_pylist(), [x or b"" for x in some.column(1).cast(pa.binary()).to_pylist()]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows one by one: those of blocks are megabytes each, of which one is copied at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in batch.columns)


def _pressed(x: bytes) -> bytes:
    return len(x).to_bytes(8, "little") + pa.compress(x, "zstd", asbytes=True)


def _raw(blob: bytes) -> bytes:
    size = int.from_bytes(blob[:8], "little")
    return pa.decompress(blob[8:], size, "zstd", asbytes=True) if size else b""


def _planes(x: np.ndarray) -> bytes:
    """An array in few bytes: its bytes of one place after the other, compressed."""
    return _pressed(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def _array(blob: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(_raw(blob), np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def _documents(blob: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray, np.ndarray]:
    """Ids, which are held out, lengths in tokens, and the tokens of a block's documents, end to end."""
    ids, held, lengths, tokens = pickle.loads(blob)
    return ids, np.array(held), np.array(lengths), _array(tokens, np.uint32)


def tokenised_blocks(docs: DataFrame, block_bytes: int = 8_000_000) -> DataFrame:
    """A row per block: its distinct words, their training counts, and its documents as word numbers.

    The end token is the empty word, number 0.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, count = TaskContext.get().partitionId(), 0
        number: dict[bytes, int] = {b"": 0}
        docs_, tokens, size = [], [], 0

        def out() -> pa.RecordBatch:
            ids, held, lengths = (list(x) for x in zip(*docs_, strict=True))
            every = np.concatenate(tokens)
            times = np.bincount(every[np.repeat(~np.array(held), lengths)], minlength=len(number)).astype(np.int64)
            row = ((part << 24) + count, len(number), _pressed(b" ".join(number)), _planes(times), pickle.dumps((ids, held, lengths, _planes(every))))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (*[pa.int64()] * 2, *[pa.binary()] * 3), strict=True)], [f.split()[0] for f in _BLOCK.split(", ")])

        for ids, raws in _texts(batches):
            for doc, raw in zip(ids, raws, strict=True):
                found = raw.lower().split()
                found.append(b"")
                tokens.append(np.fromiter((number.setdefault(w, len(number)) for w in found), np.uint32, len(found)))
                docs_.append((doc, is_held_out(doc), len(found)))
                size += len(raw)
                if size >= block_bytes:
                    yield out()
                    count += 1
                    number, docs_, tokens, size = {b"": 0}, [], [], 0
        if docs_:
            yield out()

    return docs.mapInArrow(make, _BLOCK)


def _hashes(words: bytes) -> np.ndarray:
    """Hashes of a block's words, of which the empty one is first; some at a time, to hold little."""
    own, at = [np.array([END])], 0
    while at < len(words):
        end = words.find(b" ", at + (1 << 20))
        end = len(words) if end < 0 else end
        own.append(word_hashes(words[at:end]))
        at = end
    return np.concatenate(own)


def _ranges_for(n: int, most: int, least: int = 64) -> int:
    """A power of two of hash ranges with at most ``most`` of ``n`` in each."""
    return min(max(least, 1 << max(0, -(-n // most) - 1).bit_length()), 1 << 20)


def _dealt(hashes: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of a block's words by hash range, which ranges have some, and where each begins."""
    part = (hashes >> np.uint64(65 - ranges.bit_length())).astype(np.int32)
    order = np.argsort(part, kind="stable")
    return order, *np.unique(part[order], return_index=True)


def _sent(block: int, parts: np.ndarray, **columns: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(parts), block)), pa.array(parts), *(pa.array(x, pa.binary()) for x in columns.values())], ["block", "part", *columns])


def known_words(blocks: DataFrame, words_per_range: int = 2_000_000) -> tuple[DataFrame, int, int, int]:
    """(block, part, counts): over all blocks, the training counts of the words that a block has in a hash range; N and V; the number of ranges."""
    ranges = _ranges_for(blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0], words_per_range)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, blob, counts in _rows(batches):
            raw, times = _raw(blob), _array(counts, np.int64)
            order, parts, begins = _dealt(_hashes(raw), ranges)
            words, ends = raw.split(b" "), [*begins[1:], len(order)]
            own = [order[a:b] for a, b in zip(begins, ends, strict=True)]
            yield _sent(block, parts, words=[_pressed(b" ".join([words[i] for i in some])) for some in own], counts=[_planes(times[some]) for some in own])

    def answer(asked: pa.Table) -> pa.Table:
        words = [_raw(b).split(b" ") for b in asked["words"].to_pylist()]
        place = pa.array(chain.from_iterable(words), pa.binary()).dictionary_encode().indices.to_numpy()
        times = np.concatenate([_array(b, np.int64) for b in asked["counts"].to_pylist()])
        c = np.bincount(place, weights=times).astype(np.int64)
        found = [_planes(x) for x in np.split(c[place], np.cumsum([len(x) for x in words])[:-1])]
        sums = ([int(x), *[0] * (len(words) - 1)] for x in (c.sum(), np.count_nonzero(c)))
        return pa.table([asked["block"], asked["part"], pa.array(found, pa.binary()), *(pa.array(x, pa.int64()) for x in sums)], ["block", "part", "counts", "n", "v"])

    asked = blocks.select("block", "words", "counts").mapInArrow(ask, "block long, part int, words binary, counts binary")
    known = stored(asked.groupBy("part").applyInArrow(answer, "block long, part int, counts binary, n long, v long"), "counts")
    total, distinct = known.agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in ("n", "v"))).first()
    return known.select("block", "part", "counts"), int(total), int(distinct), ranges


_BASE = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double"


def _base(counts: pa.Table, words: bytes, blob: bytes, ranges: int, total: int, distinct: int) -> pa.Table:
    """The rows of a block's documents from its words' counts."""
    ids, held, lengths, tokens = _documents(blob)
    order, _, _ = _dealt(_hashes(words), ranges)
    c = np.empty(len(order), np.int64)
    c[order] = np.concatenate([_array(b, np.int64) for b in counts.sort_by("part")["counts"].to_pylist()])
    logs = np.log10((c + 1) / (total + 1 * (distinct + 1)))
    starts = np.cumsum(lengths) - lengths
    seen, base = (np.add.reduceat(x[tokens], starts) for x in ((c > 0).astype(np.int64), logs))
    return pa.table([pa.array(ids, pa.int64()), pa.array(held), pa.array(lengths), pa.array(seen), pa.array(base)], [f.split()[0] for f in _BASE.split(", ")])


def base_scores(known: DataFrame, blocks: DataFrame, ranges: int, total: int, distinct: int) -> DataFrame:
    """Per document row the exact base score."""

    def score(counts: pa.Table, block: pa.Table) -> pa.Table:
        return _base(counts, _raw(block["words"][0].as_py()), block["documents"][0].as_py(), ranges, total, distinct)

    own = blocks.select(F.col("block").alias("own"), "words", "documents")
    return known.groupBy("block").cogroup(own.groupBy("own")).applyInArrow(score, _BASE)


def grams(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of a text, the end token last, and of each with the token before it."""
    h = np.concatenate([[START], word_hashes(raw), [END]])
    return mixed(h[1:]), ngrams(h, 2)


def block_grams(words: bytes, lengths: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What ``grams`` gives for each of a block's texts, end to end."""
    h = _hashes(words)[tokens]
    place = np.arange(len(h)) + np.repeat(np.arange(1, len(lengths) + 1), lengths)
    marked = np.full(len(h) + len(lengths), START)
    marked[place] = h
    return mixed(h), ngrams(marked, 2)[place - 1]


def width_for(n_tokens: int) -> int:
    """Bits of a hash: twelve more than the words and pairs of this many tokens could need, so that the chance to meet another does not grow with them."""
    return min(64, max(40, 12 + (2 * n_tokens).bit_length()))


def _cut(h: np.ndarray, width: int) -> np.ndarray:
    """Keeps the top bits of a hash, of which the first name its range."""
    return h >> np.uint64(64 - width)


def sent_grams(blocks: DataFrame, ranges: int, width: int, together: int = 4) -> DataFrame:
    """(block, part, grams): sorted hashes of ``width`` bits with training counts, packed, for each block and some neighbouring hash ranges.

    Ranges are sent ``together`` as rows would get short where there are thousands of ranges.
    """
    step = np.uint64((1 << width) // max(64, ranges // together))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, words, blob in _rows(batches):
            _, held, lengths, tokens = _documents(blob)
            values, inverse = np.unique(_cut(np.concatenate(block_grams(_raw(words), lengths, tokens)), width), return_inverse=True)
            times = np.bincount(inverse, weights=np.tile(np.repeat(~held, lengths), 2)).astype(np.int64)
            parts, begins = np.unique((values // step).astype(np.int32), return_index=True)
            yield _sent(block, parts, grams=[packed(v, t, width) for v, t in zip(np.split(values, begins[1:]), np.split(times, begins[1:]), strict=True)])

    return blocks.select("block", "words", "documents").mapInArrow(make, "block long, part int, grams binary")


def packed(values: np.ndarray, times: np.ndarray, width: int = 64) -> bytes:
    """Sorted values and their counts in few bytes: gaps and counts, compressed."""
    size = -(-width // 8)
    gaps = np.diff(values, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    raw = np.ascontiguousarray(gaps[:, :size].T).tobytes() + np.minimum(times, 2**32 - 1).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(values).to_bytes(4, "little") + bytes([size]) + pa.compress(raw, "zstd", asbytes=True)


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, size = int.from_bytes(blob[:4], "little"), blob[4]
    raw = np.frombuffer(pa.decompress(blob[5:], (size + 4) * n, "zstd", asbytes=True), np.uint8).reshape(size + 4, n)
    gaps = np.zeros((n, 8), np.uint8)
    gaps[:, :size] = raw[:size].T
    return np.cumsum(gaps.view("<u8").reshape(-1)), np.ascontiguousarray(raw[size:].T).view("<u4").reshape(-1).astype(np.int64)


def _spots(values: np.ndarray, level: int, hashes: int, bits: int | np.ndarray) -> list[np.ndarray]:
    a = mixed(values + np.uint64(level * 0xD1B54A32D192ED03 % (1 << 64)))
    b = mixed(a) | np.uint64(1)
    return [(a + np.uint64(j) * b) % np.asarray(bits, np.uint64) for j in range(hashes)]


_MIDDLE = np.array([0.0, 1.0, *(1.5 * 2.0 ** (level - 1) - 0.5 for level in range(2, 64))])


class Filter:
    """Segments of ``bits`` bits each, one for each hash range, that begin at the bytes ``starts`` of one array."""

    def __init__(self, data: np.ndarray, ranges: int, starts: np.ndarray, bits: np.ndarray, hashes: int, width: int):
        self.data, self.ranges, self.starts, self.bits, self.hashes, self.width = data, ranges, starts, bits, hashes, width

    def has(self, values: np.ndarray, level: int) -> np.ndarray:
        part = (values // np.uint64((1 << self.width) // self.ranges)).astype(np.int64)
        base, bits = self.starts[part] * np.uint64(8), self.bits[part]
        ok = np.ones(len(values), bool)
        for spot in _spots(values, level, self.hashes, bits):
            at = base + spot
            ok &= (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return ok

    def levels(self, values: np.ndarray) -> np.ndarray:
        """The highest level in a row that is present."""
        found, at = np.zeros(len(values), np.uint8), np.arange(len(values))
        for level in range(1, 64):
            at = at[self.has(values[at], level)] if len(at) else at
            if not len(at):
                break
            found[at] = level
        return found

    def counts(self, values: np.ndarray) -> np.ndarray:
        """Counts up to the quantisation: the middle of the level."""
        return _MIDDLE[self.levels(values)]


def filter_of(segments: Iterable[tuple[int, bytes]], ranges: int, hashes: int, width: int) -> Filter:
    """The filter with these segments; a range without one has eight bits that are off."""
    own = list(segments)
    sizes = np.array([len(segment) for _, segment in own], np.uint64)
    starts, bits = np.full(ranges, sizes.sum(), np.uint64), np.full(ranges, 8, np.uint64)
    parts = [part for part, _ in own]
    starts[parts] = np.cumsum(sizes) - sizes
    bits[parts] = sizes * np.uint64(8)
    return Filter(np.frombuffer(b"".join([*(segment for _, segment in own), b"\0"]), np.uint8), ranges, starts, bits, hashes, width)


def segment_of(values: np.ndarray, times: np.ndarray, bits_per_gram: int, hashes: int) -> bytes:
    """The segment of the filter that holds these distinct hashes with these counts."""
    level = 1 + np.floor(np.log2(times)).astype(np.int64)
    bits = 8 * max(128, -(-int(level.sum()) * bits_per_gram // 8))
    on = np.zeros(bits, bool)
    for j in range(1, int(level.max()) + 1):
        for spot in _spots(values[level >= j], j, hashes, bits):
            on[spot.astype(np.int64)] = True
    return np.packbits(on, bitorder="little").tobytes()


def segments_of(values: np.ndarray, times: np.ndarray, ranges: int, width: int, bits_per_gram: int, hashes: int) -> list[tuple[int, bytes]]:
    """The segments of these sorted distinct hashes by hash range; one that was not counted is in none."""
    values, times = values[times > 0], times[times > 0]
    parts, begins = np.unique((values // np.uint64((1 << width) // ranges)).astype(np.int32), return_index=True)
    ends = [*begins[1:], len(values)]
    return [(int(p), segment_of(values[a:b], times[a:b], bits_per_gram, hashes)) for p, a, b in zip(parts, begins, ends, strict=False)]


def _merged(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """The distinct hashes of a part and their counts over all blocks, the place there of every hash that was sent, and how many each block sent."""
    pairs = [unpacked(b) for b in blobs]
    values, inverse = np.unique(np.concatenate([v for v, _ in pairs]), return_inverse=True)
    return values, np.bincount(inverse, weights=np.concatenate([t for _, t in pairs])), inverse, [len(v) for v, _ in pairs]


def filter_segments(grams: DataFrame, ranges: int, width: int, bits_per_gram: int, hashes: int) -> DataFrame:
    """(part, segment) of the filter over all training rows."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        values, times, _, _ = _merged(list(pdf["grams"]))
        return pd.DataFrame(segments_of(values, times, ranges, width, bits_per_gram, hashes), columns=["part", "segment"])

    return grams.groupBy("part").applyInPandas(build, "part int, segment binary")


def found_levels(grams: DataFrame, ranges: int, width: int, bits_per_gram: int, hashes: int) -> DataFrame:
    """(block, part, levels): the segments are made, and the hashes that blocks sent are looked up in them."""

    def answer(asked: pa.Table) -> pa.Table:
        values, times, inverse, sent = _merged(asked["grams"].to_pylist())
        segments = segments_of(values, times, ranges, width, bits_per_gram, hashes)
        levels = filter_of(segments, ranges, hashes, width).levels(values)[inverse]
        found = [_pressed(x.tobytes()) for x in np.split(levels, np.cumsum(sent)[:-1])]
        return pa.table([asked["block"], asked["part"], pa.array(found, pa.binary())], ["block", "part", "levels"])

    return grams.groupBy("part").applyInArrow(answer, "block long, part int, levels binary")


def _filter(blocks: DataFrame, ranges: int, width: int, bits_per_gram: int, hashes: int) -> Filter:
    segments = filter_segments(sent_grams(blocks, ranges, width), ranges, width, bits_per_gram, hashes)
    return filter_of(((r.part, r.segment) for r in segments.collect()), ranges, hashes, width)


def build_filter(docs: DataFrame, n_tokens: int, bits_per_gram: int = 10, hashes: int = 3, grams_per_range: int = 2_000_000) -> Filter:
    """The whole filter, on the driver."""
    return _filter(tokenised_blocks(docs), _ranges_for(2 * n_tokens, grams_per_range), width_for(n_tokens), bits_per_gram, hashes)


def _mix(single: np.ndarray, both: np.ndarray, lengths: np.ndarray, total: int, distinct: int, weight: float) -> np.ndarray:
    """Log10 probabilities of texts of these lengths from the counts at each place."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    before = np.concatenate([[0.0], single[:-1]])
    before[starts] = single[lengths[0] - 1]  # as many texts begin as end
    p = weight * np.minimum(both, before) / np.maximum(before, 1) + (1 - weight) * np.minimum((single + 1) / (total + distinct + 1), 1)
    return np.add.reduceat(np.log10(p), starts)


def model_scores(found: DataFrame, blocks: DataFrame, known_ranges: int, width: int, total: int, distinct: int, model: Filter | None = None, weight: float = 0.7) -> DataFrame:
    """What ``base_scores`` gives and the log10 probability of each text, its end included: by ``model``, or the levels among the ``found`` rows of each block."""
    shared = model and blocks.sparkSession.sparkContext.broadcast((model.data, model.ranges, model.starts, model.bits, model.hashes, model.width))

    def score(found_: pa.Table, block: pa.Table) -> pa.Table:
        words, blob = _raw(block["words"][0].as_py()), block["documents"][0].as_py()
        out = _base(found_.filter(found_["counts"].is_valid()), words, blob, known_ranges, total, distinct)
        _, _, lengths, tokens = _documents(blob)
        values, inverse = np.unique(_cut(np.concatenate(block_grams(words, lengths, tokens)), width), return_inverse=True)
        if shared:
            levels = Filter(*shared.value).levels(values)
        else:  # in the order of the values
            sent = found_.filter(found_["levels"].is_valid()).sort_by("part")["levels"].to_pylist()
            levels = np.frombuffer(b"".join(_raw(b) for b in sent), np.uint8)
        assert len(values) == len(levels)
        at = _MIDDLE[levels][inverse]
        return out.append_column("score", pa.array(_mix(at[: len(tokens)], at[len(tokens) :], lengths, total, distinct, weight)))

    own = blocks.select(F.col("block").alias("own"), "words", "documents")
    return found.groupBy("block").cogroup(own.groupBy("own")).applyInArrow(score, f"{_BASE}, score double")


def base_columns(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``score_documents`` gives but for the model's score, without making the model."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = stored(tokenised_blocks(docs), "tokens")
    known, total, distinct, ranges = known_words(blocks)
    return base_scores(known, blocks, ranges, total, distinct).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score")


def score_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = 1 << 26, bits_per_gram: int = 10, hashes: int = 3, grams_per_range: int = 2_000_000) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = stored(tokenised_blocks(docs), "tokens")
    known, total, distinct, known_ranges = known_words(blocks)
    ranges, width = _ranges_for(2 * total, grams_per_range), width_for(total)
    if 128 * ranges + 2 * total * bits_per_gram // 8 <= max_bytes:  # a count has no more levels than it is high
        model = _filter(blocks, ranges, width, bits_per_gram, hashes)
        out = model_scores(known, blocks, known_ranges, width, total, distinct, model)
    else:
        levels = found_levels(sent_grams(blocks, ranges, width), ranges, width, bits_per_gram, hashes)
        out = model_scores(levels.unionByName(known, allowMissingColumns=True), blocks, known_ranges, width, total, distinct)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
