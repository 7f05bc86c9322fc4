"""Hierarchical packing of documents into sequences of several lengths.

The tiers are context sizes, powers of two; a sequence of such a size needs no padding. A document
gives as many windows of the largest tier as it fills by itself; the rest of it, its tail, is routed to
the smallest tier that holds it. From the largest tier down, each tail of a tier opens a window of
that size, and the gap is filled from the shorter tiers: with the longest tail that fits, again and
again, and when none fits with the beginning of the shortest tail that is longer than the gap, whose
rest is routed anew. So a window is full to its last token, and at most one document is cut for it.
What remains at the end of a block, less than one window, is cut at powers of two.

The windows of a tier are dealt to step groups, which training takes as one step each: ordered by
the cost of attention (the sum of squared lengths of their pieces) and dealt back and forth, so that
all groups of a tier hold about the same tokens at about the same cost.

Tasks work on a slice of their texts at a time (a block), with nothing to shuffle, collect or join: ids,
places and checks of a piece are known where its text is read, no key is ever gathered, and memory is
bounded by a slice. A block leaves at most one window in parts. Sequence numbers are the task's number
and a counter, so tasks of a lost executor give the same rows again.

Ids are looked up by pre-token: kinds of characters, which the tokenizer itself is asked for once, cut
the texts of a slice in numpy, and each different piece of text goes through the model once. Texts with the
names of special tokens, and tokenizers of another kind, take the whole tokenizer.

Defined results: a null text is an empty one, whose only token is the closing id; a null id is kept;
rows that repeat are packed each on their own; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import _ALPHABET, slices

SPACE, LETTER, NUMBER, OTHER = range(4)
TIERS = (1024, 512, 256, 128)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class PreTokens(dict):
    """Pre-token (UTF-8 bytes) -> its ids as little-endian 32-bit bytes; forgets everything past ``limit``."""

    limit = 500_000

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        made = json.loads(self.tokenizer.to_str())
        pre = made["pre_tokenizer"] or {}
        self.divides = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and made["normalizer"] is None and made["post_processor"] is None and made["model"]["type"] == "BPE" and not any(t["normalized"] or t["lstrip"] or t["rstrip"] for t in made["added_tokens"])
        self.special = [t["content"] for t in made["added_tokens"]]
        self.kinds = np.full(0x110000, 255, np.uint8)

    def __missing__(self, piece: bytes) -> bytes:
        value = np.array([t.id for t in self.model.tokenize(piece.decode("latin-1").translate(_ALPHABET))], "<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[piece] = value
        return value

    def kind(self, points: np.ndarray) -> np.ndarray:
        """Kind of each code point; one seen for the first time is told by what the tokenizer joins it with."""
        out = self.kinds[points]
        new = np.unique(points[out == 255])
        if len(new):
            joins = lambda a, c: len(self.tokenizer.pre_tokenizer.pre_tokenize_str(a + c)) == 1
            for p in new.tolist():
                c = chr(p)
                self.kinds[p] = LETTER if joins("a", c) else NUMBER if joins("1", c) else OTHER if joins("!", c) else SPACE
            out = self.kinds[points]
        return out

    def whole(self, text: str) -> np.ndarray:
        return np.frombuffer(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), "<u4")


_own: dict[str, PreTokens] = {}


def code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of each character, its code point) of UTF-8."""
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    b = raw[at].astype(np.int32)
    if not len(at) or int(b.max()) < 0x80:
        return at, b
    after = lambda k, some: (raw[at[some] + k] & 0x3F).astype(np.int32)
    for low, high, mask, extra in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0xF8, 0x07, 3)):
        some = np.flatnonzero((raw[at] >= low) & (raw[at] < high))
        value = b[some] & mask
        for k in range(1, extra + 1):
            value = (value << 6) | after(k, some)
        b[some] = value
    return at, b


def pre_token_starts(points: np.ndarray, kinds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which characters begin a pre-token; ``first`` marks the first of each text.

    A pre-token is a contraction (an apostrophe and s, t, re, ve, m, ll or d), a run of one kind with the single
    blank before it, or white space up to that blank.
    """
    n = len(points)
    space = kinds == SPACE
    edge = np.append(first[1:], True)  # the last of its text
    following = np.append(space[1:], True)
    tail = space & ~edge & ~following  # white space right before other characters
    before = np.concatenate([[True], space[:-1]])
    starts = first | (space & ~before) | tail
    attached = np.concatenate([[False], (tail & (points == 0x20))[:-1]])
    changed = np.concatenate([[True], kinds[1:] != kinds[:-1]])
    starts |= ~space & ((before & ~attached) | (~before & changed))
    for at in np.flatnonzero((points == 0x27) & starts).tolist():
        if at + 1 < n and not first[at + 1]:
            a = points[at + 1]
            two = at + 2 < n and not first[at + 2] and (a, points[at + 2]) in _TWO
            size = 2 if a in _ONE else 3 if two else 0
            if size:
                starts[at + 1 : at + size] = False
                if at + size < n:
                    starts[at + size] = True
    return starts


_ONE = {ord(c) for c in "stmd"}
_TWO = {(ord(a), ord(b)) for a, b in ("re", "ve", "ll")}


def token_ids(texts: pa.StringArray, path: str) -> list[np.ndarray]:
    """Ids of each text; each different pre-token of the texts is looked up once."""
    if path not in _own:
        _own[path] = PreTokens(path)
    own = _own[path]
    if not own.divides:
        return [own.whole(t) for t in texts.to_pylist()]
    odd = np.zeros(len(texts), bool)
    for name in own.special:
        odd |= pc.match_substring(texts, name).to_numpy(zero_copy_only=False)
    plain = pc.if_else(pa.array(odd), "", texts).cast(pa.large_binary())
    ends = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + len(plain) + 1]
    raw = np.frombuffer(plain.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    cuts = ends - ends[0]
    at, points = code_points(raw)
    first = np.zeros(len(at), bool)
    opens = cuts[:-1][np.diff(cuts) > 0]
    first[np.searchsorted(at, opens)] = True
    starts = at[pre_token_starts(points, own.kind(points), first)] if len(at) else at
    offsets = np.append(starts, len(raw)).astype(np.int64)
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
    found = list(map(own.__getitem__, pieces.dictionary.to_pylist()))
    table, sizes = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
    word = pieces.indices.to_numpy()
    lengths = sizes[word]
    stops = np.cumsum(lengths)
    ids = table[np.repeat((np.cumsum(sizes) - sizes)[word] - stops + lengths, lengths) + np.arange(stops[-1] if len(stops) else 0)]
    bounds = np.concatenate([[0], stops])[np.searchsorted(starts, cuts)].tolist()
    out = [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
    for i in np.flatnonzero(odd).tolist():
        out[i] = own.whole(texts[i].as_py())
    return out


class Tails:
    """Open tails by length; the bits of ``some`` say which lengths there are."""

    def __init__(self) -> None:
        self.of: dict[int, list[tuple[int, int]]] = {}
        self.some = 0

    def put(self, doc: int, start: int, length: int) -> None:
        self.of.setdefault(length, []).append((doc, start))
        self.some |= 1 << length

    def take(self, length: int) -> tuple[int, int, int]:
        own = self.of[length]
        doc, start = own.pop()
        if not own:
            self.some &= ~(1 << length)
        return doc, start, length

    def longest(self, most: int) -> int:
        """The greatest length up to ``most``; 0 if there is none."""
        return max(0, (self.some & ((2 << most) - 1)).bit_length() - 1)

    def above(self, least: int) -> int:
        """The smallest length over ``least``; 0 if there is none."""
        rest = self.some >> (least + 1)
        return least + (rest & -rest).bit_length() if rest else 0


Piece = tuple[int, int, int]  # document, start, length


def parted(window: list[Piece]) -> Iterator[list[Piece]]:
    """A window that is not full, as sequences of decreasing powers of two."""
    left, total = list(window), sum(p[2] for p in window)
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        own = []
        while room:
            doc, start, length = left.pop(0)
            own.append((doc, start, min(length, room)))
            if length > room:
                left.insert(0, (doc, start + room, length - room))
            room -= own[-1][2]
        yield own


def windows(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> Iterator[tuple[int, list[Piece]]]:
    """(size, pieces) of each sequence of a block of documents; sizes are powers of two, and full."""
    top, tails = tiers[0], Tails()
    for doc, n in enumerate(lengths):
        whole = n // top
        for k in range(whole):
            yield top, [(doc, k * top, top)]
        if n % top:
            tails.put(doc, whole * top, n % top)
    for tier, below in zip(tiers, (*tiers[1:], 0), strict=True):
        while (length := tails.longest(tier)) > below:
            window, gap = [tails.take(length)], tier - length
            while gap and tails.some:
                if length := tails.longest(gap):
                    window.append(tails.take(length))
                    gap -= length
                else:
                    doc, start, length = tails.take(tails.above(gap))
                    window.append((doc, start, gap))
                    tails.put(doc, start + gap, length - gap)
                    gap = 0
            if gap:
                yield from ((sum(p[2] for p in own), own) for own in parted(window))
            else:
                yield tier, window


def step_groups(sizes: np.ndarray, costs: np.ndarray, step_tokens: int) -> np.ndarray:
    """A group for each sequence: of one size, of about ``step_tokens`` tokens, of about equal cost."""
    out, fresh = np.zeros(len(sizes), np.int64), 0
    for size in np.unique(sizes)[::-1].tolist():
        own = np.flatnonzero(sizes == size)
        own = own[np.argsort(-costs[own], kind="stable")]
        n = max(1, round(len(own) * size / step_tokens))
        turn = np.arange(len(own)) % (2 * n)
        out[own] = fresh + np.where(turn < n, turn, 2 * n - 1 - turn)
        fresh += n
    return out


def pack_documents(documents: DataFrame, tokenizer_path: str | None = None, tiers: tuple[int, ...] = TIERS, end_id: int = 0, step_tokens: int = 65_536, block_bytes: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length, step_group (and ids, as bytes, if asked)."""
    if any(t & (t - 1) or t <= 0 for t in tiers) or sorted(tiers, reverse=True) != list(dict.fromkeys(tiers)):
        raise ValueError("tiers are different powers of two, the largest first")
    path = tokenizer_path or default_tokenizer()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group", "ids"][: 10 if with_ids else 9]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, task = np.array([end_id], "<u4"), TaskContext.get().partitionId() << 40
        sequence = group = task
        for batch in batches:
            for some in slices(batch, 1, block_bytes):
                ids = [np.concatenate([i, end]) for i in token_ids(pc.fill_null(some.column(1), ""), path)]
                docs = some.column(0).to_pylist()
                packed = list(windows([len(i) for i in ids], tiers))
                sizes = np.array([s for s, _ in packed], np.int64)
                groups = step_groups(sizes, np.array([sum(n * n for _, _, n in w) for _, w in packed], np.int64), step_tokens)
                rows = []
                for (size, window), g in zip(packed, (groups + group).tolist(), strict=True):
                    offset = 0
                    for doc, start, n in window:
                        raw = ids[doc][start : start + n].tobytes()
                        rows.append((docs[doc], start, n, zlib.crc32(raw), len(ids[doc]), sequence, offset, size, g, raw)[: len(names)])
                        offset += n
                    sequence += 1
                group += int(groups.max()) + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for c, n in zip(zip(*rows, strict=True), names, strict=True)], names)

    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in names))
