"""Personal data: fixed patterns, and a linear-chain conditional random field for what they miss.

Base spans come from four patterns (email, ip, card, phone), leftmost and without overlap per
kind; a match that fails its check is dropped and not retried. So neighbours spoil each other:
two card numbers with a space between are one match of too many digits. The random field reads
word shapes instead. It is trained on a small labelled table (``labelled_table``), and decodes
by Viterbi in numpy batches; its spans are added where no base span is.

Its tokens are runs of digits, runs of letters, runs of white space and single other characters.
A token that is more than ``CONTEXT`` tokens away from any digit or at-sign can only be outside
(no kind has such a token in the table), so only the stretches around those are decoded: the
result is that of decoding the whole text under this constraint. Every stretch is decoded whole.

Nulls, ties and repeats: a null text is an empty one and has no spans; a null id is kept; rows
that repeat give equal rows; spans of one start are in the order email, ip, card, phone; other
columns are ignored, and kept as they are by ``redact``.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind, end

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # the same matches, in linear time
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(rb"[0-9@]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, in order."""
    found: list[Span] = []
    last = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < m.start():
            found.append((start, 0, m.end()))
            last = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _NO_DIGIT.sub("", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_NO_DIGIT.sub("", m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


# ---- the random field

LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
CONTEXT = 12
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.DOTALL)
_ACTIVE = re.compile(r"[0-9]+|@")


def shape(token: str) -> str:
    """A token's shape: kind and length of digits, case of letters, other characters as they are."""
    if token[0] in "0123456789":
        n = len(token)
        if n > 4:
            return f"d{n if n < 20 else 20}{'+' if 14 <= n <= 19 and luhn(token) else ''}"
        return f"d{n}{'b' if n <= 3 and int(token) <= 255 else ''}"
    if token.isspace():
        return " " if token == " " else "\n"
    if token.isalpha():
        return ("x" if token.islower() else "X" if token.isupper() else "Xx") + ("1" if len(token) == 1 else "")
    return token


def token_features(shapes: list[str]) -> list[list[str]]:
    padded = ["<", "<", "<", *shapes, ">", ">", ">"]
    out = []
    for i in range(3, len(padded) - 3):
        a, b, c, d, e = padded[i - 2 : i + 3]
        out.append([f"0{c}", f"-1{b}", f"+1{d}", f"-1{b}|{c}", f"+1{c}|{d}", f"-2{a}|{b}|{c}", f"+2{c}|{d}|{e}", f"w{b}|{c}|{d}", f"+3{c}|{d}|{e}|{padded[i + 3]}", f"-3{padded[i - 3]}|{a}|{b}|{c}"])
    return out


#: Sentences of the labelled table. {kind} stands for an example of that kind, {other} words for what is none.
SENTENCES = (
    "write to {email} today", "in {email} we", "the end.\n{email}", "mail {email}, please.", "{email}", "contact: {email}; thanks", "From <{email}> to <{email}>", "{email} {phone}",
    "the host {ip} is down", "{ip}", "from {ip} to {ip}.", "({ip})", "{ip} {card} seen", "at {ip}, then",
    "paid with {card} yesterday", "{card}", "card {card}, valid", "{card} {card} both", "{number} {card} here", "{card} {number} there", "{phone} {card} given", "{card} {phone}", "no {number} {card} {number} in",
    "call {phone} now", "{phone}", "phone: {phone}.", "{phone} {phone}", "| name | {phone} | x |", "call {phone}, or {email}", "{phone} {number} x", "{digits} {phone}",
    "order {number} was sent", "{number}", "{number} {number} are", "version {version} is out", "Version {version}.", "in {year} and {year}, they", "{digits} items at {price}", "{hex} is no secret",
    'token = "{hex}" here', "id {digits}-{digits}", "{version}", "score {digits}:{digits}", "an @ sign, and @name too", "BY-NC {version}.", "page {digits}", "{digits} {digits} {digits}", "on {year}-{day}-{day}",
)


def labelled_table(copies: int = 8, seed: int = 11) -> list[tuple[list[str], list[int]]]:
    """The training table: token lists with their labels."""
    rng = np.random.default_rng(seed)
    digit = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    name = lambda: "".join(rng.choice(list("aeionrstlm"), rng.integers(3, 8)))

    def card() -> str:
        head = digit(int(rng.choice([13, 14, 15, 15, 15, 15])))
        own = next(str(d) for d in range(10) if luhn(head + str(d)))
        whole = head + own
        return whole if rng.random() < 0.8 or len(whole) != 16 else rng.choice([" ", "-"]).join(whole[i : i + 4] for i in range(0, 16, 4))

    def number() -> str:
        while True:
            n = digit(int(rng.choice([6, 9, 12, 15, 16, 16, 16, 22])))
            if not (14 <= len(n) <= 19 and luhn(n)):
                return n

    make = {
        "email": lambda: f"{name()}{rng.choice(['.', '_', ''])}{rng.choice([digit(2), digit(2), name()])}@{name()}{rng.choice(['', digit(1)])}.{name()}{rng.choice(['', '.com', '.co.uk'])}",
        "ip": lambda: ".".join(str(x) for x in rng.integers(0, 256, 4)),
        "card": card,
        "phone": lambda: rng.choice([f"+1 ({digit(3)}) {digit(3)}-{digit(4)}", f"+{digit(2)} {digit(3)} {digit(7)}", f"+{digit(11)}", f"+{digit(1)}-{digit(3)}-{digit(3)}-{digit(4)}"]),
        "number": number,
        "version": lambda: f"{digit(1)}.{digit(1)}",
        "year": lambda: str(rng.integers(1900, 2030)),
        "day": lambda: f"{rng.integers(1, 28):02d}",
        "digits": lambda: digit(int(rng.integers(1, 5))),
        "price": lambda: f"{digit(2)}.{digit(2)}",
        "hex": lambda: "".join(rng.choice(list("0123456789abcdef"), 40)),
    }
    table = []
    for _ in range(copies):
        for sentence in SENTENCES:
            tokens, labels = [], []
            for part in re.split(r"(\{\w+\})", f"{name()} {sentence} {name()}"):
                kind = part[1:-1]
                text = make[kind]() if part[:1] == "{" else part
                own = _TOKEN.findall(text)
                k = KINDS.index(kind) if part[:1] == "{" and kind in KINDS else None
                tokens += own
                labels += [0] * len(own) if k is None else [1 + 2 * k, *[2 + 2 * k] * (len(own) - 1)]
            table.append((tokens, labels))
    return table


class Field:
    """Weights of a linear-chain conditional random field."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.names, self.emit, self.move = names, emit, move

    def scores(self, shapes: list[str]) -> np.ndarray:
        return np.stack([self.emit[[self.names[f] for f in fs if f in self.names]].sum(0) for fs in token_features(shapes)])


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def train(table: list[tuple[list[str], list[int]]], epochs: int = 12, rate: float = 0.3, decay: float = 1e-4, seed: int = 5) -> Field:
    """Adaptive gradient steps on the exact log-likelihood, by forward and backward sums."""
    rows = [([token_features([shape(t) for t in tokens])][0], labels) for tokens, labels in table]
    names: dict[str, int] = {}
    made = [([np.array([names.setdefault(f, len(names)) for f in fs]) for fs in feats], np.array(labels)) for feats, labels in rows]
    n = len(LABELS)
    emit, move = np.zeros((len(names), n)), np.zeros((n, n))
    for k in range(len(KINDS)):  # an inside label only follows its own kind
        for prev in range(n):
            if prev not in (1 + 2 * k, 2 + 2 * k):
                move[prev, 2 + 2 * k] = -1e4
    frozen = move < 0
    seen_e, seen_m = np.full_like(emit, 1e-2), np.full_like(move, 1e-2)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(made)):
            feats, y = made[i]
            s = np.stack([emit[f].sum(0) for f in feats])
            s[0, 2::2] = -1e4
            t = len(y)
            forward, back = np.zeros((t, n)), np.zeros((t, n))
            forward[0] = s[0]
            for k in range(1, t):
                forward[k] = s[k] + _logsum(forward[k - 1][:, None] + move, 0)
            for k in range(t - 2, -1, -1):
                back[k] = _logsum(move + (s[k + 1] + back[k + 1])[None, :], 1)
            z = _logsum(forward[-1], 0)
            p = np.exp(forward + back - z)
            p[np.arange(t), y] -= 1
            gm = np.exp(np.logaddexp.reduce(forward[:-1, :, None] + move[None] + (s[1:] + back[1:])[:, None, :] - z, axis=0)) if t > 1 else np.zeros_like(move)
            np.subtract.at(gm, (y[:-1], y[1:]), 1)
            gm += decay * np.where(frozen, 0, move)
            gm[frozen] = 0
            seen_m += gm * gm
            move -= rate * gm / np.sqrt(seen_m)
            for f, g in zip(feats, p, strict=True):
                g = g + decay * emit[f]
                seen_e[f] += g * g
                emit[f] -= rate * g / np.sqrt(seen_e[f])
    return Field(names, emit, move)


@functools.lru_cache(1)
def default_field() -> Field:
    return train(labelled_table())


def viterbi(field: Field, emits: list[np.ndarray]) -> list[np.ndarray]:
    """Best label sequences of a batch, decoded together: one numpy step per place."""
    lengths = np.array([len(e) for e in emits])
    b, t, n = len(emits), int(lengths.max()), len(LABELS)
    s = np.zeros((b, t, n))
    for i, e in enumerate(emits):
        s[i, : len(e)] = e
    s[:, 0, 2::2] = -1e4
    best, back = s[:, 0].copy(), np.zeros((b, t, n), np.int8)
    for k in range(1, t):
        through = best[:, :, None] + field.move[None]
        back[:, k] = through.argmax(1)
        best = np.where((k < lengths)[:, None], through.max(1) + s[:, k], best)
    at = best.argmax(1)
    out = np.zeros((b, t), np.int64)
    for k in range(t - 1, -1, -1):
        live = k < lengths
        out[live, k] = at[live]
        if k:
            at = np.where(live, back[np.arange(b), k, at], at)
    return [o[:m] for o, m in zip(out, lengths, strict=True)]


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Parts of a text around digits and at-signs, ``CONTEXT`` tokens wide on both sides."""
    start = end = -1
    for m in _ACTIVE.finditer(text):
        # whole runs of letters or white space count as one token
        lo, left = m.start(), CONTEXT
        while lo > 0 and left:
            k = _kind(text[lo - 1])
            lo -= 1
            while k and lo > 0 and _kind(text[lo - 1]) == k:
                lo -= 1
            left -= 1
        hi = m.end()
        for left, more in enumerate(_TOKEN.finditer(text, m.start())):
            hi = more.end()
            if left == CONTEXT:
                break
        if lo <= end:
            end = max(end, hi)
        else:
            if end > 0:
                yield start, end
            start, end = lo, hi
    if end > 0:
        yield start, end


def _kind(c: str) -> int:
    return 1 if c in "0123456789" else 2 if c.isspace() else 3 if c.isalpha() else 0


def found_spans(field: Field, texts: list[str], batch: int = 512) -> list[list[Span]]:
    """Spans that the random field finds in each text."""
    out: list[list[Span]] = [[] for _ in texts]
    parts = []
    for i, text in enumerate(texts):
        for lo, hi in stretches(text):
            tokens = list(_TOKEN.finditer(text, lo, hi))
            parts.append((i, tokens, field.scores([shape(m.group()) for m in tokens])))
    parts.sort(key=lambda p: len(p[1]))
    for at in range(0, len(parts), batch):
        some = parts[at : at + batch]
        size = max(len(p[1]) for p in some)
        step = max(1, min(batch, 200_000 // size))  # a very long stretch is decoded with few others
        for k in range(0, len(some), step):
            own = some[k : k + step]
            for (i, tokens, _), labels in zip(own, viterbi(field, [p[2] for p in own]), strict=True):
                j = 0
                while j < len(labels):
                    label = int(labels[j])
                    if label % 2:  # begins a span
                        e = j + 1
                        while e < len(labels) and labels[e] == label + 1:
                            e += 1
                        out[i].append((tokens[j].start(), label // 2, tokens[e - 1].end()))
                        j = e
                    else:
                        j += 1
    return out


def all_spans(field: Field, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """(base, all) spans of each text; a found span that touches a base span, or fails its kind's check, is left out."""
    base = [base_spans(t) for t in texts]
    out = []
    for text, own, more in zip(texts, base, found_spans(field, texts), strict=True):
        add = [(s, k, e) for s, k, e in more if _plausible(text[s:e], k) and all(e <= a or b <= s for a, _, b in own)] if more else []
        out.append((own, sorted(own + add)))
    return out


def _plausible(value: str, kind: int) -> bool:
    digits = _NO_DIGIT.sub("", value)
    return (
        kind == 0 and 0 < value.find("@") < len(value) - 3 and "." in value[value.find("@") :]
        or kind == 1 and value.count(".") == 3 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in value.split("."))
        or kind == 2 and 14 <= len(digits) <= 19 and luhn(digits)
        or kind == 3 and value[0] == "+" and 10 <= len(digits) <= 15
    )


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _span_batches(raws: list[bytes | None], field: Field) -> list[tuple[str, list[Span], list[Span]]]:
    live = [i for i, r in enumerate(raws) if r and _ANY.search(r)]
    texts = [raws[i].decode() for i in live]
    both = dict(zip(live, zip(texts, all_spans(field, texts), strict=True), strict=True)) if live else {}
    return [(both[i][0], *both[i][1]) if i in both else ("", [], []) for i in range(len(raws))]


def find_personal_data(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, counts of base spans per kind, base_sha256 and all spans."""
    shared = documents.sparkSession.sparkContext.broadcast(default_field())
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _span_batches(batch.column(1).cast(pa.binary()).to_pylist(), shared.value)
            counts = [pa.array([sum(s[1] == k for s in own) for _, own, _ in rows], pa.int64()) for k in range(len(KINDS))]
            digests = [hashlib.sha256(spelled(own).encode()).hexdigest() for _, own, _ in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(digests, pa.string()), pa.array([spelled(every) for _, _, every in rows], pa.string())], names)

    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; of spans that overlap, the first names the whole."""
    out, last = [], 0
    for start, kind, end in spans:
        if start >= last:
            out += [text[last:start], f"[{KINDS[kind].upper()}]"]
        last = max(last, end)
    return "".join([*out, text[last:]])


def redact(documents: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """Documents, all rows and columns, with personal data replaced and the length column put right."""
    shared = documents.sparkSession.sparkContext.broadcast(default_field())
    at = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, (text, _, every) in enumerate(_span_batches([t.encode() if t is not None else None for t in texts], shared.value)):
                if every:
                    texts[i] = redacted(text, every)
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = documents.mapInArrow(run, documents.schema)
    if length_col in out.columns:
        kind = documents.schema[length_col].dataType
        out = out.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.length(text_col)).cast(kind))
    return out
