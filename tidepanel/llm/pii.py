"""Operator 5: personal data. Patterns find the base spans, in time linear in the text; a linear-chain conditional random
field over word-shape features adds spans that the patterns don't cover, decoded by Viterbi over many sequences at once in
numpy: numbers of a phone without a plus, cards in groups parted by full stops or of 13 digits, addresses of mail whose host
has letters beyond ASCII or that are spelt with [at], (dot) and the like.

Words are [^\\x20\\x09-\\x0D]+. A word's shape is a number made of how many digits it has, whether it has letters, a capital
first, `@`, full stops, hyphens, a plus, brackets or other marks. Shapes of a word and of its two neighbours are the
features. A sequence is a line, whatever its length: long lines are decoded as blocks side by side, which are then joined, with
the labels of the whole line. The field is trained on a small labelled table of (words, labels), by default one made from
rules.

Found spans are trimmed of surrounding marks, must hold what their kind needs (digits, dots, an @ or its spelling, a valid
check digit; 512 code points at most), and give way where they touch a base span. Null and empty texts have none; offsets
count code points, ends are exclusive.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
MOST_WORDS = 128
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_LETTER = regex.compile(r"\p{L}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+. A match has one @, and what precedes that can't
    go back past the match or the @ before it: each stretch between them is read once, backwards."""
    stop, p = 0, text.find("@")
    while p >= 0:
        begin = p - _LOCAL.match(text[stop:p][::-1]).end()
        stop = p + 1
        if begin < p and (host := _HOST.match(text, p + 1)):
            yield begin, host.end()
            stop = host.end()
        p = text.find("@", stop)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+) whose parts are at most 255: each chain of numbers joined by
    single full stops holds one for every four of them."""
    for chain in _DOTTED.finditer(text):
        if chain[0].count(".") < 3:
            continue
        parts, at = chain[0].split("."), chain.start()
        for i in range(0, len(parts) - 3, 4):
            some = parts[i : i + 4]
            end = at + sum(map(len, some)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in some):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """start, kind, end by start, then kind."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    out += [(a, 1, b) for a, b in addresses(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


# Word shapes: bits 0-2 how many digits, then one bit for each mark.
_DIGIT_STEPS = np.searchsorted([1, 4, 7, 10, 14, 20], np.arange(256), "right")
SHAPES = 1 << 12


def _byte_classes() -> np.ndarray:
    t = np.zeros(256, np.uint8)
    t[128:] = 1
    for lo, hi, bit in ((65, 90, 1), (97, 122, 1), (64, 64, 2), (45, 45, 8), (43, 43, 16), (40, 41, 32), (91, 91, 32), (93, 93, 32), (123, 123, 32), (125, 125, 32)):
        t[lo : hi + 1] = bit
    for c in b"!\"#$%&'*,/:;<=>?\\^_`|~":
        t[c] = 64
    return t


_CLASS = _byte_classes()


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Shape numbers of the words."""
    if not len(starts):
        return np.empty(0, np.int64)
    inner = np.stack([starts, ends], 1).reshape(-1)
    inner[-1] = min(inner[-1], len(data))
    cut = inner[:-1] if ends[-1] >= len(data) else inner
    kinds = np.bitwise_or.reduceat(_CLASS[data], cut)[::2]
    digit = np.add.reduceat(((data >= 48) & (data <= 57)).astype(np.int32), cut)[::2]
    stops = np.add.reduceat((data[:] == 46).astype(np.int32), cut)[::2]
    last_stop = data[ends - 1] == 46
    stops = np.minimum(stops - last_stop, 3)
    capital = (data[starts] >= 65) & (data[starts] <= 90)
    return (
        _DIGIT_STEPS[np.minimum(digit, 255)]
        | (kinds & 1).astype(np.int64) << 3
        | (kinds & 2).astype(np.int64) >> 1 << 4
        | stops.astype(np.int64) << 5
        | (kinds & 8).astype(np.int64) >> 3 << 7
        | (kinds & 16).astype(np.int64) >> 4 << 8
        | (kinds & 32).astype(np.int64) >> 5 << 9
        | (kinds & 64).astype(np.int64) >> 6 << 10
        | capital.astype(np.int64) << 11
    )


def _attributes() -> np.ndarray:
    """0/1 features of each shape number: one-hot digits, one-hot stops, the marks, and marks together with digits."""
    s = np.arange(SHAPES)
    digits, stops = s & 7, s >> 5 & 3
    marks = [s >> b & 1 for b in (3, 4, 7, 8, 9, 10, 11)]
    columns = [digits == d for d in range(7)] + [stops == d for d in range(4)] + [m == 1 for m in marks]
    columns += [(digits == d) & (m == 1) for d in range(1, 7) for m in marks]
    columns += [(digits == d) & (stops == e) for d in range(1, 7) for e in range(1, 4)]
    columns += [(digits == d) & (np.sum(marks, 0) == 0) & (stops == 0) for d in range(1, 7)]
    return np.stack(columns, 1).astype(np.float64)


def default_table(rows: int = 600, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """A small labelled table made from rules: words and the kind of each word, `other` for most."""
    rng = np.random.default_rng(seed)
    syllables = ["an", "er", "the", "on", "ti", "le", "qu", "sch", "de", "os", "né", "ü"]

    def word() -> str:
        w = "".join(rng.choice(syllables, rng.integers(1, 5)))
        return (w.capitalize() if rng.random() < 0.15 else w) + str(rng.choice(["", "", "", "", ",", ".", "!", "###", "%%%", "&&&"]))

    def num(n: int) -> str:
        return "".join(map(str, rng.integers(0, 10, n)))

    def octet() -> str:
        return str(rng.integers(0, 256))

    def email():
        name, host, top = f"{rng.choice(['jo', 'ann', 'mail', 'x.y'])}{num(int(rng.integers(0, 3)))}", f"{rng.choice(['mail', 'host', 'müller'])}{num(1)}", str(rng.choice(["com", "org", "de"]))
        at, dot = str(rng.choice(["[at]", "(at)", "{at}"])), str(rng.choice(["[dot]", "(dot)", "{dot}"]))
        return [[f"{name}@{host}.example.{top}"], [f"{name}@{host}.{top}"], [name, at, f"{host}.{top}"], [name, at, host, dot, top]][rng.integers(4)]

    def phone():
        a, b, c = num(3), num(3), num(4)
        return [["+1", f"({a})", f"{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"+{num(2)}", a, b + c], [f"+{num(2)}{num(10)}"], [f"{a}.{b}.{c}"], ["+1", f"{a}-{b}-{c}"], [f"0{num(3)}", num(3), num(4)]][rng.integers(8)]

    def card():
        parts = [num(4) for _ in range(4)]
        return [["".join(parts)], parts, ["-".join(parts)], [".".join(parts)], [num(13)]][rng.integers(5)]

    def other():
        return [
            [str(rng.integers(1900, 2100))], [num(int(rng.integers(1, 4)))], [f"{num(1)}.{num(1)}"], [f"${num(2)}.{num(2)}"], [f"{num(4)}-{num(2)}-{num(2)}"], [f"{num(2)}:{num(2)}"],
            ["".join(rng.choice(list("0123456789abcdef"), 40))], [f"v{num(1)}.{num(1)}.{num(1)}"], [f"{num(1)},{num(3)}"], ["key_" + "".join(rng.choice(list("0123456789ABCdef"), 24))],
            ["|"], [f"({word()})"], [f"{num(6)}"], [f"#{num(3)}"], [f"{word()}-{word()}"], [num(24)], ["License,", "version", f"{num(1)}.{num(1)}."], [f"https://{word()}.com/{num(3)}"],
            [f"[{num(1)}]"], ["(a)"], ["[sic]"], [f"{num(3)}-{num(3)}"], [f"{num(4)}-{num(4)}"], [num(4), num(4)], [f"{num(3)}.{num(3)},{num(2)}"], [f"@{word()}"],
        ][rng.integers(26)]

    table = []
    for _ in range(rows):
        words, labels = [], []
        for _ in range(rng.integers(1, 4)):
            for _ in range(rng.integers(0, 5)):
                words.append(word())
                labels.append("other")
            pick = rng.random()
            kind, made = ("email", email()) if pick < 0.15 else ("ip", [".".join(octet() for _ in range(4))]) if pick < 0.3 else ("card", card()) if pick < 0.45 else ("phone", phone()) if pick < 0.6 else ("other", other())
            made = made[:-1] + [made[-1] + str(rng.choice(["", "", "", ".", ",", "###", "!!"]))]
            words += made
            labels += [kind] * len(made)
        table.append((words, labels))
    return table


class ShapeField:
    """Emission tables for the shape of a word, of the one before and of the one after, and transitions."""

    def __init__(self, table: np.ndarray, bias: np.ndarray, steps: np.ndarray):
        self.table, self.bias, self.steps = table, bias, steps

    def emissions(self, shape: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        before, after = np.roll(shape, 1), np.roll(shape, -1)
        e = self.table[0][shape] + self.bias
        e += np.where(first[:, None], 0, self.table[1][before])
        e += np.where(last[:, None], 0, self.table[2][after])
        return e

    def line_labels(self, e: np.ndarray, line_starts: np.ndarray) -> np.ndarray:
        """Best labels of the lines that start at the words `line_starts`. Lines of more than MOST_WORDS words are worked on as
        blocks of that size, all blocks at once: the best score from each label before a block to each label at its end
        first, then a walk over each line's blocks, then the labels inside."""
        if not len(e):
            return np.zeros(0, np.int8)
        sizes = np.diff(np.append(line_starts, len(e)))
        blocks = -(-sizes // MOST_WORDS)
        if (blocks == 1).all():
            return self.viterbi(e, sizes)
        inner = common.ragged(blocks)
        line = np.repeat(np.arange(len(sizes)), blocks)
        begin = line_starts[line] + inner * MOST_WORDS
        size = np.minimum(MOST_WORDS, (line_starts + sizes)[line] - begin)
        long = blocks[line] > 1
        at, later = np.flatnonzero(long), np.flatnonzero(inner > 0)
        words = np.repeat(begin[at], size[at]) + common.ragged(size[at])
        opening = np.cumsum(size[at]) - size[at]
        goes_on = inner[at] > 0
        reach = np.empty((len(at), len(self.steps), e.shape[1]), e.dtype)  # of each block, by label before it and at its end
        for i, step in enumerate(self.steps):
            part = e[words]
            part[opening[goes_on]] += step
            reach[:, i] = self.forward(part, size[at])[0]
        ends = np.zeros(len(line), np.int64)
        first = np.cumsum(blocks) - blocks  # of each line
        place = np.cumsum(long) - 1
        many = np.flatnonzero(blocks > 1)
        many = many[np.argsort(-blocks[many], kind="stable")]
        score = reach[place[first[many]], 0]
        back, finals = [], np.zeros((len(many), e.shape[1]), e.dtype)
        most = int(blocks[many[0]])
        alive = [int((blocks[many] > k).sum()) for k in range(most)]
        for k in range(1, most):
            n = alive[k]
            finals[n : len(score)] = score[n:]
            cand = score[:n, :, None] + reach[place[first[many[:n]] + k]]
            back.append(cand.argmax(1))
            score = cand.max(1)
        finals[: len(score)] = score
        best = finals.argmax(1)
        for k in range(most - 1, -1, -1):
            n = alive[k]
            ends[first[many[:n]] + k] = best[:n]
            if k:
                best[:n] = back[k - 1][np.arange(n), best[:n]]
        held = e.copy()
        held[begin[later]] += self.steps[ends[later - 1]]
        shut = np.where(np.arange(e.shape[1]) == ends[at, None], 0, -1e9).astype(e.dtype)
        held[begin[at] + size[at] - 1] += shut
        return self.viterbi(held, size)

    def forward(self, e: np.ndarray, sizes: np.ndarray):
        """Of consecutive sequences of the given sizes: best score by last label, and what viterbi needs to go back. Step t
        is taken for all sequences longer than t at once, sequences ordered by size."""
        begin = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        begin, sizes = begin[order], sizes[order]
        alive = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")  # sequences of more than t words
        score = e[begin]
        back: list[np.ndarray] = []
        finals = np.zeros((len(sizes), e.shape[1]), e.dtype)
        for t in range(1, sizes[0]):
            n = alive[t]
            finals[n : len(score)] = score[n:]
            cand = score[:n, :, None] + self.steps[None]
            back.append(cand.argmax(1).astype(np.int8))
            score = np.take_along_axis(cand, back[-1][:, None, :].astype(np.int64), 1)[:, 0] + e[begin[:n] + t]
        finals[: len(score)] = score
        unordered = np.empty_like(finals)
        unordered[order] = finals
        return unordered, finals, back, begin, alive

    def viterbi(self, e: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Best labels of consecutive sequences of the given sizes."""
        labels = np.zeros(len(e), np.int8)
        if not len(e):
            return labels
        _, finals, back, begin, alive = self.forward(e, sizes)
        best = finals.argmax(1).astype(np.int8)
        for t in range(len(alive) - 1, -1, -1):
            n = alive[t]
            labels[begin[:n] + t] = best[:n]
            if t:
                best[:n] = np.take_along_axis(back[t - 1], best[:n, None].astype(np.int64), 1)[:, 0]
        return labels


def train(table: list[tuple[list[str], list[str]]], rounds: int = 250, shrink: float = 2e-3) -> ShapeField:
    """Maximum conditional likelihood by gradient steps with momentum; forward and backward over all rows at once."""
    attributes = _attributes()
    n_attr, n_label = attributes.shape[1], OTHER + 1
    longest = max(len(w) for w, _ in table)
    ids = np.zeros((len(table), longest), np.int64)
    gold = np.full((len(table), longest), OTHER)
    size = np.array([len(w) for w, _ in table])
    for i, (words, labels) in enumerate(table):
        raw = [w.encode() for w in words]
        ends = np.cumsum([len(w) + 1 for w in raw]) - 1
        ids[i, : len(raw)] = shapes(np.frombuffer(b" ".join(raw), np.uint8), ends - [len(w) for w in raw], ends)
        gold[i, : len(raw)] = [KINDS.index(x) if x in KINDS else OTHER for x in labels]
    mask = np.arange(longest) < size[:, None]
    here = attributes[ids] * mask[:, :, None]
    before = np.concatenate([np.zeros_like(here[:, :1]), here[:, :-1]], 1) * mask[:, :, None]
    after = np.concatenate([here[:, 1:], np.zeros_like(here[:, :1])], 1) * mask[:, :, None]
    x = np.concatenate([here, before, after, mask[:, :, None].astype(float)], 2)
    onehot = np.eye(n_label)[gold] * mask[:, :, None]
    theta, steps = np.zeros((x.shape[2], n_label)), np.zeros((n_label, n_label))
    m = [np.zeros_like(theta), np.zeros_like(steps)]
    v = [np.zeros_like(theta), np.zeros_like(steps)]
    for r in range(1, rounds + 1):
        e = x @ theta
        fwd = np.zeros_like(e)
        bwd = np.zeros_like(e)
        fwd[:, 0] = e[:, 0]
        for t in range(1, longest):
            new = np.logaddexp.reduce(fwd[:, t - 1, :, None] + steps, axis=1) + e[:, t]
            fwd[:, t] = np.where(mask[:, t, None], new, fwd[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = np.logaddexp.reduce(steps + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], axis=2)
            bwd[:, t] = np.where(mask[:, t + 1, None], new, 0)
        z = np.logaddexp.reduce(fwd[:, -1], axis=1)
        unary = np.exp(fwd + bwd - z[:, None, None]) * mask[:, :, None]
        pair = np.exp(fwd[:, :-1, :, None] + steps + (e + bwd)[:, 1:, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        grads = [np.einsum("ntf,ntl->fl", x, onehot - unary) / len(table) - shrink * theta, (np.einsum("nti,ntj->ij", onehot[:, :-1] * mask[:, 1:, None], onehot[:, 1:]) - pair.sum((0, 1))) / len(table) - shrink * steps]
        for k, (p, g) in enumerate(zip((theta, steps), grads, strict=True)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            p += 0.1 * (m[k] / (1 - 0.9**r)) / (np.sqrt(v[k] / (1 - 0.99**r)) + 1e-8)
    parts = theta[: 3 * n_attr].reshape(3, n_attr, n_label)
    return ShapeField(np.stack([attributes @ p for p in parts]).astype(np.float32), theta[-1].astype(np.float32), steps.astype(np.float32))


@lru_cache(1)
def default_field() -> ShapeField:
    return train(default_table())


_TRIM = re.compile(r"^[^0-9A-Za-z(+]+|[^0-9A-Za-z)]+$")
_SPELT_AT, _SPELT_DOT = re.compile(r"\s*[\[({]at[\])}]\s*"), re.compile(r"\s*[\[({]dot[\])}]\s*")
_MAIL = re.compile(r"[^@\s]+@[^@\s.]+(?:\.[^@\s.]+)*\.[A-Za-z]{2,}")


def _holds(kind: int, piece: str) -> bool:
    """What a span of the kind must hold."""
    if len(piece) > 512:
        return False
    number = _NOT_DIGIT.sub("", piece)
    digits = len(number)
    if kind == 0:
        return _MAIL.fullmatch(_SPELT_DOT.sub(".", _SPELT_AT.sub("@", piece))) is not None
    if kind == 1:
        return list(addresses(piece)) == [(0, len(piece))]
    if _LETTER.search(piece):
        return False
    return (kind == 2 and 13 <= digits <= 19 and luhn(number)) or (kind == 3 and 7 <= digits <= 15 and any(c in piece for c in "+-() ."))


def find(field: ShapeField, data: np.ndarray, offs: np.ndarray) -> list[tuple[str, list, list]]:
    """For each row its text, its base spans and all its spans."""
    starts, ends, words = common.word_bounds(data, offs)
    row = np.repeat(np.arange(len(offs) - 1), words)
    line = np.concatenate([[0], np.cumsum(data == 10)])[starts] if len(starts) else starts
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (line[1:] != line[:-1])
    begin = np.flatnonzero(fresh)
    last = np.append(fresh[1:], True) if len(starts) else fresh
    labels = field.line_labels(field.emissions(shapes(data, starts, ends), fresh, last), begin) if len(starts) else np.empty(0, np.int8)
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    hit = labels != OTHER
    if hit.any():
        opening = np.flatnonzero(hit & (fresh | np.append(True, labels[1:] != labels[:-1])))
        closing = np.flatnonzero(hit & (last | np.append(labels[1:] != labels[:-1], True)))
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
        lead = points[starts[opening]] - points[offs[row[opening]]]
        for i, j, p in zip(opening.tolist(), closing.tolist(), lead.tolist(), strict=True):
            runs.setdefault(int(row[i]), []).append((int(starts[i]), int(labels[i]), int(ends[j]), p))
    raw = data.tobytes()
    out = []
    for r, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
        text = raw[a:b].decode()
        base = base_spans(text)
        more, reach = [], 0
        if r in runs:
            ordered = [x for x, _, _ in base]
            furthest = list(itertools.accumulate((y for _, _, y in base), max))
        for s, kind, e, first in runs.get(r, ()):
            piece = raw[s:e].decode()
            core = _TRIM.sub("", piece)
            if core and _holds(kind, core):
                lo = first + piece.find(core)
                hi = lo + len(core)
                k = bisect.bisect_left(ordered, hi)  # base spans that start before hi
                if (not k or furthest[k - 1] <= lo) and lo >= reach:
                    more.append((lo, kind, hi))
                    reach = hi
        out.append((text, base, sorted(base + more) if more else base))
    return out


def _field_of(field: ShapeField | None) -> ShapeField:
    return field or default_field()


def find_personal_data(docs: DataFrame, field: ShapeField | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row; the counts are of base spans."""
    common.ensure_importable(docs.sparkSession)
    rows = docs.select(id_col, text)
    field = _field_of(field)

    def run(batches):
        for part, data, offs in common.slices(batches, text):
            out = []
            for _, base, every in find(field, data, offs):
                out.append((*(sum(k == j for _, k, _ in base) for j in range(4)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.string()] * 2, strict=True))], names=[id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, field: ShapeField | None = None, text: str = "text") -> DataFrame:
    """docs with every span of the text replaced by its kind in angle brackets; a null text stays null."""
    common.ensure_importable(docs.sparkSession)
    field = _field_of(field)

    def run(batches):
        for part, data, offs in common.slices(batches, text):
            column = part.column(part.schema.get_field_index(text))
            out = []
            for (whole, _, every), valid in zip(find(field, data, offs), column.is_valid().to_pylist(), strict=True):
                pieces, at = [], 0
                for a, k, b in every:
                    if a >= at:
                        pieces += [whole[at:a], f"<{KINDS[k]}>"]
                    at = max(at, b)
                out.append("".join([*pieces, whole[at:]]) if valid else None)
            yield common.passthrough(part, **{text: pa.array(out, pa.string())})

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))


def op5_pii(spark, sf_dir: str) -> DataFrame:
    return find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
