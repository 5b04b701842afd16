"""Operator 8: BPE encoding and decoding. A piece of text is a doubly linked list of symbols; a priority queue holds the
merge ranks of neighbouring pairs; an entry whose symbols have changed since it was pushed is stale and skipped. Decoding
joins vocabulary strings.

The vocabulary file names the normaliser (canonical composition, white space to a blank, lower case character by character),
the splitting pattern and the byte alphabet; they are followed here without the library. Special tokens in a text are
recognised before normalisation. A null text is empty and has no ids; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

#: Words and pieces whose ids a worker keeps; beyond it the store starts anew.
CACHED_WORDS = 200_000
LONGEST_CACHED = 64


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: Latin-1 printables stand for themselves, others for U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = itertools.count(0x100)
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def lower_each(text: str) -> str:
    """Lower case of each character by itself: a final sigma is not special."""
    text = text.lower() if "Σ" not in text else "σ".join(part.lower() for part in text.split("Σ"))
    return text if text.isascii() else text.translate(_LOWER_NEW)


#: Letters and numbers that Unicode has from version 17 on, which the vocabulary's library, at version 16,
#: takes for neither while the regex module takes them for letters or numbers.
SINCE_17 = (
    r"\u0558\u058B\u058C\u088F\u0C5C\u0CDC\u208F\u209D-\u209F\uA7CE\uA7CF\uA7D2\uA7D4\uA7DD\uA7E2\uA7F1\uAB6C\uAB6D\U000107BB-\U000107BF"
    r"\U00010940-\U00010959\U00010EC5-\U00010EC7\U00010ED9-\U00010EEE\U00011B0A\U00011DB0-\U00011DDB\U00011DE0-\U00011DE9\U00011DF1"
    r"\U0001246F\U00012475-\U0001247F\U00012550-\U00012686\U00016EA0-\U00016EB8\U00016EBB-\U00016ED3\U00016FF2-\U00016FF6"
    r"\U000187F8-\U000187FF\U00018CD6-\U00018CDA\U00018D09-\U00018D20\U00018D80-\U00018DF2\U00018E00-\U00019191\U000191A0-\U000191D2"
    r"\U0001B123-\U0001B128\U0001B168\U0001D6A6\U0001DF1F-\U0001DF24\U0001DF2B-\U0001DF81\U0001DF90-\U0001DF96\U0001DFCD-\U0001DFFF"
    r"\U0001E6C0-\U0001E6DE\U0001E6E0-\U0001E6E2\U0001E6E4\U0001E6E5\U0001E6E7-\U0001E6ED\U0001E6F0-\U0001E6F4\U0001E6FE\U0001E6FF"
    r"\U0002B73A-\U0002B73F\U0002B81E\U0002CEA2-\U0002CEAD"
)
#: Capitals of Unicode 16 and 17 that Python's older tables don't lower, as first capital, last capital, first small letter.
LOWER_NEW = ((0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0x16EA0, 0x16EB8, 0x16EBB))
_LOWER_NEW = {c: small + c - first for first, last, small in LOWER_NEW for c in range(first, last + 1)}


class BytePairCoder:
    """Encodes and decodes with the vocabulary and merges of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = {i: s for s, i in (self.vocab | self.special).items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.vocab[left], self.vocab[right]] = (rank, self.vocab[left + right])
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        for name in ("L", "N"):
            pattern = pattern.replace(f"\\p{{{name}}}", f"[\\p{{{name}}}--[{SINCE_17}]]")
        self.piece = regex.compile(pattern, regex.V1)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        alphabet = byte_alphabet()
        self.first = [self.vocab[c] for c in alphabet]
        self.last = [self.vocab[c + self.suffix] for c in alphabet]
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one piece."""
        symbols = [self.first[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        n = len(symbols)
        if n == 1:
            return symbols
        merges = self.merges
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            if found := merges.get((symbols[i], symbols[i + 1])):
                queue.append((found[0], i, found[1], symbols[i], symbols[i + 1]))
        heapq.heapify(queue)
        while queue:
            _, i, merged, left, right = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # stale: one of the two was merged meanwhile
            symbols[i], symbols[j] = merged, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := merges.get((merged, symbols[k])):
                    heapq.heappush(queue, (found[0], i, found[1], merged, symbols[k]))
            h = before[i]
            if h >= 0 and (found := merges.get((symbols[h], merged))):
                heapq.heappush(queue, (found[0], h, found[1], symbols[h], merged))
        return [s for s in symbols if s >= 0]

    def _piece(self, text: str) -> bytes:
        if (ids := self.pieces.get(text)) is None:
            ids = np.array(self.merge(text.encode()), "<u4").tobytes()
            if len(text) <= LONGEST_CACHED:
                if len(self.pieces) > CACHED_WORDS:
                    self.pieces.clear()
                self.pieces[text] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        text = lower_each(unicodedata.normalize("NFC", text))
        return b"".join([self._piece(m) for m in self.piece.findall(text)])

    def word(self, raw: bytes) -> bytes:
        """Ids, as little-endian unsigned 32-bit, of text without ASCII white space."""
        text = raw.decode()
        if self.at_special is None or b"<" not in raw:
            return self._plain(text)
        out = []
        for part in self.at_special.split(text):
            out.append(np.array([self.special[part]], "<u4").tobytes() if part in self.special else self._plain(part))
        return b"".join(out)

    def encode(self, raw: bytes) -> bytes:
        """Ids of a whole UTF-8 text. ASCII white space parts words that never merge, so each is encoded by itself."""
        words = (raw if b"<" in raw else raw.lower()).split()
        known = self.words
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            pass
        if len(known) > CACHED_WORDS:
            known.clear()
        out = []
        for w in words:
            if (ids := known.get(w)) is None:
                ids = self.word(w)
                if len(w) <= LONGEST_CACHED:
                    known[w] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The vocabulary strings of the ids, a blank between them: the file names no decoder."""
        return " ".join(map(self.strings.__getitem__, memoryview(ids).cast("I").tolist()))


@lru_cache(2)
def coder(path: str) -> BytePairCoder:
    return BytePairCoder(path)


def _texts(data: np.ndarray, offs: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[a:b] for a, b in itertools.pairwise(offs.tolist())]


def encode_texts(docs: DataFrame, vocab_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a binary column of ids, little-endian unsigned 32-bit."""
    common.ensure_importable(docs.sparkSession)
    kept = [c for c in docs.columns if c != ids]

    def run(batches):
        c = coder(vocab_path)
        for rows, data, offs in common.slices(batches, text):
            yield common.passthrough(rows, **{ids: pa.array([c.encode(t) for t in _texts(data, offs)], pa.binary())})

    rows = docs.select(*kept)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(ids, T.BinaryType())]))


def decode_ids(rows: DataFrame, vocab_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """rows with a text column decoded from the ids; null ids decode to an empty text."""
    common.ensure_importable(rows.sparkSession)
    rows = rows.select(*[c for c in rows.columns if c != text])

    def run(batches):
        c = coder(vocab_path)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield common.passthrough(part, **{text: pa.array([c.decode(x or b"") for x in part.column(part.schema.get_field_index(ids)).to_pylist()], pa.string())})

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(text, T.StringType())]))


def round_trip_digests(docs: DataFrame, vocab_path: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """docs with n_tokens, ids_sha256, decoded_sha256, and ids if asked for, instead of the text: encode, decode and digest
    in one pass, so that decoded texts don't leave the worker."""
    common.ensure_importable(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name not in (text, "n_tokens", "ids_sha256", "decoded_sha256", "ids")]
    rows = docs.select(*(f.name for f in kept), text)
    new = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), *[T.StructField("ids", T.BinaryType())] * with_ids]

    def run(batches):
        c = coder(vocab_path)
        for part, data, offs in common.slices(batches, text):
            coded = [c.encode(t) for t in _texts(data, offs)]
            columns = [
                pa.array([len(x) // 4 for x in coded], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in coded], pa.string()),
                pa.array([hashlib.sha256(c.decode(x).encode()).hexdigest() for x in coded], pa.string()),
                *[pa.array(coded, pa.binary())] * with_ids,
            ]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), *columns], names=[*(f.name for f in kept), *(f.name for f in new)])

    return rows.mapInArrow(run, T.StructType([*kept, *new]))


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip_digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
