"""Operator 4: benchmark decontamination by latent semantic retrieval. Benchmark items are cut into passages, weighted by
TF-IDF with document frequencies of the whole corpus, and projected on their leading right singular vectors, found by a
randomised SVD whose products run as Spark jobs. Every passage of every document is compared by cosine; candidates are then
judged by the longest common subsequence of words and by whether the answer, the passage's last sentence, is there. The
latent space has 64 axes for the passages of 512 items: at that rank no planted item of a share of 0.7 or more was missed in
1,000, and fewer at 0.6 than in the whole space.

Words are runs of ASCII letters and digits and of bytes from 128 on, lower-cased. A passage is `2 * STEP` words;
passages start every `STEP` words. A term weighs sqrt(tf) * idf, so that a passage's squared length is the sum over its
words of idf squared. A passage is passed over before projection if the most that each of its words can add to a cosine
with any benchmark passage doesn't sum to the least cosine: that bound is exact. Benchmark items are worked on in blocks of
`block_items`, of which ALIVE are on the workers at once: document frequencies of FEATURES hashed words and the passages of
those blocks. A larger benchmark takes several passes over the documents.

An item of fewer than LEAST_WORDS words has too few terms for a cosine; it is found where all its words follow each other.

Null and empty texts on either side match nothing; repeated rows are judged alike; with an empty benchmark or corpus there
is no hit.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import common

FEATURES = 1 << 18
STEP = 24
LEAST_WORDS = 6
ALIVE = 4
REACH_BITS = 20
U = np.uint64


def _inside() -> np.ndarray:
    t = np.zeros(256, bool)
    for lo, hi in ((48, 57), (65, 90), (97, 122), (128, 255)):
        t[lo : hi + 1] = True
    return t


_INSIDE = _inside()


def lowered(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows in lower case: Latin-1 byte by byte, rows of slices with other scripts by Python."""
    if len(data) and data.max() > 0xC3:
        raw = data.tobytes()
        rows = [raw[a:b].decode().lower().encode() for a, b in itertools.pairwise(offs.tolist())]
        return np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    low = common.lower_ascii(data)
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    after = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
    low[after] += 32
    return low, offs


def words_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, where they start in the lower-cased bytes, and the number of words of each row."""
    low, offs = lowered(data, offs)
    starts, ends, counts = common.word_bounds(low, offs, _INSIDE[low])
    return common.span_hashes(low, starts, ends), starts, counts


def features_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes & U(FEATURES - 1)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Number of documents that have each hashed word, and of documents: counted over all rows, combined before the
    shuffle. The driver holds FEATURES numbers."""
    common.ensure_importable(docs.sparkSession)

    def count(batches):
        total, n = np.zeros(FEATURES, np.int64), 0
        for _, data, offs in common.slices(batches):
            h, _, counts = words_of(data, offs)
            pair = np.unique(np.repeat(np.arange(len(counts), dtype=np.int64), counts) * FEATURES + features_of(h))
            total += np.bincount(pair & (FEATURES - 1), minlength=FEATURES)
            n += len(counts)
        f = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(f, -1).astype(np.int32)), pa.array(np.append(total[f], n))], names=["feature", "n"])

    got = docs.select("text").mapInArrow(count, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(FEATURES, np.int64)
    at = got.feature.to_numpy()
    df[at[at >= 0]] = got.n.to_numpy()[at >= 0]
    return df, int(got.n[got.feature == -1].sum())


@dataclass
class Index:
    """A block of benchmark passages in the latent space."""

    items: list  # item_id of each passage
    words: list[np.ndarray]  # word hashes of each passage
    answers: list[np.ndarray]
    idf2: np.ndarray  # squared idf by feature
    vocabulary: np.ndarray  # word hashes of the benchmark, ascending
    axes: np.ndarray  # vocabulary x rank
    latent: np.ndarray  # passages x rank, projected and divided by the passage's full length
    kept: np.ndarray  # share of each passage's length that the projection keeps
    reach: np.ndarray  # by the low bits of a word's hash, the most that one occurrence adds to a scaled product with any passage
    short: dict  # by number of words: for the hash of all words of items of so many, the items


def _hashed(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word hashes and where the words start."""
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    h, starts, _ = words_of(raw, np.array([0, len(raw)]))
    return raw, h, starts


def passages_of(text: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Word hashes and answer word hashes of the passages of an item."""
    raw, h, starts = _hashed(text)
    if len(h) < LEAST_WORDS:
        return []
    out = []
    for i in range(0, max(1, len(h) - STEP), STEP):
        j = min(len(h), i + 2 * STEP)
        begin, end = int(starts[i]), int(starts[j]) if j < len(h) else len(raw)
        stops = [begin + m.end() for m in re.finditer(rb"[.?!]\s", raw[begin:end].tobytes().rstrip())]
        cut = max(int(np.searchsorted(starts, stops[-1])) if stops else i, j - 16)
        out.append((h[i:j], h[min(cut, j - 3) : j]))
    return out


def sequence_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words that follow each other."""
    out = np.zeros(max(0, len(h) - n + 1), U)
    for i in range(n):
        out = common.mix64(out * U(31) + h[i : len(h) - n + 1 + i])
    return out


def short_items(items: list[tuple]) -> dict:
    """By number of words, below LEAST_WORDS: hash of the words -> item_ids."""
    out: dict[int, dict] = {}
    for item, text in items:
        _, h, _ = _hashed(text or "")
        if 0 < len(h) < LEAST_WORDS:
            out.setdefault(len(h), {}).setdefault(int(sequence_hashes(h, len(h))[0]), []).append(item)
    return out


def _weights(words: np.ndarray, idf2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w, tf = np.unique(words, return_counts=True)
    return w, np.sqrt(tf * idf2[features_of(w)])


def build_index(spark, items: list[tuple], df: np.ndarray, n_docs: int, rank: int, seed: int = 3, tasks: int = 4) -> Index | None:
    """The index of a block of (item_id, text): randomised SVD with two rounds of power iteration. Each product with the
    passage matrix is a Spark job over the passages; a task returns vocabulary x rank numbers."""
    idf2 = (np.log((n_docs + 1) / (df + 1)) + 0.05).astype(np.float32) ** 2
    rows = [(i, w, a) for i, text in items for w, a in passages_of(text or "")]
    short = short_items(items)
    if not rows:
        none = np.zeros((0, 0), np.float32)
        return Index([], [], [], idf2, np.zeros(0, U), none, none, np.zeros(0), np.zeros(1 << REACH_BITS, np.float32), short) if short else None
    weighted = [_weights(w, idf2) for _, w, _ in rows]
    vocabulary = np.unique(np.concatenate([f for f, _ in weighted]))
    length = np.array([np.sqrt((x**2).sum()) for _, x in weighted])
    table = spark.createDataFrame([(np.searchsorted(vocabulary, f).tolist(), (x / max(n, 1e-9)).tolist()) for (f, x), n in zip(weighted, length, strict=True)], "at array<int>, weight array<double>").repartition(tasks)
    rank = min(rank, len(rows), len(vocabulary))
    n_vocabulary = len(vocabulary)

    def gram_times(q: np.ndarray) -> np.ndarray:
        """A'A q over all passages A."""
        held = spark.sparkContext.broadcast(q)

        def run(batches):
            total = np.zeros((n_vocabulary, q.shape[1]))
            for batch in batches:
                for at, weight in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    total[at] += np.outer(weight, np.asarray(weight) @ held.value[at])
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

        return sum(np.frombuffer(r.part).reshape(n_vocabulary, -1) for r in table.mapInArrow(run, "part binary").toLocalIterator())

    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(n_vocabulary, rank)))[0]
    for _ in range(2):
        q = np.linalg.qr(gram_times(q))[0]
    values, turn = np.linalg.eigh(q.T @ gram_times(q))
    axes = q @ turn[:, np.argsort(-values)]
    latent = np.stack([(x / max(n, 1e-9)) @ axes[np.searchsorted(vocabulary, f)] for (f, x), n in zip(weighted, length, strict=True)])
    kept = np.sqrt((latent**2).sum(1))
    back = np.abs(latent @ axes.T) / np.maximum(kept**2, 1e-9)[:, None]  # passages in the vocabulary's space again
    reach = np.zeros(1 << REACH_BITS, np.float32)
    np.maximum.at(reach, (vocabulary & U((1 << REACH_BITS) - 1)).astype(np.int64), (back.max(0) * np.sqrt(idf2[features_of(vocabulary)]) * 1.001).astype(np.float32))
    return Index([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], idf2, vocabulary, axes.astype(np.float32), latent.astype(np.float32), kept, reach, short)


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a column of the table at a time as the bits of one integer."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        if m := at.get(x):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def search(index: Index, data: np.ndarray, offs: np.ndarray, least_cosine: float, least_share: float, sure_share: float) -> list[tuple[int, object, float, float, bool]]:
    """row, item_id, cosine, share of the item passage's words in common order, whether the answer is there: the best
    passage of each (row, item) that counts as a leak."""
    h, _, counts = words_of(data, offs)
    if not len(h):
        return []
    out: dict[tuple[int, object], tuple] = {}
    for n, of in index.short.items():
        seen = sequence_hashes(h, n)
        row = np.repeat(np.arange(len(counts)), counts)
        for i in np.flatnonzero(np.isin(seen, np.fromiter(of, U, len(of)))).tolist():
            if row[i] == row[i + n - 1]:
                for item in of[int(seen[i])]:
                    out[int(row[i]), item] = 1.0, 1.0, True
    if not index.items:
        return [(row, item, cos, share, answered) for (row, item), (share, cos, answered) in out.items()]
    mass = index.idf2[features_of(h)]
    reach = index.reach[(h & U((1 << REACH_BITS) - 1)).astype(np.int64)]
    halves = -(-counts // STEP)
    half_base = np.cumsum(halves) - halves
    inner = common.ragged(counts) // STEP
    half_of = np.repeat(half_base, counts) + inner
    begin = np.flatnonzero(np.concatenate([[True], half_of[1:] != half_of[:-1]]))  # first word of each half
    size = np.diff(np.append(begin, len(h)))
    half_mass = np.add.reduceat(mass, begin)
    half_reach = np.add.reduceat(reach, begin)
    row_of_half = np.repeat(np.arange(len(counts)), halves)
    second = np.zeros(len(begin), bool)  # halves whose follower belongs to the same row
    second[:-1] = row_of_half[1:] == row_of_half[:-1]
    is_passage = second.copy()
    is_passage[half_base[halves == 1]] = True
    whole = half_mass + np.where(second, np.append(half_mass[1:], 0), 0)
    most = half_reach + np.where(second, np.append(half_reach[1:], 0), 0)
    chosen = np.flatnonzero(is_passage & (most >= least_cosine * np.sqrt(whole)))
    row_end = np.cumsum(counts)
    for c in range(0, len(chosen), 1024):
        part = chosen[c : c + 1024]
        n = size[part] + np.where(second[part], np.append(size[1:], 0)[part], 0)
        token = np.repeat(begin[part], n) + common.ragged(n)
        which = np.repeat(np.arange(len(part)), n)
        word = h[token]
        place = np.minimum(np.searchsorted(index.vocabulary, word), len(index.vocabulary) - 1)
        inside = index.vocabulary[place] == word
        pair, tf = np.unique(which[inside] * len(index.vocabulary) + place[inside], return_counts=True)
        owner, at = pair // len(index.vocabulary), pair % len(index.vocabulary)
        value = np.sqrt(tf * index.idf2[features_of(index.vocabulary[at])]).astype(np.float32)
        projected = common.row_sums(value[:, None] * index.axes[at], np.bincount(owner, minlength=len(part)))
        cosine = projected @ index.latent.T / np.sqrt(np.maximum(whole[part], 1e-9))[:, None]
        for p, q in zip(*np.nonzero(cosine >= least_cosine * index.kept**2), strict=True):
            half = part[p]
            row = int(row_of_half[half])
            lo = max(int(begin[half]) - STEP, int(row_end[row] - counts[row]))
            hi = min(int(begin[half]) + 3 * STEP, int(row_end[row]))
            window = h[lo:hi].tolist()
            item = index.words[q].tolist()
            share = common_subsequence(item, window) / len(item)
            answer = index.answers[q].tolist()
            answered = common_subsequence(answer, window) >= 0.6 * len(answer)
            if share >= sure_share or (share >= least_share and answered):
                key = row, index.items[q]
                if key not in out or out[key][0] < share:
                    out[key] = share, float(cosine[p, q]), answered
    return [(row, item, cos, share, answered) for (row, item), (share, cos, answered) in out.items()]


def _blocks(benchmark: DataFrame, block_items: int):
    held = []
    for r in benchmark.select("item_id", F.col("text").cast("string").alias("text")).toLocalIterator():
        held.append((r.item_id, r.text))
        if len(held) == block_items:
            yield held
            held = []
    if held:
        yield held


class Decontaminator:
    """A benchmark against a corpus: document frequencies are counted once, blocks of items are indexed when their turn comes."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, rank: int = 64, block_items: int = 512, least_cosine: float = 0.25, least_share: float = 0.6, sure_share: float = 0.75):
        self.spark, self.benchmark = docs.sparkSession, benchmark
        common.ensure_importable(self.spark)
        self.limits = least_cosine, least_share, sure_share
        self.rank, self.block_items = rank, block_items
        self.df, self.n = document_frequencies(docs)

    def _groups(self) -> Iterator[tuple[list, bool]]:
        """Broadcast indexes of ALIVE blocks, and whether more follow."""
        held, waiting = [], None
        for block in _blocks(self.benchmark, self.block_items):
            if waiting is not None:
                yield waiting, True
                waiting = None
            index = build_index(self.spark, block, self.df, self.n, self.rank)
            if index is not None:
                held.append(self.spark.sparkContext.broadcast(index))
            if len(held) == ALIVE:
                held, waiting = [], held
        if waiting is not None:
            yield waiting, bool(held)
        if held or waiting is None:
            yield held, False

    def hits(self, docs: DataFrame) -> DataFrame:
        """doc_id, item_id, cosine, share, answered of every leak."""
        rows = docs.select("doc_id", "text")
        item_type = self.benchmark.schema["item_id"].dataType
        schema = T.StructType([rows.schema["doc_id"], T.StructField("item_id", item_type), *(T.StructField(c, T.DoubleType()) for c in ("cosine", "share")), T.StructField("answered", T.BooleanType())])
        types = [to_arrow_type(item_type), pa.float64(), pa.float64(), pa.bool_()]
        limits, found = self.limits, []
        for held, more in self._groups():

            def run(batches, held=held):
                for part, data, offs in common.slices(batches):
                    got = [x for index in held for x in search(index.value, data, offs, *limits)]
                    if got:
                        row, *columns = zip(*got, strict=True)
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=schema.names)

            found.append(rows.mapInArrow(run, schema))
            if more:
                found[-1] = common.materialize(found[-1], "hits")
                for index in held:
                    index.destroy()
        return reduce(DataFrame.union, found)

    def clean(self, docs: DataFrame) -> DataFrame:
        """docs without the rows that hold a leak: a pass for each ALIVE blocks, no shuffle."""
        limits = self.limits
        for held, more in self._groups():

            def run(batches, held=held):
                for part, data, offs in common.slices(batches):
                    bad = {row for index in held for row, *_ in search(index.value, data, offs, *limits)}
                    kept = [i for i in range(part.num_rows) if i not in bad]
                    if kept:
                        yield part.take(pa.array(kept, pa.int32())) if bad else part

            docs = docs.mapInArrow(run, T.StructType(docs.schema.fields))
            if more:
                docs = common.materialize(docs, "decontaminated")
                for index in held:
                    index.destroy()
        return docs


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return Decontaminator(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).hits(docs)
