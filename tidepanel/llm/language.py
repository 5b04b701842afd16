"""Operator 6: language identification by error-correcting output codes. Every language has a codeword; for each bit a
binary classifier on hashed byte n-grams says how far a text speaks for 1 or 0; the codeword of least weighted logistic
loss is chosen, and a text whose two best codewords are close is flagged as ambiguous.

Learning: n-gram counts by language over all learning rows (combined before the shuffle; the driver holds languages times
features numbers), from which each bit's classifier has its log-odds weights. The slope and the weight of each bit come from
the margins of at most `calibration_rows` learning rows, those of the least hashes.

A text that is null or has no letter (Unicode category L) is `und` with score 0. Rows with null lang or null doc_id teach nothing; a null doc_id
counts as held out. With no learning row, everything is `und`. Ties of loss go to the language first by name.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

FEATURES = 1 << 16
GRAMS = (2, 3)
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def _fold() -> np.ndarray:
    """Letters lower-cased, bytes of other scripts kept, everything else a blank."""
    t = np.full(256, 32, np.uint8)
    t[128:] = np.arange(128, 256)
    for upper, lower in zip(range(65, 91), range(97, 123), strict=True):
        t[upper] = t[lower] = lower
    return t


_TABLE = _fold()


def grams(data: np.ndarray, offs: np.ndarray):
    """For each n of GRAMS the features of all n-grams that lie within a row, and their number in each row."""
    folded = _TABLE[data].astype(np.uint32)
    sizes = np.diff(offs)
    for n in GRAMS:
        m = len(folded) - n + 1
        if m <= 0:
            yield np.empty(0, np.int64), np.zeros(len(sizes), np.int64)
            continue
        h = np.zeros(m, np.uint32)
        for j in range(n):
            h = h * np.uint32(257) + folded[j : m + j]
        h = ((h * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
        inside = np.ones(m, bool)
        for j in range(1, n):
            at = offs[1:-1] - j
            inside[at[(at >= 0) & (at < m)]] = False
        yield h[inside], np.maximum(sizes - n + 1, 0)


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """n rows of +1 and -1. Up to five classes: every way to part them; more: random columns, the best of 200 draws by the
    least distance of two rows."""
    if n <= 5:
        width = max(1, 2 ** (n - 1) - 1)
        return np.array([[1 if i == 0 or c >> (i - 1) & 1 else -1 for c in range(width)] for i in range(n)])
    rng = np.random.default_rng(seed)
    width = int(np.ceil(10 * np.log2(n)))
    best, most = None, -1
    for _ in range(200):
        code = rng.choice([-1, 1], (n, width))
        apart = min(int((a != b).sum()) for a, b in itertools.combinations(code, 2)) if n <= 64 else int((code[:-1] != code[1:]).sum(1).min())
        if apart > most and (np.abs(code.sum(0)) < n).all():
            best, most = code, apart
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: list[np.ndarray]  # for each n of GRAMS, FEATURES x bits
    slope: np.ndarray
    trust: np.ndarray

    def margins(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Mean log-odds of each bit."""
        total = np.zeros((len(offs) - 1, self.code.shape[1]))
        n = np.zeros(len(offs) - 1)
        for (features, counts), w in zip(grams(data, offs), self.weights, strict=True):
            total += common.row_sums(w[features], counts, np.float64)
            n += counts
        return total / np.maximum(n, 1)[:, None]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, score, lead over the second."""
        loss = (np.logaddexp(0, -self.code[None] * (self.slope * margins)[:, None]) * self.trust).sum(2)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        ranked = np.sort(p, axis=1)
        lead = ranked[:, -1] - ranked[:, -2] if p.shape[1] > 1 else ranked[:, -1]
        return loss.argmin(1), p.max(1), lead


def learning(docs: DataFrame) -> DataFrame:
    """docs with held_out: crc32 of doc_id as text leaves 1 when divided by 3, or doc_id is null."""
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(True)))


def fit(learned: DataFrame, calibration_rows: int = 4000, smoothing: float = 0.5) -> Model | None:
    """learned: text, lang. The classifiers of all bits; None without a row that has a language."""
    common.ensure_importable(learned.sparkSession)
    rows = learned.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for part, data, offs in common.slices(batches):
            lang = np.array(part.column(0).to_pylist())
            for j, (features, counts) in enumerate(grams(data, offs)):
                of = np.repeat(lang, counts) if len(set(lang)) > 1 else None
                for name in set(lang):
                    got = features if of is None else features[of == name]
                    sums.setdefault(name, np.zeros((len(GRAMS), FEATURES), np.int64))[j] += np.bincount(got, minlength=FEATURES)
        for name, found in sums.items():
            j, f = np.nonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(j), pa.string()), pa.array((j * FEATURES + f).astype(np.int32)), pa.array(found[j, f])], names=["lang", "feature", "n"])

    counted = rows.mapInArrow(count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    if not len(counted):
        return None
    languages = sorted(counted.lang.unique())
    total = np.zeros((len(languages), len(GRAMS) * FEATURES))
    total[counted.lang.map({x: i for i, x in enumerate(languages)}), counted.feature] = counted.n
    total = total.reshape(len(languages), len(GRAMS), FEATURES)
    share = (total + smoothing) / (total + smoothing).sum(2, keepdims=True)
    code = codewords(len(languages))
    one, zero = (np.einsum("lb,lgf->gfb", code == side, share) / np.maximum((code == side).sum(0), 1) for side in (1, -1))
    floor = share.min()
    weights = [np.log(np.maximum(one[g], floor) / np.maximum(zero[g], floor)).astype(np.float32) for g in range(len(GRAMS))]
    model = Model(languages, code, weights, np.ones(code.shape[1]), np.ones(code.shape[1]))
    hashed = rows.withColumn("_h", F.xxhash64("lang", "text"))
    least = hashed.select("_h").orderBy("_h").limit(calibration_rows).agg(F.max("_h").alias("h")).first().h
    _calibrate(model, hashed.where(F.col("_h") <= least).drop("_h").orderBy("lang", "text").limit(calibration_rows))
    return model


def _calibrate(model: Model, rows: DataFrame) -> None:
    held = rows.sparkSession.sparkContext.broadcast(model)

    def margins(batches):
        for part, data, offs in common.slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(held.value.margins(data, offs)), pa.list_(pa.float64()))], names=["lang", "margins"])

    got = rows.mapInArrow(margins, "lang string, margins array<double>").collect()  # at most calibration_rows
    if not got:
        return
    y = model.code[[model.languages.index(r.lang) for r in got]]
    f = np.array([r.margins for r in got])
    slope = np.ones(f.shape[1])
    for _ in range(60):  # logistic loss with a little shrinkage, Newton steps
        p = 1 / (1 + np.exp(np.clip(y * f * slope, -30, 30)))
        slope += ((p * y * f).sum(0) - 0.01 * slope) / ((p * (1 - p) * f * f).sum(0) + 0.01)
        slope = np.clip(slope, 0.1, 200)
    model.slope = slope
    wrong = (np.sign(f) != y).mean(0)
    model.trust = np.maximum(0.05, 1 - 2 * wrong)


def identify(docs: DataFrame, model: Model | None, text: str = "text", ambiguous_lead: float = 0.1) -> DataFrame:
    """docs with lang_pred, score, ambiguous."""
    spark = docs.sparkSession
    common.ensure_importable(spark)
    rows = docs.drop("lang_pred", "score", "ambiguous")
    if model is None:
        return rows.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "ambiguous": F.lit(True)})
    held = spark.sparkContext.broadcast(model)  # languages x bits and FEATURES x bits numbers: of fixed size

    def run(batches):
        m = held.value
        for part, data, offs in common.slices(batches, text):
            best, score, lead = m.decode(m.margins(data, offs))
            known = np.array([bool(t) and _LETTER.search(t) is not None for t in part.column(part.schema.get_field_index(text)).to_pylist()], bool)
            yield common.passthrough(
                part,
                lang_pred=pa.array([m.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)], pa.string()),
                score=pa.array(np.where(known, score, 0.0)),
                ambiguous=pa.array(~known | (lead < ambiguous_lead)),
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, lang_pred string, score double, ambiguous boolean")


def op6_language(spark, sf_dir: str) -> DataFrame:
    docs = learning(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
    model = fit(docs.where("not held_out"))
    return identify(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
