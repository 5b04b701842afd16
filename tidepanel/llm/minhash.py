"""Operator 3: document fingerprints by one-permutation MinHash. Each shingle is hashed once; the leading bits of the hash
choose a bin, which keeps the least of the rest; empty bins copy a full bin found by hashing (bin, attempt), the same for
every document; the low-order bits of the bins are packed. The share of equal codes, freed of the share that is equal by
chance, estimates the Jaccard likeness.

Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z; shingles have five of them, a shorter text is one shingle. A text
without words (null counts as empty) has an empty fingerprint: likeness 1 to another such, 0 to any other. Documents follow
each other by doc_id, null first, ties by text (by a hash of it first, if one doc_id fills several ranges); the last is
followed by the first, a lone one by itself.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, ranges
from .simhash import normalised, shingle_spans

U = np.uint64


def shingle_hashes(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the k-word shingles of the rows, and their number in each row."""
    text, starts, ends, words = normalised(data, offs)
    first, last, counts = shingle_spans(starts, ends, words, k)
    return common.span_hashes(text, first, last), counts


def signatures(hashes: np.ndarray, counts: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of densified bins for each document, and which documents have any shingle. bins is a power of two."""
    shift = U(64 - bins.bit_length() + 1)
    empty_value = U((1 << 64) - 1)
    sig = np.full((len(counts), bins), empty_value, U)
    row = np.repeat(np.arange(len(counts)), counts)
    np.minimum.at(sig.reshape(-1), row * bins + (hashes >> shift).astype(np.int64), hashes & ((U(1) << shift) - U(1)))
    full = sig != empty_value
    some = full.any(1)
    lone = full.sum(1) == 1
    sig[lone] = sig[lone].min(1)[:, None]  # every attempt ends at the only full bin
    r, b = np.nonzero(~full & (some & ~lone)[:, None])
    attempt = 0
    while len(r):
        attempt += 1
        source = (common.mix64(np.arange(bins, dtype=U) * U(0x9E3779B97F4A7C15) + U(attempt)) & U(bins - 1)).astype(np.int64)[b]
        hit = full[r, source]
        sig[r[hit], b[hit]] = sig[r[hit], source[hit]]
        r, b = r[~hit], b[~hit]
    return sig, some


def codes(data: np.ndarray, offs: np.ndarray, k: int = 5, bins: int = 256, bits: int = 4) -> tuple[np.ndarray, np.ndarray]:
    sig, some = signatures(*shingle_hashes(data, offs, k), bins)
    return (sig & U((1 << bits) - 1)).astype(np.uint8), some


def pack(code: np.ndarray, bits: int) -> bytes:
    """Codes of one document, low-order bits next to each other, the first code in the highest bits."""
    return np.packbits(np.unpackbits(code[:, None], axis=1)[:, 8 - bits :].reshape(-1)).tobytes()


def unpack(packed: bytes, bits: int) -> np.ndarray:
    lines = np.unpackbits(np.frombuffer(packed, np.uint8)).reshape(-1, bits)
    return np.packbits(np.pad(lines, ((0, 0), (8 - bits, 0))), axis=1).reshape(-1)


def likeness(a: np.ndarray | None, b: np.ndarray | None, bits: int) -> float:
    """Jaccard likeness from codes; None stands for a text without words."""
    if a is None or b is None:
        return float(a is b)
    chance = 0.5**bits
    return float(min(1.0, max(0.0, (np.mean(a == b) - chance) / (1 - chance))))


def edited_text(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the next text, or all that it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_neighbours(docs: DataFrame, k: int = 5, bins: int = 256, bits: int = 4, shards: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    Rows are dealt into ranges of doc_id; the first row of each range also goes, as the follower of its last row, to the
    range before it. Text is shuffled once; the driver holds the first row's place of each range."""
    spark = docs.sparkSession
    common.ensure_importable(spark)
    shards = shards or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt_to = ranges.ranges_of(rows, shards)
    rows = ranges.placed(rows, dealt_to)

    def first_rows(batches):
        for batch in batches:
            if batch.num_rows:
                place, mark = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                order = np.lexsort([mark, place])
                at, first = np.unique(dealt_to.of(place, mark)[order], return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(place[order[first]]), pa.array(mark[order[first]])], names=["to", "place", "mark"])

    firsts = rows.select("place", "mark").mapInArrow(first_rows, "to int, place long, mark long").groupBy("to").agg(F.min(F.struct("place", "mark")).alias("first"))
    firsts = sorted((r.to, r.first.place, r.first.mark) for r in firsts.collect())  # a row per range
    before = np.array([(place, mark, firsts[i - 1][0]) for i, (_, place, mark) in enumerate(firsts)], np.int64).reshape(-1, 3)

    def deal(batches):
        """Each row to its range, and those that may open a range also to the one before it."""
        for batch in batches:
            place, mark = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            at = np.minimum(np.searchsorted(before[:, 0], place, "left"), len(before) - 1)
            while (more := (at + 1 < len(before)) & (before[at, 0] == place) & (before[at, 1] < mark)).any():
                at = at + more
            opens = np.flatnonzero((before[at, 0] == place) & (before[at, 1] == mark))
            rows = np.concatenate([np.arange(batch.num_rows), opens])
            to = np.concatenate([dealt_to.of(place, mark), before[at[opens], 2].astype(np.int32)])
            halo = np.repeat(np.array([0, 1], np.int32), [batch.num_rows, len(opens)])
            taken = batch.take(pa.array(rows)) if len(opens) else batch
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(to), pa.array(halo)], names=["doc_id", "text", "place", "mark", "to", "halo"])

    dealt = rows.mapInArrow(deal, "doc_id long, text string, place long, mark long, to int, halo int")
    dealt = dealt.repartitionById(len(dealt_to), F.col("to")).sortWithinPartitions("to", "halo", "place", "mark", "text").select("doc_id", "text", "halo")

    def code_of(texts: list[str]) -> list[np.ndarray | None]:
        array = pa.array(texts, pa.large_string())
        code, some = codes(*common.byte_view(array), k, bins, bits)
        return [c if s else None for c, s in zip(code, some.tolist(), strict=True)]

    def hexed(c) -> str:
        return "" if c is None else pack(c, bits).hex()

    def run(batches):
        held: list[tuple] = []  # doc_id, text, code of rows whose follower hasn't come
        last = False
        for part, data, offs in common.slices(itertools.chain(batches)):
            halo = part.column(2).to_pylist()
            ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            stop = next((i for i, h in enumerate(halo) if h), len(halo))
            if last:
                continue  # only the first follower counts; others are ties of it
            last = stop < len(halo)
            n = min(stop + 1, len(halo))
            held += zip(ids[:n], texts[:n], code_of(texts[:n]), strict=True)
            if len(held) > 1:
                yield solve(held)
                held = held[-1:]

    def solve(held):
        edited = [edited_text(a[1], b[1]) for a, b in itertools.pairwise(held)]
        changed = code_of(edited)
        out = [
            (a[0], len(a[1]), hashlib.sha256(e.encode()).hexdigest(), hexed(a[2]), hexed(c), likeness(a[2], c, bits), likeness(a[2], b[2], bits))
            for (a, b), e, c in zip(itertools.pairwise(held), edited, changed, strict=True)
        ]
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op3_minhash(spark, sf_dir: str) -> DataFrame:
    return fingerprint_neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet"))
