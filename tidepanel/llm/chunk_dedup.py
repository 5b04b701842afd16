"""Operator 2: substring deduplication by content-defined chunks. A gear hash rolls over the bytes; a chunk ends where masked
bits of it are zero, or where it is least if no such end comes in time, so that an insertion moves the ends near it and no
others. Chunks are compared by a 128-bit digest.

A chunk occurrence repeats if the digest occurs in a document of smaller doc_id, or earlier in the same document; texts of one
doc_id, or of none, follow each other by their 128-bit keys. A run of
neighbouring repeated chunks is extended byte by byte as far as the bytes beside its first and last chunk of each keeper equal
those of the keeper, `REACH` bytes at most. What then is at least `least_run` bytes long is removed; shorter repeats are
chance and stay. The first occurrence, that of the smallest doc_id, is kept, so that a passage survives once: every removed
byte has an equal one earlier in the order of doc_id and place.

Ends lie only between code points, so that what is kept is whole UTF-8. Null counts as empty; empty texts have no chunk;
a row whose text equals that of a row of smaller doc_id is removed whole, as are rows that repeat a (doc_id, text), all but
one; null doc_id sorts last, and rows with null doc_id and the same text are kept once in the same way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, spans

U = np.uint64
LAST_ID = (1 << 63) - 1
#: Bytes that a gear hash depends on: no end lies nearer to the start of a row, where the hash holds bytes of another row.
WINDOW = 32
#: Bytes beside a chunk that are compared with the keeper's: twice as many as the longest chunk may have.
REACH = 256


def gear_table(seed: int = 7) -> np.ndarray:
    """A 32-bit value for each byte."""
    return (common.mix64(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed)) >> U(32)).astype(np.uint32)


def gear_hashes(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """At each byte the 32-bit gear hash, h = 2h + table[byte], of the last 32 bytes: five doublings instead of a loop."""
    h = table[data]
    for j in range(5):
        w = 1 << j
        h[w:] = h[w:] + (h[:-w] << np.uint32(w))
    return h


def chunk_ends(data: np.ndarray, offs: np.ndarray, bits: int, least: int, most: int, table: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each row. A chunk has at least `least` bytes, but for the last of a row, and about `most` at most;
    one that would have more ends where the hash is least, which depends on the bytes and hardly on where the chunk starts."""
    hashes = gear_hashes(data, table)
    inner = np.ones(len(data), bool)  # bytes after which a code point goes on
    inner[:-1] = (data[1:] & 0xC0) == 0x80
    hits = np.flatnonzero((hashes >> np.uint32(32 - bits)) == 0) + 1
    hits = hits[hits < len(data)]
    hits = hits[(data[hits] & 0xC0) != 0x80].tolist()
    out, k, n_hits = [], 0, len(hits)
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        ends, at = [], a
        while k < n_hits and hits[k] <= a:
            k += 1
        while at < b:
            while k < n_hits and (hits[k] < at + least or hits[k] < a + WINDOW):
                k += 1
            cut = min(hits[k] if k < n_hits else b, b)
            if cut > at + most:
                lo = max(at + least, a + WINDOW) - 1
                held = np.where(inner[lo : at + most], 1 << 32, hashes[lo : at + most].astype(np.int64))
                cut = lo + int(held.argmin()) + 1 if len(held) and held.min() < 1 << 32 else at + most
                while cut < b and data[cut] & 0xC0 == 0x80:
                    cut += 1
            at = min(cut, b)
            ends.append(at)
        out.append(ends)
    return out


def _chunk_rows(texts: DataFrame, carried: list[str], bits: int, least: int, most: int) -> DataFrame:
    """The carried columns and h1, h2 (digest), at, size of each chunk."""
    rows = texts.select(*carried, "text")
    schema = rows.select(*carried).schema.add("h1", "long").add("h2", "long").add("at", "integer").add("size", "integer")

    def run(batches):
        table = gear_table()
        for part, data, offs in common.slices(batches):
            raw = data.tobytes()
            row, start, end = [], [], []
            for i, (a, ends) in enumerate(zip(offs[:-1].tolist(), chunk_ends(data, offs, bits, least, most, table), strict=True)):
                row += [i] * len(ends)
                start += [a, *ends[:-1]] if ends else []
                end += ends
            if not row:
                continue
            digest = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(start, end, strict=True)]), "<i8").reshape(-1, 2)
            row, start, end = np.array(row), np.array(start), np.array(end)
            taken = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(j).take(taken) for j in range(len(carried))), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), pa.array((start - offs[row]).astype(np.int32)), pa.array((end - start).astype(np.int32))],
                names=schema.names,
            )

    return rows.mapInArrow(run, schema)


#: What the size of a found chunk is marked with: that its text holds the first occurrence; that several texts have the
#: keeper's doc_id.
OWN, TIED = 1 << 24, 1 << 25


def _sized(chunks: list[dict] | None) -> list[dict]:
    """Found chunks in order of place, marks parted from sizes."""
    out = [{**c, "size": c["size"] & (OWN - 1), "own": bool(c["size"] & OWN), "keeper": (c["h1"], c["h2"]) if c["size"] & TIED else c["keeper"], "from": c["keeper"]} for c in chunks or ()]
    return sorted(out, key=lambda c: c["at"])


def _runs(chunks: list[dict]) -> list[list[dict]]:
    """Runs of neighbouring repeated chunks of a text, first occurrences left out."""
    runs, seen = [], set()
    for c in chunks:
        digest = c["h1"], c["h2"]
        if c["own"] and digest not in seen:
            seen.add(digest)
        elif runs and runs[-1][-1]["at"] + runs[-1][-1]["size"] == c["at"]:
            runs[-1].append(c)
        else:
            runs.append([c])
    return runs


def _edges(found: DataFrame) -> DataFrame:
    """h1, h2, left, k1, k2, at of the chunks beside which a run may go on: its first and last of each keeper, those near
    enough to its end. at is where the bytes to be compared end (left) or start."""

    def run(batches):
        for batch in batches:
            out = []
            for k1, k2, chunks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for r in _runs(_sized(chunks)):
                    lo, hi = r[0]["at"], r[-1]["at"] + r[-1]["size"]
                    first, last = {c["keeper"]: c for c in reversed(r)}, {c["keeper"]: c for c in r}
                    out += [(c["h1"], c["h2"], True, k1, k2, c["at"]) for c in first.values() if c["at"] - lo < REACH]
                    out += [(c["h1"], c["h2"], False, k1, k2, c["at"] + c["size"]) for c in last.values() if hi - c["at"] - c["size"] < REACH]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["h1", "h2", "left", "k1", "k2", "at"])

    return found.select("k1", "k2", "found").mapInArrow(run, "h1 long, h2 long, left boolean, k1 long, k2 long, at int")


def _besides(texts: DataFrame, found: DataFrame, edges: DataFrame) -> DataFrame:
    """h1, h2, left, n (edges that want it), bytes: what stands beside the kept occurrence of each chunk of edges."""
    wanted = edges.groupBy("h1", "h2", "left").agg(F.count(F.lit(1)).alias("n"))
    own = found.select("k1", "k2", F.explode("found").alias("c")).where(F.col("c.size").bitwiseAND(F.lit(OWN)) != 0)
    first = own.groupBy("k1", "k2", "c.h1", "c.h2").agg(F.min(F.struct("c.at", F.col("c.size").bitwiseAND(F.lit(OWN - 1)).alias("size"))).alias("c"))
    held = first.join(wanted, ["h1", "h2"]).groupBy("k1", "k2").agg(F.collect_list(F.struct("h1", "h2", "left", "n", "c.at", "c.size")).alias("wanted"))
    rows = texts.select("k1", "k2", "text").join(held, ["k1", "k2"]).select("text", "wanted")

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part, out = batch.slice(i, 256), []
                for text, chunks in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    raw = text.encode()
                    for c in chunks:
                        a, b = (max(0, c["at"] - REACH), c["at"]) if c["left"] else (c["at"] + c["size"], c["at"] + c["size"] + REACH)
                        out.append((c["h1"], c["h2"], c["left"], c["n"], raw[a:b]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()), strict=True)], names=["h1", "h2", "left", "n", "bytes"])

    return rows.mapInArrow(run, "h1 long, h2 long, left boolean, n long, bytes binary")


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax())


def extended(raw: bytes, lo: int, hi: int, beside: list[dict]) -> tuple[int, int]:
    """lo and hi moved apart as far as the bytes beside the run's chunks equal those of their keepers, in whole code points."""
    a, b = lo, hi
    for e in beside:
        if e["left"]:
            a = min(a, e["at"] - _common(raw[max(0, e["at"] - REACH) : e["at"]][::-1], e["bytes"][::-1]))
        else:
            b = max(b, e["at"] + _common(raw[e["at"] : e["at"] + REACH], e["bytes"]))
    while raw[a] & 0xC0 == 0x80:
        a += 1
    while b < len(raw) and raw[b] & 0xC0 == 0x80:
        b -= 1
    return a, b


def removed_chunks(docs: DataFrame, bits: int = 5, least: int = 16, most: int = 128, least_run: int = 120, with_text: bool = False) -> DataFrame:
    """k1, k2, first_id, copies of each distinct text with n_bytes, n_chunks, n_removed, n_spans, kept_sha256, found_in (the
    doc_ids, ascending, that hold the first occurrence of what was removed), and with with_text the kept text."""
    common.ensure_importable(docs.sparkSession)
    rows = docs.select(F.coalesce("doc_id", F.lit(LAST_ID)).cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = common.materialize(common.distinct_texts(rows).select("k1", "k2", "first_id", "text", "copies"), "texts")
    counted = _chunk_rows(texts, ["first_id"], bits, least, most).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("first_id").alias("keeper"))
    several = common.materialize(counted.where("n > 1"), "repeated-chunks")
    chunks = _chunk_rows(texts, ["k1", "k2", "first_id"], bits, least, most)
    own = F.col("keeper") == F.col("first_id")
    marks = F.when(own, OWN).otherwise(0)
    tied = common.materialize(texts.groupBy("first_id").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1"), "tied-ids")
    if not tied.isEmpty():  # of several texts with the keeper's doc_id the one of the least key keeps the chunk
        among = _chunk_rows(common.join_heavy(texts.select("k1", "k2", "first_id", "text"), tied, ["first_id"], "k1", count="texts"), ["k1", "k2", "first_id"], bits, least, most)
        among = common.join_heavy(among, several, ["h1", "h2"], "k1").where(own).groupBy("h1", "h2").agg(F.min(F.struct("k1", "k2")).alias("first"))
        several = common.materialize(several.join(among, ["h1", "h2"], "left"), "repeated-chunks-of-texts")
        is_first = F.col("first").isNull() | (F.col("first") == F.struct("k1", "k2"))
        marks = F.when(own & is_first, OWN).otherwise(0) + F.when(F.col("first").isNotNull(), TIED).otherwise(0)
    found = common.materialize(
        common.join_heavy(chunks, several, ["h1", "h2"], "k1")
        .groupBy("k1", "k2")
        .agg(F.collect_list(F.struct("at", (F.col("size") + marks).alias("size"), "h1", "h2", "keeper")).alias("found")),
        "found-chunks",
    )
    edges = common.materialize(_edges(found), "run-edges")
    besides = common.materialize(_besides(texts, found, edges), "beside-chunks")
    beside = common.join_heavy(edges, besides, ["h1", "h2", "left"], "k1").groupBy("k1", "k2").agg(F.collect_list(F.struct("left", "at", "bytes")).alias("beside"))
    joined = texts.join(found.select("k1", "k2", "found"), ["k1", "k2"], "left").join(beside, ["k1", "k2"], "left").select("k1", "k2", "first_id", "text", "found", "beside", "copies")

    def cut(batches):
        table = gear_table()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part, out = batch.slice(i, 256), []
                for text, chunks, beside in zip(*(part.column(j).to_pylist() for j in (3, 4, 5)), strict=True):
                    raw = text.encode()
                    runs = _runs(_sized(chunks))
                    spread = []
                    for r in runs:
                        lo, hi = r[0]["at"], r[-1]["at"] + r[-1]["size"]
                        spread.append(extended(raw, lo, hi, [e for e in beside or () if lo <= e["at"] <= hi and (e["at"] < hi if e["left"] else e["at"] > lo)]))
                    s, e = spans.merge_spans(np.array([a for a, _ in spread], np.int64), np.array([b for _, b in spread], np.int64))
                    long = e - s >= least_run
                    s, e = s[long], e[long]
                    whose = set()
                    for r, (a, _) in zip(runs, spread, strict=True):
                        j = int(np.searchsorted(s, a, "right")) - 1
                        if j >= 0 and a < e[j]:
                            whose.update(c["from"] for c in r)
                    n_chunks = len(chunk_ends(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), bits, least, most, table)[0])
                    n_bytes, n_removed, n_spans, sha = spans.digest_row(raw, s, e)
                    out.append((n_bytes, n_chunks, n_removed, n_spans, sha, sorted(whose - {LAST_ID}), spans.without(raw, s, e).decode() if with_text else None))
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), part.column(6), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True))], names=["k1", "k2", "first_id", "copies", "n_bytes", "n_chunks", "n_removed", "n_spans", "kept_sha256", "found_in", "kept"])

    made = joined.mapInArrow(cut, "k1 long, k2 long, first_id long, copies long, n_bytes long, n_chunks long, n_removed long, n_spans long, kept_sha256 string, found_in array<long>, kept string")
    return made if with_text else made.drop("kept")


EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def chunk_dedup(docs: DataFrame, bits: int = 5, least: int = 16, most: int = 128, least_run: int = 120) -> DataFrame:
    """doc_id, n_bytes, n_chunks, n_removed, n_spans, kept_sha256, found_in of every row."""
    rows = common.text_key(docs.select("doc_id", "text"))
    held = F.coalesce("doc_id", F.lit(LAST_ID))
    with common.scratch(docs.sparkSession):
        results = common.materialize(removed_chunks(docs, bits, least, most, least_run), "kept-chunks", keep=True)
    # a row of the text's first doc_id stands for the text, one row if that doc_id repeats
    same = rows.groupBy("k1", "k2", "doc_id").agg(F.count(F.lit(1)).alias("rows"))
    joined = common.join_heavy(same, results, ["k1", "k2"], "doc_id", count="copies")
    first = F.col("first_id") == held
    copy = (F.col("n_bytes") > 0) & ~first
    whole = [
        "doc_id",
        "n_bytes",
        "n_chunks",
        F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(copy, F.lit(EMPTY_SHA256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(copy, F.array("first_id")).otherwise(F.col("found_in")).alias("found_in"),
    ]
    once = joined.select(*whole)
    again = joined.where("rows > 1").withColumn("nth", F.explode(F.sequence(F.lit(2), F.col("rows").cast("int"))))
    removed = F.col("n_bytes") > 0
    again = again.select(
        "doc_id",
        "n_bytes",
        "n_chunks",
        F.col("n_bytes").alias("n_removed"),
        F.when(removed, 1).otherwise(0).cast("long").alias("n_spans"),
        F.lit(EMPTY_SHA256).alias("kept_sha256"),
        F.when(removed & (F.col("first_id") != LAST_ID), F.array("first_id")).otherwise(F.array().cast("array<long>")).alias("found_in"),
    )
    return once.union(again)


def op2_chunk_dedup(spark, sf_dir: str) -> DataFrame:
    return chunk_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
