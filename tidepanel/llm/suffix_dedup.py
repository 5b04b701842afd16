"""Operator 9: exact substring deduplication by suffix sorting. Every byte covered by a `length`-byte string that also starts
anywhere else is removed.

How the corpus is cut into pieces that can be sorted apart, without losing a match:
  * Each string of `length` bytes is owned by the smallest-hashed of its `gram`-byte substrings (the leftmost of equals).
    Equal strings have equal owners at equal places, so only strings whose owners have equal content can be equal.
  * An owner with all the starts it owns is an anchor. Anchors whose gram occurs once in the corpus are dropped: a count
    by key, combined before the shuffle.
  * What is left is sent as contexts (the bytes that the owned strings span) to the key's partition. Equal contexts are
    folded into one first: if there were several, all of their strings repeat.
  * A partition's contexts are suffix-sorted in batches that end where a key ends, by two-stage sorting: only suffixes
    smaller than their successors are sorted directly, the others are induced by scanning the buckets of first bytes.
    Neighbours in that order whose common prefix reaches `length` are repeats.
  * A key with more than `most` different contexts isn't gathered. Equal strings have their owner at the same offset, so its
    strings are parted by classes of offsets: the strings of a class have a longer piece around the owner in common, which
    becomes the key of a shorter context, folded and sorted like the others. Classes are 17 offsets wide, then one: there
    the piece is the whole string, and a key has one context.

Copies of a text are folded into one before texts are shuffled; a text with copies is removed whole if it has `length`
bytes. Null counts as empty; shorter texts lose nothing; repeated rows are copies of each other; doc_id may be null or
repeated, as texts are held by their content.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, spans

#: Windows whose starts lie in such a range of a text are worked on together.
PIECE = 1 << 21
#: Bytes of contexts that are suffix-sorted together; a key's contexts stay together.
BATCH_BYTES = 1 << 18
#: Offsets of a class, for keys of many contexts and for those that still have many.
CLASSES = (17, 1)
U = np.uint64
_RANGES = "array<struct<from:int,to:int>>"


def anchors(data: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """row, key, owner position, first and last start of each anchor; positions are relative to the row."""
    out = []
    reach = length - gram  # an owner lies up to this many bytes after the start
    for p in range(0, len(data), PIECE):
        q = min(p + PIECE, len(data) - length + 1)
        if q <= p:
            break
        piece = data[p : q + length - 1]
        n_grams = len(piece) - gram + 1
        up, down = common._powers(len(piece) + 1)[:2]
        sums = np.zeros(len(piece) + 1, U)
        np.cumsum((piece.astype(U) + U(1)) * up[: len(piece)], out=sums[1:])
        hashed = (sums[gram:] - sums[:-gram]) * down[:n_grams]
        ranked = ((hashed * U(0xD6E8FEB86659FD93)) & U(0xFFFFFFFFFF000000)) | np.arange(n_grams, dtype=U)
        width, least = 1, ranked
        while width * 2 <= reach + 1:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        extra = reach + 1 - width
        least = np.minimum(least[: len(least) - extra], least[extra:]) if extra else least
        owner = (least & U(0xFFFFFF)).astype(np.int64)
        whole = np.ones(q - p, bool)
        for end in offs[np.searchsorted(offs, p, "right") : np.searchsorted(offs, q + length, "left")].tolist():
            whole[max(0, end - length + 1 - p) : max(0, end - p)] = False  # these would cross the end of a row
        start = np.flatnonzero(whole)
        if not len(start):
            continue
        own = owner[start]
        first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (start[1:] != start[:-1] + 1)]))
        last = np.concatenate([first[1:] - 1, [len(start) - 1]])
        at = own[first]
        r = np.searchsorted(offs, start[first] + p, "right") - 1
        base = offs[r]
        out.append((r, common.mix64(hashed[at]), at + p - base, start[first] + p - base, start[last] + p - base))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, U), *[np.empty(0, np.int64)] * 3)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes of text, ordered at least by their first `depth` bytes: two-stage sorting."""
    n = len(text)
    t = np.concatenate([text.astype(np.int16), np.array([-1], np.int16)])
    step = np.diff(t)
    turns = np.flatnonzero(step)
    small = step[turns[np.searchsorted(turns, np.arange(n))]] > 0  # smaller than its successor
    raw = text.tobytes()
    direct = np.array(sorted(np.flatnonzero(small).tolist(), key=lambda i: raw[i : i + depth]), np.int64)
    size = np.bincount(text, minlength=256)
    size_direct = np.bincount(text[direct], minlength=256) if len(direct) else np.zeros(256, np.int64)
    begin = np.cumsum(size) - size
    order = np.full(n, -1, np.int64)
    tail = begin + size - size_direct
    order[np.repeat(tail, size_direct) + common.ragged(size_direct)] = direct
    head = begin.copy()

    def induce(found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[~small[before]]
        if len(before):
            first = text[before]
            by = np.argsort(first, kind="stable")
            count = np.bincount(first, minlength=256)
            order[np.repeat(head, count) + common.ragged(count)] = before[by]
            head[:] += count

    if n:
        order[head[text[-1]]] = n - 1  # the last suffix is larger than the empty one after it
        head[text[-1]] += 1
    for c in np.flatnonzero(size):
        at = begin[c]
        while at < head[c]:  # suffixes of a run of one byte follow each other within the bucket
            stop = head[c]
            induce(order[at:stop])
            at = stop
        induce(order[tail[c] : begin[c] + size[c]])
    return order


def adjacent_repeats(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Of the starts in order, those with a neighbour that has `length` bytes in common, as a mask over text."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.ndarray((len(text),), "<u8", padded, strides=(1,))
    left, right = order[:-1], order[1:]
    for k in [*range(0, length - 7, 8), length - 8]:
        same = words[left + k] == words[right + k]
        left, right = left[same], right[same]
    found = np.zeros(len(text), bool)
    found[left] = found[right] = True
    return found


def repeated_starts(contexts: list[bytes], length: int) -> Iterator[np.ndarray]:
    """For each context, the starts whose `length` bytes also start at another place of these contexts."""
    text = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts])
    ends = np.cumsum(sizes)
    able = np.zeros(len(text), bool)
    for e, s in zip(ends.tolist(), sizes.tolist(), strict=True):
        able[e - s : e - length + 1] = True
    order = suffix_order(text, length)
    found = adjacent_repeats(text, order[able[order]], length)
    for e, s in zip(ends.tolist(), sizes.tolist(), strict=True):
        yield np.flatnonzero(found[e - s : e - length + 1])


def _ranges(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte ranges that strings of `length` from these ascending starts cover."""
    if not len(starts):
        return []
    s, e = spans.merge_spans(starts, starts + length)
    return list(zip(s.tolist(), e.tolist(), strict=True))


def _rows(columns, types, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _anchor_rows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """k1, k2, key, at (first start), own (owner position less it), more (last start less it) of the texts."""

    def run(batches):
        for part, data, offs in common.slices(batches):
            row, key, own, first, last = anchors(data, offs, length, gram)
            if len(row):
                k1, k2 = (part.column(i).to_numpy(zero_copy_only=False)[row] for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(key.view(np.int64)), pa.array(first * 65536 + (own - first) * 256 + (last - first) if length - gram < 256 else first)], names=["k1", "k2", "key", "place"])

    return texts.select("k1", "k2", "text").where(F.octet_length("text") >= length).mapInArrow(run, "k1 long, k2 long, key long, place long")


def _folded(contexts: DataFrame) -> DataFrame:
    """key, name, n, own, context: equal contexts of a key are one; n is how many there were. A name is 64 bits of what the
    context holds, beside the 64 of the key."""
    return common.materialize(contexts.groupBy("key", "name").agg(F.sum("n").alias("n"), F.first("own").alias("own"), F.first("context").alias("context")), "contexts")


def _batched(columns: tuple, names: list[str], rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for j in range(0, len(rows), 4096):
        yield _rows(zip(*rows[j : j + 4096], strict=True), columns, names)


def _sorted_ranges(folded: DataFrame, length: int) -> DataFrame:
    """key, name, n, ranges of the contexts that hold repeats: the contexts of each key are suffix-sorted together."""

    def sort_keys(batches):
        """Rows come ordered by key."""
        key, held, size = None, [], 0
        for batch in batches:
            for row in zip(*(batch.column(j).to_pylist() for j in range(4)), strict=True):
                if row[0] != key:
                    if size > BATCH_BYTES:
                        yield solve(held)
                        held, size = [], 0
                    key = row[0]
                held.append(row)
                size += len(row[3])
        if held:
            yield solve(held)

    def solve(rows):
        alone = {k for k, g in itertools.groupby(rows, lambda r: r[0]) if len(list(g)) == 1}
        sorted_rows = [r for r in rows if r[0] not in alone]
        found = dict(zip([(r[0], r[1]) for r in sorted_rows], repeated_starts([r[3] for r in sorted_rows], length), strict=True)) if sorted_rows else {}
        out = []
        for key, name, n, context in rows:
            ranges = [(0, len(context))] if n > 1 else _ranges(found[key, name], length) if (key, name) in found else []
            if ranges:
                out.append((key, name, n, [{"from": a, "to": b} for a, b in ranges]))
        return _rows(zip(*out, strict=True) if out else ([], [], [], []), (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))), ["key", "name", "n", "ranges"])

    n_parts = int(folded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = folded.select("key", "name", "n", "context").repartition(n_parts, "key").sortWithinPartitions("key", "name")
    return dealt.mapInArrow(sort_keys, f"key long, name long, n long, ranges {_RANGES}")


def _classes(hot: DataFrame, length: int, width: int, with_bytes: bool) -> DataFrame:
    """The parts of contexts by class of offsets: key, name, n, own, context of the parts, or where they lie in the whole:
    whole_key, whole_name, at, key, name."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                out = []
                for key, name, n, own, context in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns), strict=True):
                    last = len(context) - length
                    for c in range((own - last) // width, own // width + 1):
                        low, high = own - c * width - width + 1, own - c * width  # starts of the class, the piece lies in all of their strings
                        first, end = max(0, low), min(last, high) + length
                        if end - first < length:
                            continue
                        piece, part = context[max(0, high) : low + length], context[first:end]
                        part_key, part_name = hash_context(piece, (key ^ c) & (1 << 64) - 1), hash_context(part, own - first)
                        out.append((part_key, part_name, n, own - first, part) if with_bytes else (key, name, first, part_key, part_name))
                if with_bytes:
                    yield from _batched((pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), ["key", "name", "n", "own", "context"], out)
                else:
                    yield from _batched((pa.int64(),) * 5, ["whole_key", "whole_name", "at", "key", "name"], out)

    return hot.select("key", "name", "n", "own", "context").mapInArrow(run, "key long, name long, n long, own int, context binary" if with_bytes else "whole_key long, whole_name long, at long, key long, name long")


def _covered(folded: DataFrame, length: int, most: int, widths: tuple[int, ...]) -> DataFrame:
    """key, name, n, ranges of the contexts that hold repeats."""
    sizes = common.materialize(folded.groupBy("key").agg(F.count(F.lit(1)).alias("contexts")).where(F.col("contexts") > most), "many-contexts") if widths else None
    if sizes is None or sizes.isEmpty():
        return common.materialize(_sorted_ranges(folded, length), "covered")
    marked = common.join_heavy(folded, sizes, ["key"], "name", "left", "contexts")
    usual, hot = marked.where("contexts is null"), common.materialize(marked.where("contexts is not null").drop("contexts"), "hot-contexts")
    usual = common.materialize(_sorted_ranges(usual, length), "covered")
    parts = _covered(_folded(_classes(hot, length, widths[0], True)), length, most, widths[1:])
    met = common.join_heavy(_classes(hot, length, widths[0], False), parts, ["key", "name"], "whole_name")
    shifted = F.transform("ranges", lambda r: F.struct((r["from"] + F.col("at")).cast("int").alias("from"), (r["to"] + F.col("at")).cast("int").alias("to")))
    whole = met.select(F.col("whole_key").alias("key"), F.col("whole_name").alias("name"), shifted.alias("ranges")).groupBy("key", "name").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    return common.materialize(usual.union(whole.join(hot.select("key", "name", "n"), ["key", "name"]).select("key", "name", "n", "ranges")), "covered-with-hot")


def repeated_ranges(docs: DataFrame, length: int = 200, gram: int = 64, most: int = 256) -> tuple[DataFrame, DataFrame]:
    """The distinct texts (k1, k2, text, copies, first_id) and the byte ranges of each that repeat elsewhere
    (k1, k2, ranges: array of struct from, to)."""
    common.ensure_importable(docs.sparkSession)
    if not 8 <= gram <= length <= gram + 255:
        raise ValueError("gram must lie between 8 and length, and length - gram below 256")
    rows = common.text_key(docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    one = F.xxhash64("k1", "k2", "place")
    keys = _anchor_rows(rows, length, gram).groupBy("key").agg(F.min(one).alias("a"), F.max(one).alias("b"), F.count(F.lit(1)).alias("n"))
    repeated = common.materialize(keys.where("a <> b").select("key", "n"), "repeated-keys")
    texts = common.distinct_texts(docs)
    places = common.join_heavy(_anchor_rows(texts, length, gram), repeated, ["key"], "k1").groupBy("k1", "k2").agg(F.collect_list(F.struct("key", "place")).alias("places"))
    places = common.materialize(places, "places")
    with_text = texts.select("k1", "k2", "text").join(places, ["k1", "k2"])

    def contexts(batches, with_bytes):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                out = []
                for k1, k2, text, found in zip(*(c.to_pylist() for c in batch.slice(i, 64).columns), strict=True):
                    raw = text.encode()
                    for p in found:
                        place = p["place"]
                        at, own, more = place >> 16, place >> 8 & 255, place & 255
                        context = raw[at : at + more + length]
                        name = hash_context(context, own)
                        out.append((p["key"], name, 1, own, context) if with_bytes else (k1, k2, at, p["key"], name))
                if with_bytes:
                    yield from _batched((pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), ["key", "name", "n", "own", "context"], out)
                else:
                    yield from _batched((pa.int64(),) * 5, ["k1", "k2", "at", "key", "name"], out)

    folded = _folded(with_text.mapInArrow(lambda b: contexts(b, True), "key long, name long, n long, own int, context binary"))
    covered = _covered(folded, length, most, CLASSES)
    uses = with_text.mapInArrow(lambda b: contexts(b, False), "k1 long, k2 long, at long, key long, name long")
    ranges = (
        common.join_heavy(uses, covered, ["key", "name"], "k1")
        .select("k1", "k2", F.transform("ranges", lambda r: F.struct((r["from"] + F.col("at")).cast("long").alias("from"), (r["to"] + F.col("at")).cast("long").alias("to"))).alias("ranges"))
        .groupBy("k1", "k2")
        .agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    )
    return texts, ranges


def hash_context(context: bytes, own: int) -> int:
    import xxhash

    h = xxhash.xxh3_64_intdigest(context, own)
    return h - (1 << 64) if h >> 63 else h


def removed_texts(docs: DataFrame, length: int = 200, gram: int = 64, most: int = 256, with_text: bool = False) -> DataFrame:
    """k1, k2, copies of each distinct text with n_bytes, n_removed, n_spans, kept_sha256, and with with_text the kept bytes."""
    texts, ranges = repeated_ranges(docs, length, gram, most)
    joined = texts.select("k1", "k2", "text", "copies").join(ranges, ["k1", "k2"], "left")

    def cut(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                out = []
                for text, copies, found in zip(*(part.column(j).to_pylist() for j in range(2, 5)), strict=True):
                    raw = text.encode()
                    if copies > 1 and len(raw) >= length:
                        s, e = np.array([0]), np.array([len(raw)])
                    else:
                        s, e = spans.merge_spans(np.array([r["from"] for r in found or ()], np.int64), np.array([r["to"] for r in found or ()], np.int64))
                    out.append((*spans.digest_row(raw, s, e), spans.without(raw, s, e) if with_text else b""))
                columns = list(zip(*out, strict=True))[: 5 if with_text else 4]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=False))], names=names)

    names = ["k1", "k2", "copies", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text]
    return joined.mapInArrow(cut, "k1 long, k2 long, copies long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


def suffix_dedup(docs: DataFrame, length: int = 200, gram: int = 64, most: int = 256) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    with common.scratch(docs.sparkSession):
        results = common.materialize(removed_texts(docs, length, gram, most), "removed", keep=True)
    rows = common.text_key(docs.select("doc_id", "text")).select("doc_id", "k1", "k2")
    return common.join_heavy(rows, results, ["k1", "k2"], "doc_id", count="copies").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
