"""Operator 7: SimHash near-duplicates. Fingerprints of word shingles; a self-join of binary tries finds the pairs that
differ in few bits; linked fingerprints are gathered into components by repeated star contraction.

The join: fingerprints are cut into blocks of bits. Two that differ in at most d bits agree in at least (blocks - d) of
them, so each fingerprint is sent to one bucket per choice of that many blocks, and buckets are joined apart. In a bucket,
the sorted fingerprints are a binary trie: a node is a range of them and a level. Pairs of nodes go down together, level by
level; a pair adds a differing bit when it takes different branches, and is dropped once it has more than the budget.
Links within a bucket are reduced at once to links to the smallest of each connected part, so that a bucket of n
fingerprints returns fewer than n rows however dense it is, and no link between parts is lost.

Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z. Null, empty and blank texts have fingerprint zero and link like any
other. Equal texts, repeated rows and ties share a component; a component's id is its smallest doc_id; rows with null
doc_id get the component of their fingerprint (null if it has no other row). Empty tables give empty results.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 64
#: Links that fit one task, should a node have all of them: 64 MB.
FEW_LINKS = 2_000_000


def shingle_spans(starts: np.ndarray, ends: np.ndarray, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end byte of each k-word shingle and the number of them in each row; fewer words make one shingle."""
    counts = np.where(words >= k, words - k + 1, (words > 0).astype(np.int64))
    first = np.repeat(np.cumsum(words) - words, counts) + common.ragged(counts)
    last = first + np.repeat(np.minimum(words, k) - 1, counts)
    return starts[first], ends[last], counts


def normalised(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes in which one blank stands before each word, and starts, ends and counts of words in them."""
    starts, ends, words = common.word_bounds(data, offs)
    lengths = ends - starts
    begin = np.cumsum(lengths + 1) - lengths
    out = np.full(int((lengths + 1).sum()), 32, np.uint8)
    inside = np.ones(len(out), bool)
    inside[begin - 1] = False
    keep = np.zeros(len(data) + 1, np.int8)
    keep[starts] += 1
    np.subtract.at(keep, ends, 1)
    out[inside] = common.lower_ascii(data)[np.cumsum(keep[:-1]).astype(bool)]
    return out, begin, begin + lengths, words


def simhash(data: np.ndarray, offs: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Fingerprints of the rows: a bit is 1 if more than half of the shingle hashes have it."""
    text, starts, ends, words = normalised(data, offs)
    first, last, counts = shingle_spans(starts, ends, words, k)
    raw, hash_of = text.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((hash_of(raw[a:b], seed) for a, b in zip(first.tolist(), last.tolist(), strict=True)), np.uint64, len(first))
    ones = common.row_sums(np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1), counts, np.int32)
    bits = ones * 2 > counts[:, None]
    return np.packbits(bits, axis=1).view(">u8").reshape(-1).astype(np.uint64)


def fingerprints(docs: DataFrame, k: int = 3, seed: int = 42, text: str = "text", out: str = "fp") -> DataFrame:
    """docs without the text, with a signed 64-bit fingerprint."""
    common.ensure_importable(docs.sparkSession)
    rows = docs.select(*[c for c in docs.columns if c != out])
    kept = [c for c in rows.columns if c != text]

    def run(batches):
        for part, data, offs in common.slices(batches, text):
            fp = simhash(data, offs, k, seed).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), pa.array(fp)], names=[*kept, out])

    return rows.mapInArrow(run, rows.select(*kept).schema.add(out, "long"))


def trie_pairs(values: np.ndarray, bits: int, budget: int, bounds: np.ndarray | None = None, most: int = 1 << 18):
    """Pairs of indices into the values, as arrays, that differ in at most budget bits. The values between two bounds are a
    trie, sorted and distinct; all tries are joined with themselves at once. Node pairs descend together; the frontier is
    worked off in pieces of at most `most` pairs, deepest first. A value has at most 1 + bits + bits * (bits - 1) / 2 others
    within two bits, so the pairs grow no faster than the values, however dense they are."""
    n = len(values)
    zeros = np.zeros((bits, n + 1), np.int64)
    for level in range(bits):
        np.cumsum((values >> np.uint64(bits - 1 - level)) & np.uint64(1) == 0, out=zeros[level, 1:])
    bounds = np.array([0, n]) if bounds is None else bounds
    first, last = bounds[:-1][np.diff(bounds) > 1], bounds[1:][np.diff(bounds) > 1]
    stack = [(0, first, last, first, last, np.zeros(len(first), np.int64))]  # level; range of node a; of node b; bits that differ so far
    while stack:
        level, a0, a1, b0, b1, off = stack.pop()
        if level == bits:
            found = a0 != b0
            if found.any():
                yield a0[found], b0[found]
            continue
        if len(a0) > most:
            for i in range(0, len(a0), most):
                stack.append((level, *(x[i : i + most] for x in (a0, a1, b0, b1, off))))
            continue
        z = zeros[level]
        am, bm = a0 + z[a1] - z[a0], b0 + z[b1] - z[b0]
        same = a0 == b0
        parts = [(a0, am, b0, bm, off), (am, a1, bm, b1, off), (a0, am, bm, b1, off + 1)]
        apart = ~same  # of a node with itself, 0-1 and 1-0 are the same pairs
        parts.append((am[apart], a1[apart], b0[apart], bm[apart], off[apart] + 1))
        kept = []
        for p in parts:
            ok = (p[0] < p[1]) & (p[2] < p[3]) & (p[4] <= budget)
            ok &= ~((p[0] == p[2]) & (p[1] - p[0] == 1))  # a lone value with itself
            kept.append([x[ok] for x in p])
        merged = [np.concatenate(x) for x in zip(*kept, strict=True)]
        if len(merged[0]):
            stack.append((level + 1, *merged))


def local_roots(n: int, pairs) -> np.ndarray:
    """Smallest index that each of n items reaches over the pairs, which come in pieces."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            ra, rb = root[a], root[b]
            if (ra == rb).all():
                break
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (root != root[root]).any():
                root = root[root]
    return root


def _choices(blocks: int, budget: int) -> list[tuple[int, int]]:
    """Masks of the blocks that are held equal, and the number of bits left."""
    size = BITS // blocks
    out = []
    for held in itertools.combinations(range(blocks), blocks - budget):
        mask = sum(((1 << size) - 1) << (BITS - size * (b + 1)) for b in held)
        out.append((mask, BITS - size * len(held)))
    return out


def _rest(fp: np.ndarray, mask: int) -> np.ndarray:
    """The bits of fp outside the mask, pushed together."""
    out, shift = np.zeros(len(fp), np.uint64), 0
    at = 0
    while at < BITS:
        if mask >> at & 1:
            at += 1
            continue
        run = at
        while run < BITS and not mask >> run & 1:
            run += 1
        out |= ((fp >> np.uint64(at)) & np.uint64((1 << (run - at)) - 1)) << np.uint64(shift)
        shift += run - at
        at = run
    return out


def near_links(distinct: DataFrame, budget: int = 2, blocks: int = 4, fp: str = "fp") -> DataFrame:
    """src, dst: links that join all fingerprints differing in at most `budget` bits, over the buckets of each choice of
    equal blocks. src is larger than dst; a bucket of n gives fewer than n."""
    common.ensure_importable(distinct.sparkSession)
    choices = _choices(blocks, budget)

    def signed(x: int) -> int:
        return x - (1 << 64) if x >> 63 else x

    keyed = distinct.select(F.col(fp).alias("fp"), F.posexplode(F.array(*[F.col(fp).bitwiseAND(F.lit(signed(m)).cast("long")) for m, _ in choices])).alias("choice", "bucket"))
    n = distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = keyed.repartition(int(n), "choice", "bucket").sortWithinPartitions("choice", "bucket")

    def run(batches):
        held: list[tuple] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(tuple(batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("choice", "bucket", "fp")))
                if sum(len(x[0]) for x in held) < 1 << 16:
                    continue
            if not held:
                continue
            choice, bucket, value = (np.concatenate(x) for x in zip(*held, strict=True))
            edge = np.flatnonzero((choice[1:] != choice[:-1]) | (bucket[1:] != bucket[:-1])) + 1
            bounds = np.concatenate([[0], edge, [len(choice)]])
            stop = bounds[-1] if batch is None else bounds[-2]  # the last bucket may go on in the next batch
            held = [(choice[stop:], bucket[stop:], value[stop:])] if stop < len(choice) else []
            bounds = bounds[bounds <= stop]
            sizes = np.diff(bounds)
            shared = np.repeat(sizes > 1, sizes)
            sizes = sizes[sizes > 1]
            if not len(sizes):
                continue
            choice, fps = choice[:stop][shared], value[:stop][shared].view(np.uint64)
            rest = np.empty_like(fps)
            for c, (mask, _) in enumerate(choices):
                rest[choice == c] = _rest(fps[choice == c], mask)
            order = np.lexsort([rest, np.repeat(np.arange(len(sizes)), sizes)])
            rest, fps = rest[order], fps[order].view(np.int64)
            root = local_roots(len(rest), trie_pairs(rest, choices[0][1], budget, np.concatenate([[0], np.cumsum(sizes)])))
            joined = np.flatnonzero(root != np.arange(len(root)))
            if len(joined):
                a, b = fps[joined], fps[root[joined]]
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["src", "dst"])

    return dealt.mapInArrow(run, "src long, dst long")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root: the smallest node that each linked node reaches. Rounds of large-star and small-star contraction, each
    written out; the driver sees two numbers a round. Neighbourhood minima are aggregated, never gathered; the links of a
    node that has very many are spread. Nodes may be of any type that has an order."""

    def star(edges: DataFrame, large: bool, many: bool) -> DataFrame:
        both = edges.union(edges.select("dst", "src")) if large else edges
        low = common.materialize(both.groupBy("src").agg(F.min("dst").alias("low"), F.count(F.lit(1)).alias("n")), "star-low")
        meet = lambda rows: common.join_heavy(rows, low, ["src"], "dst") if many else rows.join(low, "src")
        if large:  # every larger neighbour of a node links to the node's smallest neighbour, or to the node itself
            joined = meet(both.where("dst > src")).select(F.col("dst").alias("src"), F.least("src", "low").alias("dst"))
        else:  # every smaller neighbour and the node itself link to the smallest neighbour
            joined = meet(edges).where("dst > low").select(F.col("dst").alias("src"), F.col("low").alias("dst")).union(low.select("src", F.col("low").alias("dst")))
        return common.materialize(joined.where("src <> dst").distinct(), "star")

    with common.scratch(links.sparkSession):
        edges, seen = common.materialize(links.distinct(), "links"), None
        for _ in range(most_rounds):
            now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")).first()
            if now == seen or not now.n:
                return common.materialize(edges.select(F.col("src").alias("node"), F.col("dst").alias("root")), "components", keep=True)
            seen, many = now, now.n > FEW_LINKS
            edges = star(star(edges, True, many), False, many)
    raise RuntimeError("components did not settle")


def near_classes(rows: DataFrame, k: int = 3, seed: int = 42, budget: int = 2) -> tuple[DataFrame, DataFrame]:
    """rows (with text) without their text but with fp, and fp, root: a name for the component of each fingerprint."""
    with common.scratch(rows.sparkSession):
        marked = common.materialize(fingerprints(rows, k, seed), "fingerprints", keep=True)
        distinct = common.materialize(marked.select("fp").distinct(), "distinct-fingerprints")
        roots = components(near_links(distinct, budget))
        named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))
        return marked, common.materialize(named, "roots", keep=True)


def near_components(docs: DataFrame, k: int = 3, seed: int = 42, budget: int = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, component_id of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))
    marked, named = near_classes(rows, k, seed, budget)
    with common.scratch(docs.sparkSession):
        least = common.materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "least")
        with_root = common.materialize(least.join(named, "fp"), "least-by-root")
        ids = common.materialize(with_root.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("f")), "component-ids")
        classes = common.join_heavy(with_root.select("fp", "root", "n"), ids, ["root"], "fp", count="f").select("fp", "component_id", "n")
        classes = common.materialize(classes, "classes", keep=True)
    return common.join_heavy(marked, classes, ["fp"], "doc_id").select("doc_id", "fp", "component_id")


def duplicates(rows: DataFrame, k: int = 3, seed: int = 42, budget: int = 2) -> tuple[DataFrame, DataFrame]:
    """Of rows (node, place, text): the nodes that go, all of a component but that of the least place and node; and the nodes
    that several rows have."""
    with common.scratch(rows.sparkSession):
        marked, classes = near_classes(rows.select("node", "place", "text"), k, seed, budget)
        each = common.materialize(marked.groupBy("fp", "node", "place").agg(F.count(F.lit(1)).alias("rows")), "rows-of-fingerprint")
        size = each.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("place", "node")).alias("first"))
        rooted = common.materialize(size.join(classes, "fp"), "first-of-fingerprint")
        first = common.materialize(rooted.groupBy("root").agg(F.min("first").alias("stays"), F.count(F.lit(1)).alias("f")), "first-of-root")
        stays = common.join_heavy(rooted.select("fp", "root", "n"), first, ["root"], "fp", count="f").select("fp", "n", F.col("stays.node").alias("stays"))
        every = common.join_heavy(each, common.materialize(stays, "stays"), ["fp"], "node")
        gone = common.materialize(every.where("node <> stays").select("node"), "gone", keep=1)
        again = common.materialize(each.where("rows > 1").select("node"), "repeated", keep=1)
    return gone, again


def keep_one(docs: DataFrame, k: int = 3, seed: int = 42, budget: int = 2) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id (null last), the smallest name among ties, one of rows
    that repeat. Columns of any names are carried through."""
    named, name, rows = common.named_rows(docs)
    return common.without_rows(named, name, *duplicates(rows, k, seed, budget)).select(*docs.columns)


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
