"""Near-duplicate texts by likeness of their word shingles, for the pipeline: SimHash at two bits takes texts that are all but
equal, while texts with 0.8 of their five-word shingles in common lie four to seventeen bits apart, too far for a trie join
on a large corpus. Here bands of one-permutation MinHash bins name the candidates and the shingle sets themselves judge them.

A key that one text alone has is dropped by a combined aggregate, and of keys that the same texts share one is kept. The texts
of a key are compared pair by pair, but for those already joined; a key of n texts returns fewer than n links. A key of more
than `MOST` texts isn't gathered: each of its texts is compared with that one of them which meets most others, in tasks of its own,
which settles the key if all are alike to it. The texts of the other such keys get the longer bands of the next level, where
keys whose texts are joined already are passed over. A pair at 0.8 is missed by chance in about 1 of 20,000 at each of the levels.

Rows are named by 128 bits of doc_id and text, so rows that repeat both stay or go together. Texts without words (null counts
as empty) link to nothing here; equal texts link like any others; an empty table gives no link.
"""

from __future__ import annotations

import itertools
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, minhash, simhash

#: Bins, bins of a band, bands: each level's bands are longer and more. 0.8 to the bins of a band, missed by all bands:
#: 4.9e-5, 1.6e-5, 4.7e-5.
LEVELS = ((512, 5, 25), (1024, 8, 60), (2048, 12, 140))
#: Texts of a key that are gathered.
MOST = 1024
#: Tasks that the texts of one large key are dealt to.
SALTS = 64
U = np.uint64


def band_keys(rows: DataFrame, bins: int, band_bins: int, bands: int, k: int = 5) -> DataFrame:
    """rows (with text) without the text, with keys: a hash of each band of the text's bins. Texts without words go."""
    common.ensure_importable(rows.sparkSession)
    kept = [c for c in rows.columns if c != "text"]

    def run(batches):
        for part, data, offs in common.slices(batches):
            sig, some = minhash.signatures(*minhash.shingle_hashes(data, offs, k), bins)
            at = np.flatnonzero(some)
            if not len(at):
                continue
            sig = common.mix64(sig[at, : bands * band_bins])
            band = np.tile(np.arange(1, bands + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(bins), (len(at), 1))
            for i in range(band_bins):
                band = common.mix64(band ^ sig[:, i::band_bins])
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, band.size + 1, bands, dtype=np.int32)), pa.array(band.view(np.int64).reshape(-1)))
            chosen = part.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*(chosen.column(chosen.schema.get_field_index(c)) for c in kept), keys], names=[*kept, "keys"])

    return rows.mapInArrow(run, rows.select(*kept).schema.add("keys", T.ArrayType(T.LongType())))


def shingle_sets(rows: DataFrame, k: int = 5) -> DataFrame:
    """h, node and shingles (ascending 64-bit hashes of the text's different shingles) of rows with h, node and text."""
    common.ensure_importable(rows.sparkSession)

    def run(batches):
        for part, data, offs in common.slices(batches):
            hashes, counts = minhash.shingle_hashes(data, offs, k)
            ends = np.cumsum(counts)
            sets = pa.array([np.unique(hashes[a:b]).tobytes() for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), sets], names=["h", "node", "shingles"])

    return rows.select("h", "node", "text").mapInArrow(run, "h long, node binary, shingles binary")


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether 0.8 of the shingles of two sets, both ascending, are common."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    same = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * same >= 4 * (len(a) + len(b) - same)


def joined_roots(sets: list[np.ndarray], root: np.ndarray) -> np.ndarray:
    """Smallest index that each text reaches over pairs of alike texts, from the roots that are known. A text's common
    shingles with all others are counted at once, from the texts of each shingle. Texts of the largest known group need no
    count of their own: each pair across groups has another side."""
    root, size = root.copy(), np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    values, owner = flat[order], np.repeat(np.arange(len(sets)), size)[order]
    members = np.bincount(root, minlength=len(sets))
    largest = int(members.argmax())
    waiting = np.flatnonzero(root != largest) if members[largest] > 1 else np.arange(len(sets) - 1)
    for i in waiting.tolist():
        if (root == root[i]).all():
            continue
        first, last = np.searchsorted(values, sets[i], "left"), np.searchsorted(values, sets[i], "right")
        same = np.bincount(owner[np.repeat(first, last - first) + common.ragged(last - first)], minlength=len(sets))
        met = np.flatnonzero((5 * same >= 4 * (size + size[i] - same)) & (root != root[i]))
        if len(met):
            joined = np.unique(np.append(root[met], root[i]))
            root[np.isin(root, joined)] = joined[0]
    return root


def _links(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    pairs = [(max(p), min(p)) for p in found if p[0] != p[1]]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in (zip(*pairs, strict=True) if pairs else ((), ()))], names=["src", "dst"])


def group_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """src, dst (src larger): links that join all nodes of a key whose texts are alike; members: key, h, comp (those of equal
    comp are joined already)."""
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.join(sets.hint("merge"), "h").select("key", "node", "comp", "shingles").repartition(n, "key").sortWithinPartitions("key", "node")

    def run(batches):
        rows = (row for batch in batches for i in range(0, batch.num_rows, 256) for row in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns), strict=True))
        found = []
        for _, group in itertools.groupby(rows, lambda r: r[0]):
            _, node, comp, shingles = zip(*group, strict=True)
            first = {}
            root = np.array([first.setdefault(c, i) for i, c in enumerate(comp)])
            found += [(node[i], node[r]) for i, r in enumerate(joined_roots([np.frombuffer(x, U) for x in shingles], root).tolist()) if i != r]
            if len(found) > 10_000:
                yield _links(found)
                found = []
        yield _links(found)

    return dealt.mapInArrow(run, "src binary, dst binary")


def lead_links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """lead, h, src, dst of the pairs (lead, h) whose texts are alike. A lead's texts are dealt to SALTS tasks, its own to
    each."""
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("h"), F.lit(SALTS)))
    leads = dealt.select("lead", "salt", F.col("lead").alias("h")).distinct()
    rows = leads.union(dealt.select("lead", "salt", "h")).join(sets, "h").select("lead", "salt", "h", "node", "shingles")
    rows = rows.repartition(n, "lead", "salt").sortWithinPartitions("lead", "salt", F.col("h") != F.col("lead"))
    types, names = (pa.int64(), pa.int64(), pa.binary(), pa.binary()), ["lead", "h", "src", "dst"]

    def run(batches):
        lead, whose, own, found = None, None, None, []
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                for to, _, h, node, shingles in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns), strict=True):
                    if h == to and lead != to:
                        lead, whose, own = to, node, np.frombuffer(shingles, U)
                    elif to == lead and alike(own, np.frombuffer(shingles, U)):
                        found.append((to, h, max(node, whose), min(node, whose)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [()] * 4, types, strict=True)], names=names)
            found = []

    return rows.mapInArrow(run, "lead long, h long, src binary, dst binary")


def near_links(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """src, dst (src larger): links that join all nodes whose texts are alike. texts: node, h (64 bits of it) and text, each node
    once; keys: h and the keys of the first level. Keys are counted and met by h, which is half as long; links are between
    nodes."""
    links, sets, comps = [], None, None
    for level in range(len(LEVELS)):
        last = level + 1 == len(LEVELS)
        keyed = keys.select("h", F.explode(F.array_distinct("keys")).alias("key"))
        keyed = keyed.withColumn("comp", F.col("h")) if comps is None else keyed.join(comps, "h", "left").withColumn("comp", F.coalesce("comp", "h"))
        ends = keyed.groupBy("key").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.shiftrightunsigned("h", 32)).alias("x"), F.sum(F.col("h").bitwiseAND(F.lit(0xFFFFFFFF))).alias("y"),
            F.min("comp").alias("low"), F.max("comp").alias("high"),
        )
        # keys of the same texts are one
        groups = ends.where("low <> high").groupBy("n", "x", "y").agg(F.min("key").alias("key"))
        groups = common.materialize(groups.select("key", "n"), "shared-bands")
        members = common.materialize(common.join_heavy(keyed, groups, ["key"], "h", merge=True), "band-members")
        if sets is None:
            sets = common.materialize(shingle_sets(texts.join(members.select("h").distinct().hint("merge"), "h", "left_semi")), "shingle-sets")
        few = members if last else members.where(F.col("n") <= MOST)
        links.append(common.materialize(group_links(few.select("key", "h", "comp"), sets), "near-links"))
        many = members.where(F.col("n") > MOST)
        if last or many.isEmpty():
            break
        # a key's first text is that which meets most others: of a text and its copies the text itself
        many = common.materialize(many.select("key", "h", "n"), "large-keys")
        met = many.groupBy("h").agg(F.sum("n").alias("met"), F.count(F.lit(1)).alias("keys"))
        ranked = common.join_heavy(many, common.materialize(met, "met-by"), ["h"], "key", count="keys")
        lead = ranked.groupBy("key").agg(F.max(F.struct("met", "h")).alias("first"), F.first("n").alias("n")).select("key", F.col("first.h").alias("lead"), "n")
        many = common.materialize(common.join_heavy(many.select("key", "h"), common.materialize(lead, "leads"), ["key"], "h"), "led-keys")
        alone = F.col("h") != F.col("lead")
        led = common.materialize(lead_links(many.where(alone).select("lead", "h").distinct(), sets), "lead-links")
        links.append(led.select("src", "dst"))
        apart = many.where(alone).join(led.select("lead", "h").distinct(), ["lead", "h"], "left_anti").select("key").distinct()
        left = many.join(common.materialize(apart, "unsettled-keys"), "key", "left_semi").select("h").distinct()
        left = common.materialize(left, "unsettled")
        if left.isEmpty():
            break
        roots = simhash.components(reduce(DataFrame.union, links)).withColumnRenamed("node", "_node")
        comps = roots.union(roots.select("root", "root").distinct()).select(F.xxhash64("_node").alias("h"), F.xxhash64("root").alias("comp")).dropDuplicates(["h"])
        keys = common.materialize(band_keys(texts.join(left, "h", "left_semi").select("h", "text"), *LEVELS[level + 1]), "longer-bands")
    return reduce(DataFrame.union, links)


def duplicates(rows: DataFrame, but: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Of rows (node, h, place, text), those of `but` (node) left out: the nodes that go, all of a group of alike texts but that of
    the least place and node; and the nodes that several rows have. Bands are made of all rows, so that none is looked up by
    its text before it is known to share a key."""
    with common.scratch(rows.sparkSession):
        keys = common.materialize(band_keys(rows, *LEVELS[0]), "bands")
        again = common.materialize(keys.groupBy("node").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("node"), "repeated", keep=1)
        if but is not None:
            keys = keys.join(but, "node", "left_anti")
        texts = rows.select("node", "h", "text")
        if not again.isEmpty():
            texts, keys = texts.dropDuplicates(["node"]), keys.dropDuplicates(["node"])
        linked = simhash.components(near_links(texts, keys.select("h", "keys")))
        members = linked.union(linked.select("root", "root").distinct())
        placed = common.materialize(members.join(keys.select("node", "place"), "node"), "near-text-members")
        first = placed.groupBy("root").agg(F.min(F.struct("place", "node")).alias("first"), F.count(F.lit(1)).alias("n"))
        first = common.materialize(first.select("root", F.col("first.node").alias("stays"), "n"), "near-text-first")
        gone = common.join_heavy(placed, first, ["root"], "node").where("node <> stays").select("node")
        gone = common.materialize(gone, "near-text-gone", keep=1)
    return gone, again


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of alike texts: that of the smallest doc_id (null last), ties by name; rows that repeat
    and are like no other stay. Columns of any names are carried through."""
    named, name, rows = common.named_rows(docs)
    gone, _ = duplicates(rows)
    return common.without_rows(named, name, gone, gone.where("false")).select(*docs.columns)
