"""What the operators of this subpackage share: the shared folder, cut lineage, byte views of Arrow text."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that one numpy step works on; a longer single text is worked on alone.
SLICE_BYTES = 1 << 20
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Where that is unset, one of our own if the master is local
    (tests); on a cluster, where no folder of one machine will do, an error."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file:///tmp/checkpoints/{context.applicationId}"
    return base.rstrip("/")


_OPEN: list[list[str]] = []


def fresh_path(spark: SparkSession, name: str, keep: int = 0) -> str:
    """A path of its own in the shared folder. Inside a scratch block it goes with the block; keep: with that so many further
    out, if there is one."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if len(_OPEN) > keep:
        _OPEN[-1 - keep].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession):
    """What materialize() and fresh_path() make inside is deleted when the block ends, but for what they are told to keep."""
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield
    finally:
        _OPEN.pop()
        for path in made:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str, keep: int = 0) -> DataFrame:
    """df written once in the shared folder and read back: lineage ends here, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, name, keep)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # its shuffle files go when the write is done, not when the driver collects garbage
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a key above one in so many of all rows make it heavy: there are fewer such keys than this.
HEAVY_SHARE = 2000


def join_heavy(rows: DataFrame, side: DataFrame, keys: list[str], spread: str, how: str = "inner", count: str = "n", merge: bool = False) -> DataFrame:
    """rows joined with side, which has each key once and in `count` about how many rows have it (a written table, as it is
    read more than once). Fewer than HEAVY_SHARE keys have more than one in HEAVY_SHARE of the rows that side counts: those
    are broadcast, and their rows are spread by the column `spread` instead of meeting in one task; rows of the other keys
    meet theirs by shuffle, or as Spark chooses; by shuffle whatever the size with `merge`. rows is read once."""
    if how not in ("inner", "left"):
        raise ValueError(how)
    seen = side.agg(F.sum(count).alias("total"), F.max(count).alias("most")).first()
    least = max((seen.total or 0) // HEAVY_SHARE, 1000)
    if (seen.most or 0) <= least:
        return rows.join(side.hint("merge") if merge else side, keys, how).select(*rows.columns, *[c for c in side.columns if c not in keys])
    columns = [c for c in side.columns if c not in keys]
    heavy = F.broadcast(side.where(F.col(count) > least).select(*keys, F.struct(*columns).alias("_heavy")))
    light = side.where(F.col(count) <= least).select(F.lit(0).cast("long").alias("_none"), *[F.col(k).alias(f"_{k}") for k in keys], F.struct(*columns).alias("_light"))
    met = rows.join(heavy, keys, "left").withColumn("_spread", F.when(F.col("_heavy").isNotNull(), F.xxhash64(spread).bitwiseOR(F.lit(1))).otherwise(F.lit(0).cast("long")))
    joined = met.join(light.hint("merge") if merge else light, [F.col("_spread") == F.col("_none"), *[F.col(k) == F.col(f"_{k}") for k in keys]], "left")
    out = joined.select(*rows.columns, F.coalesce("_heavy", "_light").alias("_side"))
    if how == "inner":
        out = out.where("_side is not null")
    return out.select(*rows.columns, "_side.*")


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers import this package when the repository runs from its folder and isn't installed; and, unless the
    session has a size of its own, send them Arrow batches of few enough rows for long texts."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, "1000")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def text_key(df: DataFrame, text: str = "text", names: tuple[str, str] = ("k1", "k2")) -> DataFrame:
    """Adds two columns, 128 bits that stand for the text; null counts as empty."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return df.withColumns({names[0]: F.xxhash64(whole), names[1]: F.xxhash64(F.lit(1), whole)})


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores before them until no column has them."""
    taken, lead = {c.lower() for c in columns}, "_"
    while any((lead + n).lower() in taken for n in names):
        lead += "_"
    return [lead + n for n in names]


def named_rows(docs: DataFrame) -> tuple[DataFrame, str, DataFrame]:
    """docs with a column that names each row by 128 bits of its doc_id and text, that column's own name, and the rows as node
    (the name), h (64 bits of it), place (doc_id, null last) and text (null empty). Rows that repeat have one name."""
    (name,) = unused(docs.columns, "node")
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    half = lambda *c: F.lpad(F.hex(F.xxhash64(*c)), 16, "0")
    named = docs.withColumn(name, F.unhex(F.concat(half("doc_id", whole), half(F.lit(1), "doc_id", whole))))
    rows = named.select(F.col(name).alias("node"), F.xxhash64(name).alias("h"), F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("place"), whole.alias("text"))
    return named, name, rows


def without_rows(named: DataFrame, name: str, gone: DataFrame, again: DataFrame) -> DataFrame:
    """named without the rows of gone (node), and one row of each of again (node, rows that repeat); written tables both. The
    text is shuffled once, whatever their size: rows that go are met by name."""
    rest = named.join(gone.select(F.col("node").alias(name)).hint("merge"), name, "left_anti")
    if again.isEmpty():
        return rest
    some = again.select(F.col("node").alias(name))
    return rest.join(some, name, "left_anti").unionByName(rest.join(some, name, "left_semi").dropDuplicates([name]))


def distinct_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k1, k2, text, copies, first_id: one row per distinct text. Copies are folded before the shuffle, so that the text
    of a group of any size crosses it once per task."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return text_key(rows).groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"))


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its rows; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch in slices of about `limit` bytes of text: the slice, its bytes and its offsets."""
    for batch in batches:
        data, offs = byte_view(batch.column(batch.schema.get_field_index(text)))
        i, n = 0, batch.num_rows
        while i < n:
            j = min(n, max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1))
            yield batch.slice(i, j - i), data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            i = j


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def word_bounds(data: np.ndarray, offs: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the number of words of each row; no word spans two rows. Words are runs of bytes
    that `inside` marks, [^\\x20\\x09-\\x0D]+ by default."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs) - 1, np.int64)
    if inside is None:
        inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    before[0] = True
    np.logical_not(inside[:-1], out=before[1:])
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = True
    np.logical_not(inside[1:], out=after[:-1])
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offs))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        made = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, U64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _POWERS[:] = made
    return _POWERS


def mix64(h: np.ndarray) -> np.ndarray:
    """A full-avalanche finaliser of 64-bit values."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]: a polynomial by prefix sums, shifted to the same power and mixed."""
    if not len(starts):
        return np.empty(0, U64)
    up, down = _powers(len(data) + 1)[:2]
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts])


def ragged(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c of counts, one after another."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def row_sums(values: np.ndarray, counts: np.ndarray, dtype=None) -> np.ndarray:
    """Sums of consecutive groups of rows, groups of none included."""
    out = np.zeros((len(counts), *values.shape[1:]), dtype or values.dtype)
    full = np.flatnonzero(counts)
    if len(full):
        out[full] = np.add.reduceat(values, (np.cumsum(counts) - counts)[full], axis=0, dtype=dtype)
    return out


def passthrough(batch: pa.RecordBatch, **new: pa.Array) -> pa.RecordBatch:
    """batch with columns replaced or added."""
    names = [*batch.schema.names, *(k for k in new if k not in batch.schema.names)]
    return pa.RecordBatch.from_arrays([new[k] if k in new else batch.column(batch.schema.get_field_index(k)) for k in names], names=names)
