"""Operator 1: token ids as binary shards. Fixed-size blocks of ids are transposed into bit or byte planes, each plane is
compressed with zstandard, and a chunk index at the end of the shard says where each block lies.

A shard:
    magic "TPBP0001"
    the compressed planes of block 0, block 1, ...
    document table: an Arrow stream with doc_id (null allowed) and n_tokens, compressed
    footer: JSON with the id width, the block size, the plane kind, the number of ids, the place of the document table and
        the chunk index [first id, number of ids, offset, plane lengths, crc32]; compressed
    length of the footer (8 bytes), magic

The corpus is dealt into ranges of doc_id with about equal numbers of rows by bounds from a scan of doc_id alone, so that
text is tokenised once and shuffled once. A task writes its shard under a name of its own and then moves it into place: a
task that runs twice writes the same bytes. Null doc_id sorts first; a null text is empty; repeated doc_ids stay separate
documents, ordered by their ids (by a hash of the text before that, if one doc_id fills several ranges); an empty table makes
no shard.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, ranges

MAGIC = b"TPBP0001"
BLOCK_IDS = 1 << 16
#: Words whose ids a worker keeps.
CACHED_WORDS = 800_000
LONGEST_CACHED = 64
#: A control character that is a piece by itself between blanks. New words go to the library joined by it, and its id parts
#: theirs; a word that holds it goes alone.
STOP = b"\x01"
BETWEEN = b" \x01 "
#: Bytes of text whose words are numbered together.
ENCODED_BYTES = 4 << 20


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block of unsigned ids: byte planes, or bit planes of which the last byte is padded with zero bits."""
    size = ids.dtype.itemsize
    octets = ids.astype(ids.dtype.newbyteorder("<")).view(np.uint8).reshape(-1, size)
    if kind == "byte":
        return [octets[:, i].tobytes() for i in range(size)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, i], bitorder="little").tobytes() for i in range(size * 8)]


def from_planes(planes: list[bytes], n: int, dtype: np.dtype, kind: str) -> np.ndarray:
    if kind == "byte":
        octets = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        octets = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(octets).view(np.dtype(dtype).newbyteorder("<")).reshape(-1)


class ShardWriter:
    """Takes documents in order and writes blocks as they fill: memory holds a block, the document table and the index."""

    def __init__(self, out, width: int = 4, block: int = BLOCK_IDS, kind: str = "byte", level: int = 3):
        self.out, self.dtype, self.block, self.kind = out, np.dtype(f"u{width}"), block, kind
        self.pack = zstandard.ZstdCompressor(level=level)
        self.index, self.doc_ids, self.lengths = [], [], []
        self.pending, self.waiting, self.total, self.at = [], 0, 0, len(MAGIC)
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.pending.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            whole = np.concatenate(self.pending)
            full = len(whole) // self.block * self.block
            for i in range(0, full, self.block):
                self._flush(whole[i : i + self.block])
            self.pending, self.waiting = [whole[full:].copy()], len(whole) - full

    def _flush(self, ids: np.ndarray) -> None:
        ids = ids.astype(self.dtype)
        packed = [self.pack.compress(p) for p in to_planes(ids, self.kind)]
        self.index.append([self.total, len(ids), self.at, [len(p) for p in packed], zlib.crc32(ids.tobytes())])
        for p in packed:
            self.out.write(p)
            self.at += len(p)
        self.total += len(ids)

    def close(self) -> None:
        if self.waiting:
            self._flush(np.concatenate(self.pending))
        table = io.BytesIO()
        batch = pa.RecordBatch.from_arrays([pa.array(self.doc_ids, pa.int64()), pa.array(self.lengths, pa.int64())], names=["doc_id", "n_tokens"])
        with pa.ipc.new_stream(table, batch.schema) as w:
            w.write_batch(batch)
        packed = self.pack.compress(table.getvalue())
        footer = self.pack.compress(json.dumps({"width": self.dtype.itemsize, "block": self.block, "kind": self.kind, "ids": self.total, "docs": [self.at, len(packed)], "chunks": self.index}).encode())
        self.out.write(packed + footer + struct.pack("<Q", len(footer)) + MAGIC)


class ShardReader:
    """Random access to a shard through its chunk index."""

    def __init__(self, file):
        self.file, end = file, file.size()
        file.seek(end - 16)
        length, magic = struct.unpack("<Q8s", file.read(16))
        if magic != MAGIC:
            raise ValueError("not a bit-plane shard")
        file.seek(end - 16 - length)
        self.unpack = zstandard.ZstdDecompressor()
        self.meta = json.loads(self.unpack.decompress(file.read(length)))
        at, size = self.meta["docs"]
        file.seek(at)
        self.docs = pa.ipc.open_stream(self.unpack.decompress(file.read(size))).read_all()

    def chunk(self, i: int) -> np.ndarray:
        _, n, at, sizes, crc = self.meta["chunks"][i]
        self.file.seek(at)
        ids = from_planes([self.unpack.decompress(self.file.read(s)) for s in sizes], n, np.dtype(f"u{self.meta['width']}"), self.meta["kind"])
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"chunk {i} is damaged")
        return ids

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """Each document's id and token ids, one block in memory at a time besides the document itself."""
        k, left = 0, np.empty(0, f"<u{self.meta['width']}")
        for doc_id, n in zip(self.docs["doc_id"].to_pylist(), self.docs["n_tokens"].to_pylist(), strict=True):
            parts, have = [left], len(left)
            while have < n:
                parts.append(self.chunk(k))
                have += len(parts[-1])
                k += 1
            whole = np.concatenate(parts) if len(parts) > 1 else parts[0]
            yield doc_id, whole[:n]
            left = whole[n:]


_ENCODERS: dict[str, "LibraryEncoder"] = {}
#: White space, and letters or digits and marks of ASCII by byte. The splitting pattern parts a mark from a letter or digit
#: before it, whatever they are. An apostrophe isn't among the marks, as it can begin a contraction.
_BLANK, _LETTER, _MARK = (np.zeros(256, bool) for _ in range(3))
for _table, _ranges in ((_BLANK, ((9, 13), (32, 32))), (_LETTER, ((48, 57), (97, 122))), (_MARK, ((33, 38), (40, 47), (58, 64), (91, 96), (123, 126)))):
    for _low, _high in _ranges:
        _table[_low : _high + 1] = True


class LibraryEncoder:
    """Ids by the tokenizers library. The normaliser of the file maps white space to a blank that the splitter drops, so ASCII
    white space cuts a text into words that are encoded apart, and so does the place before a mark that the splitter parts
    anyway. The words of a slice of texts are numbered by Arrow, so that only its distinct words are looked up; a worker
    keeps the ids of words that it has met, and of a full store the words met since it was half full. ASCII is lower-cased
    first. Texts that could hold a special token are cut at white space alone."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        (self.stop,) = self.tokenizer.encode(BETWEEN.decode(), add_special_tokens=False).ids
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def cut(self, data: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The words of the texts and the number of words of each."""
        rows, low = np.zeros(len(offs) - 1, bool), common.lower_ascii(data)
        at = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
        if len(at):  # "<|"
            rows[np.searchsorted(offs, at, "right") - 1] = True
            special = np.repeat(rows, np.diff(offs))
            low[special] = data[special]
        inside = ~_BLANK[low]
        first = inside.copy()
        first[1:] &= ~inside[:-1] | (_MARK[low[1:]] & _LETTER[low[:-1]] & (~special[1:] if len(at) else True))
        edges = offs[:-1][np.diff(offs) > 0]
        first[edges] = inside[edges]
        starts = np.flatnonzero(first)
        held = low[inside]
        bounds = np.append((np.cumsum(inside, dtype=np.int32) - np.int32(1))[starts], np.int32(len(held)))
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(held)])
        return words, np.diff(np.searchsorted(starts, offs))

    def look_up(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words, little-endian unsigned 32-bit."""
        if len(self.known) > CACHED_WORDS // 2:
            self.known, self.older = {}, self.known
        got = list(map(self.known.get, words))
        gaps = [i for i, ids in enumerate(got) if ids is None] if None in got else []
        new = []
        for i in gaps:
            word = words[i]
            if (ids := self.older.get(word)) is None:
                new.append(i)
            else:
                got[i] = self.known[word] = ids
        alone = {i for i in new if STOP in words[i]}
        joined = [i for i in new if i not in alone] if alone else new
        runs = [joined[k : k + 1024] for k in range(0, len(joined), 1024)] + [[i] for i in sorted(alone)]
        for some, e in zip(runs, self.tokenizer.encode_batch_fast([BETWEEN.join([words[i] for i in some]).decode() for some in runs], add_special_tokens=False), strict=True):
            raw = (ids := np.array(e.ids, "<u4")).tobytes()
            stops = (np.flatnonzero(ids == self.stop) * 4).tolist() if len(some) > 1 else []
            for i, a, b in zip(some, [0, *(x + 4 for x in stops)], [*stops, len(raw)], strict=True):
                got[i] = raw[a:b]
                if len(words[i]) <= LONGEST_CACHED:
                    self.known[words[i]] = got[i]
        return got

    def encode(self, data: np.ndarray, offs: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end_id after each, and the number of ids of each text."""
        words, counts = self.cut(data, offs)
        coded = words.dictionary_encode()
        ids = [*self.look_up(coded.dictionary.to_pylist()), array("I", [end_id]).tobytes()]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        order = np.insert(coded.indices.to_numpy(), np.cumsum(counts), len(ids) - 1)  # the end is one more word of each text
        lengths = sizes[order]
        flat = np.frombuffer(b"".join(ids), "<u4")
        places = np.repeat((np.cumsum(sizes) - sizes)[order] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        return flat[places], common.row_sums(lengths, counts + 1)


def library_encoder(path: str) -> LibraryEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = LibraryEncoder(path)
    return _ENCODERS[path]


def write_token_shards(docs: DataFrame, path: str, vocab_path: str, end_id: int = 2, shards: int | None = None, kind: str = "byte", block: int = BLOCK_IDS) -> DataFrame:
    """Encodes every text, appends end_id, and writes one shard file per range of doc_id under path. Returns the manifest:
    shard, file, n_docs, n_tokens (a row per shard)."""
    spark = docs.sparkSession
    common.ensure_importable(spark)
    shards = shards or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt_to = ranges.ranges_of(docs, shards)

    def encode(batches):
        coder = library_encoder(vocab_path)
        for rows, data, offs in common.slices(batches, limit=ENCODED_BYTES):
            place, mark = (rows.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            ids, counts = coder.encode(data, offs, end_id)
            width = 2 if ids.max() < 1 << 16 else 4  # two bytes an id through the shuffle where they suffice
            bounds = np.zeros(len(counts) + 1, np.int64)
            np.cumsum(counts * width, out=bounds[1:])
            packed = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(bounds), pa.py_buffer(ids.astype(f"<u{width}"))])
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([width] * len(counts), pa.int32()), packed.cast(pa.binary()), pa.array(dealt_to.of(place, mark)), rows.column(3)], names=["doc_id", "width", "ids", "shard", "mark"])

    def write(batches):
        fs, base = pafs.FileSystem.from_uri(path)
        writer, out, shard = None, None, None
        done = []

        def finish():
            writer.close()
            out.close()
            final = f"{base}/shard-{shard:06d}.tpbp"
            fs.move(temporary, final)
            done.append((shard, final, len(writer.lengths), writer.total))

        for batch in batches:
            for doc_id, width, ids, at in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if at != shard:
                    if writer:
                        finish()
                    shard = at
                    temporary = f"{base}/.part-{shard:06d}-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(temporary)
                    writer = ShardWriter(out, kind=kind, block=block)
                writer.add(doc_id, np.frombuffer(ids, f"<u{width}"))
        if writer:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done) if done else [[]] * 4, (pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["shard", "file", "n_docs", "n_tokens"])

    pafs.FileSystem.from_uri(path)[0].create_dir(pafs.FileSystem.from_uri(path)[1], recursive=True)
    coded = ranges.placed(docs, dealt_to).mapInArrow(encode, "doc_id long, width int, ids binary, shard int, mark long")
    dealt = coded.repartitionById(len(dealt_to), F.col("shard")).sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "mark", "ids").drop("mark")
    rows = dealt.mapInArrow(write, "shard int, file string, n_docs long, n_tokens long").collect()  # a row per shard
    return spark.createDataFrame(sorted(rows), "shard int, file string, n_docs long, n_tokens long")


def read_token_shards(manifest: DataFrame, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of every document, read from the shards; start counts
    the ids of all documents before it. A row per shard is all that the driver holds."""
    spark = manifest.sparkSession
    rows, start = [], 0
    for r in sorted(manifest.collect()):
        rows.append((r.shard, r.file, start))
        start += r.n_tokens
    plan = spark.createDataFrame(rows, "shard int, file string, start long").repartitionById(max(1, len(rows)), F.col("shard"))

    def read(batches):
        fs, _ = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for file, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                with fs.open_input_file(file) as f:
                    held, size = [], 0
                    for doc_id, ids in ShardReader(f).documents():
                        held.append((doc_id, at, len(ids), ids.astype("<u4").tobytes()))
                        at += len(ids)
                        size += 4 * len(ids)
                        if size > common.SLICE_BYTES:
                            yield _rows(held)
                            held, size = [], 0
                    if held:
                        yield _rows(held)

    def _rows(held):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "start", "n_tokens", "ids"])

    return plan.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def op1_token_bitplanes(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = common.fresh_path(spark, "token-shards")
    manifest = write_token_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_shards(manifest, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
