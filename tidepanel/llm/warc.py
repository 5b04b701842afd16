"""Operator 10: WARC archives. Pages are written as records with chunked transfer framing; long records are cut into
segments, the first a `response`, the others `continuation` records. Reading back groups segments by origin identifier,
orders them by segment number, verifies the total length, and decodes the chunked framing.

Segments are short (1 KiB by default), so that most pages are cut and reassembled.

Of records with equal payloads of at least `min_bytes`, that with the largest page_id is the response and the others are
`revisit` records that refer to it; rows that tie for the largest are all responses. A null page_id is never the largest:
payloads that only such rows have are responses. A null html is an empty payload, a null url becomes urn:page:<id>. Each
record is a gzip member of its own. An archive is written under a name of its own by each task attempt and only the
archives that the manifest names are read. An empty table makes no archive.

A response is named by page_id and digest; one whose (page_id, payload) repeats, and every revisit, has a name of its own, so
that a group of segments is one record however often a row repeats. What a revisit stands for is found by its digest.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CRLF = b"\r\n"
CHUNK_BYTES = 4096
SEGMENT_BYTES = 1 << 10
ARCHIVE_BYTES = 1 << 26
#: Compressed bytes that a member is fed at a time: what it leaves over is copied.
FED_BYTES = 1 << 12
_SPACE = uuid.UUID("6f9d1c52-7a77-4f0e-9d35-4f7a6d0f5a10")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing."""
    parts = []
    for i in range(0, len(payload), size):
        piece = payload[i : i + size]
        parts += [f"{len(piece):x}".encode(), CRLF, piece, CRLF]
    return b"".join([*parts, b"0", CRLF, CRLF])


def unchunked(framed: bytes) -> bytes:
    """Payload of a chunked body; extensions after a size and trailer fields are passed over."""
    out, at = [], 0
    while True:
        end = framed.index(CRLF, at)
        size = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if len(framed) < at + size + 2 or framed[at + size : at + size + 2] != CRLF:
            raise ValueError("broken chunk")
        out.append(framed[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """The body of an HTTP response, its transfer framing decoded."""
    head, _, body = block.partition(CRLF + CRLF)
    fields = dict(x.lower().split(b":", 1) for x in head.split(CRLF)[1:] if b":" in x)
    return unchunked(body) if b"chunked" in fields.get(b"transfer-encoding", b"") else body


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}')}>"


def _clean(value: str) -> str:
    return " ".join(value.split())


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {_clean(str(v))}\r\n" for k, v in fields if v is not None) + f"Content-Length: {len(block)}\r\n\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + block + CRLF + CRLF) + pack.flush()


def page_records(page_id: int | None, url: str | None, payload: bytes, keeper: int | None, segment: int, own: str | None = None) -> Iterator[bytes]:
    """The records of a page. keeper: the page_id that holds the payload if this one only refers to it. own: the record's
    name, made of page_id and digest if none is given."""
    digest = base32_sha1(payload)
    own = own or record_id(page_id, digest)
    shared = [
        ("WARC-Target-URI", url or f"urn:page:{page_id}"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Page-Id", page_id),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html;charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if keeper is not None:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), ("WARC-Profile", profile), ("WARC-Refers-To", record_id(keeper, digest)), *shared], head)
        return
    block = head + chunked(payload)
    pieces = [block[i : i + segment] for i in range(0, len(block), segment)]
    several = len(pieces) > 1
    yield record([("WARC-Type", "response"), ("WARC-Record-ID", own), ("WARC-Segment-Number", 1 if several else None), *shared], pieces[0])
    for n, piece in enumerate(pieces[1:], 2):
        total = len(block) if n == len(pieces) else None
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, f'{own}/{n}')}>"), ("WARC-Segment-Number", n), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Total-Length", total), shared[0], shared[1]], piece)


def read_records(file) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (names in lower case) and block of each record of an archive, one member in memory at a time."""
    held, at = memoryview(b""), 0
    while True:
        unpack, member = zlib.decompressobj(31), []
        while not unpack.eof:
            if at == len(held):
                held, at = memoryview(file.read(1 << 20)), 0
                if not len(held):
                    if member or unpack.unconsumed_tail:
                        raise ValueError("the archive ends within a record")
                    return
            fed = held[at : at + FED_BYTES]
            member.append(unpack.decompress(fed))
            at += len(fed) - len(unpack.unused_data)
        whole = b"".join(member)
        head, _, rest = whole.partition(CRLF + CRLF)
        fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in head.decode().split("\r\n")[1:])}
        yield fields, rest[: int(fields["content-length"])]


def keepers_of(rows: DataFrame, min_bytes: int) -> DataFrame:
    """sha, keeper (largest page_id), again (whether rows of the keeper repeat), n of the payloads that several rows have:
    counted by payload and page first, so that a payload of many rows is combined before each shuffle."""
    each = rows.where(F.octet_length("html") >= min_bytes).groupBy("sha", "page_id").agg(F.count(F.lit(1)).alias("n"))
    found = each.groupBy("sha").agg(F.max(F.struct("page_id", "n")).alias("last"), F.sum("n").alias("n")).where("n > 1")
    return common.materialize(found.select("sha", F.col("last.page_id").alias("keeper"), (F.col("last.n") > 1).alias("again"), "n"), "keepers")


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, segment: int = SEGMENT_BYTES) -> DataFrame:
    """Writes every page under path; returns the manifest: file, n_records."""
    spark = pages.sparkSession
    common.ensure_importable(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    joined = common.join_heavy(rows, keepers_of(rows, min_bytes), ["sha"], "page_id", "left")
    other = ~F.col("keeper").eqNullSafe(F.col("page_id"))
    marked = joined.select("page_id", "url", "html", F.when(other, F.col("keeper")).alias("keeper"), F.coalesce(F.col("again") | F.when(other, F.col("keeper")).isNotNull(), F.lit(False)).alias("own_name"))

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(path)
        out, file, n, size, done = None, None, 0, 0, []
        for page_id, url, html, keeper, own_name in itertools.chain.from_iterable(zip(*(b.column(i).to_pylist() for i in range(5)), strict=True) for b in batches):
            if out is None or size > ARCHIVE_BYTES:
                if out is not None:
                    out.close()
                    done.append((file, n))
                file, n, size = f"{base}/pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                out = fs.open_output_stream(file, compression=None)
                info = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                out.write(info)
            own = f"<urn:uuid:{uuid.uuid5(_SPACE, f'{file}/{n}')}>" if own_name else None
            for r in page_records(page_id, url, html.encode(), keeper, segment, own):
                out.write(r)
                size += len(r)
                n += 1
        if out is not None:
            out.close()
            done.append((file, n))
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], names=["file", "n_records"])

    fs, base = pafs.FileSystem.from_uri(path)
    fs.create_dir(base, recursive=True)
    return common.materialize(marked.mapInArrow(run, "file string, n_records long"), "archive-manifest")


def read_archives(manifest: DataFrame, path: str) -> DataFrame:
    """record_id, record_type, page_id, refers_to_id, payload_digest, payload of every response and revisit record; a
    revisit has no payload. Segments meet by origin identifier; an unsegmented record crosses the shuffle alone too, as a
    group of one. A group is one record's segments. Archives are read again if a task is lost."""
    common.ensure_importable(manifest.sparkSession)
    files = manifest.select("file").repartition(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "file")
    names = ["origin", "record_type", "page_id", "refers_to_id", "payload_digest", "segment", "total", "block"]
    types = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary())

    def read(batches):
        fs, _ = pafs.FileSystem.from_uri(path)
        for file in itertools.chain.from_iterable(b.column(0).to_pylist() for b in batches):
            with fs.open_input_stream(file, compression=None) as f:
                held, size = [], 0
                for x, block in read_records(f):
                    if x["warc-type"] not in ("response", "revisit", "continuation"):
                        continue
                    digest = x.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    number = int(x.get("warc-segment-number", 0))
                    total = int(x["warc-segment-total-length"]) if "warc-segment-total-length" in x else None
                    held.append((x.get("warc-segment-origin-id", x["warc-record-id"]), x["warc-type"], int(x["x-page-id"]) if "x-page-id" in x else None, x.get("warc-refers-to"), digest, number, total, None if x["warc-type"] == "revisit" else block))
                    size += len(block)
                    if size > common.SLICE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    parts = files.mapInArrow(read, "origin string, record_type string, page_id long, refers_to_id string, payload_digest string, segment int, total long, block binary")
    grouped = parts.groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("segment", "record_type", "page_id", "refers_to_id", "payload_digest", "total", "block"))).alias("parts"))
    out_names = ["record_id", "record_type", "page_id", "refers_to_id", "payload_digest", "payload"]
    out_types = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary())

    def join(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                piece, out = batch.slice(i, 64), []
                for origin, found in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    for first in (p for p in found if p["record_type"] != "continuation"):
                        payload = None
                        if first["record_type"] == "response":
                            payload = http_payload(assemble([first] if not first["segment"] else [first, *_once(p for p in found if p["record_type"] == "continuation")]))
                            if first["payload_digest"] and base32_sha1(payload) != first["payload_digest"]:
                                raise ValueError(f"{origin}: the payload differs from its digest")
                        out.append((origin, first["record_type"], first["page_id"], first["refers_to_id"], first["payload_digest"], payload))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 6, out_types, strict=True)], names=out_names)

    return grouped.mapInArrow(join, "record_id string, record_type string, page_id long, refers_to_id string, payload_digest string, payload binary")


def _once(parts) -> list[dict]:
    """One record for each segment number."""
    return list({p["segment"]: p for p in parts}.values())


def assemble(parts: list[dict]) -> bytes:
    """The whole block of a record from its segments: numbers must run from 1 without a gap, the last names the length."""
    if len(parts) == 1 and not parts[0]["segment"]:
        return parts[0]["block"]
    parts = sorted(parts, key=lambda p: p["segment"])
    if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)):
        raise ValueError("a segment is missing")
    whole = b"".join(p["block"] for p in parts)
    if parts[-1]["total"] != len(whole):
        raise ValueError("the segments don't have the length that the last one names")
    return whole


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of records without their payloads (payload_bytes is
    null for a revisit): a revisit takes page_id and payload_bytes of the response that has its digest."""
    revisits = records.where("record_type = 'revisit'")
    meant = common.materialize(revisits.groupBy("payload_digest").agg(F.count(F.lit(1)).alias("n")), "revisited")
    responses = records.where("record_type = 'response'")
    target = common.join_heavy(responses, meant, ["payload_digest"], "page_id").groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.max("payload_bytes").alias("full_bytes"), F.max("n").alias("n"))
    found = common.join_heavy(revisits, common.materialize(target, "revisit-targets"), ["payload_digest"], "page_id", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(*columns).union(found.withColumn("payload_bytes", F.col("full_bytes")).select(*columns))


def op10_warc(spark, sf_dir: str) -> DataFrame:
    with common.scratch(spark):
        path = common.fresh_path(spark, "archives")
        records = read_archives(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path), path)
        small = records.select("page_id", "record_type", "payload_digest", F.octet_length("payload").cast("long").alias("payload_bytes"))
        small = common.materialize(small, "records", keep=True)
    return resolved(small)
