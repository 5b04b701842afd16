"""Each registered query over whole tables against SQL or a plain version of its contract."""

import hashlib
import itertools
import os
import re
import sys
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from test_chunk_ties import plain as plain_chunks
from test_exact import scanned
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle import compare  # noqa: E402
from tidepanel.llm import queries as Q  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")


@pytest.fixture(scope="module")
def rows(spark):
    return sorted((r.doc_id, r.text or "", r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())


def run(spark, name):
    return Q.queries()[name](spark, SF).collect()


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, name):
    assert compare(spark, Q.queries()[name], Q.oracle_sql()[name], SF) > 0


def test_op1_and_op8(spark, rows):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    at, planes, coded = 0, {}, {}
    for i, text, _ in rows:
        ids = t.encode(text, add_special_tokens=False).ids
        raw = np.array([*ids, 2], "<u4").tobytes()
        planes[i] = (at, len(ids) + 1, zlib.crc32(raw))
        at += len(ids) + 1
        coded[i] = (len(ids), hashlib.sha256(raw[:-4]).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in run(spark, "op1_token_bitplanes")} == planes
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(spark, "op8_bpe")} == coded


def test_op2(spark, rows):
    first, copies = {}, {}
    for i, text, _ in rows:
        first.setdefault(text, i)
        copies[i] = first[text]
    want = plain_chunks([(i, text) for text, i in first.items()])
    for r in run(spark, "op2_chunk_dedup"):
        if copies[r.doc_id] == r.doc_id or not r.n_bytes:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[copies[r.doc_id]]
        else:
            assert r.n_removed == r.n_bytes and list(r.found_in) == [copies[r.doc_id]]


def test_op3(spark, rows):
    got = {r.doc_id: r for r in run(spark, "op3_minhash")}
    by_text = {}
    for (i, text, _), (j, following, _) in zip(rows, [*rows[1:], rows[0]], strict=True):
        half = len(text) // 2
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest()
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert r.near_next == 1 or text != following
    assert len(got) == len(rows)


def test_op4(spark, rows):
    items = {r.item_id: " ".join(re.findall(r"[^\W_]+", r.text.lower())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    texts = {i: " ".join(re.findall(r"[^\W_]+", t.lower())) for i, t, _ in rows}
    hits = run(spark, "op4_decontaminate")
    found = {(r.doc_id, r.item_id) for r in hits}
    verbatim = {(i, k) for i, t in texts.items() for k, x in items.items() if f" {x} " in f" {t} "}
    assert verbatim and verbatim <= found and all(r.share >= 0.6 for r in hits)


def test_op5(spark, rows):
    texts = {i: t for i, t, _ in rows}
    for r in run(spark, "op5_pii"):
        base = scanned(texts[r.doc_id])
        listed = ",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in base) for j in range(4)]


def test_op6(spark, rows):
    langs = {i: lang for i, _, lang in rows}
    got = run(spark, "op6_language")
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got) and len(got) == len(rows)
    held = [r.lang_pred == langs[r.doc_id] for r in got if r.held_out and langs[r.doc_id]]
    assert np.mean(held) >= 0.95


def test_op7(spark, rows):
    def fingerprint(text):
        words = re.split(r"[\x20\x09-\x0d]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text).strip(" \t\n\v\f\r"))
        words = [w for w in words if w]
        grams = [words[i : i + 3] for i in range(len(words) - 2)] if len(words) >= 3 else [words] if words else []
        h = [xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    marks = {i: fingerprint(t) for i, t, _ in rows}
    root = {i: i for i in marks}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(sorted(marks), 2):
        if (marks[i] ^ marks[j]).bit_count() <= 2:
            a, b = sorted((top(i), top(j)))
            root[b] = a
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, "op7_simhash")} == {i: (f"{m:016x}", top(i)) for i, m in marks.items()}
