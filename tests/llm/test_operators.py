"""Each operator against a brute-force version, with null, empty, long, repeated and tied rows, and empty tables."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from tokenizers import Tokenizer

from tidepanel.llm import bitplane, bpe, chunk_dedup, common, decontaminate, language, minhash, pii, simhash, suffix_dedup, warc

VOCAB = P.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, k1 string"


def rows():
    random.seed(5)
    words = ["".join(random.choice("aeiounrst") for _ in range(random.randint(2, 7))) for _ in range(300)]
    make = lambda n: " ".join(random.choice(words) for _ in range(n))
    passage = make(70)
    texts = [make(random.randint(20, 120)) for _ in range(24)]
    texts += [make(15) + " " + passage + " " + make(20) for _ in range(5)]
    texts += [texts[0], texts[0], None, "", " \t\n", "é" * 260, "ab" * 400, "Don't <|endoftext|> ΣΑΣ 12.5% İ", "x", make(4000)]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, "clash") for i, t in rows()], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids_of(t):
    return Tokenizer.from_file(VOCAB).encode(t or "", add_special_tokens=False).ids


def test_bit_planes(spark, docs, empty):
    for kind in ("byte", "bit"):
        path = common.fresh_path(spark, "t")
        manifest = bitplane.write_token_shards(docs, path, VOCAB, shards=3, kind=kind, block=256)
        got = {r.doc_id: r for r in bitplane.read_token_shards(manifest, path).collect()}
        start = 0
        for i, t in rows():
            ids = [*ids_of(t), 2]
            assert (got[i].start, got[i].n_tokens, bytes(got[i].ids)) == (start, len(ids), np.array(ids, "<u4").tobytes())
            start += len(ids)
    path = common.fresh_path(spark, "t")
    assert bitplane.read_token_shards(bitplane.write_token_shards(empty, path, VOCAB), path).count() == 0
    ids = np.random.default_rng(0).integers(0, 1 << 32, 1001).astype("<u4")
    assert all((bitplane.from_planes(bitplane.to_planes(ids, k), 1001, np.dtype("u4"), k) == ids).all() for k in ("bit", "byte"))


def test_bpe(docs, empty):
    t = Tokenizer.from_file(VOCAB)
    got = {r.doc_id: r for r in bpe.round_trip_digests(docs, VOCAB, with_ids=True).collect()}
    for i, text in rows():
        ids = ids_of(text)
        assert bytes(got[i].ids) == np.array(ids, "<u4").tobytes()
        assert got[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    both = bpe.decode_ids(bpe.encode_texts(docs, VOCAB), VOCAB)
    assert {r.decoded for r in both.collect()} == {t.decode(ids_of(x), skip_special_tokens=False) for _, x in rows()}
    assert bpe.round_trip_digests(empty, VOCAB).count() == 0


def brute_removed(texts, n):
    seen = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("most", [1 << 14, 2])
def test_suffix_dedup(docs, empty, most):
    want = brute_removed([(t or "").encode() for _, t in rows()], 200)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.suffix_dedup(docs, most=most).collect()}
    assert [got[i] for i, _ in rows()] == want and sum(w[1] for w in want) > 2000
    assert most == 2 or suffix_dedup.suffix_dedup(empty).count() == 0


def test_suffix_order():
    rng = np.random.default_rng(1)
    for alphabet in (1, 2, 4, 256):
        for n in (1, 2, 7, 200):
            t = rng.integers(0, alphabet, n).astype(np.uint8)
            r = t.tobytes()
            assert suffix_dedup.suffix_order(t, n).tolist() == sorted(range(n), key=lambda i: r[i:])


def test_chunk_dedup(docs, empty):
    got = {r.doc_id: r for r in chunk_dedup.chunk_dedup(docs).collect()}
    assert len(got) == len(rows()) and got[29].n_removed == got[29].n_bytes and got[29].found_in == [0]
    assert got[0].n_removed == 0 and all(got[i].n_removed >= 200 for i in range(25, 29)) and got[24].n_removed == 0
    assert all(got[i].n_removed == 0 for i in range(24))
    assert chunk_dedup.chunk_dedup(empty).count() == 0
    table = chunk_dedup.gear_table()
    data, h = np.frombuffer(b"the gear hash of these bytes, taken one by one" * 3, np.uint8), 0
    for b, fast in zip(data, chunk_dedup.gear_hashes(data, table), strict=True):
        h = (2 * h + int(table[b])) & 0xFFFFFFFF
        assert h == fast


def test_chunks_resist_shifts():
    random.seed(2)
    text = "".join(random.choice("abcdefgh ") for _ in range(3000)).encode()
    cut = lambda t: {t[a:b] for e in chunk_dedup.chunk_ends(np.frombuffer(t, np.uint8), np.array([0, len(t)]), 5, 16, 256, chunk_dedup.gear_table()) for a, b in zip([0, *e], e)}  # noqa: E731, B905
    assert len(cut(text) & cut(text[:500] + b"inserted" + text[500:])) > 0.9 * len(cut(text))


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingles(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", fold(t))
    return [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])


def test_simhash(docs, empty):
    got = {r.doc_id: r for r in simhash.near_components(docs).collect()}
    fp = {}
    for i, t in rows():
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(t, 3)]
        fp[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert got[i].fp & ((1 << 64) - 1) == fp[i]
    root = {i: i for i in fp}
    for _ in fp:
        for i in fp:
            for j in fp:
                if (fp[i] ^ fp[j]).bit_count() <= 2:
                    root[i] = root[j] = min(root[i], root[j])
    assert {i: r.component_id for i, r in got.items()} == root
    assert simhash.near_components(empty).count() == 0
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == set(root.values())


def test_trie_join_in_a_dense_ball():
    rng = np.random.default_rng(3)
    v = np.unique(np.array([77 ^ sum(1 << int(b) for b in rng.choice(32, rng.integers(0, 4), replace=False)) for _ in range(300)], np.uint64))
    got = {tuple(sorted(p)) for a, b in simhash.trie_pairs(v, 32, 2, most=64) for p in zip(a.tolist(), b.tolist(), strict=True)}
    assert got == {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if int(v[i] ^ v[j]).bit_count() <= 2}


def test_minhash(docs, empty):
    got = {r.doc_id: r for r in minhash.fingerprint_neighbours(docs, shards=3).collect()}
    all_rows = rows()
    for n, (i, t) in enumerate(all_rows):
        t, follow = t or "", all_rows[(n + 1) % len(all_rows)][1] or ""
        e = t[: len(t) - len(t) // 2] + follow[: len(t) // 2]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        a, b = set(shingles(t, 5)), set(shingles(e, 5))
        if len(a) > 40:
            assert abs(got[i].near_edited - len(a & b) / len(a | b)) < 0.2
    assert got[0].fingerprint == got[29].fingerprint and got[31].fingerprint == got[32].fingerprint == "" and got[31].near_next == 1.0
    assert minhash.fingerprint_neighbours(empty).count() == 0
    c = np.random.default_rng(0).integers(0, 16, 256).astype(np.uint8)
    assert (minhash.unpack(minhash.pack(c, 4), 4) == c).all()


def test_language(spark, empty):
    random.seed(1)
    sound = {"aa": "abcd", "bb": "efgh", "cc": "ijkl", "dd": "mnop", "ee": "qrst", "ff": "uvwx"}
    made = [(i, " ".join("".join(random.choice(sound[k]) for _ in range(5)) for _ in range(30)), k) for i, k in enumerate(list(sound) * 20)]
    made += [(900, None, "aa"), (901, "123 ...", "bb"), (902, "abcd dcba abba", None), (None, "efgh hgfe", "bb")]
    d = language.learning(spark.createDataFrame(made, "doc_id long, text string, lang string"))
    model = language.fit(d.where("not held_out"))
    got = {(r.doc_id, r.text): r for r in language.identify(d, model).collect()}
    assert all(got[i, t].lang_pred == k for i, t, k in made[:120]) and all(got[i, t].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, t, _ in made[:120])
    assert got[900, None].lang_pred == got[901, "123 ..."].lang_pred == "und" and got[902, "abcd dcba abba"].lang_pred == "aa" and got[None, "efgh hgfe"].held_out
    assert language.fit(empty) is None and language.identify(empty, None).count() == 0


def test_personal_data(spark, docs, empty):
    text = "é a.b@c.de, 1.2.3.4 or 1.2.3.999! +1 (743) 555-3824 or 4539 1488 0343 6467 and 4539 1488 0343 6468\ncall (743) 555-3824 now"
    d = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_personal_data(d).collect()}
    base = pii.joined(pii.base_spans(text))
    assert [x.split(":")[0] for x in base.split(",")] == ["email", "ip", "phone", "card"] and got[1].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    spans = got[1].spans.split(",")
    assert set(base.split(",")) < set(spans)
    assert "(743) 555-3824" in [text[int(a) : int(b)] for _, a, b in (x.split(":") for x in spans)]
    assert got[2].spans == "" and got[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = {r.doc_id: r.text for r in pii.redact(d).collect()}
    assert "<email>" in clean[1] and "555" not in clean[1] and clean[2] is None
    assert all(r.spans == "" for r in pii.find_personal_data(docs).collect()) and pii.find_personal_data(empty).count() == 0


def test_warc(spark):
    big = "<p>" + "long page " * 9000 + "</p>"
    made = [(1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "v", big), (6, "w", big), (6, "w", big), (None, "n", "<p>n</p>")]
    pages = spark.createDataFrame(made, "page_id long, url string, html string")
    path = common.fresh_path(spark, "w")
    got = warc.read_archives(warc.write_archives(pages, path, segment=700), path).collect()
    assert len(got) == len(made)
    by = defaultdict(list)
    for r in got:
        by[r.page_id].append(r)
    assert by[6][0].record_type == by[6][1].record_type == "response" and bytes(by[6][0].payload).decode() == big
    assert by[1][0].record_type == "revisit" and by[1][0].refers_to_id == by[2][0].record_id and by[3][0].record_type == "revisit" and by[None][0].record_type == "response"
    assert by[2][0].payload_digest == base64.b32encode(hashlib.sha1(b"<p>x</p>").digest()).decode()
    none = warc.write_archives(pages.where("page_id > 99"), path)
    assert warc.read_archives(none, path).count() == 0
    assert warc.unchunked(b"3;x=1\r\nabc\r\n0\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.assemble([{"segment": 1, "block": b"a", "total": None}, {"segment": 3, "block": b"b", "total": 2}])


def test_decontamination(spark, docs, empty):
    item = "The answer to the quiet question lies beyond seven silver rivers. Nobody counted them twice, said the old ferryman."
    close = item.replace("quiet", "silent").replace("old ", "").upper()
    more = [(100, "lead words before " + item + " and some after"), (101, "intro " + close + " outro"), (102, "the answer to nothing")]
    d = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    b = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")
    c = decontaminate.Decontaminator(d, b)
    assert {(r.doc_id, r.item_id) for r in c.hits(d).collect()} == {(100, 7), (101, 7)}
    assert {r.doc_id for r in d.collect()} - {r.doc_id for r in c.clean(d).collect()} == {100, 101}
    assert decontaminate.Decontaminator(empty, b).hits(empty).count() == 0 and decontaminate.Decontaminator(d, b.where("item_id = 8")).clean(d).count() == d.count()
    assert decontaminate.common_subsequence([1, 2, 3, 4], [9, 1, 3, 9, 4]) == 3
