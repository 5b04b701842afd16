"""Chunk deduplication where doc_ids are null or repeat, and against a brute-force version on random texts."""

import random

import numpy as np

from tidepanel.llm import chunk_dedup, spans


def made(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeiounrstlmé") for _ in range(rng.randint(2, 9)))
    make = lambda n: " ".join(word() for _ in range(n))
    passages = [make(rng.randint(60, 90)) for _ in range(4)]
    return [" ".join([make(rng.randint(8, 40)), rng.choice(passages), make(rng.randint(8, 40)), *([rng.choice(passages)] if rng.random() < 0.3 else [])]) for _ in range(n)], passages


def test_null_and_repeated_ids_keep_a_passage_once(spark):
    for ids in ([None] * 6, [7] * 6, [None, 7, None, 7, 3, None]):
        passage = " ".join(f"passage{i}" for i in range(60))
        texts = [" ".join(f"w{k}x{i}" for i in range(30)) + " " + passage + " " + " ".join(f"e{k}x{i}" for i in range(30)) for k in range(6)]
        docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
        kept = [r.kept for r in chunk_dedup.removed_chunks(docs, with_text=True).collect()]
        assert sum(passage in k for k in kept) == 1 and len(kept) == 6
        assert all(len(t) - 3 * len(passage) < len(k) for t, k in zip(sorted(texts), sorted(kept), strict=True))


def plain(rows, bits=5, least=16, most=128, least_run=120):
    """doc_id -> kept_sha256 and n_removed, texts distinct and doc_ids too: a dictionary of chunks, one text after another."""
    table, first, out = chunk_dedup.gear_table(), {}, {}
    cut = {}
    for doc_id, text in sorted(rows):
        raw = text.encode()
        ends = chunk_dedup.chunk_ends(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), bits, least, most, table)[0]
        cut[doc_id] = raw, list(zip([0, *ends[:-1]], ends, strict=True))
        for a, b in cut[doc_id][1]:
            first.setdefault(raw[a:b], (doc_id, a, b))
    for doc_id, (raw, chunks) in cut.items():
        runs = []
        for a, b in chunks:
            if first[raw[a:b]][:2] == (doc_id, a):
                continue
            if runs and runs[-1][-1][1] == a:
                runs[-1].append((a, b))
            else:
                runs.append([(a, b)])
        found = []
        for r in runs:
            lo, hi = r[0][0], r[-1][1]
            left, right = lo, hi
            firsts, lasts = {}, {}
            for a, b in r:
                keeper = first[raw[a:b]]
                firsts.setdefault(keeper[0], (a, keeper))
                lasts[keeper[0]] = b, keeper
            for a, (k, ka, _) in firsts.values():
                n = 0
                while a - lo < chunk_dedup.REACH and n < chunk_dedup.REACH and a - n > 0 and ka - n > 0 and raw[a - n - 1] == cut[k][0][ka - n - 1]:
                    n += 1
                left = min(left, a - n)
            for b, (k, _, kb) in lasts.values():
                n = 0
                while hi - b < chunk_dedup.REACH and n < chunk_dedup.REACH and b + n < len(raw) and kb + n < len(cut[k][0]) and raw[b + n] == cut[k][0][kb + n]:
                    n += 1
                right = max(right, b + n)
            while raw[left] & 0xC0 == 0x80:
                left += 1
            while right < len(raw) and raw[right] & 0xC0 == 0x80:
                right -= 1
            found.append((left, right))
        s, e = spans.merge_spans(np.array([x for x, _ in found], np.int64), np.array([x for _, x in found], np.int64))
        long = e - s >= least_run
        out[doc_id] = spans.digest_row(raw, s[long], e[long])
    return out


def test_against_a_dictionary_of_chunks(spark):
    texts, _ = made(4, 60)
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in chunk_dedup.chunk_dedup(docs).collect()}
    want = plain(rows)
    assert got == want and sum(x[1] for x in want.values()) > 5000
