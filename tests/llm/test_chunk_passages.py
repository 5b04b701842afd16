"""Repeated passages of just over 50 words are removed wherever they start, and survive once."""

import random

from tidepanel.llm import chunk_dedup


def test_passages_of_51_words_at_many_offsets(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeiounrstlmé") for _ in range(rng.randint(2, 9)))
    make = lambda n: " ".join(word() for _ in range(n))
    rows, passages = [], []
    for i in range(400):
        passage = make(51)
        passages.append(passage)
        rows += [(2 * i, make(rng.randint(5, 60)) + " " + passage + " " + make(20)), (2 * i + 1, make(rng.randint(5, 60)) + " " + passage + " " + make(20))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.first_id: r.kept for r in chunk_dedup.removed_chunks(docs, with_text=True).collect()}
    assert all(kept[i] == t for i, t in rows if i % 2 == 0)
    left = [len(t.encode()) - len(kept[i].encode()) - len(passages[i // 2].encode()) for i, t in rows if i % 2]
    assert min(left) >= 0 and max(left) < 12  # the passage is gone whole, with what happens to stand on both sides
