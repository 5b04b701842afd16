"""Decontamination: recall of planted paraphrases against a plain search, short items, several groups of blocks, integer ids."""

import random

import numpy as np

from tidepanel.llm import decontaminate


def words(rng, n):
    """Prose of 60 common words and 2,000 others, one of the former for each one and a half of the latter."""
    return [f"w{rng.randrange(60)}" if rng.random() < 0.4 else f"x{rng.randrange(2000)}" for _ in range(n)]


def common_length(a, b):
    table = [0] * (len(b) + 1)
    for x in a:
        before = table.copy()
        for j, y in enumerate(b):
            table[j + 1] = before[j] + 1 if x == y else max(before[j + 1], table[j])
    return table[-1]


def test_planted_paraphrases(spark, monkeypatch):
    rng = random.Random(8)
    items = [(i, " ".join(words(rng, rng.randint(14, 46))) + ".") for i in range(150)]
    docs, leaks = [], set()
    for d in range(400):
        host = words(rng, rng.randint(40, 160))
        if d % 2:
            item, text = rng.choice(items)
            own = text.rstrip(".").split()
            rate = rng.choice([0, 0.08, 0.15, 0.22])
            kept = [x for w in own if (u := rng.random()) >= rate or u < rate / 2 for x in [w if u >= rate else rng.choice(host)]]
            if common_length(own, kept) >= 0.75 * len(own):
                leaks.add((d, item))
            at = rng.randint(0, len(host))
            host[at:at] = kept
        docs.append((d, " ".join(host)))
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")
    found = decontaminate.Decontaminator(frame, bench)
    hits = {(r.doc_id, r.item_id) for r in found.hits(frame).collect()}
    assert len(leaks) > 150 and len(hits & leaks) >= 0.97 * len(leaks)
    assert not [d for d, _ in hits if d % 2 == 0]
    index = decontaminate.build_index(spark, items, found.df, found.n, found.rank)
    assert index.axes.shape[1] == 64 < len(index.items) / 2
    monkeypatch.setattr(decontaminate, "ALIVE", 2)
    several = decontaminate.Decontaminator(frame, bench, block_items=30)
    more = {(r.doc_id, r.item_id) for r in several.hits(frame).collect()}
    assert len(more & leaks) >= 0.97 * len(leaks)
    assert {r.doc_id for r in several.clean(frame).collect()} == {d for d, _ in docs} - {d for d, _ in more}


def test_short_items(spark):
    docs = spark.createDataFrame([(1, "so Blue   whales, sing at night"), (2, "blue sing whales"), (3, "blue"), (4, "whales sing"), (5, None)], "doc_id long, text string")
    bench = spark.createDataFrame([("a", "blue WHALES sing"), ("b", ""), ("c", None), ("d", "?!")], "item_id string, text string")
    c = decontaminate.Decontaminator(docs, bench)
    assert [(r.doc_id, r.item_id) for r in c.hits(docs).collect()] == [(1, "a")]
    assert sorted(r.doc_id for r in c.clean(docs).collect()) == [2, 3, 4, 5]
    assert decontaminate.Decontaminator(docs, bench.where("item_id > 'a'")).hits(docs).count() == 0


def test_subsequence_by_bits():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a, b = rng.integers(0, 6, rng.integers(1, 30)).tolist(), rng.integers(0, 6, rng.integers(0, 40)).tolist()
        assert decontaminate.common_subsequence(a, b) == common_length(a, b)
