"""Large keys: hundreds of near copies of one text beside texts that share a long passage and aren't alike, against all pairs."""

import itertools
import random

import numpy as np

from tidepanel.llm import common, minhash, near_text


def shingles(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return set(minhash.shingle_hashes(data, np.array([0, len(data)]), 5)[0].tolist())


def expected(rows):
    """Smallest ids of the components over all pairs at 0.8 or more."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        same = len(sets[i] & sets[j])
        if sets[i] and 5 * same >= 4 * (len(sets[i]) + len(sets[j]) - same):
            a, b = sorted((top(i), top(j)))
            root[b] = a
    return {rows[top(i)][0] for i in range(len(rows))}


def test_large_keys(spark, monkeypatch):
    monkeypatch.setattr(near_text, "MOST", 8)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeiounrstlm") for _ in range(rng.randint(3, 8)))
    base, shared = [word() for _ in range(160)], [word() for _ in range(140)]
    texts = []
    for _ in range(90):  # near copies: up to four words changed
        some = base.copy()
        for _ in range(rng.randint(0, 4)):
            some[rng.randrange(160)] = word()
        texts.append(" ".join(some))
    for i in range(60):  # a passage that all share, and words of their own: likeness about 0.55 to 0.85
        texts.append(" ".join([*shared, *(word() for _ in range(rng.randint(12, 50)))]))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in near_text.keep_one(docs).collect()} == expected(rows)


def test_heavy_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY_SHARE", 3)
    rows = spark.createDataFrame([(i, "hot" if i % 2 else str(i % 50), i) for i in range(6000)] + [(None, None, 1)], "id long, k string, v int")
    side = rows.where("k <> '4'").groupBy("k").count().toDF("k", "n").selectExpr("k", "n", "concat('x', k) AS x")
    for how in ("inner", "left"):
        got = common.join_heavy(rows, side, ["k"], "id", how)
        want = rows.join(side, "k", how).select(*rows.columns, "n", "x")
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
