"""Pairs planted just below, at and just above a likeness of 0.8 are judged by their shingle sets."""

from tidepanel.llm import near_text


def planted(pair, n, off):
    """Two texts of n + 4 words (n shingles each) of which the last `off` shingles differ."""
    words = [f"p{pair}w{i}" for i in range(n + 4)]
    return " ".join(words), " ".join([*words[: n + 4 - off], *(f"p{pair}x{i}" for i in range(off))])


def test_pairs_about_the_limit(spark):
    rows, gone = [], set()
    for pair in range(120):
        # (n - off) / (n + off): 0.781, 0.8, 0.818 of long texts, then of short ones 0.765, 0.8 and 0.818
        n, off = ((285, 35), (270, 30), (300, 30), (30, 4), (36, 4), (40, 4))[pair % 6]
        rows += [(2 * pair, planted(pair, n, off)[0]), (2 * pair + 1, planted(pair, n, off)[1])]
        if 5 * (n - off) >= 4 * (n + off):
            gone.add(2 * pair + 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in near_text.keep_one(docs).select("doc_id").collect()}
    assert len(gone) == 80 and {i for i, _ in rows} - kept == gone
