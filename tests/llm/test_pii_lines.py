"""A number of two words is found wherever it stands in a long line, and pieces decode like whole lines."""

import numpy as np

from tidepanel.llm import pii


def test_numbers_at_every_place_of_a_long_line(spark):
    texts = []
    for place in [0, 1, *range(120, 136), *range(250, 262), 298]:
        words = ["word"] * 300
        words[place : place + 2] = ["(743)", "555-3824"]
        texts.append(" ".join(words))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_personal_data(d).collect():
        assert [texts[r.doc_id][int(a) : int(b)] for _, a, b in (x.split(":") for x in r.spans.split(","))] == ["(743) 555-3824"], r.doc_id
    assert all(r.text.split().count("word") == 298 and "743" not in r.text and "555" not in r.text for r in pii.redact(d).collect())


def test_pieces_decode_like_whole_lines():
    field, rng = pii.default_field(), np.random.default_rng(4)
    some = [w for words, _ in pii.default_table(200, 5) for w in words]
    sizes = np.array([1, 3, 127, 128, 129, 900, 2500])
    words = [some[i] for i in rng.integers(0, len(some), sizes.sum())]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) + 1 for w in words]) - 1
    starts = ends - [len(w.encode()) for w in words]
    begin = np.cumsum(sizes) - sizes
    first = np.zeros(len(words), bool)
    first[begin] = True
    e = field.emissions(pii.shapes(data, starts, ends), first, np.append(first[1:], True))
    whole = field.viterbi(e, sizes)
    assert (field.line_labels(e, begin) == whole).all() and (whole != pii.OTHER).any()
