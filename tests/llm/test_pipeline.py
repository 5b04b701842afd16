"""The pipeline on the smallest tables against its rules said plainly."""

import os

import pytest
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")


def test_pipeline(spark):
    import corpus_pipeline
    import public_tokenizers
    from tidepanel.llm import pii

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts, first = {}, {}
    for r in docs.orderBy("doc_id").collect():
        texts[r.doc_id] = r.text
        first.setdefault(r.text, r.doc_id)
    for i, text in texts.items():
        leaked = any(b in " ".join((text or "").lower().split()) for b in bench)
        if not text or first[text] != i or leaked:
            assert i not in got
        elif i in got:
            if not pii.base_spans(text):
                assert got[i].n_tokens == len(t.encode(text, add_special_tokens=False).ids)
    assert len(got) > 0.75 * len(first)


def test_columns_that_clash(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "some words here to keep", "en", "s", 23, 0.5, "x"), (2, None, "en", "s", 0, 0.1, "y"), (3, "some words here to keep", "en", "s", 23, 0.7, "z")], "doc_id long, text string, lang string, source string, n_chars long, score double, k1 string")
    kept = corpus_pipeline.language_stage(spark, docs, SF)
    assert [(r.doc_id, r.score) for r in kept.orderBy("doc_id").collect()] == [(1, 0.5), (3, 0.7)] and kept.columns == docs.columns
    for stage in (corpus_pipeline.near_dedup_stage, corpus_pipeline.decontamination_stage, corpus_pipeline.pii_stage):
        kept = stage(spark, kept, SF)
        assert [(r.doc_id, r.k1) for r in kept.collect()] == [(1, "x")] and kept.columns == docs.columns
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("doc_id > 9"), SF).count() == 0, name


def test_columns_named_like_those_of_the_stages(spark):
    """Columns of any names come back as they were, null doc_ids and repeated rows included."""
    import corpus_pipeline

    names = ["_id", "_k1", "_k2", "_node", "_place", "node", "h", "key", "keys", "root", "fp", "lang_pred", "ambiguous", "_own_lang_pred", "__id"]
    words = [f"w{i}" for i in range(120)]
    near = [*words[:60], "other", *words[61:]]
    made = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words)), (4, " ".join(f"v{i}" for i in range(90))), (None, " ".join(f"u{i}" for i in range(90))), (4, " ".join(f"v{i}" for i in range(90)))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), *[f"{n}{k}" for n in names]) for k, (i, t) in enumerate(made)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    kept = docs
    for stage in (corpus_pipeline.language_stage, corpus_pipeline.near_dedup_stage, corpus_pipeline.decontamination_stage, corpus_pipeline.pii_stage):
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted((r.doc_id or 0) for r in rows) == [0, 1, 4]
    for r in rows:
        (k,) = {int(str(r[n])[len(n) :]) for n in names}
        assert made[k] == (r.doc_id, r.text)


def test_stages_leave_no_folders(spark, tmp_path, monkeypatch):
    import os

    import corpus_pipeline

    from tidepanel.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert len([x for x in os.listdir(tmp_path) if not x.startswith(".")]) == 1
    assert not common._OPEN


def test_languages_take_effect(spark):
    """A wrong or missing lang is put right; texts without a letter go."""
    import corpus_pipeline

    en, fr = "the thing that wheels shown slowly with", "eau chaque étoile oiseau que château"
    rows = [(i, " ".join([en, en.upper()][i % 2 : i % 2 + 1] * (1 + i % 3)), "en") for i in range(0, 60)] + [(i, " ".join([fr] * (1 + i % 3)), "fr") for i in range(60, 120)]
    rows += [(500, en, "fr"), (501, fr, None), (502, "½ 12 !!", "en"), (503, None, "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id: r.lang for r in corpus_pipeline.language_stage(spark, docs, SF).collect()}
    assert kept[500] == "en" and kept[501] == "fr" and 502 not in kept and 503 not in kept and len(kept) == 122
