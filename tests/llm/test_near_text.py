"""Near texts by shingle likeness: near copies, copies, null and empty rows, clashing columns, an empty table."""

from tidepanel.llm import near_text


def test_keep_one(spark):
    words = [f"w{i}" for i in range(300)]
    near = [*words[:150], "other", *words[151:]]
    rows = [(1, " ".join(words), "x"), (2, " ".join(near), "y"), (3, " ".join(f"v{i}" for i in range(300)), "z"), (4, None, "n"), (5, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sketch string")
    kept = near_text.keep_one(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5] and kept.columns == docs.columns
    assert near_text.keep_one(docs.where("doc_id > 9")).count() == 0
