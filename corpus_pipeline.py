"""A training-data pipeline over `documents`: language identification, near-duplicates, benchmark decontamination, personal
data, token ids. Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as
the docs of the next. All but the last return the columns of documents.

Empty stages pass empty tables on. Extra columns of documents are carried through, whatever their names; the stages use
doc_id, text and lang.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import bpe, common, decontaminate, language, near_text, pii, simhash


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language, lang set to the one that was found. Those without a letter, or null, go, and those whose two
    best codewords are too close to tell."""
    model = language.fit(language.learning(docs).where("not held_out"))
    apart = common.unused(docs.columns, *docs.columns)  # columns of any names stay
    named = language.identify(docs.toDF(*apart), model, text=apart[docs.columns.index("text")])
    kept = named.where((F.col("lang_pred") != language.UNKNOWN) & ~F.col("ambiguous"))
    return kept.select(*[F.col("lang_pred" if c == "lang" else own).alias(c) for c, own in zip(docs.columns, apart, strict=True)])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id: first of SimHash's groups, then of the
    texts left that have 0.8 of their five-word shingles in common."""
    named, name, rows = common.named_rows(docs)
    with common.scratch(spark):
        gone, again = simhash.duplicates(rows)
        more, _ = near_text.duplicates(rows, gone)
        every, again = common.materialize(gone.union(more), "all-gone", keep=1), common.materialize(again, "all-repeated", keep=1)
    return common.without_rows(named, name, every, again).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.Decontaminator(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).clean(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids_sha256, decoded_sha256, ids of each document."""
    import public_tokenizers

    return bpe.round_trip_digests(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("language", language_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("bpe", bpe_stage),
]

#: No stage but the filters of the first could be SQL: tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with common.scratch(spark):  # the results of all stages but the last go at the end
        for name, stage in STAGES:
            with common.scratch(spark):  # what a stage leaves behind goes when its result is written
                docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}", keep=1 + (name == STAGES[-1][0]))
    return docs
