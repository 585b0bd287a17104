"""A training-corpus pipeline over ``documents``; each stage is written and read again before the next.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of ``documents``: documents
whose language is not recognised go, repeated lines go, one document of each group of near copies stays,
documents that hold benchmark items go, and the rest is tokenized.

The first and the last stage return maps in Python that run when their caller reads them. They leave the session with
bounded batches to Python (``common.BATCHES``), unless it has sizes of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecue.llm import bpe, decontam, langid, linedup, minhash
from tidecue.llm.common import bound_batches, delete, scope, settle, table
from tidecue.llm.queries import language_model, tokenizer_path

#: A document whose best language has a lower posterior than this is rejected.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language identification: documents without letters or without a clear language go (operator 4).

    lang becomes the predicted language.
    """
    bound_batches(spark)
    found = langid.label(docs, language_model(docs))
    kept = found.where((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: lines that repeat an earlier one go (operator 3), and n_chars follows the text.

    Documents left without any word go: nothing of them is new.
    """
    kept = linedup.remove_lines(docs).where(F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: of each group of near copies the smallest id stays (operator 2)."""
    return minhash.keep_one(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold an item go (operator 10)."""
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode every text: one row of digests per document (operator 6)."""
    bound_batches(spark)
    return bpe.round_trip(docs, tokenizer_path())


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("leaks", leaks), ("tokens", tokens)]

#: SQL cannot express the classifier and the tokenizer; tests compare the pipeline with a plain model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's own tables go once it is written, and it goes once the next one is written;
    the table that the result reads is the only one left.
    """
    docs, written = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        before, written = written, []
        try:
            with scope(spark):
                docs = settle(stage(spark, docs, sf_dir), name, written)
        finally:
            delete(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
