"""A corpus pipeline of five stages, each one operator of ``wayfold.llm``.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the columns
of ``documents``; its result is written as Parquet and read again as the next stage's ``docs``.  The last
stage returns the encoded texts.  Models are fitted on the stage's own input, the documents that are
left, so that the pipeline can run on any table with the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayfold.llm import decontaminate, language_id, minhash_dedup, secret_scan, sentencepiece_bpe
from wayfold.llm.common import cut, table

#: Near copies of a stage share this part of their five-word shingles; the 85 of op8 is that query's own.
SIMILAR_PERCENT = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go (null, no letter, or a narrow margin)."""
    return language_id.accepted(docs, language_id.fit(language_id.training_rows(docs)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies (four fifths or more of their shingles common) the document with the smallest id stays, unchanged."""
    return minhash_dedup.deduplicated(docs, percent=SIMILAR_PERCENT)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more repeats benchmark windows go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Credentials are replaced by a mark; every document stays."""
    return secret_scan.redacted(docs, secret_scan.fit(docs))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, with the check that they decode to it."""
    return sentencepiece_bpe.encode(docs, sentencepiece_bpe.read_model())


STAGES = [("language_id", language), ("minhash_dedup", near_duplicates), ("decontaminate", benchmark), ("secret_scan", secrets), ("sentencepiece", pieces)]

#: Compression, a forest and tokenization have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
