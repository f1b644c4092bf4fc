"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fill_in_middle, html_extract, language_id, maxent_lm, minhash_dedup, quality_rules, secret_scan, sentencepiece_bpe, simhash_dedup, toxicity, url_filter, vector_codes
from .common import remainder, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.findings(docs, secret_scan.fit(docs))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, toxicity.training_labels(labels))
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "plain", "targeted", "negated", "reported", "threats")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.fit(pages)).select("page_id", "url", "text", "n_chars")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = language_id.fit(language_id.training_rows(docs))
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return language_id.identify(docs, dictionaries).select("doc_id", held_out, "lang_pred", "score", "rejected")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.ledger(table(spark, sf_dir, "documents"))
    base_failed = ~quality_rules.passes("failed", "1")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), quality_rules.passes("failed").alias("kept"), "failed")


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode(table(spark, sf_dir, "documents"), sentencepiece_bpe.read_model())


def op10_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = maxent_lm.fit(docs.where(F.coalesce(remainder("doc_id", 5) != 1, F.lit(False))).select("text"))
    held_out = F.coalesce(remainder("doc_id", 5) == 1, F.lit(False)).alias("held_out")
    return maxent_lm.score(docs, model).select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(fill_in_middle.transform(table(spark, sf_dir, "documents")))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_secret_scan, op2_url_filter, op3_toxicity, op4_html_extract, op5_language_id, op6_decontaminate, op7_quality_rules, op8_minhash_dedup, op9_sentencepiece, op10_maxent_lm, op11_vector_codes, op12_simhash_dedup, op13_fill_in_middle]
    return {f.__name__: f for f in own}
