"""The registered queries of this subpackage; __spark_entry__ adds them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptmatrix.llm import alignment, byte_bpe, exact_search, html_text, language_model, leaderboard, mixing, nbsvm, near_dup, pieces, quality_rules, substring_dedup, toxicity
from promptmatrix.llm.session import remainder, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.apply(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.apply(table(spark, sf_dir, "pages"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = nbsvm.fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 3) != 1)
    return nbsvm.apply(docs, model).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), pieces.load())


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = language_model.score(table(spark, sf_dir, "documents"), remainder("doc_id", 7) != 2)
    return scored.select("doc_id", (remainder("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    return toxicity.apply(docs, model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), byte_bpe.load())


def op13_leaderboard_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboard.run(table(spark, sf_dir, "sale_lines"), table(spark, sf_dir, "items"), table(spark, sf_dir, "vendors"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_near_duplicates, op3_html_extraction, op4_substring_dedup, op5_quality_classifier, op6_sentencepiece, op7_language_model, op8_exact_search, op9_mixing, op10_toxicity, op11_alignment, op12_byte_bpe, op13_leaderboard_feed)}


def oracle_sql() -> dict[str, str]:
    return {"op4_substring_dedup": substring_dedup.ORACLE, "op8_exact_search": exact_search.ORACLE, "op9_mixing": mixing.ORACLE}
