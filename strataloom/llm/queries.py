"""Queries pN_ over the tables of a data directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.plans.tables import table
from strataloom.llm import boilerplate, canonical, keywords, leaks, levels, packing, scans, splitting, truncation

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return keywords.distinctive_keywords(table(spark, sf, "topic")).select("doc_id", "topic_ix", "keyword").distinct()


def p1_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Every keyword of every topic with its score, rounded for comparison."""
    scores = keywords.keyword_scores(table(spark, sf, "topic"))
    return scores.select("doc_id", "topic_ix", "keyword", F.col("tf").cast("bigint").alias("tf"), F.col("n_records").cast("bigint").alias("n_topics"), F.round("score", 4).alias("score"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return boilerplate.repeated_lines(table(spark, sf, "block"), table(spark, sf, "documents"), **boilerplate.WHOLE).select("doc_id", "pos", "line_ix").distinct()


def p2_lines(spark: SparkSession, sf: str) -> DataFrame:
    return boilerplate.line_report(table(spark, sf, "block"), table(spark, sf, "documents"))


def p2_clean(spark: SparkSession, sf: str) -> DataFrame:
    return boilerplate.clean_blocks(table(spark, sf, "block"), table(spark, sf, "documents"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return scans.scan_faults(table(spark, sf, "block"), table(spark, sf, "documents"))


def p3_text(spark: SparkSession, sf: str) -> DataFrame:
    """The continuous text of the scanned documents, without blocks of page furniture."""
    got = scans.repaired_scans(table(spark, sf, "block"), table(spark, sf, "documents"))
    return got.where("text is not null").select("doc_id", "pos", "type", "text")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncated_values(table(spark, sf, "topic")).select("doc_id", "topic_ix", "field").distinct()


def p4_rates(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.cut_rates(table(spark, sf, "topic"), table(spark, sf, "documents"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.oversized_blocks(table(spark, sf, "block"), table(spark, sf, "size_limit"))


def p5_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.all_pieces(table(spark, sf, "block"), table(spark, sf, "size_limit"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    texts = canonical.block_and_title_texts(table(spark, sf, "block"), table(spark, sf, "topic"))
    return canonical.canonical_texts(texts).where("found > 0").select("field", "doc_id", "ix").distinct()


def p6_texts(spark: SparkSession, sf: str) -> DataFrame:
    """All texts in their consistent form."""
    texts = canonical.block_and_title_texts(table(spark, sf, "block"), table(spark, sf, "topic"))
    return canonical.canonical_texts(texts).select("field", "doc_id", "ix", "text")


def _packed(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    capacity = packing.container_capacity(table(spark, sf, "size_limit"))
    return packing.pack_documents(table(spark, sf, "documents"), capacity, spark.conf.get("spark.strataloom.tokenizer", packing.TOKENIZER)), capacity


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(spark, sf)[0].where("n_pieces > 1").select("doc_id").distinct()


def p7_packing(spark: SparkSession, sf: str) -> DataFrame:
    """The container of every document or piece of one."""
    return _packed(spark, sf)[0].select("container_id", "doc_id", "piece_ix", "n_pieces", "n_tokens", "char_start", "char_end")


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packing_report(*_packed(spark, sf))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaked_pairs(table(spark, sf, "documents"), table(spark, sf, "eval_item"))


def p8_items(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leak_report(table(spark, sf, "documents"), table(spark, sf, "eval_item"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return levels.reading_levels(table(spark, sf, "documents"), table(spark, sf, "level_label")).select("doc_id", "level")


def p9_profile(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return levels.level_profile(levels.reading_levels(docs, table(spark, sf, "level_label")), docs)


def queries() -> dict[str, Query]:
    names = ("p1_found", "p1_scores", "p2_found", "p2_lines", "p2_clean", "p3_found", "p3_text", "p4_found", "p4_rates", "p5_found", "p5_pieces", "p6_found", "p6_texts", "p7_found", "p7_packing", "p7_report", "p8_found", "p8_items", "p9_found", "p9_profile")
    return {n: globals()[n] for n in names}
