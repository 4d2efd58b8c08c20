"""The queries of the llm problems and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperlode.llm import leaks, lookalike, replies, scans, sentences, split, tokenize
from paperlode.session import read


def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.lookalike_records(read(spark, sf_dir, "questions"), read(spark, sf_dir, "chunks"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.lookalike_pairs(p2_forms(spark, sf_dir))


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.one_delivery(split.split_oversized(read(spark, sf_dir, "filings"), read(spark, sf_dir, "chunks"), read(spark, sf_dir, "chunk_limits")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.oversized(split.split_oversized(read(spark, sf_dir, "filings"), read(spark, sf_dir, "chunks"), read(spark, sf_dir, "chunk_limits")))


def p4_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repair(read(spark, sf_dir, "filings")).select("doc_id", "text").distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.line_defects(scans.repair(read(spark, sf_dir, "filings"), with_text=False))


def p5_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replies.templates(replies.cut_lineage(replies.replies(read(spark, sf_dir, "answers"), read(spark, sf_dir, "questions"), read(spark, sf_dir, "documents"))))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replies.defects(read(spark, sf_dir, "answers"), read(spark, sf_dir, "questions"), read(spark, sf_dir, "documents"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.tokenize(read(spark, sf_dir, "documents"))


def p7_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked(p7_overlaps(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentences(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found,
    "p2_forms": p2_forms,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p4_found": p4_found,
    "p4_text": p4_text,
    "p5_found": p5_found,
    "p5_templates": p5_templates,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p7_overlaps": p7_overlaps,
    "p8_found": p8_found,
}

SQL: dict[str, str] = {
    "p3_found": r"""
        WITH limits AS (SELECT lower(regexp_replace(domain, '^\s+|\s+$', '', 'g')) AS name, max_chars FROM chunk_limits),
        items AS (SELECT 'filings' AS item_table, doc_id AS item_id, domain, text FROM filings
                  UNION ALL SELECT 'chunks', chunk_id, domain, text FROM chunks)
        SELECT DISTINCT item_table, item_id
        FROM items LEFT JOIN limits ON lower(regexp_replace(items.domain, '^\s+|\s+$', '', 'g')) = limits.name
        WHERE length(text) > coalesce(limits.max_chars, (SELECT max_chars FROM limits WHERE name = 'default'))""",
}
