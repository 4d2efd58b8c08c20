"""Sinks: documents, chunks, manifest, index, answers and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def documents(docs: DataFrame, path: str, form: str = "parquet") -> None:
    """Documents or chunks, a folder for each domain."""
    docs.write.mode("overwrite").partitionBy("domain").format(form).save(path)


def manifest(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """A row for each document with its number of chunks and characters, and the error that kept it from being read."""
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"))
    error = F.col("error") if "error" in docs.columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", "domain", "title", "path", "source_type", F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("char_count"), error.alias("error"))
    return rows.join(counts, "doc_id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))


def pending(docs: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    """Documents that are not in the manifest yet; all of them if forced."""
    return docs if force else docs.join(done.filter("error IS NULL").select("doc_id").distinct(), "doc_id", "left_anti")


def answers(results: DataFrame, path: str, one_file: bool = False) -> None:
    """The answer file as CSV: a summary of the tokens first, then a row for each question in order, header with a byte
    order mark. Nulls are empty texts and zeros, values are quoted where they need it.

    Parts are written in the order of their rows, each with its header; one_file joins them, for a report that one task
    can hold.
    """
    use = ["prompt_tokens", "completion_tokens", "total_tokens"]
    total = results.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in use]).select(F.lit("summary").alias("\ufeffqid"), F.lit("").alias("answer"), *use, F.lit(0).alias("_o"))
    own = results.filter("qid IS NOT NULL").select(F.col("qid").alias("\ufeffqid"), F.coalesce("answer", F.lit("")).alias("answer"), *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in use], F.lit(1).alias("_o"))
    rows = total.unionByName(own)
    rows = rows.coalesce(1).sortWithinPartitions("_o", "\ufeffqid") if one_file else rows.orderBy("_o", "\ufeffqid")
    rows.drop("_o").write.mode("overwrite").option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


def markdown(pages: DataFrame, path: str) -> None:
    """Pages as text with a mark before each; a folder for each document."""
    body = F.array_join(F.transform(F.filter("pages", lambda p: F.trim(p["text"]) != ""), lambda p: F.concat(F.lit("<!-- page: "), p["page"].cast("string"), F.lit(" -->\n"), p["text"])), "\n\n")
    pages.select("doc_id", body.alias("value")).write.mode("overwrite").partitionBy("doc_id").text(path)


def report(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
