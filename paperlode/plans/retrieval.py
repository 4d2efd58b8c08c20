"""Queries of cleaning, chunking, indexing, search, packing and calculation over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperlode.functions import text as T
from paperlode.operators import analysis, calculation, chunking, evaluation, index, packing, prompting, retrieval, search
from paperlode.session import cut_lineage, read

#: The query set of `search_docs`, in its SQL too: every row whose id is divisible by this, against all rows. The other searches ask all.
QUERY_STEP = 50


def _joined(c: Column | str) -> Column:
    return F.array_join(c, "|")


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.one_each(read(spark, sf_dir, "questions"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).filter(F.regexp_extract("qid", r"(\d+)$", 1).cast("bigint") % QUERY_STEP == 0)


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.corpus(read(spark, sf_dir, "chunks"))


def _queries(asked: DataFrame) -> DataFrame:
    text = T.question_query(F.col("question"), F.col("options"), F.col("type"), F.col("doc_ids"))
    return asked.select(F.col("qid").alias("query_id"), text.alias("query"), F.coalesce("domain", F.lit("")).alias("domain"), F.coalesce("doc_ids", F.array().cast("array<string>")).alias("doc_ids"))


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "filings").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    return rows.select("doc_id", F.md5(T.compact_whitespace(F.col("text")).cast("binary")).alias("text_md5"), T.stable_id(F.col("doc_id"), F.lit("0"), F.lit("0")).alias("stable_id")).distinct()


def doc_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    stem = F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)
    rows = read(spark, sf_dir, "filings").filter("doc_id IS NOT NULL AND path IS NOT NULL")
    return rows.select("doc_id", stem.alias("stem"), F.regexp_extract(path, r"([^/]+)/[^/]*$", 1).alias("folder"), F.trim(F.regexp_replace(stem, r"[_\-]+", " ")).alias("file_title"), F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)).alias("suffix")).distinct()


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = F.filter("pages", lambda p: F.trim(p["text"]) != "")
    marked = F.array_join(F.transform(pages, lambda p: F.concat(F.lit("[PAGE "), p["page"].cast("string"), F.lit("]\n"), p["text"])), "\n\n")
    rows = read(spark, sf_dir, "filings").filter("doc_id IS NOT NULL AND pages IS NOT NULL")
    return rows.select("doc_id", F.size(pages).cast("bigint").alias("pages_with_text"), F.md5(marked.cast("binary")).alias("marked_md5")).distinct()


def paragraph_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.blocks(chunking.documents(read(spark, sf_dir, "filings")))
    return rows.select("doc_id", F.col("idx").cast("bigint").alias("idx"), F.col("page").cast("bigint").alias("page"), "char_start", "char_end", "kind", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def chunk_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk(chunking.documents(read(spark, sf_dir, "filings")))


def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).filter("text IS NOT NULL").select("chunk_id", _joined(T.keywords(F.col("text"))).alias("keywords"))


def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = index.postings(index.tokens(_chunks(spark, sf_dir), T.plain_tokens))
    return posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    bags = index.tokens(_chunks(spark, sf_dir), T.plain_tokens)
    return bags.groupBy(F.coalesce("domain", F.lit("")).alias("domain")).agg(F.count("*").alias("chunks"), F.sum(F.size("tokens").cast("bigint")).alias("tokens"), F.round(F.avg(F.size("tokens")), 6).alias("avg_tokens"))


def doc_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.doc_profiles(_chunks(spark, sf_dir)).select("doc_id", "term", "cnt")


def structured_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.terms(_questions(spark, sf_dir)).select("qid", *[_joined(c).alias(c) for c in ("structured", "metrics", "numbers", "years", "strong", "important", "hints")])


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = search.bm25_top(_queries(_questions(spark, sf_dir)), _chunks(spark, sf_dir), 10, T.plain_tokens)
    return best.select("query_id", "rank", "chunk_id", F.col("bm25").alias("score"))


def search_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search_chunks(cut_lineage(_queries(_questions(spark, sf_dir))), _chunks(spark, sf_dir), 10)
    return found.withColumn("matched", _joined("matched"))


def search_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_docs(cut_lineage(_queries(_asked(spark, sf_dir)).withColumn("doc_ids", F.array().cast("array<string>"))), _chunks(spark, sf_dir))


def sub_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.sub_queries(_questions(spark, sf_dir)).drop("doc_ids")


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_lineage(retrieval.retrieve(cut_lineage(_questions(spark, sf_dir)), cut_lineage(_chunks(spark, sf_dir))))


def retrieve_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).select("qid", "rank", "evidence_id", "chunk_id", "doc_id", F.round("score", 6).alias("score"), "option", _joined("matched").alias("matched"))


def pack_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_evidence(spark, sf_dir), _questions(spark, sf_dir)).select("qid", "place", "evidence_id", "chunk_id", "doc_id", "option", F.length("text").cast("bigint").alias("chars"))


def render_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _questions(spark, sf_dir)
    return packing.render(packing.pack(_evidence(spark, sf_dir), asked), asked)


def solve_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calculation.solve(_questions(spark, sf_dir), _evidence(spark, sf_dir))


def calculation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, evidence = cut_lineage(_questions(spark, sf_dir)), _evidence(spark, sf_dir)
    return calculation.context(asked, evidence, calculation.solve(asked, evidence))


def extract_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calculation.extract_values(_chunks(spark, sf_dir), ["chunk_id"])


def option_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calculation.option_values(_questions(spark, sf_dir)).select("qid", "option", F.col("pos").cast("bigint").alias("pos"), "value", "unit")


def question_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = _questions(spark, sf_dir)
    kinds = analysis.classify(questions).withColumn("tags", _joined("tags"))
    return kinds.join(questions.select("qid", analysis.formula(F.col("question"), F.col("options")).alias("formula")), "qid")


def yearly_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change over a year and the share of each year, of orders by priority."""
    year = read(spark, sf_dir, "orders").groupBy("o_orderpriority", F.year("o_orderdate").cast("bigint").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("amount"))
    before = F.lag("amount").over(Window.partitionBy("o_orderpriority").orderBy("year"))
    total = F.sum("amount").over(Window.partitionBy("o_orderpriority"))
    return year.select("o_orderpriority", "year", "amount", F.round((F.col("amount") - before) / F.abs(before) * 100, 4).alias("yoy_pct"), F.round(F.col("amount") / total * 100, 4).alias("share_pct"))


def normalize_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = _questions(spark, sf_dir).select("qid", "answer_format", "options")
    rows = read(spark, sf_dir, "answers").filter("answer_id IS NOT NULL").select("answer_id", "qid", F.col("answer").alias("given"), "option_judgements").dropDuplicates(["answer_id"]).join(questions, "qid")
    answer = evaluation.normalize_answer(F.coalesce("given", F.lit("")), F.col("answer_format"), F.col("options"), F.col("option_judgements"))
    return rows.select("answer_id", answer.alias("letters"))


def parse_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = _questions(spark, sf_dir).select("qid", "answer_format", "options")
    rows = read(spark, sf_dir, "answers").filter("answer_id IS NOT NULL").select("answer_id", "qid", "raw_model_output").dropDuplicates(["answer_id"]).join(questions, "qid")
    value = evaluation.json_object(F.col("raw_model_output"))
    judged = evaluation.judgements(F.col("_json"))
    said = F.coalesce(evaluation.answer_text(F.col("_json")), evaluation.answer_in_text(F.col("raw_model_output")), F.lit(""))
    rows = rows.withColumn("_json", value).withColumn("_judged", judged)
    return rows.select("answer_id", F.col("_json").isNotNull().alias("is_json"), evaluation.normalize_answer(said, F.col("answer_format"), F.col("options"), F.col("_judged")).alias("letters"), F.array_join(F.array_sort(F.map_keys(F.map_filter("_judged", lambda k, v: v))), "").alias("judged_true"))


def eval_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.breakdown(evaluation.scored(_questions(spark, sf_dir), read(spark, sf_dir, "answers")))


def eval_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluation.scored(_questions(spark, sf_dir), read(spark, sf_dir, "answers"))
    return rows.filter("correct = 0").select("qid", F.col("answer").alias("gold"), "pred", "was_missing")


def _diagnosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = _questions(spark, sf_dir)
    return evaluation.diagnosed(questions, analysis.classify(questions), read(spark, sf_dir, "answers"))


def run_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.diagnostics(_diagnosed(spark, sf_dir))


def suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _diagnosed(spark, sf_dir).filter("error IS NOT NULL OR evidence = 0 OR correct = 0")
    return rows.select("qid", F.col("error").isNotNull().alias("has_error"), "evidence", "gold", "pred", "correct")


def question_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.ledger(read(spark, sf_dir, "answers"), "qid")


def assemble_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replies to a question in the order in which they came: the first is checked by the second where the policy of
    the second pass asks for it."""
    questions = _questions(spark, sf_dir)
    w = Window.partitionBy("qid").orderBy(F.asc_nulls_last("answered_at"), "answer_id")
    rows = read(spark, sf_dir, "answers").filter("answer_id IS NOT NULL AND qid IS NOT NULL").dropDuplicates(["answer_id"]).withColumn("_n", F.row_number().over(w)).filter("_n <= 2")
    rows = rows.select("qid", "_n", F.col("raw_model_output").alias("raw"), "token_usage.*", "error", "answer", "confidence")
    kinds = analysis.classify(questions).select("qid", "kind").join(questions.select("qid", "answer_format"), "qid")
    wanted = rows.filter("_n = 1").join(kinds, "qid").filter(prompting.second_pass(F.col("answer"), F.col("answer_format"), F.col("kind"), F.col("confidence"))).select("qid")
    made = prompting.assemble(questions, rows.filter("_n = 1"), rows.filter("_n = 2").withColumn("error", F.lit(None).cast("string")).join(wanted, "qid", "left_semi"))
    true = F.array_join(F.transform(F.filter("judgements", lambda j: j["verdict"]), lambda j: j["option"]), "")
    return made.select("qid", "answer", true.alias("judged_true"), "token_usage.total_tokens", F.round("confidence", 6).alias("confidence"))


def token_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.ledger(read(spark, sf_dir, "answers"))


def budget_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.run_scores(_questions(spark, sf_dir), read(spark, sf_dir, "answers"))


QUERIES = {f.__name__: f for f in (
    clean_text, doc_meta, page_text, paragraph_blocks, chunk_assemble, keywords, term_stats, corpus_stats, doc_profiles,
    structured_terms, bm25_topk, search_chunks, search_docs, sub_queries, retrieve_full, pack_evidence, render_context,
    solve_questions, calculation_text, extract_values, option_values, question_kind, yearly_growth, normalize_answers, parse_replies,
    eval_breakdown, eval_errors, run_diagnostics, suspects, token_ledger, question_ledger, assemble_answers, budget_score,
)}
