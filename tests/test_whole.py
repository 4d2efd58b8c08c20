"""Searches ask every question, whatever its id."""

import pytest

from paperlode.plans import registry

QUESTION = "qid string, domain string, question string, options map<string,string>, type string, doc_ids array<string>, answer_format string, answer string"
CHUNK = "chunk_id string, doc_id string, domain string, title string, section_path array<string>, text string, keywords array<string>, page_start int, page_end int, char_start int"
QIDS = {"q_1", "q_2", "q_50", "q_51", "plain"}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = [(q, "x", "营业收入同比增长多少？", {"A": "20%", "B": "25%"}, "", ["d1"] if i % 2 else None, "mcq", "A") for i, q in enumerate(sorted(QIDS))]
    spark.createDataFrame(rows, QUESTION).write.parquet(f"{folder}/questions.parquet")
    text = "营业收入2024年为100亿元。" + "，" * 80 + "营业收入2025年为1200000万元"
    chunks = [(f"d{i}__0", f"d{i}", "x", "年报", ["第一章"], f"第{i}份。{text}", ["营业收入"], 1, 1, 0) for i in range(4)]
    spark.createDataFrame(chunks, CHUNK).write.parquet(f"{folder}/chunks.parquet")
    return folder


@pytest.mark.parametrize("name", ["bm25_topk", "search_chunks", "retrieve_full", "pack_evidence", "render_context", "solve_questions", "calculation_text"])
def test_every_question_is_asked(spark, tables, name):
    rows = registry.QUERIES[name](spark, tables)
    assert {r[0] for r in rows.select("query_id" if "query_id" in rows.columns else "qid").collect()} == QIDS
