"""Blocks, folds and chunks on small documents."""

from paperlode.config import Chunking
from paperlode.operators import chunking

SCHEMA = "doc_id string, domain string, title string, text string"


def chunks(spark, rows, **settings):
    df = chunking.chunk(chunking.documents(spark.createDataFrame(rows, SCHEMA)), Chunking(by_domain={}, **settings))
    return sorted(df.collect(), key=lambda r: (r["doc_id"], r["chunk_no"]))


def test_overlap_is_whole_blocks_and_not_checked_again(spark):
    assert chunking.assigned([10, 10, 10], [False] * 3, 10, 5, 5) == [[0], [0, 1], [1, 2]]


def test_short_rest_is_dropped(spark):
    assert chunking.assigned([50], [False], 1800, 260, 80) == []
    assert chunks(spark, [("d", None, "t", "short")]) == []


def test_boundary_closes_a_chunk(spark):
    assert chunking.assigned([100, 10, 100], [False, True, False], 1000, 5, 80) == [[0], [0, 1, 2]]


def test_pages_sections_and_offsets(spark):
    text = "[PAGE 3]\n\n第一章 总则\n\n" + "甲" * 60 + "\n\n[PAGE 4] 1.1 细节\n\n" + "乙" * 60
    got = chunks(spark, [("d", "research", "t", text)], min_chars=10, overlap_chars=0)
    assert got[0]["page_start"] == 3 and got[-1]["page_end"] == 4
    assert got[-1]["section_path"] == ["第一章 总则", "1.1 细节"]


def test_large_block_is_cut(spark):
    got = chunks(spark, [("d", None, "t", "。".join(["句" * 30] * 10) + "。")], max_chars=100, overlap_chars=0, min_chars=10)
    assert len(got) > 2 and all(len(r["text"]) <= 115 + 100 for r in got)
    assert "".join(r["text"] for r in got).count("句") >= 300


def test_nulls_repeats_and_empty_table(spark):
    long = "一二三四五六七八九十" * 20
    rows = [("a", None, None, None), ("b", None, None, ""), (None, "x", "t", long), ("c", None, "t", long), ("c", None, "t", long)]
    got = chunks(spark, rows)
    assert {r["doc_id"] for r in got} == {"c"} and len(got) == 1
    assert chunks(spark, [("z", None, None, None)]) == []
    extra = spark.createDataFrame([("c", None, "t", long, "clash", 1)], SCHEMA + ", page string, no int")
    assert chunking.chunk(chunking.documents(extra)).count() == 1
