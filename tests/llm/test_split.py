from hypothesis import given, settings
from hypothesis import strategies as st
import pytest

from paperlode.llm import split as S

FILING = "doc_id string, domain string, text string, piece_no int"
CHUNK = "chunk_id string, doc_id string, domain string, section_path array<string>, text string, char_start int, char_end int"


def limits(spark, *rows):
    return spark.createDataFrame(list(rows) or [("law", 20, 5), ("default", 30, 6)], "domain string, max_chars int, overlap_chars int")


def cut(spark, texts, most, over):
    df = spark.createDataFrame([(i, t, most, over) for i, t in enumerate(texts)], "id int, text string, m int, o int")
    return [r["pieces"] for r in sorted(S.split_text(df, "text", "m", "o").collect(), key=lambda r: r["id"])]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="ab。，\n 句𠮷é́", max_size=120), max_size=6), st.integers(2, 40), st.integers(0, 20))
def test_pieces_cover_the_text(spark, texts, most, over):
    over_in_force = min(over, most // 2)
    for text, pieces in zip(texts, cut(spark, texts, most, over)):
        end = 0
        for k, p in enumerate(pieces):
            assert len(p["text"]) <= most and text[p["start"] : p["end"]] == p["text"]
            assert p["start"] == (0 if k == 0 else end - over_in_force)
            end = p["end"]
        assert end == len(text) and (len(pieces) <= 1) == (len(text) <= most)


def test_strong_boundaries_first(spark):
    (pieces,) = cut(spark, ["第一段在此。\n\n第二段也在此，还有很多话要说。结束了。"], 16, 0)
    assert pieces[0]["text"] == "第一段在此。\n\n"


def test_edges(spark):
    long = "无边界" * 50_000
    got = cut(spark, [None, "", "abc", long], 1000, 100)
    assert got[0] == [] and got[1] == [] and [p["text"] for p in got[2]] == ["abc"] and sum(len(p["text"]) for p in got[3]) == len(long) + 100 * (len(got[3]) - 1)
    df = spark.createDataFrame([("x" * 50, None, None), ("y" * 50, 10, -3), ("z" * 50, 0, 9)], "text string, m int, o int")
    assert sorted(len(r["pieces"]) for r in S.split_text(df, "text", "m", "o").collect()) == [1, 5, 50]


def test_places_in_the_filing(spark):
    text = "[PAGE 1]\n第一节 总则\n\n" + "甲" * 15 + "\n\n[PAGE 2]\n1.1 细节\n" + "乙" * 25
    body = text[9:].replace("[PAGE 2]\n", "")
    filings = spark.createDataFrame([("d", " LAW", text, 7), ("d", " LAW", text, 7), (None, None, "x" * 99, 7), ("e", None, None, 7)], FILING)
    chunks = spark.createDataFrame([("c", "d", "law", ["p"], body, 9, len(text)), ("n", "d", "law", None, body, 9, len(text)), ("o", "gone", "odd", None, "z" * 31, 0, 31)], CHUNK)
    pieces = S.one_delivery(S.split_oversized(filings, chunks, limits(spark))).collect()
    for p in pieces:
        if p["item_id"] in ("d", "c", "n"):
            assert text[p["char_start"] : p["char_end"]].replace("[PAGE 2]\n", "") == p["text"].replace("[PAGE 2]\n", "")
    paths = {(p["item_id"], p["piece_no"]): p["section_path"] for p in pieces}
    assert paths["c", 1] == ["p"] and paths["n", 0] == ["第一节 总则"] and paths["d", 0] == []
    found = S.oversized(S.split_oversized(filings, chunks, limits(spark)))
    assert sorted((r["item_table"], r["item_id"]) for r in found.filter("item_id IS NOT NULL").collect()) == [("chunks", "c"), ("chunks", "n"), ("chunks", "o"), ("filings", "d")]


def test_empty_tables_and_no_default(spark):
    filings, chunks = spark.createDataFrame([], FILING), spark.createDataFrame([("c", "d", "odd", None, "z" * 500, 0, 500)], CHUNK)
    assert S.oversized(S.split_oversized(filings, chunks, limits(spark, ("law", 20, 5)))).count() == 0
    assert S.split_oversized(filings, chunks.limit(0), limits(spark)).count() == 0


@pytest.mark.parametrize("name", ["p3_found"])
def test_same_as_sql(spark, sf_dir, name):
    import os

    import duckdb

    from paperlode.llm import queries

    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    assert sorted(map(tuple, queries.QUERIES[name](spark, sf_dir).collect())) == sorted(con.sql(queries.SQL[name]).fetchall())
