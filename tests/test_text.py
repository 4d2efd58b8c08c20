"""Text functions against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from paperlode import config
from paperlode.functions import text as T


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "function,value,expected",
    [
        (T.compact_whitespace, " a　 \t b\n\n\n\nc ", "a b\n\nc"),
        (T.compact_whitespace, None, None),
        (T.compact_whitespace, "", ""),
        (T.ngrams, "营业收入", ["营业", "业收", "收入", "营业收", "业收入", "营业收入"]),
        (T.ngrams, "营业", ["营业"]),
        (T.plain_tokens, "PB 12.5%　营业", ["pb", "12.5%", "营业"]),
        (T.plain_tokens, None, []),
        (T.structured_terms, "根据第三条，2024年营收12亿元，《年度报告》第三条", ["第三条", "2024", "12亿元", "《年度报告》"]),
        (T.metric_terms, "回购与营业收入", ["营业收入", "回购"]),
        (T.numbers, "1,234 万元 和 5%", ["1,234万元", "5%"]),
        (T.years, "2023 2024 2023", ["2023", "2024"]),
        (T.strong_words, "不得超过，不得", ["不得", "超过"]),
        (T.doc_hints, "see FC_text01 and annual_abc_report", ["text01", "annual_abc_report"]),
        (T.doc_aliases, "annual_a_b_report", ["annual_a_b_report", "a", "b"]),
        (T.doc_aliases, "text07", ["text07", "fc_text07"]),
        (T.sentences, "第一句话在这里结束。短。第二句话也在这里结束", ["第一句话在这里结束。", "第二句话也在这里结束"]),
        (T.keywords, "2024年营收，2024年", ["2024", "年营收"]),
    ],
)
def test_values(spark, function, value, expected):
    got = one(spark, value, function)
    assert got == expected if not isinstance(expected, list) or function is not T.keywords else got[:2] == expected[:2]


def test_tokens_count_for_each_source(spark):
    tokens = one(spark, "净利润", T.tokenize)
    assert tokens.count("净利润") == 3  # lexicon, triple, whole run


def test_count_contains_repeats(spark):
    row = spark.createDataFrame([("a 1 0 b", ["10", "10", "B", "x"])], "t string, w array<string>").select(T.count_contains(F.col("t"), F.col("w")).alias("n")).first()
    assert row["n"] == 3


def test_stable_id(spark):
    assert spark.range(1).select(T.stable_id(F.lit("d1"), F.lit("0"), F.lit("0")).alias("i")).first()["i"] == "a9423b16e3c5"


def test_settings(monkeypatch, tmp_path):
    monkeypatch.setenv("PL_A", "x")
    (tmp_path / "s.yaml").write_text("a: ${PL_A:y}\nb: ['${PL_B:z}', 2]\nc: no ${PL_A}\n", encoding="utf-8")
    assert config.settings(str(tmp_path / "s.yaml")) == {"a": "x", "b": ["z", 2], "c": "no ${PL_A}"}
