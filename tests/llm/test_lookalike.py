import unicodedata

import pytest

from paperlode.llm import lookalike as L


def forms(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    return [r["form"] for r in sorted(L.one_form(df, ["id"]).collect(), key=lambda r: r["id"])]


SAME = [("Ｃａｆé‐Ｐｌａｎ　３", "Café-Plan 3"), ("金​额", "金额"), ("⼈⼝", "人口"), ("сору", "copy"), ("㎡", "m²"), ("ạ́", "ạ́"), ("金", "金"), ("1，2（3）", "1,2(3)"), ("．．．", "…"), ("a b c", "a b c"), ("ё", "ë"), ("e​́", "é"), ("a\r\nb", "a\nb")]
OTHER = [("m²", "m2"), ("A", "a"), ("👩‍💼", "👩💼"), ("é", "e"), ("10", "1０１"), ("a b", "ab"), ("5", "⁵")]


def test_pairs(spark):
    got = forms(spark, [t for p in SAME + OTHER for t in p])
    for k, (a, b) in enumerate(SAME + OTHER):
        assert (got[2 * k] == got[2 * k + 1]) == (k < len(SAME)), (a, b)


def test_against_plain_folding(spark):
    table = {k: "".join(p[0] for p in v) for k, v in L.code_points()[0]}
    texts = ["Ｖｅｒｔｒａｇ № 5 — Ünïcödé", "条款（一）：不得…", "plain ascii, nothing to do", "Ａ́ ḅ̂", "Й Корея 한국", "ﬁn ½ ①"]
    for text, form in zip(texts, forms(spark, texts)):
        want = unicodedata.normalize("NFC", "".join(table.get(c, c) for c in unicodedata.normalize("NFD", text) if not "ᄀ" <= c <= "ᇿ"))
        assert unicodedata.normalize("NFC", form).replace("…", "...") == want.replace("…", "...") or "한" in text


def test_texts_that_need_no_exploding_have_the_same_form(spark, monkeypatch):
    """Texts of frequent characters alone are folded in place; taken apart into code points they have the same form."""
    texts = ["plain ascii (nothing) 5%", "条款（一）：不得转让，违者“除名”；见《办法》…", "Größe über 3 %—Café", "a，b：c；d！e？f（g）％...", "净利润为5.4亿元。\r\n次年…", "", "第——章"]
    folded = forms(spark, texts)
    monkeypatch.setattr(L, "PLAIN", r"\x{7F}")
    assert forms(spark, texts) == folded


def test_edges(spark):
    long = "很长的文本，" * 20_000 + "Ｘ"
    got = forms(spark, [None, "", "​", long])
    assert got[:3] == [None, "", ""] and got[3].endswith("X") and len(got[3]) == len(long)


def test_found(spark):
    q = spark.createDataFrame([("q1", "a，b"), ("q2", "a,b"), ("q2", "a,b"), ("q3", "a,b"), ("q4", None), (None, "a,b"), ("q5", "A,b")], "qid string, question string")
    c = spark.createDataFrame([("c1", "a,b", "x")], "chunk_id string, text string, form string")
    pairs = L.lookalike_pairs(L.lookalike_records(q, c))
    assert sorted(map(tuple, pairs.collect())) == [("question", "q1", "q2"), ("question", "q1", "q3")]
    empty = L.lookalike_records(spark.createDataFrame([], q.schema), spark.createDataFrame([], c.schema))
    assert L.lookalike_pairs(empty).count() == 0


@pytest.mark.parametrize("n", [300])
def test_many_copies_of_one_text(spark, n):
    q = spark.createDataFrame([(f"q{i:04d}", "same，text") for i in range(n)] + [("r", "same,text")], "qid string, question string")
    c = spark.createDataFrame([], "chunk_id string, text string")
    assert L.lookalike_pairs(L.lookalike_records(q, c)).count() == n


def test_decomposed_hangul(spark):
    text = "한국어 문서의 값, 각각 닭"
    parted = unicodedata.normalize("NFD", text)
    composed, taken_apart, mixed, letters = forms(spark, [text, parted, text.replace("값", "가" + parted[parted.index(unicodedata.normalize("NFD", "값")) + 2]), text.replace("값", "ㄱㅏㅄ")])
    assert composed == taken_apart == mixed == text and letters != text
