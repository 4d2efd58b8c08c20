import pytest

from paperlode.llm import sentences as S

NONE = S.train([])


def units(text, model=NONE):
    return [text[a:b] for a, b in S.sentences_of(text, model)]


@pytest.mark.parametrize(
    "parts",
    [
        ["本期净利润为5.4亿元。", "这笔减值究竟由谁承担？！"], ["“我们不会降价。”负责人重申。", "他写道：“请参阅第7.3节。”", "受季节因素影响，下降。"], ["《保单还能退吗？》一文撰写于2026年。"],
        ["该条款（详见附录2。另见释义）自2020年起施行。"], ["口号是“稳健！长远！”，印在保单上。"], ["“何时生效？？”——有投资者这样问。", "已用41.3%……其余未动用。"], ["董事会通过了该议案.", "其余不变。"],
        ["監査人は「問題はない。」と述べた。", "配当は見送られました！"], ["“해지가 가능합니까?”라고 계약자가 물었다."], ["“Hold the line!” was the slogan.", "The trustee warned: “Redeem early!”", "It cost RMB 4.1m in all."],
        ["Dr. Osterwick signed it.", "What now?"], ["«Будет ли выкуп?» — спросил аудитор.", "Дивидендов не будет!"], ["« Faut-il corriger ? » demanda l’auditeur.", "Aucun dividende !"], ["Die Prüfung ergab: „Keine Mängel.“", "Das kostet 3 €!"],
        ["कोई लाभांश नहीं!", "ब्याज दर 4% है।"], ["1. See the annex.", "Then go on."],
    ],
)
def test_sentences(parts):
    text = ("" if ord(parts[0][0]) > 0x2E80 or "「" in parts[0] else " ").join(parts)
    joint = "" if any("一" <= c <= "鿿" for c in parts[0]) else " "
    text = joint.join(parts)
    assert units(text) == parts


def test_lines():
    assert units("第三节 重要事项\n\n等待期9日\n备案文件V2.1已归档") == ["第三节 重要事项", "等待期9日", "备案文件V2.1已归档"]
    wrapped = "甲" * 28 + "\n" + "乙" * 28 + "\n" + "丙。"
    assert units(wrapped) == [wrapped]
    assert units("Key figures\n\nThe reinsurer reviewed the rate of participating policies and left\nthe rest unchanged. Next one.") == ["Key figures", "The reinsurer reviewed the rate of participating policies and left\nthe rest unchanged.", "Next one."]


def test_edges():
    assert units(None) == units("") == units(" \n\t ") == []
    assert units("​甲。​乙。") == ["甲。", "乙。"]
    assert len(units("句子。" * 30_000)) == 30_000


def test_gaps_are_learned_without_marks():
    """A long stretch without marks or blanks is cut where text with its marks stripped was cut; a short line is not."""
    parts = ["董事会批准了年度预算", "监事会没有提出异议", "公司随后披露公告", "评级机构维持评级不变", "投资者询问分红安排"]
    texts = ["。".join(parts[(i + k * (1 + i // 5)) % 5] for k in range(5)) + "。" for i in range(20)]
    model = S.train([S.examples(t) for t in texts])
    assert model.longest < 20
    assert units("监事会没有提出异议董事会批准了年度预算公司随后披露公告", model) == [parts[1], parts[0], parts[2]]
    assert units("监事会没有提出", model) == ["监事会没有提出"]


def test_long_paragraphs_count_as_evidence():
    """The end of a paragraph of 3,000 characters is read like that of a short one."""
    long = "Alpha beta gamma. " * 170 + "It ended at Zorbex."
    _, between, _ = S.examples(long + "\n\nNext one follows.")
    assert [(x.behind, x.ahead) for x in between] == [(("zorbex",), ("Next",))]


DOC = "doc_id long, text string, char_start int"


def test_unpunctuated_script_is_learned(spark):
    a, b = "คณะกรรมการยังไม่จ่ายเงินปันผล", "อัตราดอกเบี้ยอยู่ที่ร้อยละ 2.5 ต่อปีตามสัญญา"
    rows = [(i, f"{a}\n\n{b}\n\n{a} {b}", 1) for i in range(60)]
    got = {(r["char_start"], r["char_end"]) for r in S.sentences(spark.createDataFrame(rows, DOC)).filter("doc_id = 5").collect()}
    text = rows[5][1]
    assert [text[x:y] for x, y in sorted(got)] == [a, b, a, b]


def test_tables(spark):
    rows = [(1, None, 0), (2, "", 0), (None, "甲。", 0), (3, "甲。乙。", 0)]
    got = sorted(map(tuple, S.sentences(spark.createDataFrame(rows, DOC)).collect()))
    assert got == [(3, 0, 2), (3, 2, 4)]
    assert S.sentences(spark.createDataFrame([], DOC)).count() == 0


def test_held_out_abbreviations(spark):
    """Which words before a stop end no sentence is learned from where paragraphs end."""
    names = [f"Nam{c}" for c in "abcdefghij"]
    both = lambda i, k: [f"The fund Xq. {names[(i + k) % 10]} paid the fee.", "The fee was paid."][:: 1 if (i + k) % 2 else -1]
    rows = [(i, "\n\n".join(" ".join(both(i, k)) for k in range(4)), 0) for i in range(80)]
    got = S.sentences(spark.createDataFrame(rows, DOC)).filter("doc_id = 3").count()
    assert got == 8


def test_all_documents_are_learned_from(spark, monkeypatch):
    """Words of every document, also far down in it, and all stretches whose marks are stripped count, in whatever shards."""
    monkeypatch.setattr(S, "SHARD_CHARS", 100_000, raising=False)
    name = lambda i: "".join(chr(97 + int(c)) for c in f"{i:04d}")
    rows = [(i, f"It ended at Zx{name(i)}.\n\nNext.", 0) for i in range(8_400)]
    rows.append((9_000, "Alpha beta. " * 500 + "It ended at Zxfar.\n\nNext.\n\n" + "\n\n".join("董事会批准。" + "甲" * (60 + i) + "。" for i in range(5)), 0))
    model = S.learn(spark.createDataFrame(rows, DOC))
    assert {f"stop<zx{name(i)}" for i in range(8_400)} | {"stop<zxfar"} <= set(model.evidence)
    assert model.longest == 64
