import pytest
from pyspark.sql import functions as F

from paperlode.llm import replies as R

Q = "根据报告，2024年净利润的变动是否超过 5%？"
OPTIONS = ["增长三成", "下降一成"]


@pytest.mark.parametrize(
    "raw,shape,answered",
    [
        (None, "empty", False), ("", "empty", False), ("​　", "empty", False), ("null", "empty", False), ("{}", "empty", False), ("[]", "empty", False), ("N/A", "empty", False), ("……", "empty", False),
        ('{"answer": null}', "empty", False), ("答案：", "empty", False), ("```json\n```", "empty", False), ("A", "plain", True), ("Answer: A.", "plain", True), ("答案为ABCD", "plain", True), ('{"answer": "B"}', "plain", True),
        ('{"answer": "B", "reason": "附注', "truncated", False), ("答案：A。附注说明该金额已", "truncated", True), ("附注说明该金额已剔除。故选A", "plain", True), (Q, "copy", False), ("题干：" + Q, "copy", False),
        (Q.replace("，", " ") + "\nA. 增长三成\nB. 下降一成", "copy", False), ('{"answer": "' + Q + '", "e": []}', "copy", False), ("题目问：“" + Q + "”答案：A。附注说明该金额已剔除。", "plain", True), ("抱歉，我无法回答这个问题。", "plain", False),
    ],
)
def test_shapes(raw, shape, answered):
    got = R.taken_apart(raw, Q, OPTIONS)
    assert got["shape"] == shape and (shape == "truncated" or got["answered"] == answered)


TEXTS = {
    "en": "The board approved the annual budget and the auditors raised no objection to the figures. The company will publish its report in the spring, and the change was within the range that the directors had named. Investors asked about the dividend which the management wants to keep as it is.",
    "de": "Der Vorstand hat den Haushalt genehmigt und die Prüfer haben keine Einwände gegen die Zahlen erhoben. Die Gesellschaft wird ihren Bericht im Frühjahr veröffentlichen, und die Änderung lag in dem Rahmen, den die Leitung genannt hatte.",
    "fr": "Le conseil a approuvé le budget annuel et les auditeurs n’ont soulevé aucune objection sur les chiffres. La société publiera son rapport au printemps, et la variation restait dans la fourchette que la direction avait indiquée.",
    "es": "El consejo aprobó el presupuesto anual y los auditores no plantearon ninguna objeción sobre las cifras. La sociedad publicará su informe en la primavera, y la variación quedó dentro del margen que la dirección había indicado.",
    "pt": "O conselho aprovou o orçamento anual e os auditores não levantaram nenhuma objeção sobre os números. A sociedade publicará o seu relatório na primavera, e a variação ficou dentro da margem que a direção tinha indicado.",
    "it": "Il consiglio ha approvato il bilancio annuale e i revisori non hanno sollevato alcuna obiezione sulle cifre. La società pubblicherà la sua relazione in primavera, e la variazione è rimasta nel margine che la direzione aveva indicato.",
    "nl": "Het bestuur heeft de jaarlijkse begroting goedgekeurd en de accountants hadden geen bezwaar tegen de cijfers. De vennootschap zal haar verslag in het voorjaar publiceren, en de verandering bleef binnen de marge die de leiding had genoemd.",
    "vi": "Hội đồng đã phê duyệt ngân sách hàng năm và các kiểm toán viên không có ý kiến phản đối về các số liệu. Công ty sẽ công bố báo cáo vào mùa xuân, và thay đổi nằm trong phạm vi mà ban giám đốc đã nêu.",
}
REPLIES = {
    "en": "The figures of the report support the first statement, and the others are not named in the text.", "de": "Die Zahlen des Berichts stützen die erste Aussage, die anderen werden im Text nicht genannt.",
    "fr": "Les chiffres du rapport confirment la première affirmation, les autres ne figurent pas dans le texte.", "es": "Las cifras del informe confirman la primera afirmación, las otras no figuran en el texto.",
    "pt": "Os números do relatório confirmam a primeira afirmação, as outras não constam do texto.", "it": "Le cifre della relazione confermano la prima affermazione, le altre non figurano nel testo.",
    "nl": "De cijfers van het verslag bevestigen de eerste bewering, de andere worden in de tekst niet genoemd.", "vi": "Các số liệu của báo cáo xác nhận nhận định thứ nhất, các nhận định khác không có trong văn bản.",
}


def counts(*names):
    out = {}
    for name in names:
        for g in R.grams_of(TEXTS[name]):
            out.setdefault(name, {})[g] = out.get(name, {}).get(g, 0) + 1
    return out


def test_languages():
    none, known = R.Profiles({}), R.Profiles(counts(*TEXTS))
    assert R.language("证据显示该指标为三亿元，与选项一致", none) == "zh" and R.language("条項には書面による通知が必要と明記", none) == "ja"
    assert R.language("Договор требует уведомления", none) == "ru" and R.language("A", none) == "" and R.expected_language(Q + "请用英文说明理由。", none) == "en"
    assert R.expected_language("How many? Please give the reasons in Chinese.", none) == "zh"
    assert {name: R.language(text, known) for name, text in REPLIES.items()} == {name: name for name in REPLIES}
    assert R.language("Thе сlause rеquires nоtice of the case that the directors named", known) == "en"
    assert not R.foreign(REPLIES["de"], "en", none) and R.foreign(REPLIES["de"], "zh", none) and not R.foreign("12", "en", known) and not R.foreign(REPLIES["de"], "", known)
    assert {(a, b) for a in REPLIES for b in REPLIES if R.foreign(REPLIES[a], b, known)} == {(a, b) for a in REPLIES for b in REPLIES if a != b}


def test_languages_without_a_profile_are_still_others():
    """A reply in a language that no document is written in is not taken for English."""
    known = R.Profiles(counts("en", "de", "fr", "es"))
    assert all(R.foreign(REPLIES[name], "en", known) for name in ("pt", "it", "nl", "vi")) and not R.foreign(REPLIES["en"], "en", known)


def test_profiles_of_documents(spark):
    rows = [(i, spelt, TEXTS.get(name)) for i, (spelt, name) in enumerate([("EN", "en"), ("en-GB", "en"), ("eng", "en"), ("DE", "de"), ("ger", "de"), ("fr", "fr"), (None, "fr"), ("de", "")])]
    known = R.profiles(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert known.names == ["de", "en", "fr"] and known.language(REPLIES["de"]) == "de"
    assert R.profiles(spark.createDataFrame([], "doc_id long, lang string, text string")).names == []


ANSWER = "answer_id long, qid string, raw_model_output string, defect string"
QUESTION = "qid string, question string, options map<string,string>"


def test_defects(spark):
    questions = [(f"q{i}", f"关于第{i}号文件的净利润是否超过{i}%？", {"A": "是"}) for i in range(8)] + [("q0", "关于第0号文件的净利润是否超过0%？", {"A": "是"}), (None, None, None), ("n", None, None)]
    ok = "证据显示该指标与选项表述一致，附注说明该金额已剔除。故选A"
    rows = [(i, f"q{i}", ok, "x") for i in range(8)] + [(10 + i, f"q{i}", f"很遗憾，第{i}号文件的内容不在讨论范围之内。", "x") for i in range(8)]
    rows += [(30, "q1", None, "x"), (31, "q2", "The evidence puts the figure as the option states. Hence A", "x"), (31, "q2", "The evidence puts the figure as the option states. Hence A", "x"), (32, "q3", "关于第3号文件的净利润是否超过3%？", "x"), (33, "gone", "Answer: A.", "x"), (34, None, "答案：A。附注", "x"), (None, "q1", None, "x"), (35, "q1", "甲" * 200_000 + "。故选A", "x")]
    got = dict(map(tuple, R.defects(spark.createDataFrame(rows, ANSWER), spark.createDataFrame(questions, QUESTION)).collect()))
    assert {k: v for k, v in got.items() if k >= 30} == {30: "empty", 31: "wrong_language", 32: "copy", 34: "truncated"}
    assert {k for k, v in got.items() if v == "refusal"} == set(range(10, 18)) and not any(k < 10 for k in got)


def test_empty_tables(spark):
    assert R.defects(spark.createDataFrame([], ANSWER), spark.createDataFrame([], QUESTION)).count() == 0


def test_classes_against_all_pairs(spark):
    base = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    texts = [" ".join(base), " ".join([*base[:-1], "zz"]), " ".join(base[::-1]), " ".join([*base, "end"]), "one two", "one two three"] + [" ".join([*base[:3], str(i), *base[4:]]) for i in range(70)]
    got = dict(map(tuple, R.classes(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).collect()))
    shingles = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    parent = list(range(len(texts)))
    root = lambda x: x if parent[x] == x else root(parent[x])
    for i in range(len(texts)):
        for j in range(i):
            if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    assert got == {i: root(i) for i in range(len(texts))}


def connected(texts):
    """Classes by comparing all pairs."""
    shingles = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in map(str.split, texts)]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in range(len(texts))}


@pytest.mark.parametrize("leaders", [1, 4])
def test_large_bucket_against_all_pairs(spark, monkeypatch, leaders):
    """500 near texts in one bucket: chains that lead away from every leader stay whole, strangers stay apart."""
    signed, words = R.signed, [f"w{i}" for i in range(400)]
    monkeypatch.setattr(R, "LEADERS", leaders)
    monkeypatch.setattr(R, "signed", lambda texts: signed(texts).withColumn("bands", F.array(F.lit(1).cast("long"))))
    texts = [" ".join(words[3 * i : 3 * i + 40]) for i in range(120)] + [" ".join([*words[:20], f"x{i}", *words[21:40]]) for i in range(180)]
    texts += [" ".join(f"s{i}_{k}" if k % 7 == i % 7 else f"c{k}" for k in range(36)) for i in range(200)]
    texts = list(dict.fromkeys(texts))
    got = dict(map(tuple, R.classes(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).collect()))
    assert got == connected(texts)


def test_rewordings_are_one_prompt(spark):
    """A class whose replies answer near-copies of one question is no template; unrelated questions make one."""
    base = [f"word{i}" for i in range(30)]
    ask = [" ".join(base), " ".join([*base, "please"]), "Who signed the lease of the new office?"]
    rows = [(i, f"q{i}", "Sadly nothing can be said on that.", "") for i in range(3)]
    said = lambda n: {r["refusal"] for r in R.templates(R.cut_lineage(R.replies(spark.createDataFrame(rows[:n], ANSWER), spark.createDataFrame([(f"q{i}", q, None) for i, q in enumerate(ask)], QUESTION)))).collect()}
    assert said(2) == {False} and said(3) == {True}


def test_one_question_makes_no_template(spark):
    """Replies to one question, or to its copies under other ids, are no recurring refusal; to two questions they are."""
    words = " ".join(f"word{i}" for i in range(30))
    questions = [("q1", "What is the margin of the first year?", None), ("q2", "what is the margin of the first year ?", None), ("q3", "Who signed the lease?", None), ("q4", "Which rate was agreed?", None)]
    rows = [(1, "q1", words + " once.", ""), (2, "q1", words + " twice.", ""), (3, "q2", words + " thrice.", ""), (4, "q3", words[::-1] + " a.", ""), (5, "q4", words[::-1] + " b.", "")]
    parsed = R.cut_lineage(R.replies(spark.createDataFrame(rows, ANSWER), spark.createDataFrame(questions, QUESTION)))
    got = {(r["prompts"], r["replies"], r["refusal"]) for r in R.templates(parsed).collect()}
    assert got == {(1, 3, False), (2, 2, True)}
