"""Answers in one form, accuracy and scores."""

import pytest
from pyspark.sql import functions as F

from paperlode.operators import evaluation as E
from paperlode.operators import prompting


@pytest.mark.parametrize(
    "answer,form,options,judged,expected",
    [
        ("c, a,C", "multi", ["A", "B", "C", "D"], {}, "AC"),
        ("BA", "mcq", ["A", "B"], {}, "B"),
        ("AND", "multi", ["a", "d"], None, "AD"),
        ("", "mcq", ["C", "B"], {}, "B"),
        (None, "tf", ["B", "A"], None, "A"),
        ("x", "multi", ["A", "B", "C"], {"A": True, "C": True, "D": True}, "AC"),
        ("", "mcq", ["A", "B"], {"B": True}, "B"),
        ("", None, [], None, "A"),
        ("E", "multi", None, None, "A"),
    ],
)
def test_normalize(spark, answer, form, options, judged, expected):
    df = spark.createDataFrame([(answer, form, None if options is None else {o: "x" for o in options}, judged)], "a string, f string, o map<string,string>, j map<string,boolean>")
    assert df.select(E.normalize_answer(F.col("a"), F.col("f"), F.col("o"), F.col("j")).alias("x")).first()["x"] == expected


@pytest.mark.parametrize(
    "raw,letters,judged",
    [
        ('{"answer": "B"}', "B", None),
        ('```json\n{"answer": ["A","C"], "opt": {"a": true, "B": false}}\n```', "AC", {"A": True, "B": False}),
        ('so {"choice": "D"} it is', "D", None),
        ("no json", None, None),
        (None, None, None),
        ('{"answer": "A", "judgements": {"A": {"verdict": true, "reason": "r"}}}', "A", {"A": True}),
        ('{"answer": {"A": true, "B": 0, "c": "x"}}', "Ac", None),
        ('{"answer": {"choice": ["B", "D"]}}', "BD", None),
        ('{"answer": "B", "judgements": [{"option": "b", "v": true}, {"letter": "A", "verdict": "false"}, {"key": "B", "verdict": 0}, 3]}', "B", {"A": True, "B": False}),
        ('{"answer": "B", "option_judgements": {}, "opt": {"b": 1, "B": 0, "x": 1}}', "B", {"B": True}),
    ],
)
def test_reply_parsing(spark, raw, letters, judged):
    df = spark.createDataFrame([(raw,)], "r string").select(E.json_object(F.col("r")).alias("v"))
    row = df.select(E.answer_text(F.col("v")).alias("a"), E.judgements(F.col("v")).alias("j")).first()
    assert row["a"] == letters and (row["j"] or None) == judged


def test_answer_in_text(spark):
    df = spark.createDataFrame([("答案：AC。其余",), ('x "answer" : "B" y',), ("plain",)], "r string")
    assert [r["x"] for r in df.select(E.answer_in_text(F.col("r")).alias("x")).collect()] == ["AC", "B", "plain"]


def test_score(spark):
    row = spark.range(1).select(E.budget_score(F.lit(0.17), F.lit(3628186)).alias("s")).first()
    assert row["s"] == pytest.approx(13.2993, abs=1e-4)


def test_missing_prediction_takes_the_fallback(spark):
    questions = spark.createDataFrame([("q", "d", {"B": "x", "A": "y"}, "mcq", "t", "A")], "qid string, domain string, options map<string,string>, answer_format string, type string, answer string")
    answers = spark.createDataFrame([], "answer_id long, qid string, run_id string, answer string, option_judgements map<string,boolean>, answered_at timestamp, ingested_at timestamp")
    row = E.scored(questions, answers).first()
    assert row["was_missing"] and row["pred"] == "A" and row["correct"] == 1
    keys = {r["key"]: r["accuracy"] for r in E.breakdown(E.scored(questions, answers)).collect()}
    assert keys == {"overall": 1.0, "domain:d": 1.0, "format:mcq": 1.0, "type:t": 1.0}


def test_reasons_and_evidence_of_judgements(spark):
    raw = '{"judgements": {"A": {"verdict": true, "reason": "r", "evidence_ids": ["E1"]}, "C": {"v": false, "r": "q", "e": ["E2", "E3"]}}}'
    rows = spark.createDataFrame([(raw,)], "r string").select(E.judged_options(E.json_object(F.col("r"))).alias("j")).first()["j"]
    assert [tuple(x) for x in rows] == [("A", True, "r", ["E1"]), ("C", False, "q", ["E2", "E3"])]


def test_diagnostics_count_unanswered_questions(spark):
    questions = spark.createDataFrame([("q", "d", {"A": "x", "B": "y"}, "mcq", "t", "B"), ("r", "d", {"A": "x"}, "tf", None, None)], "qid string, domain string, options map<string,string>, answer_format string, type string, answer string")
    kinds = spark.createDataFrame([("q", "calculation", True), ("r", "judgement", False)], "qid string, kind string, requires_calculation boolean")
    answers = spark.createDataFrame([(1, "q", "B", "", ["d1"])], "answer_id long, qid string, answer string, error string, used_doc_ids array<string>").selectExpr("*", "current_timestamp() AS answered_at", "current_timestamp() AS ingested_at")
    got = {r["key"]: (r["total"], r["errors"], r["no_evidence"], r["accuracy"], r["no_evidence_rate"]) for r in E.diagnostics(E.diagnosed(questions, kinds, answers)).collect()}
    assert got == {"overall": (2, 0, 1, 1.0, 0.5), "domain:d": (2, 0, 1, 1.0, 0.5), "format:mcq": (1, 0, 0, 1.0, 0.0), "format:tf": (1, 0, 1, None, 1.0), "kind:calculation": (1, 0, 0, 1.0, 0.0), "kind:judgement": (1, 0, 1, None, 1.0), "calc:True": (1, 0, 0, 1.0, 0.0), "calc:False": (1, 0, 1, None, 1.0)}


def test_ledger_by_question(spark):
    rows = spark.createDataFrame([(1, "q", "r", (1, 2, 3)), (1, "q", "r", (1, 2, 3)), (2, "q#verify", "r", (4, None, 4)), (3, None, "r", (9, 9, 9))], "answer_id long, qid string, run_id string, token_usage struct<prompt_tokens: long, completion_tokens: long, total_tokens: long>")
    assert {r["qid"]: (r["answers"], r["total_tokens"]) for r in E.ledger(rows, "qid").collect()} == {"q": (1, 3), "q#verify": (1, 4), None: (2, 7)}


def test_assembly_of_two_passes(spark):
    questions = spark.createDataFrame([("q", "multi", {"A": "x", "B": "y"}), ("r", "mcq", {"A": "x", "B": "y"})], "qid string, answer_format string, options map<string,string>")
    reply = "qid string, raw string, prompt_tokens long, completion_tokens long, total_tokens long, error string"
    first = spark.createDataFrame([("q", '{"answer": "A", "judgements": {"A": true}, "confidence": 0.3}', 1, 1, 2, None), ("r", "答案：B", 5, 0, 5, None)], reply)
    second = spark.createDataFrame([("q", '{"answer": "AB", "confidence": 0.9}', 2, 1, 3, None), ("r", None, 0, 0, 0, "down")], reply)
    got = {r["qid"]: r for r in prompting.assemble(questions, first, second).collect()}
    assert got["q"]["answer"] == "AB" and got["q"]["token_usage"]["total_tokens"] == 5 and got["q"]["confidence"] == 0.9 and "second_output" in got["q"]["raw_model_output"]
    assert [(j["option"], j["verdict"]) for j in got["q"]["judgements"]] == [("A", True), ("B", True)]
    assert got["r"]["answer"] == "B" and got["r"]["raw_model_output"] == "答案：B" and [j["verdict"] for j in got["r"]["judgements"]] == [False, True]
