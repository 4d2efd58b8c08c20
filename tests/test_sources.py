"""Files in, files out, and the incremental run."""

import json

from pyspark.sql import functions as F

from paperlode.operators import prompting
from paperlode.sources import readers, writers
from paperlode.streaming import incremental


def test_files_of_all_kinds(spark, tmp_path):
    folder = tmp_path / "raw" / "law"
    folder.mkdir(parents=True)
    (folder / "a_b-c.txt").write_text("plain text", encoding="utf-8")
    (folder / "p.html").write_text("<p>one</p><script>no</script><p>two &amp; three</p>", encoding="utf-8")
    (folder / "j.json").write_text(json.dumps({"text": "from json"}), encoding="utf-8")
    (folder / "bad.json").write_text("{", encoding="utf-8")
    (folder / "x.pdf").write_bytes(b"%PDF")
    (folder / "skip.bin").write_bytes(b"0")
    files = readers.discover(spark, str(tmp_path / "raw"))
    docs = {r["doc_id"]: r for r in readers.parse_files(files, {".pdf": [("one", lambda b: ["short"]), ("two", lambda b: ["p" * 150, "q" * 150])]}).collect()}
    assert set(docs) == {"a_b-c", "p", "j", "bad", "x"} and docs["a_b-c"]["title"] == "a b c" and docs["a_b-c"]["domain"] == "law"
    assert docs["p"]["text"] == "one\ntwo & three" and docs["j"]["text"] == "from json" and docs["bad"]["error"] and not docs["p"]["error"]
    assert [p["source"] for p in docs["x"]["pages"]] == ["two", "two"] and docs["x"]["text"].startswith("[PAGE 1]\n")


def test_pages(spark):
    df = spark.createDataFrame([("<!-- page: 2 -->\nb\n[PAGE 3]\nc", "a\fb\f ")], "m string, f string")
    row = df.select(readers.pages_of_markdown(F.col("m"), "md").alias("m"), readers.pages_of_feeds(F.col("f"), F.lit(4)).alias("f")).first()
    assert [(p["page"], p["text"]) for p in row["m"]] == [(2, "b"), (3, "c")]
    assert [(p["page"], p["text"]) for p in row["f"]] == [(1, "a"), (2, "b"), (3, ""), (4, "")]
    pages = spark.createDataFrame([([(1, "x" * 50, "t"), (2, "", "t")], {2: "seen"})], "p array<struct<page: int, text: string, source: string>>, r map<int,string>")
    row = pages.select(readers.enough_text(F.col("p"), 10, 5).alias("e"), readers.thin_pages(F.col("p"), 5).alias("t"), readers.with_recognised(F.col("p"), F.col("r")).alias("o")).first()
    assert not row["e"] and row["t"] == [2] and row["o"][1]["text"] == "seen"


def test_questions_and_answers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"qid": "1", "options": {"a": "x"}}]), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps({"questions": [{"qid": "2", "question": "?", "doc_ids": ["d"], "answer": "A"}]}), encoding="utf-8")
    got = {r["qid"]: r for r in readers.questions(spark, str(tmp_path)).collect()}
    assert got["1"]["options"] == {"A": "x"} and got["1"]["answer_format"] == "multi" and got["2"]["doc_ids"] == ["d"] and got["1"]["answer"] is None
    results = spark.createDataFrame([("q2", "B", 1, 2, 3), ("q1", "A", 10, 20, 30)], "qid string, answer string, prompt_tokens long, completion_tokens long, total_tokens long")
    writers.answers(results, str(tmp_path / "out"), one_file=True)
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert lines[1] == "summary,,11,22,33" and lines[2] == "q1,A,10,20,30" and lines[0].lstrip("﻿").startswith("qid,")
    assert {tuple(r) for r in readers.answers_csv(spark, str(tmp_path / "out")).collect()} == {("q1", "A"), ("q2", "B")}
    odd = spark.createDataFrame([("q,1", None, None, 2, 3), ("q2", 'say "A"', 1, 1, 1)], results.schema)
    writers.answers(odd, str(tmp_path / "odd"))
    assert {tuple(r) for r in readers.answers_csv(spark, str(tmp_path / "odd")).collect()} == {("q,1", ""), ("q2", 'say "A"')}


def test_evidence(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps([{"qid": "1", "evidence_chunks": [{"chunk_id": "c"}], "used_doc_ids": ["d"], "error": None}, {"qid": ""}, {"no": 1}]), encoding="utf-8")
    (tmp_path / "f.json").write_text("{}", encoding="utf-8")
    assert [(r["qid"], r["error"], r["evidence_chunks"], r["used_doc_ids"], r["chunk_ids"]) for r in readers.evidence(spark, str(tmp_path)).collect()] == [("1", None, 1, ["d"], ["c"])]
    chunks, manifest = spark.createDataFrame([("c", "d"), ("x", "e")], "chunk_id string, doc_id string"), spark.createDataFrame([("d", "t", 7)], "doc_id string, title string, char_count long")
    assert [(r["chunk_id"], r["metadata"]["title"]) for r in readers.with_metadata(chunks, manifest).collect()] == [("c", "t")]


def test_manifest_and_pending(spark):
    docs = spark.createDataFrame([("a", "x", "t", "p", "txt", "12", None), ("b", "x", "t", "p", "txt", None, "broken")], "doc_id string, domain string, title string, path string, source_type string, text string, error string")
    made = writers.manifest(docs, spark.createDataFrame([("a",), ("a",)], "doc_id string"))
    rows = {r["doc_id"]: r for r in made.collect()}
    assert rows["a"]["chunk_count"] == 2 and rows["b"]["chunk_count"] == 0 and rows["b"]["error"] == "broken"
    assert [r["doc_id"] for r in writers.pending(docs, made).collect()] == ["b"] and writers.pending(docs, made, True).count() == 2


def test_incremental(spark, tmp_path):
    schema = "doc_id string, domain string, title string, text string"
    paths = [str(tmp_path / n) for n in ("docs", "chunks", "state")]
    add = lambda name: spark.createDataFrame([(name, "x", "t", "内容" * 60)], schema).write.mode("append").parquet(paths[0])
    for name, total in (("a", 1), ("b", 2), (None, 2)):
        if name:
            add(name)
        incremental.chunk_new(spark, *paths).awaitTermination()
        assert spark.read.parquet(paths[1]).count() == total


def test_prompt_and_call(spark):
    rows = spark.createDataFrame([("q", "calculation", "law", "Q?"), ("r", "odd", None, None)], "qid string, kind string, domain string, question string")
    templates = spark.createDataFrame([("default", "D {question} {guidance}"), ("calculation", "C {question} {guidance}")], "key string, template string")
    guidance = spark.createDataFrame([("default", "g"), ("law", "l")], "domain string, guidance string").withColumnRenamed("domain", "domain")
    made = prompting.render(rows, templates, guidance.selectExpr("domain", "guidance"), ["question"])
    got = {r["qid"]: r["prompt"] for r in made.collect()}
    assert got == {"q": "C Q? l", "r": "D  g"}
    by_kind = spark.createDataFrame([("default", "any"), ("calculation", "count")], "kind string, guidance string")
    checked = prompting.validation(rows.selectExpr("*", "'A' AS first_answer", "repeat('x', 5000) AS first_output"), "{question_guidance}|{domain_guidance}|{first_answer}|{first_output}", guidance, [], by_kind=by_kind, system="be exact")
    assert {tuple(r["prompt"].split("|")[:3]) for r in checked.collect()} == {("count", "l", "A"), ("any", "g", "A")}
    assert {(len(r["prompt"].split("|")[3]), r["system"]) for r in checked.collect()} == {(3000, "be exact")}

    def broken(prompts):
        raise RuntimeError("down")

    assert prompting.call(made).filter("error IS NULL AND total_tokens = prompt_tokens + completion_tokens").count() == 2
    assert prompting.call(made, broken).filter("error = 'down' AND raw IS NULL").count() == 2
    row = spark.range(1).select(prompting.second_pass(F.lit("A"), F.lit("mcq"), F.lit("fact_lookup"), F.lit(0.5)).alias("low"), prompting.second_pass(F.lit("A"), F.lit("mcq"), F.lit("fact_lookup"), F.lit(0.9)).alias("high")).first()
    assert row["low"] and not row["high"]
