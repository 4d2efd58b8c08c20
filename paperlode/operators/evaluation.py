"""Answers in one form, accuracy by groups, diagnostics, token ledger and score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOKEN_BUDGET = 5_000_000


def json_object(raw: Column) -> Column:
    """The JSON object in a reply as a variant: without a code fence, else from the first to the last brace; null if none."""
    body = F.regexp_replace(F.trim(raw), r"^```(?:json)?\s*|\s*```$", "")
    return F.coalesce(F.try_parse_json(body), F.try_parse_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0)))


def truthy(value: Column) -> Column:
    """Whether a JSON value counts as yes: all but false, null, zero and what is empty. Words do, "false" too."""
    return F.coalesce(~F.to_json(value).isin("false", "null", "0", "0.0", '""', "[]", "{}"), F.lit(False))


def answer_text(value: Column) -> Column:
    """The answer inside a parsed reply: a string, a list joined, the value under one of the usual keys, also one level
    further down, or the letters of an object whose values count as yes."""
    names = ("answer", "value", "choice", "choices", "letters")
    at = lambda path: F.coalesce(F.array_join(F.try_variant_get(value, path, "array<string>"), ""), F.when(F.try_variant_get(value, path, "map<string,variant>").isNull(), F.try_variant_get(value, path, "string")))

    def letters(path: str) -> Column:
        said = F.map_entries(F.try_variant_get(value, path, "map<string,variant>"))
        said = F.filter(said, lambda e: F.upper(e["key"]).isin("A", "B", "C", "D") & truthy(e["value"]))
        return F.when(F.size(said) > 0, F.array_join(F.transform(said, lambda e: e["key"]), ""))

    return F.coalesce(at("$.answer"), *[at(f"$.answer.{k}") for k in names], letters("$.answer"), *[at(f"$.{k}") for k in names[1:]], letters("$"))


def judged_options(value: Column) -> Column:
    """array<struct<option, verdict, reason, evidence_ids>> of the options a parsed reply judges, in the order A to D.

    The judgements stand under one of the usual keys, as an object by letter or as a list of objects that name their
    option; a judgement is a value that counts as yes or no, or an object with verdict, reason and evidence. Of several on
    one option the last counts: in a list by place, in an object, whose order parsing does not keep, by spelling.
    """
    raw = F.coalesce(*[F.when(truthy(x), x) for x in (F.try_variant_get(value, f"$.{k}", "variant") for k in ("option_judgements", "judgements", "opt"))])
    get = lambda v, kind, *names: F.coalesce(*[F.try_variant_get(v, f"$.{n}", kind) for n in names])
    by_letter = F.transform(F.map_entries(F.try_variant_get(raw, "$", "map<string,variant>")), lambda e: F.struct(F.upper(e["key"]).alias("option"), e["value"].alias("v")))
    listed = F.transform(F.try_variant_get(raw, "$", "array<variant>"), lambda v: F.struct(F.upper(get(v, "string", "option", "key", "letter")).alias("option"), v.alias("v")))
    entries = F.coalesce(by_letter, listed)

    def last(letter: Column) -> Column:
        v = F.element_at(F.filter(entries, lambda e: e["option"] == letter), -1)["v"]
        whole = F.try_variant_get(v, "$", "map<string,variant>").isNotNull()
        verdict = F.when(whole, truthy(get(v, "variant", "verdict", "v"))).otherwise(truthy(v))
        return F.struct(
            letter.alias("option"), verdict.alias("verdict"), F.coalesce(get(v, "string", "reason", "r"), F.lit("")).alias("reason"),
            F.coalesce(get(v, "array<string>", "evidence_ids", "e"), F.array().cast("array<string>")).alias("evidence_ids"),
        )

    there = F.filter(F.array(*[F.lit(x) for x in "ABCD"]), lambda x: F.exists(entries, lambda e: e["option"] == x))
    return F.transform(there, last)


def judgements(value: Column) -> Column:
    """map<letter, boolean> of the options a parsed reply judges; null where it judges none."""
    return F.map_from_entries(F.transform(judged_options(value), lambda j: F.struct(j["option"], j["verdict"])))


def answer_in_text(raw: Column) -> Column:
    """The letters after "answer" in free text, else the text itself."""
    quoted = F.regexp_extract(raw, r'(?i)"answer"\s*:\s*"([A-D]+)"', 1)
    said = F.regexp_extract(raw, r"(?i)(?:答案|answer)\s*[:：]?\s*([A-D]{1,4})", 1)
    return F.when(quoted != "", quoted).when(said != "", said).otherwise(raw)


def option_keys(options: Column) -> Column:
    return F.coalesce(F.array_sort(F.array_distinct(F.transform(F.map_keys(options), F.upper))), F.array().cast("array<string>"))


def fallback(form: Column, keys: Column, judged: Column) -> Column:
    """Letters judged true that are options; else A for a true-or-false question that has it; else the first option."""
    true = F.filter(keys, lambda k: F.coalesce(F.try_element_at(judged, k), F.lit(False)))
    first = F.coalesce(F.get(keys, F.lit(0)), F.lit("A"))
    return F.when((form == "multi") & (F.size(true) > 0), F.array_join(true, "")).when(form.isin("mcq", "tf") & (F.size(true) > 0), F.get(true, F.lit(0))).when((form == "tf") & F.array_contains(keys, "A"), "A").otherwise(first)


def normalize_answer(answer: Column, form: Column, options: Column, judged: Column) -> Column:
    """Option letters of an answer: the first of a single choice, else all in order; the fallback where there is none."""
    keys = option_keys(options)
    allowed = F.when(F.size(keys) == 0, F.array(*[F.lit(c) for c in "ABCD"])).otherwise(keys)
    letters = F.coalesce(F.filter(F.regexp_extract_all(F.upper(answer), F.lit("[ABCD]"), F.lit(0)), lambda c: F.array_contains(allowed, c)), F.array().cast("array<string>"))
    form = F.coalesce(form, F.lit("multi"))
    single = form.isin("mcq", "tf")
    judged = F.coalesce(judged, F.create_map().cast("map<string,boolean>"))
    return F.when((F.size(letters) > 0) & single, F.get(letters, F.lit(0))).when(F.size(letters) > 0, F.array_join(F.array_sort(F.array_distinct(letters)), "")).otherwise(fallback(form, keys, judged))


def last_answers(answers: DataFrame) -> DataFrame:
    """The last answer of each run to each question; ties go to the higher id."""
    w = Window.partitionBy("run_id", "qid").orderBy(F.desc_nulls_last("answered_at"), F.desc("answer_id"), F.desc_nulls_last("ingested_at"))
    return answers.filter("qid IS NOT NULL AND run_id IS NOT NULL").withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def predictions(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """(qid, pred, was_missing) of every question: its last answer over all runs in one form; a question without one
    is scored by the fallback and flagged."""
    w = Window.partitionBy("qid").orderBy(F.desc_nulls_last("answered_at"), F.desc("answer_id"), F.desc_nulls_last("ingested_at"))
    last = answers.filter("qid IS NOT NULL").withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    last = last.select("qid", F.col("answer").alias("_answer"), F.col("option_judgements").alias("_judged"), F.lit(True).alias("_there"))
    both = questions.join(last, "qid", "left")
    pred = normalize_answer(F.coalesce("_answer", F.lit("")), F.col("answer_format"), F.col("options"), F.col("_judged"))
    return both.select("qid", pred.alias("pred"), F.col("_there").isNull().alias("was_missing"))


def scored(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions with a gold answer, their prediction and whether it is right."""
    return questions.filter("answer IS NOT NULL").join(predictions(questions, answers), "qid").withColumn("correct", (F.col("pred") == F.col("answer")).cast("bigint"))


def breakdown(rows: DataFrame) -> DataFrame:
    """(key, total, correct, accuracy) over all, by domain, by answer format and by type."""
    names = rows.select("correct", F.coalesce("domain", F.lit("")).alias("d"), F.coalesce("answer_format", F.lit("")).alias("f"), F.coalesce("type", F.lit("")).alias("t"))
    grouped = names.groupingSets([[], ["d"], ["f"], ["t"]], "d", "f", "t").agg(F.count("*").alias("total"), F.sum("correct").alias("correct"), F.grouping("d").alias("gd"), F.grouping("f").alias("gf"), F.grouping("t").alias("gt"))
    key = F.when(F.col("gd") == 0, F.concat(F.lit("domain:"), "d")).when(F.col("gf") == 0, F.concat(F.lit("format:"), "f")).when(F.col("gt") == 0, F.concat(F.lit("type:"), "t")).otherwise("overall")
    return grouped.select(key.alias("key"), "total", "correct", F.round(F.col("correct") / F.col("total"), 6).alias("accuracy"))


def diagnosed(questions: DataFrame, kinds: DataFrame, answers: DataFrame) -> DataFrame:
    """(qid, domain, form, kind, calc, error, evidence, gold, pred, correct) of every question with its last answer of all
    runs; a question without one has the fallback and no evidence. kinds is the result of `analysis.classify`."""
    w = Window.partitionBy("qid").orderBy(F.desc_nulls_last("answered_at"), F.desc("answer_id"), F.desc_nulls_last("ingested_at"))
    last = answers.filter("qid IS NOT NULL").withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    last = last.select("qid", F.col("answer").alias("_given"), "error", F.size(F.coalesce("used_doc_ids", F.array().cast("array<string>"))).alias("_evidence"))
    both = questions.join(last, "qid", "left").join(kinds.select("qid", "kind", F.col("requires_calculation").alias("calc")), "qid")
    none = F.create_map().cast("map<string,boolean>")
    form = lambda c: normalize_answer(F.coalesce(c, F.lit("")), F.col("answer_format"), F.col("options"), none)
    gold = F.when(F.col("answer").isNotNull(), form("answer"))
    rows = both.select("qid", "domain", F.col("answer_format").alias("form"), "kind", "calc", F.when(F.col("error") != "", F.col("error")).alias("error"), F.coalesce("_evidence", F.lit(0)).cast("bigint").alias("evidence"), gold.alias("gold"), form("_given").alias("pred"))
    return rows.withColumn("correct", (F.col("pred") == F.col("gold")).cast("bigint"))


def diagnostics(rows: DataFrame) -> DataFrame:
    """(key, total, errors, no_evidence, with_gold, correct, accuracy, error_rate, no_evidence_rate) over all, by domain,
    answer format, kind of question and whether it calculates, of the rows of `diagnosed`. Rates are null where nothing counts."""
    names = ("domain", "form", "kind", "calc")
    shown = rows.select("error", "evidence", "gold", "correct", *[F.coalesce(F.col(n) if n != "calc" else F.when(F.col(n), "True").otherwise("False"), F.lit("")).alias(f"_{n}") for n in names])
    grouped = shown.groupingSets([[], *[[f"_{n}"] for n in names]], *[f"_{n}" for n in names]).agg(
        F.count("*").alias("total"), F.count("error").alias("errors"), F.count_if(F.col("evidence") == 0).alias("no_evidence"), F.count("gold").alias("with_gold"),
        F.count_if(F.col("correct") == 1).alias("correct"), *[F.grouping(f"_{n}").alias(f"g_{n}") for n in names],
    )
    key = F.lit("overall")
    for n, shown_as in zip(names, ("domain", "format", "kind", "calc")):
        key = F.when(F.col(f"g_{n}") == 0, F.concat(F.lit(f"{shown_as}:"), f"_{n}")).otherwise(key)
    rate = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(b)), 4)
    return grouped.select(key.alias("key"), "total", "errors", "no_evidence", "with_gold", "correct", rate("correct", "with_gold").alias("accuracy"), rate("errors", "total").alias("error_rate"), rate("no_evidence", "total").alias("no_evidence_rate"))


def ledger(usage: DataFrame, by: str = "run_id") -> DataFrame:
    """(by, answers, prompt_tokens, completion_tokens, total_tokens) by run, or by question, and in all with a null in `by`.

    An answer that was delivered again counts once. A second pass is booked under the id of its question and "#verify",
    so with by = "qid" it has a row of its own.
    """
    one = usage.filter("answer_id IS NOT NULL").dropDuplicates(["answer_id"]).filter(F.col(by).isNotNull())
    use = lambda n: F.sum(F.coalesce(F.col(f"token_usage.{n}"), F.lit(0))).alias(n)
    return one.rollup(by).agg(F.count("*").alias("answers"), use("prompt_tokens"), use("completion_tokens"), use("total_tokens"))


def budget_score(accuracy: Column, tokens: Column) -> Column:
    """100 times accuracy times 0.7 plus 0.3 times the unused share of the token budget; no tokens leave no share."""
    share = F.when(tokens <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (TOKEN_BUDGET - tokens) / TOKEN_BUDGET)))
    return 100 * accuracy * (0.7 + 0.3 * share)


def run_scores(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """(run_id, answered, accuracy, tokens, score, rank) of each run over its questions with a gold answer."""
    last = last_answers(answers)
    both = last.withColumnRenamed("answer", "_answer").join(questions.filter("answer IS NOT NULL").select("qid", F.col("answer").alias("gold"), "answer_format", "options"), "qid")
    pred = normalize_answer(F.coalesce("_answer", F.lit("")), F.col("answer_format"), F.col("options"), F.col("option_judgements"))
    runs = both.groupBy("run_id").agg(F.count("*").alias("answered"), F.avg((pred == F.col("gold")).cast("double")).alias("accuracy"), F.sum(F.coalesce("token_usage.total_tokens", F.lit(0))).alias("tokens"))
    runs = runs.withColumn("score", F.round(budget_score(F.col("accuracy"), F.col("tokens")), 6)).withColumn("accuracy", F.round("accuracy", 6))
    # one task, of a row for each run: some 50 bytes times the number of runs, however many answers they hold
    w = Window.orderBy(F.desc("score"), F.desc("accuracy"), "tokens", "run_id")
    return runs.withColumn("rank", F.row_number().over(w).cast("bigint"))
