"""Prompts from templates, the model call as a plug-in, and the policy of a second pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlode.functions import text as T
from paperlode.operators import evaluation as E

JUDGED = "array<struct<option: string, verdict: boolean, reason: string, evidence_ids: array<string>>>"
#: A client takes prompts and returns replies; the mock stands in where no model is at hand.
Client = Callable[[list[str]], list[str]]


def render(rows: DataFrame, templates: DataFrame, guidance: DataFrame, slots: list[str], key: str = "kind", by_kind: DataFrame | None = None, system: str = "") -> DataFrame:
    """Add prompt: the template of a row's kind, or `default`, with {slot} replaced by the columns of that name; and, where
    there is one, the system prompt as a column of its own.

    {guidance} and {domain_guidance} are what guidance (domain, guidance) says for the domain, {question_guidance} what
    by_kind (kind, guidance) says for the kind, each by its row `default` otherwise. These are settings of a few rows, so they
    are broadcast.
    """
    of = lambda df, k, v: df.select(F.col(k).alias("_k"), F.col(v).alias("_v"))
    default = lambda df, k, v: of(df, k, v).filter("_k = 'default'").select(F.col("_v").alias("_d"))
    settings = [(templates, "key", "template", key, "_template"), (guidance, "domain", "guidance", "domain", "_guidance")]
    settings += [] if by_kind is None else [(by_kind, "kind", "guidance", key, "_by_kind")]
    out = rows
    for df, k, v, on, name in settings:
        first = default(df, k, v).limit(1)
        out = out.join(F.broadcast(of(df, k, v)), F.col(on) == F.col("_k"), "left").join(F.broadcast(first), F.lit(True), "left")
        out = out.withColumn(name, F.coalesce("_v", "_d", F.lit(""))).drop("_k", "_v", "_d")
    prompt = F.col("_template")
    for slot, c in (("guidance", "_guidance"), ("domain_guidance", "_guidance"), ("question_guidance", "_by_kind" if by_kind is not None else "")):
        prompt = F.replace(prompt, F.lit("{" + slot + "}"), F.col(c) if c else F.lit(""))
    for slot in slots:
        prompt = F.replace(prompt, F.lit("{" + slot + "}"), F.coalesce(F.col(slot).cast("string"), F.lit("")))
    made = out.withColumn("prompt", prompt).drop("_template", "_guidance", "_by_kind")
    return made.withColumn("system", F.lit(system)) if system.strip() else made


def validation(rows: DataFrame, template: str, guidance: DataFrame, slots: list[str], most: int = 3000, **settings: object) -> DataFrame:
    """Prompts that ask to check a first answer: rows with first_answer and first_output, the output cut to its first
    characters, in one template for all kinds, which has these two as slots beside the others."""
    one = rows.sparkSession.createDataFrame([("default", template)], "key string, template string")
    cut = rows.withColumn("first_answer", F.coalesce("first_answer", F.lit(""))).withColumn("first_output", F.substring(F.coalesce("first_output", F.lit("")), 1, most))
    return render(cut, one, guidance, [*slots, "first_answer", "first_output"], **settings)


def mock(prompts: list[str]) -> list[str]:
    return ['{"answer": "A", "judgements": {}}'] * len(prompts)


def call(prompts: DataFrame, client: Client = mock, retries: int = 3) -> DataFrame:
    """(qid, raw, prompt_tokens, completion_tokens, total_tokens, error) of prompts (qid, prompt).

    A call that fails is tried again; then the error is a column of the row. Tokens are counted as a quarter of the
    characters unless the client's own count is joined later.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for qid, prompt in zip(part["qid"], part["prompt"]):
                raw, error = None, None
                for _ in range(retries):
                    try:
                        raw, error = client([prompt])[0], None
                        break
                    except Exception as e:
                        error = str(e)
                a, b = len(prompt or "") // 4, len(raw or "") // 4
                rows.append((qid, raw, a, b, a + b, error))
            yield pd.DataFrame(rows, columns=["qid", "raw", "prompt_tokens", "completion_tokens", "total_tokens", "error"])

    return prompts.select("qid", "prompt").mapInPandas(run, "qid string, raw string, prompt_tokens long, completion_tokens long, total_tokens long, error string")


def second_pass(answer: Column, form: Column, kind: Column, confidence: Column, forms: tuple[str, ...] = ("multi",), kinds: tuple[str, ...] = ("calculation", "comparison"), least: float = 0.68) -> Column:
    """Whether a first answer should be checked: none given, a form or kind that asks for it, or low confidence."""
    low = (confidence > 0) & (confidence < least)
    return F.coalesce(T.strip(answer) == "", F.lit(True)) | F.coalesce(form.isin(*forms), F.lit(False)) | F.coalesce(kind.isin(*kinds), F.lit(False)) | F.coalesce(low, F.lit(False))


def assemble(questions: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """(qid, answer, judgements, raw_model_output, token_usage, confidence, error) of every question with a first reply.

    first and second are replies (qid, raw, prompt_tokens, completion_tokens, total_tokens, error), one for each question
    at most. A second reply gives answer and confidence, and its judgements where it has any; tokens are added up; the
    output then holds both. An option that no reply judges is judged by whether it is in the answer.
    """
    use = ("prompt_tokens", "completion_tokens", "total_tokens")
    one = lambda df, n: df.select("qid", F.col("raw").alias(f"raw{n}"), *[F.coalesce(F.col(u), F.lit(0)).alias(f"{u}{n}") for u in use], F.col("error").alias(f"error{n}"), F.lit(True).alias(f"_there{n}"))
    rows = questions.select("qid", "answer_format", "options").join(one(first, 1), "qid").join(one(second.filter("error IS NULL"), 2), "qid", "left")
    there = F.coalesce("_there2", F.lit(False))
    for n in (1, 2):
        value = E.json_object(F.col(f"raw{n}"))
        rows = rows.withColumn(f"_v{n}", value).withColumn(f"_j{n}", E.judged_options(F.col(f"_v{n}")))
    verdicts = lambda j: F.map_from_entries(F.transform(j, lambda x: F.struct(x["option"], x["verdict"])))
    said = lambda n: F.coalesce(E.answer_text(F.col(f"_v{n}")), F.when(F.col(f"_v{n}").isNull(), E.answer_in_text(F.col(f"raw{n}"))), F.lit(""))
    final = lambda n: E.normalize_answer(said(n), F.col("answer_format"), F.col("options"), verdicts(F.col(f"_j{n}")))
    sure = lambda n: F.coalesce(F.try_variant_get(F.col(f"_v{n}"), "$.confidence", "double"), F.lit(0.0))
    rows = rows.withColumn("answer", F.when(there, final(2)).otherwise(final(1)))
    judged = F.when(there & (F.size(F.coalesce("_j2", F.array().cast(JUDGED))) > 0), F.col("_j2")).otherwise(F.coalesce("_j1", F.array().cast(JUDGED)))
    rows = rows.withColumn("_j", judged)
    missing = F.filter(E.option_keys(F.col("options")), lambda k: ~F.exists("_j", lambda j: j["option"] == k))
    filled = F.transform(missing, lambda k: F.struct(k.alias("option"), F.contains("answer", k).alias("verdict"), F.lit("fallback/default").alias("reason"), F.array().cast("array<string>").alias("evidence_ids")))
    both = F.to_json(F.struct(F.col("raw1").alias("first_output"), F.col("raw2").alias("second_output"), F.col("answer").alias("final_answer")))
    usage = F.struct(*[(F.col(f"{u}1") + F.coalesce(f"{u}2", F.lit(0))).alias(u) for u in use])
    return rows.select("qid", "answer", F.array_sort(F.concat("_j", filled)).alias("judgements"), F.when(there, both).otherwise(F.col("raw1")).alias("raw_model_output"), usage.alias("token_usage"), F.when(there, sure(2)).otherwise(sure(1)).alias("confidence"), F.col("error1").alias("error"))
