"""What kind of question it is, and what kind of calculation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlode import config
from paperlode.functions import text as T


def one_each(questions: DataFrame) -> DataFrame:
    """Questions with an id, each once; option keys in upper case, of equal ones the last."""
    names = F.transform(F.map_keys("options"), F.upper)
    last = F.filter(F.map_entries("options"), lambda e, i: F.array_position(F.slice(names, i + 2, F.size(names)), F.upper(e["key"])) == 0)
    options = F.map_from_entries(F.transform(last, lambda e: F.struct(F.upper(e["key"]), e["value"])))
    return questions.filter("qid IS NOT NULL").dropDuplicates(["qid"]).withColumn("options", F.coalesce(options, F.create_map().cast("map<string,string>")))


def option_values(options: Column) -> Column:
    return F.coalesce(F.map_values(options), F.array().cast("array<string>"))


def classify(questions: DataFrame) -> DataFrame:
    """(qid, kind, requires_calculation, requires_comparison, option_numeric_count, tags) of each question.

    A calculation goes before a comparison, a judgement and the look-up of a fact. Nulls count as empty.
    """
    blank = F.lit("")
    text = F.concat_ws("\n", F.coalesce("question", blank), F.array_join(option_values(F.col("options")), "\n"), F.coalesce("type", blank))
    count = F.size(F.filter(option_values(F.col("options")), lambda v: v.rlike(config.NUMERIC_OPTION)))
    domain = F.coalesce("domain", blank)
    calc = text.rlike(config.CALCULATES) | ((count >= 2) & (domain == "financial_reports"))
    compare, judge = text.rlike(config.COMPARES), text.rlike(config.JUDGES)
    form = F.coalesce("answer_format", blank)
    kind = F.when(calc, "calculation").when(compare, "comparison").when((form == "tf") | judge, "judgement").otherwise("fact_lookup")
    tags = F.array_distinct(F.array_compact(F.array(F.when(calc, F.lit("numeric")), F.when(compare, F.lit("compare")), F.when(judge, F.lit("judgement")), F.when(domain != "", domain), F.when(form != "", form))))
    return questions.select("qid", kind.alias("kind"), calc.alias("requires_calculation"), (compare | calc).alias("requires_comparison"), count.cast("bigint").alias("option_numeric_count"), tags.alias("tags"))


def formula(question: Column, options: Column) -> Column:
    """Growth over a year, ratio, difference or sum, by the words of question and options, in this order."""
    text = F.concat_ws("\n", F.coalesce(question, F.lit("")), F.array_join(option_values(options), " "))
    out = F.lit("unknown")
    for name, words in reversed(config.FORMULAS.items()):
        out = F.when(text.rlike(words), name).otherwise(out)
    return out


def hint(kind: Column, calculation: Column, comparison: Column, count: Column, tags: Column) -> Column:
    """The analysis as lines for a prompt."""
    yes = lambda c: F.when(c, "是").otherwise("否")
    return F.concat_ws("\n", F.concat(F.lit("题型识别："), kind), F.concat(F.lit("需要代码计算："), yes(calculation)), F.concat(F.lit("需要跨值比较："), yes(comparison)), F.concat(F.lit("选项数值数量："), count.cast("string")), F.concat(F.lit("标签："), F.when(F.size(tags) > 0, F.array_join(tags, "、")).otherwise("无")))


def metric_hint(question: Column, options: Column) -> Column:
    return F.regexp_extract(F.concat_ws("\n", F.coalesce(question, F.lit("")), F.array_join(option_values(options), " ")), config.METRIC, 0)


def terms(questions: DataFrame) -> DataFrame:
    """(qid, structured, metrics, numbers, years, strong, important, hints): the terms of the whole question."""
    text = T.question_query(F.col("question"), F.col("options"), F.col("type"), F.col("doc_ids"))
    return questions.select("qid", T.structured_terms(text).alias("structured"), T.metric_terms(text).alias("metrics"), T.numbers(text).alias("numbers"), T.years(text).alias("years"), T.strong_words(text).alias("strong"), T.important_terms(text).alias("important"), T.doc_hints(text).alias("hints"))
