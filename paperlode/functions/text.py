"""Text functions as Column expressions; all stay in the JVM. Null gives null, or an empty array where arrays come out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperlode import config

#: Fixed value: blanks that a strip removes.
BLANKS = r"\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1C}-\x{1F}"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{BLANKS}]+|[{BLANKS}]+$", "")


def compact_whitespace(text: Column) -> Column:
    """Wide blanks to blanks, runs of blanks to one, three and more line ends to two, ends stripped."""
    text = F.regexp_replace(F.replace(text, F.lit("　"), F.lit(" ")), r"[ \t]+", " ")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def stable_id(*parts: Column, length: int = 12) -> Column:
    return F.substring(F.md5(F.concat_ws("::", *parts)), 1, length)


def normalize(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("　"), F.lit(" "))


def matches(text: Column, pattern: str) -> Column:
    """All matches in order; none for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value worked out once: a plain expression inside a lambda is worked out for each element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def terms_in(text: Column, terms: list[str]) -> Column:
    """Those of a fixed list that occur in a text, whatever their case, in the order of the list."""
    fold = (lambda t: t) if all(t == t.lower() for t in terms) else F.lower
    return once(F.coalesce(F.lower(text), F.lit("")), lambda low: F.filter(strings(terms), lambda t: F.contains(low, fold(t))))


def han_terms_in(text: Column, terms: list[str]) -> Column:
    """As `terms_in`, for terms of Han characters alone: only the Han runs of the text are searched."""
    return terms_in(F.array_join(matches(text, config.CJK_RUN), " "), terms)


def names_in(text: Column) -> Column:
    """All matches of the pattern of names. It matches inside one run of letters and ends in a Han suffix, so that
    only the runs that have a suffix are tried, as far as the last one, which is costly."""
    runs = F.filter(F.transform(matches(text, config.ENTITY_RUN), lambda r: F.regexp_extract(r, f"^.*(?:{config.ENTITY_END})", 0)), lambda r: r != "")
    return F.flatten(F.transform(runs, lambda r: matches(r, config.ENTITY)))


def ngrams(run: Column) -> Column:
    """A short run itself; of a longer one all pairs, then all triples, then the run if it has up to 8 characters."""
    n = F.length(run)
    grams = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(run, i, k))
    whole = F.when(n <= 8, F.array(run)).otherwise(F.array().cast("array<string>"))
    return F.when(n <= 2, F.array(run)).otherwise(F.concat(grams(2), grams(3), whole))


def plain_tokens(text: Column) -> Column:
    """Latin words, numbers and n-grams of Han runs."""
    text = normalize(text)
    return F.concat(matches(text, config.LATIN_NUMBER), F.flatten(F.transform(matches(text, config.CJK_RUN), ngrams)))


def tokenize(text: Column) -> Column:
    """The bag of terms of a text: structured terms, names, lexicon terms, document aliases, then plain tokens. What
    several sources find counts several times."""
    low = normalize(text)
    found = [matches(low, config.STRUCTURED), names_in(low), han_terms_in(low, config.FINANCE_TERMS), matches(low, config.DOC_ALIAS), plain_tokens(text)]
    return F.filter(F.concat(*found), lambda t: F.trim(t) != "")


def structured_terms(text: Column) -> Column:
    """Ordered distinct clause numbers, years, amounts and titles of the text as it is."""
    return F.array_distinct(F.transform(matches(text, config.STRUCTURED), strip))


def metric_terms(text: Column) -> Column:
    return terms_in(text, config.METRIC_TERMS)


def numbers(text: Column) -> Column:
    """All numbers with their unit, without inner blanks, repeated ones kept."""
    return F.transform(matches(text, config.NUMBER), lambda x: F.regexp_replace(x, r"\s+", ""))


def years(text: Column) -> Column:
    return F.array_distinct(matches(text, config.YEAR))


def strong_words(text: Column) -> Column:
    return F.array_distinct(matches(text, config.STRONG))


def important_terms(text: Column, most: int = 80) -> Column:
    generic = F.filter(matches(text, config.GENERIC), lambda t: (F.length(t) >= 2) & ~F.array_contains(strings(config.STOP_WORDS), t))
    return F.slice(F.array_distinct(F.concat(metric_terms(text), numbers(text), strong_words(text), generic)), 1, most)


def squeezed(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"\s+", "")


def count_contains(text: Column, terms: Column) -> Column:
    """How many terms, repeated ones each time, occur in a text; case and blanks aside."""
    body = squeezed(text)
    return F.size(F.filter(F.transform(terms, squeezed), lambda t: (t != "") & F.contains(body, t)))


def doc_hints(text: Column) -> Column:
    """Ordered distinct document ids that a text seems to name."""
    return F.array_distinct(F.transform(matches(text, config.DOC_HINT), lambda h: F.regexp_replace(F.lower(h), "^fc_(?=text)", "")))


def doc_aliases(doc_id: Column) -> Column:
    """Other names of a document: its lower-case id, and forms that the naming of files suggests."""
    low = F.lower(doc_id)
    none = F.array().cast("array<string>")
    parts = F.split(low, "_")
    text_alias = F.when(low.startswith("text"), F.array(F.concat(F.lit("fc_"), low))).otherwise(none)
    pack_alias = F.when(low.startswith("pack2_text"), F.array(F.regexp_replace(low, "^pack2_", ""))).otherwise(none)
    year_alias = F.when(low.startswith("annual_") & (F.size(parts) >= 3), F.slice(parts, 2, 2)).otherwise(none)
    return F.array_distinct(F.concat(F.array(low), text_alias, pack_alias, year_alias))


def sentences(text: Column, least: int = 8) -> Column:
    """Pieces after each full stop, question mark or semicolon, of at least `least` characters; lines where there are none."""
    long = lambda parts: F.filter(F.transform(parts, strip), lambda s: F.length(s) >= least)
    cut = long(F.split(text, "(?<=[。！？；;])"))
    return F.when(F.size(cut) > 0, cut).otherwise(long(F.split(text, r"\r\n|\n|\r")))


def keywords(text: Column, most: int = 60) -> Column:
    found = F.filter(F.transform(matches(text, config.KEYWORD), strip), lambda t: t != "")
    return F.slice(F.array_distinct(found), 1, most)


def option_text(options: Column) -> Column:
    """Options as lines "K. text" in the order of their keys, keys in upper case."""
    entries = F.array_sort(F.transform(F.map_entries(options), lambda e: F.struct(F.upper(e["key"]).alias("key"), e["value"].alias("value"))))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(". "), F.coalesce(e["value"], F.lit("")))), "\n")


def question_query(question: Column, options: Column, kind: Column, doc_ids: Column) -> Column:
    """The text of a question with its options, type and documents, as one query."""
    blank = F.lit("")
    return F.concat_ws("\n", F.coalesce(question, blank), F.coalesce(option_text(options), blank), F.coalesce(kind, blank), F.coalesce(F.array_join(doc_ids, " "), blank))
