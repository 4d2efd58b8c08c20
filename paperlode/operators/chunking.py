"""Section-aware overlapping chunks of long documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperlode import config
from paperlode.config import Chunking
from paperlode.functions import text as T
from paperlode.session import cut_lineage


def limits(domain: Column, settings: Chunking = Chunking()) -> tuple[Column, Column]:
    """(limit, overlap) of a domain, the general ones where it has none of its own."""
    most, over = F.lit(settings.max_chars), F.lit(settings.overlap_chars)
    for name, (m, o) in settings.by_domain.items():
        most, over = F.when(domain == name, m).otherwise(most), F.when(domain == name, o).otherwise(over)
    return most, over


def documents(filings: DataFrame) -> DataFrame:
    """Filings with an id, each once, null texts as empty ones."""
    rows = filings.filter("doc_id IS NOT NULL").select("doc_id", F.coalesce("domain", F.lit("")).alias("domain"), "title", F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("doc_id").agg(F.min_by(F.struct("domain", "title", "text"), F.struct("domain", "text")).alias("d")).select("doc_id", "d.*")


def blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, domain, idx, text, page, char_start, char_end, kind): paragraphs; a page mark holds until the next.

    Offsets count two characters for every break, as wide as a plain blank line, so they drift where breaks are wider.
    Documents without text have no block.
    """
    rows = docs.select("doc_id", "domain", F.posexplode(F.split("text", r"\n\s*\n")).alias("idx", "raw"))
    order = Window.partitionBy("doc_id").orderBy("idx")
    before = F.coalesce(F.sum(F.length("raw") + 2).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    body = T.strip(F.col("raw"))
    mark = F.regexp_extract(body, r"^\[PAGE\s+(\d+)\]", 1)
    page = F.last(F.when(mark != "", mark.cast("int")), ignorenulls=True).over(order)
    kind = F.when(F.col("text").rlike(config.TABLE_LINE), "table").otherwise("text")
    rows = rows.withColumn("char_start", before.cast("bigint")).withColumn("page", F.coalesce(page, F.lit(1)))
    rows = rows.withColumn("text", T.strip(F.regexp_replace(body, r"^\[PAGE\s+\d+\]", ""))).filter("text <> ''")
    return rows.select("doc_id", "domain", "idx", "text", "page", "char_start", (F.col("char_start") + F.length("raw")).alias("char_end"), kind.alias("kind"))


def greedy(units: Column, most: Column, joint: Column) -> Column:
    """Strings joined in order as long as they, each with one more character, fit the limit."""
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("size"))

    def step(s: Column, u: Column) -> Column:
        full = s["open"].isNotNull() & (s["size"] + F.length(u) + 1 > most)
        return F.struct(
            F.when(full, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]).alias("done"),
            F.when(full | s["open"].isNull(), u).otherwise(F.concat(s["open"], joint, u)).alias("open"),
            F.when(full, F.length(u) + 1).otherwise(s["size"] + F.length(u) + 1).alias("size"),
        )

    return F.aggregate(units, start, step, lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


def split_large(rows: DataFrame, settings: Chunking = Chunking()) -> DataFrame:
    """Blocks of more than 1.15 times the limit in parts: of lines in tables and in domains of lines, else of
    sentences; a block of one part in slices of the limit. Numbered anew in `no`."""
    most, _ = limits(F.col("domain"), settings)
    by_line = (F.col("kind") == "table") | F.col("domain").isin(*settings.line_domains)
    lines = F.filter(F.split("text", r"\r\n|\n|\r"), lambda x: T.strip(x) != "")
    units = F.when(by_line, lines).otherwise(F.split("text", "(?<=[。！？；;])"))
    slices = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / most).cast("int")), lambda i: F.substring(F.col("text"), i * most + 1, most))
    units = F.filter(F.transform(F.when(F.size(units) <= 1, slices).otherwise(units), T.strip), lambda u: u != "")
    parts = F.when(F.length("text") <= F.floor(most * 1.15), F.array("text")).otherwise(greedy(units, F.greatest(most, F.lit(settings.min_chars)), F.when(by_line, "\n").otherwise("")))
    cut = rows.withColumn("_whole", F.length("text") <= F.floor(most * 1.15)).withColumn("_parts", parts)
    cut = cut.select("doc_id", "domain", "idx", "page", "kind", "_whole", F.col("char_start").alias("_from"), F.col("char_end").alias("_to"), F.posexplode_outer("_parts").alias("part", "text")).filter("part IS NOT NULL")
    order = Window.partitionBy("doc_id").orderBy("idx", "part")
    inside = Window.partitionBy("doc_id", "idx").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.when(F.col("_whole"), F.col("_from")).otherwise(F.col("_from") + F.coalesce(F.sum(F.length("text")).over(inside), F.lit(0)))
    cut = cut.withColumn("char_start", start).withColumn("char_end", F.when(F.col("_whole"), F.col("_to")).otherwise(F.col("char_start") + F.length("text")))
    return cut.withColumn("no", F.row_number().over(order)).select("doc_id", "domain", "no", "text", "page", "kind", "char_start", "char_end")


def sections(rows: DataFrame) -> DataFrame:
    """Add boundary and section_path: the root heading in force and the last heading under it."""
    body, domain = F.trim("text"), F.col("domain")
    is_section = F.col("text").rlike(config.SECTION)
    article = body.rlike(config.ARTICLE)
    boundary = F.when(domain == "regulatory", article).when(domain == "insurance", article | body.rlike(config.CLAUSE)).otherwise(body.rlike(config.SECTION) & (F.length(body) <= 120))
    rows = rows.withColumn("boundary", boundary)
    heading = F.when((is_section | F.col("boundary")) & (F.length("text") <= 160), T.strip(F.regexp_replace(T.strip(F.col("text")), "^#+", "")))
    rows = rows.withColumn("_h", heading).withColumn("_root", F.col("_h").startswith("第") & F.col("_h").rlike("[编章节]"))
    seen = Window.partitionBy("doc_id").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    first = F.first("_h", ignorenulls=True).over(seen)
    root = F.coalesce(F.last(F.when(F.col("_root"), F.col("_h")), ignorenulls=True).over(seen), first)
    at_root = F.last(F.when(F.col("_h").isNotNull(), F.struct(F.col("_root").alias("r"), F.col("_h").alias("h"))), ignorenulls=True).over(seen)
    rank = F.count("_h").over(seen)
    rows = rows.withColumn("_rootname", root).withColumn("_last", at_root).withColumn("_rank", rank)
    alone = F.col("_last.r") | (F.col("_rank") == 1)
    path = F.when(F.col("_last").isNull(), F.array().cast("array<string>")).when(alone, F.array("_last.h")).otherwise(F.array("_rootname", "_last.h"))
    return rows.withColumn("section_path", path).drop("_h", "_root", "_rootname", "_last", "_rank")


def assigned(sizes: list[int], bounds: list[bool], most: int, overlap: int, least: int) -> list[list[int]]:
    """The places of the blocks of each chunk. A chunk closes before a boundary once it has `least` characters, and
    before a block that would exceed the limit; the next begins with its last blocks, up to the overlap. A short rest
    is dropped."""
    out: list[list[int]] = []
    held: list[int] = []
    size = lambda: sum(sizes[i] + 2 for i in held)

    def close() -> None:
        out.append(list(held))
        kept = 0
        for n in range(len(held) - 1, -1, -1):
            kept += sizes[held[n]] + 2
            if kept >= overlap:
                del held[:n]
                break

    for i, (s, bound) in enumerate(zip(sizes, bounds)):
        if held and bound and size() >= least:
            close()
        if held and size() + s > most:
            close()
        held.append(i)
    if held and size() >= least:
        out.append(held)
    return out


def chunk(docs: DataFrame, settings: Chunking = Chunking()) -> DataFrame:
    """(chunk_id, doc_id, domain, title, chunk_no, page_start, page_end, section_path, text, keywords, char_start, char_end).

    Only sizes and boundary flags go through the fold; texts are joined where the chunks are known. Documents shorter
    than the least size give no chunk; null texts count as empty.
    """
    rows = cut_lineage(sections(split_large(blocks(docs), settings)))  # read for the plan and for the texts
    most, over = limits(F.col("domain"), settings)

    @F.pandas_udf("array<array<int>>")
    def fold(sizes: pd.Series, bounds: pd.Series, m: pd.Series, o: pd.Series) -> pd.Series:
        return pd.Series([assigned([int(x) for x in s], [bool(x) for x in b], int(mm), int(oo), settings.min_chars) for s, b, mm, oo in zip(sizes, bounds, m, o)])

    per_doc = rows.groupBy("doc_id").agg(F.first("domain").alias("domain"), F.array_sort(F.collect_list(F.struct("no", F.length("text").alias("size"), "boundary"))).alias("b"))
    plan = per_doc.select("doc_id", F.posexplode(fold(F.col("b.size"), F.col("b.boundary"), most, over)).alias("chunk_no", "places"))
    plan = plan.select("doc_id", "chunk_no", F.explode("places").alias("_place")).withColumn("no", F.col("_place") + 1)
    parts = plan.join(rows, ["doc_id", "no"])
    made = parts.groupBy("doc_id", "chunk_no").agg(
        F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"),
        F.max_by("section_path", "no").alias("section_path"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "text"))), lambda x: x["text"]), "\n\n").alias("text"),
    )
    made = made.join(docs.select("doc_id", "domain", "title"), "doc_id")
    number = F.lpad(F.col("chunk_no").cast("string"), 4, "0")
    number = F.when(F.col("chunk_no") > 9999, F.col("chunk_no").cast("string")).otherwise(number)
    name = F.concat_ws("__", F.col("doc_id"), F.concat_ws("_", number, T.stable_id(F.col("doc_id"), F.col("chunk_no").cast("string"), F.col("char_start").cast("string"))))
    return made.select(name.alias("chunk_id"), "doc_id", "domain", "title", F.col("chunk_no").cast("bigint").alias("chunk_no"), "page_start", "page_end", "section_path", "text", T.keywords(F.col("text"), settings.max_keywords).alias("keywords"), "char_start", "char_end")
