"""Sources: raw documents of several formats, questions, chunks, answers and evidence, as DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = (".pdf", ".txt", ".md", ".json", ".html", ".htm")
DOCUMENT = "doc_id string, domain string, title string, path string, source_type string, text string, pages array<struct<page: int, text: string, source: string>>, metadata map<string,string>"
QUESTION = "qid string, domain string, split string, question string, options map<string,string>, answer_format string, type string, doc_ids array<string>, answer string"
CHUNK = "chunk_id string, doc_id string, domain string, title string, page_start int, page_end int, section_path array<string>, text string, keywords array<string>, char_start int, char_end int"
#: A parser turns the bytes of a file into its page texts; an empty list means that it got nothing.
Parser = Callable[[bytes], list[str]]


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(path, doc_id, domain, title, suffix, content) of all files of known kinds under root.

    The domain is the first folder under root, the title the file's name with blanks for signs. Files of one name
    under different folders get the same doc_id; `same_ids` reports them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    plain = F.regexp_replace("path", "^file:/+", "/")
    rest = F.substring_index(plain, root.rstrip("/") + "/", -1)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    folder = F.when(F.contains(rest, F.lit("/")), F.substring_index(rest, "/", 1)).otherwise(F.element_at(F.split(F.lit(root.rstrip("/")), "/"), -1))
    rows = files.select(plain.alias("path"), stem.alias("doc_id"), folder.alias("domain"), F.trim(F.regexp_replace(stem, r"[_\-]+", " ")).alias("title"), suffix.alias("suffix"), "content")
    return rows.filter(F.col("suffix").isin(*SUFFIXES))


def same_ids(files: DataFrame) -> DataFrame:
    return files.groupBy("doc_id").agg(F.count("*").alias("files"), F.array_sort(F.collect_list("path")).alias("paths")).filter("files > 1")


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in ("script", "style", "noscript")

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in ("script", "style", "noscript") and self.hidden > 0

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


def html_text(page: str | None) -> str | None:
    """The text nodes of a page, one a line, without scripts, styles and what stands in for scripts."""
    if page is None:
        return None
    parser = _Text()
    parser.feed(page)
    parser.close()
    return "\n".join(parser.parts)


def html_column(page: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(html_text, na_action="ignore"), "string")(page)


def pages_of_markdown(text: Column, source: str) -> Column:
    """Pages of a text with marks `<!-- page: N -->` or `[PAGE N]` on lines of their own; text before the first is page 1."""
    mark = r"(?im)^[ \t]*(?:<!--\s*page:\s*(\d+)\s*-->|\[PAGE\s+(\d+)\])[ \t]*$\n?"
    numbers = F.transform(F.regexp_extract_all(text, F.lit(mark), F.lit(0)), lambda m: F.regexp_extract(m, r"(\d+)", 1).cast("int"))
    parts = F.split(text, mark)
    rows = F.transform(parts, lambda p, i: F.struct(F.coalesce(F.get(numbers, i - 1), F.lit(1)).alias("page"), F.trim(F.regexp_replace(p, r"^\n+|\n+$", "")).alias("text"), F.lit(source).alias("source")))
    return F.filter(rows, lambda p: p["text"] != "")


def pages_of_feeds(text: Column, count: Column) -> Column:
    """Pages of a text that form feeds divide; a blank last page is dropped, missing pages come out empty up to count."""
    parts = F.split(text, "\f")
    parts = F.when(F.trim(F.element_at(parts, -1)) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    missing = F.greatest(F.coalesce(count, F.lit(0)) - F.size(parts), F.lit(0))
    parts = F.concat(parts, F.array_repeat(F.lit(""), missing))
    return F.transform(parts, lambda p, i: F.struct((i + 1).cast("int").alias("page"), p.alias("text"), F.lit("pdftotext").alias("source")))


def enough_text(pages: Column, least_total: int, least_page: int) -> Column:
    """Whether extracted pages hold enough text: in all, and on one page, or two where there are two."""
    size = lambda p: F.length(F.coalesce(p["text"], F.lit("")))
    total = F.aggregate(pages, F.lit(0), lambda s, p: s + size(p))
    full = F.size(F.filter(pages, lambda p: size(p) >= least_page))
    return (total >= least_total) & (full >= F.greatest(F.lit(1), F.least(F.lit(2), F.size(pages))))


def thin_pages(pages: Column, least_page: int, most: int = 0) -> Column:
    """Numbers of pages with too little text, which a recogniser should read; most = 0 sets no limit."""
    thin = F.transform(F.filter(pages, lambda p: F.length(F.coalesce(p["text"], F.lit(""))) < least_page), lambda p: p["page"])
    return F.slice(thin, 1, most) if most else thin


def with_recognised(pages: Column, read: Column) -> Column:
    """Pages with the texts of a recogniser (map of page to text) in place of theirs where it read something."""
    better = lambda p: F.try_element_at(read, p["page"])
    new = F.transform(pages, lambda p: F.when(F.coalesce(F.trim(better(p)), F.lit("")) != "", F.struct(p["page"].alias("page"), better(p).alias("text"), F.lit("ocr").alias("source"))).otherwise(p))
    return F.array_sort(new)


def parse_files(files: DataFrame, parsers: dict[str, list[tuple[str, Parser]]] | None = None, least_total: int = 200, least_page: int = 40) -> DataFrame:
    """Documents of discovered files, with an error column: a file that cannot be read is a row, not a failure.

    Text and markdown are read as UTF-8 with replacement; JSON gives its `text` or itself; HTML its text nodes. For
    other suffixes the given parsers are tried in order until one yields enough text; the last one tried counts.
    """
    parsers = parsers or {}

    def read(suffix: str, content: bytes) -> tuple[list[tuple[str, str]], str | None]:
        import json

        if suffix in (".txt", ".md"):
            return [(content.decode("utf-8", "replace"), "text")], None
        if suffix in (".html", ".htm"):
            return [(html_text(content.decode("utf-8", "replace")) or "", "html")], None
        if suffix == ".json":
            value = json.loads(content.decode("utf-8", "replace"))
            text = value.get("text") if isinstance(value, dict) else None
            return [(text if isinstance(text, str) else json.dumps(value, ensure_ascii=False, indent=2), "json")], None
        pages: list[tuple[str, str]] = []
        for name, parser in parsers.get(suffix, []):
            pages = [(p, name) for p in parser(content)]
            sizes = [len(p) for p, _ in pages]
            if sum(sizes) >= least_total and sum(s >= least_page for s in sizes) >= max(1, min(2, len(sizes))):
                break
        return pages, None if pages else f"no parser for {suffix}"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for x in part.itertuples(index=False):
                try:
                    pages, error = read(x.suffix, x.content)
                except Exception as e:
                    pages, error = [], str(e)
                body = pages[0][0] if len(pages) == 1 and x.suffix != ".pdf" else "\n\n".join(f"[PAGE {i}]\n{p}" for i, (p, _) in enumerate(pages, 1) if p.strip())
                rows.append((x.doc_id, x.domain, x.title, x.path, x.suffix.lstrip("."), body, [{"page": i, "text": p, "source": s} for i, (p, s) in enumerate(pages, 1)], {"char_count": str(len(body))}, error))
            yield pd.DataFrame(rows, columns=["doc_id", "domain", "title", "path", "source_type", "text", "pages", "metadata", "error"])

    return files.mapInPandas(run, DOCUMENT + ", error string")


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of JSON files that hold a list, or an object with a list `questions`; option keys in upper case."""
    raw = spark.read.text(path, wholetext=True)
    value = F.try_parse_json("value")
    listed = F.coalesce(F.try_variant_get(value, "$.questions", "array<variant>"), F.try_variant_get(value, "$", "array<variant>"))
    rows = raw.select(F.explode(listed).alias("q"))
    get = lambda name, kind: F.try_variant_get("q", f"$.{name}", kind)
    text = lambda name: F.coalesce(get(name, "string"), F.lit(""))
    options = F.transform_keys(F.coalesce(get("options", "map<string,string>"), F.create_map().cast("map<string,string>")), lambda k, _: F.upper(k))
    return rows.select(text("qid").alias("qid"), text("domain").alias("domain"), text("split").alias("split"), text("question").alias("question"), options.alias("options"), F.coalesce(get("answer_format", "string"), F.lit("multi")).alias("answer_format"), text("type").alias("type"), F.coalesce(get("doc_ids", "array<string>"), F.array().cast("array<string>")).alias("doc_ids"), get("answer", "string").alias("answer"))


def chunks(spark: SparkSession, path: str, manifest: DataFrame | None = None) -> DataFrame:
    """Chunks of JSON lines; with a manifest only those of its documents, so that left-over files do not count."""
    rows = spark.read.schema(CHUNK).json(path).filter("chunk_id IS NOT NULL")
    return rows if manifest is None else rows.join(manifest.select("doc_id").distinct(), "doc_id", "left_semi")


def answers_csv(spark: SparkSession, path: str) -> DataFrame:
    """(qid, answer) of an answer file, without its summary; of repeated questions the last line of the last file counts."""
    rows = spark.read.option("escape", '"').csv(path, header=True)
    place = [F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_n")]
    rows = rows.select(F.col(f"`{rows.columns[0]}`").alias("qid"), F.coalesce("answer", F.lit("")).alias("answer"), *place).filter("qid <> 'summary'")
    return rows.groupBy("qid").agg(F.max_by("answer", F.struct("_f", "_b", "_n")).alias("answer"))


def evidence(spark: SparkSession, path: str) -> DataFrame:
    """(qid, error, used_doc_ids, evidence_chunks, chunk_ids) of JSON files that hold a list of results; of repeated
    questions one row with most chunks. Files that hold no list, and entries without a question, give no row."""
    rows = spark.read.text(path, wholetext=True).select(F.explode_outer(F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>")).alias("r")).filter("r IS NOT NULL")
    get = lambda name, kind: F.try_variant_get("r", f"$.{name}", kind)
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    ids = F.transform(none(get("evidence_chunks", "array<variant>"), "array<variant>"), lambda c: F.try_variant_get(c, "$.chunk_id", "string"))
    rows = rows.select(get("qid", "string").alias("qid"), get("error", "string").alias("error"), none(get("used_doc_ids", "array<string>"), "array<string>").alias("used_doc_ids"), ids.alias("chunk_ids")).filter("qid <> ''")
    rows = rows.withColumn("evidence_chunks", F.size("chunk_ids").cast("bigint"))
    best = rows.groupBy("qid").agg(F.max_by(F.struct("error", "used_doc_ids", "evidence_chunks", "chunk_ids"), F.struct("evidence_chunks", "chunk_ids")).alias("x"))
    return best.select("qid", "x.*")


def with_metadata(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """Chunks of the manifest's documents with what it says of them: title, path, kind and sizes of the document."""
    meta = manifest.select("doc_id", F.struct(*[F.col(c) for c in manifest.columns if c != "doc_id"]).alias("metadata")).dropDuplicates(["doc_id"])
    return chunks.join(meta, "doc_id")
