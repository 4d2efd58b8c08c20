"""Problem 3: cutting oversized texts at natural boundaries, with overlap.

One regular expression, built from the limits of the row, takes the whole text apart. Its alternatives stand in
the order of boundary strength (rest of the text, paragraph, sentence, line, clause, blank, any character); each
is a bounded repetition that takes as much as it can up to the limit. Overlap comes from looking back into the
piece before, with SQL array functions, so nothing leaves the row until the pieces are exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What may stand before a cut, from strong to weak.
BOUNDARIES = (
    r"(?<=\n\n)",
    r"(?:(?<=[。！？…])|(?<=[。！？…][”’」』）》\)])|(?<=[.!?]\s)|(?<=[.!?][\"'”’)\]]\s))(?![”’」』）》\)])",
    r"(?<=\n)",
    r"(?:(?<=[；;：，、])|(?<=,\s))",
    r"(?<=\s)",
    r"(?!\p{M})",
)
#: Fixed value: headings of a filing, first level before second level.
HEADING = r"(?:第[一二三四五六七八九十百零〇\d]{1,6}[编章节][ 　]|(?:Section|Chapter|Part) \d+|\d{1,2}(?:\.\d{1,2}){0,2} \p{L}|[一二三四五六七八九十]{1,3}、)[^\n。！？|]{0,60}"
TOP_LEVEL = r"^(?:第|Section|Chapter|Part|\d{1,2} |[一二三四五六七八九十]{1,3}、)"
PAGE_MARK = r"\[PAGE \d+\]\n"


def cut_pattern(limit: Column, overlap: Column) -> Column:
    """The expression for one row: the first piece may fill the limit, later ones the limit less the overlap."""

    def alternatives(most: Column) -> Column:
        least = F.greatest((most / 2).cast("int"), F.least(overlap, most), F.lit(1)).cast("string")
        upto = most.cast("string")
        parts = [F.concat(F.lit(".{1,"), upto, F.lit(r"}+\z"))]
        parts += [F.concat(F.lit(".{"), least, F.lit(","), upto, F.lit("}" + b)) for b in BOUNDARIES]
        parts += [F.concat(F.lit(".{1,"), upto, F.lit("}"))]
        return F.concat_ws("|", *parts)

    return F.concat(F.lit(r"(?s)\A(?:"), alternatives(limit), F.lit(r")|(?!\A)(?:"), alternatives(limit - overlap), F.lit(")"))


def running(sizes: Column) -> Column:
    """Offsets of consecutive parts from their sizes."""
    empty = F.array().cast("array<int>")
    return F.aggregate(
        sizes,
        F.struct(F.lit(0).alias("at"), empty.alias("all")),
        lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")),
        lambda s: s["all"],
    )


def split_text(df: DataFrame, text: str, limit: str, overlap: str, out: str = "pieces") -> DataFrame:
    """Add `out`: array<struct<piece_no, start, end, text>> of each text, start and end in code points.

    A text within the limit is one piece. Null and empty texts give an empty array; a null limit means no limit.
    An overlap of more than half the limit counts as half, a negative or null one as none; a limit below 1 as 1.
    Cuts are made in the order described above, so the result is the same on every run. Each later piece begins
    with the last `overlap` characters of what was cut before it. Very long texts are cut as any other.
    """
    t, most = F.col(text), F.when(F.col(limit).isNotNull(), F.greatest(F.col(limit), F.lit(1)))
    back = F.least(F.greatest(F.coalesce(F.col(overlap), F.lit(0)), F.lit(0)), (most / 2).cast("int"))
    whole = most.isNull() | (F.length(t) <= most)
    cuts = F.when(t.isNull() | (t == ""), F.array().cast("array<string>")).when(whole, F.array(t)).otherwise(F.regexp_extract_all(t, cut_pattern(most, back), F.lit(0)))
    df = df.withColumn("_cuts", cuts).withColumn("_back", back).withColumn("_at", running(F.transform("_cuts", F.length)))

    def piece(p: Column, i: Column) -> Column:
        before = F.when((i > 0) & (F.col("_back") > 0), F.right(F.get(F.col("_cuts"), i - 1), F.col("_back"))).otherwise("")
        at = F.get(F.col("_at"), i)
        return F.struct(i.alias("piece_no"), (at - F.length(before)).alias("start"), (at + F.length(p)).alias("end"), F.concat(before, p).alias("text"))

    return df.withColumn(out, F.transform("_cuts", piece)).drop("_cuts", "_back", "_at")


def with_limits(df: DataFrame, limits: DataFrame) -> DataFrame:
    """Add max_chars and overlap_chars by domain, without regard to case and outer blanks.

    A null, blank or unknown domain takes the row `default`; without such a row there is no limit. limits holds a
    row for each domain, a fixed handful, so it is broadcast.
    """
    name = lambda c: F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    own = limits.filter(F.col("domain").isNotNull()).groupBy(name(F.col("domain")).alias("_domain")).agg(F.min("max_chars").alias("_max"), F.min("overlap_chars").alias("_overlap"))
    rest = own.filter("_domain = 'default'").select(F.lit(1).alias("_one"), F.col("_max").alias("_max0"), F.col("_overlap").alias("_overlap0"))
    out = df.drop("max_chars", "overlap_chars").withColumn("_domain", name(F.col("domain"))).withColumn("_one", F.lit(1))
    out = out.join(F.broadcast(own), "_domain", "left").join(F.broadcast(rest), "_one", "left")
    return out.withColumn("max_chars", F.coalesce("_max", "_max0")).withColumn("overlap_chars", F.coalesce("_overlap", "_overlap0")).drop("_domain", "_one", "_max", "_overlap", "_max0", "_overlap0")


def exploded(array: str) -> Column:
    """Rows of an array. The outer form, as for the plain one Spark tests the array's size first, and with it works
    out all that the array is made of once more, for each of its places."""
    return F.explode_outer(array)


def headings(text: Column) -> Column:
    """array<struct<pos, top, title>> of the heading lines of a text."""
    parts = F.split(text, r"(?m)(?=^" + HEADING + r"$)")
    head = F.transform(parts, lambda p: F.regexp_extract(p, r"\A" + HEADING + r"(?=\n|\z)", 0))
    at = running(F.transform(parts, F.length))
    rows = F.transform(F.arrays_zip(at.alias("pos"), head.alias("title")), lambda h: F.struct(h["pos"].alias("pos"), h["title"].rlike(TOP_LEVEL).alias("top"), F.trim(h["title"]).alias("title")))
    return F.filter(rows, lambda h: h["title"] != "")


def section_at(heads: Column, pos: Column) -> Column:
    """The section path in force at a place: the last first-level heading and the last lower one after it."""
    seen = F.filter(heads, lambda h: h["pos"] <= pos)
    top = F.element_at(F.concat(F.array(F.lit(None)), F.filter(seen, lambda h: h["top"])), -1)
    low = F.element_at(F.concat(F.array(F.lit(None)), F.filter(seen, lambda h: ~h["top"] & (h["pos"] > F.coalesce(top["pos"], F.lit(-1))))), -1)
    return F.array_compact(F.array(top["title"], low["title"]))


def split_oversized(filings: DataFrame, chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of all filings and chunks: item_table, item_id, piece_no, n_pieces, section_path, char_start, char_end, text.

    char_start and char_end are places in the filing's text. In a chunk the page marks that were left out are
    counted in again; a chunk that was parsed anew has other characters, so its places are near, within the
    chunk's own. A chunk keeps its section_path, or takes the filing's at its start where it has none; a chunk of
    an unknown filing then has an empty path. Null and empty texts have no pieces. Re-delivered rows repeat their
    pieces here; `one_delivery` keeps one.
    """
    marks = F.split(F.col("text"), "(?m)^" + PAGE_MARK)
    mark_len = F.transform(F.regexp_extract_all("text", F.lit("(?m)^" + PAGE_MARK), F.lit(0)), F.length)
    maps = filings.filter(F.col("doc_id").isNotNull()).select("doc_id", headings(F.col("text")).alias("_heads"), F.transform(marks, F.length).alias("_gaps"), mark_len.alias("_marks"))
    # place of each mark in the text without marks, and in the text itself
    maps = maps.withColumn("_bare", F.slice(running("_gaps"), 2, F.greatest(F.size("_gaps") - 1, F.lit(0)))).withColumn("_shift", running("_marks"))
    maps = maps.groupBy("doc_id").agg(F.min(F.struct("_heads", "_bare", "_shift", "_marks")).alias("_map")).select("doc_id", "_map.*")

    f = with_limits(filings.select("doc_id", "domain", "text"), limits)
    f = split_text(f, "text", "max_chars", "overlap_chars").withColumn("_heads", headings(F.col("text")))
    f = f.select(F.lit("filings").alias("item_table"), F.col("doc_id").alias("item_id"), "_heads", F.size("pieces").alias("n_pieces"), exploded("pieces").alias("p")).filter("p IS NOT NULL")
    f = f.select("item_table", "item_id", "n_pieces", "p.piece_no", section_at(F.col("_heads"), F.col("p.start")).alias("section_path"), F.col("p.start").alias("char_start"), F.col("p.end").alias("char_end"), "p.text")

    c = with_limits(chunks.select("chunk_id", "doc_id", "domain", "section_path", "text", F.col("char_start").alias("_from"), F.col("char_end").alias("_to")), limits)
    c = split_text(c, "text", "max_chars", "overlap_chars").select("chunk_id", "doc_id", "section_path", "_from", "_to", "pieces")
    c = c.join(maps, "doc_id", "left")
    base = F.col("_from") - F.coalesce(F.aggregate(F.filter(F.arrays_zip("_bare", "_shift", "_marks"), lambda m: m["_bare"] + m["_shift"] < F.col("_from")), F.lit(0), lambda a, m: a + m["_marks"]), F.lit(0))

    def place(at: Column, strict: bool) -> Column:
        bare = at + F.col("_base")
        passed = F.filter(F.arrays_zip("_bare", "_marks", "_shift"), lambda m: (m["_bare"] < bare if strict else m["_bare"] <= bare) & (m["_bare"] + m["_shift"] >= F.col("_from")))
        moved = F.coalesce(F.aggregate(passed, F.lit(0), lambda a, m: a + m["_marks"]), F.lit(0))
        return F.least(F.col("_from") + at + moved, F.col("_to"))

    c = c.withColumn("_base", base).select(F.lit("chunks").alias("item_table"), F.col("chunk_id").alias("item_id"), F.size("pieces").alias("n_pieces"), "section_path", "_heads", "_bare", "_marks", "_shift", "_base", "_from", "_to", exploded("pieces").alias("p")).filter("p IS NOT NULL")
    path = F.coalesce("section_path", section_at(F.col("_heads"), F.col("_from")), F.array().cast("array<string>"))
    c = c.select("item_table", "item_id", "n_pieces", "p.piece_no", path.alias("section_path"), place(F.col("p.start"), False).alias("char_start"), place(F.col("p.end"), True).alias("char_end"), "p.text")
    return f.unionByName(c)


def one_delivery(pieces: DataFrame) -> DataFrame:
    """One row for each item and piece: re-delivered rows have the same content."""
    return pieces.groupBy("item_table", "item_id", "piece_no").agg(*[F.first(c).alias(c) for c in ("n_pieces", "section_path", "char_start", "char_end", "text")])


def oversized(pieces: DataFrame) -> DataFrame:
    """The items that had to be cut."""
    return pieces.filter("piece_no = 1").select("item_table", "item_id").distinct()
