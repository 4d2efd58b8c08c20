"""Problem 2: one form for texts that look alike but differ in their characters.

The tables of code points are made by rule from the Unicode character data that Python carries. A text is taken
apart into positioned code points, of which those that no rule touches stay together in runs. They are joined
with the broadcast table of decompositions and look-alike letters, combining marks are put in the order of their
class behind the character they belong to, each cluster is composed again through a second broadcast table, and
the strings are rebuilt. Texts in which nothing but the width of common punctuation may change need no exploding:
that alone is folded in place.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperlode.session import cut_lineage

#: Letters of other scripts that print as a Latin letter does, and hyphens that print as "-".
LOOKALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХҮԌԚԜаеѕіјорсухһԁԛԝӏ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧνο" + "‐‑‒⁃−",
        "ABESIJKMHOPCTYXYGQWaesijopcyxhdqwl" + "ABEZHIKMNOPTYXvo" + "-----",
    )
)
#: Fixed value: kinds of compatibility decomposition that leave the look as it is. Raised, lowered, circled and
#: fraction forms look different and stay.
SAME_LOOK = {"", "<wide>", "<narrow>", "<noBreak>", "<compat>", "<square>", "<font>", "<isolated>", "<initial>", "<medial>", "<final>", "<small>"}
#: Punctuation that differs in width only and is frequent in running text of either width.
WIDE_MARKS, NARROW_MARKS = "，！？：；（）％", ",!?:;()%"
#: Fixed value: frequent characters that no rule touches; all others are looked up one by one.
PLAIN = r"\n\x20-\x7E一-鿿、。“”《》—·‰…ÖÜäöüéñ"
#: Jamo that print as one syllable, and a syllable that a trailing jamo is added to.
SYLLABLE = r"[\x{1100}-\x{1112}][\x{1161}-\x{1175}][\x{11A8}-\x{11C2}]?|[\x{AC00}-\x{D7A3}][\x{11A8}-\x{11C2}]"
EMOJI = r"[\x{2600}-\x{27BF}\x{1F000}-\x{1FAFF}]"


def _decomposed(ch: str) -> str:
    kind, _, rest = unicodedata.decomposition(ch).rpartition("> ")
    kind = kind + ">" if kind else ""
    if not rest or kind not in SAME_LOOK or 0xAC00 <= ord(ch) <= 0xD7A3:
        return LOOKALIKES.get(ch, ch)
    return "".join(_decomposed(chr(int(x, 16))) for x in rest.split())


@lru_cache(maxsize=1)
def code_points() -> tuple[list[tuple[str, list[tuple[str, int]]]], list[tuple[str, str]]]:
    """(code point, its parts with their combining class); (cluster, its composed form).

    Both are bounded by the Unicode repertoire.
    """
    table, composed = [], []
    for n in range(128, sys.maxunicode + 1):
        if 0xD800 <= n <= 0xDFFF or 0x30000 <= n < 0xE0000 or n >= 0xF0000 or 0x3400 <= n <= 0x9FFF or 0xAC00 <= n <= 0xD7A3 or 0x20000 <= n <= 0x2F7FF:
            continue  # ideographs, Hangul syllables and private planes stand for themselves
        ch = chr(n)
        category = unicodedata.category(ch)
        if category == "Cn":
            continue
        if category == "Cf" or n in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0xFE00 <= n <= 0xFE0F or 0xE0100 <= n <= 0xE01EF:
            parts = ""
        elif category == "Zs":
            parts = " "
        elif n in (0x85, 0x2028, 0x2029):
            parts = "\n"
        else:
            parts = _decomposed(ch)
        again = unicodedata.normalize("NFC", parts)
        mark = unicodedata.combining(ch) > 0
        if ch == "…":
            continue  # three stops are folded into it
        if again == ch and len(parts) > 1:
            composed.append((parts, ch))
        if again != ch or mark or len(parts) > 1:
            table.append((ch, [(p, unicodedata.combining(p)) for p in parts]))
    return table, composed


def syllables() -> list[tuple[str, list[tuple[str, int]]]]:
    """(jamo, their syllable with class 0), also where only the trailing jamo stands apart. All Hangul syllables."""
    out = []
    for n in range(0xAC00, 0xD7A4):
        jamo = unicodedata.normalize("NFD", chr(n))
        out.append((jamo, [(chr(n), 0)]))
        if len(jamo) == 3:
            out.append((unicodedata.normalize("NFC", jamo[:2]) + jamo[2], [(chr(n), 0)]))
    return out


def tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    table, composed = code_points()
    table = [*table, ("\t", [(" ", 0)]), ("\r", []), *syllables()]
    parts = spark.createDataFrame(table, "piece string, parts array<struct<c: string, ccc: int>>")
    return parts, spark.createDataFrame(composed, "cluster string, whole string")


def one_form(df: DataFrame, keys: list[str], text: str = "text", out: str = "form") -> DataFrame:
    """(keys, out): the form that is the same for texts that look alike, for every row of df.

    Width, kind of blank, invisible characters, look-alike letters and composition are made one; raised digits,
    case and wording are kept, and so is the joiner inside an emoji or after a virama. A null text has a null
    form; an empty one, or one of invisible characters only, an empty form. Rows that repeat keys and text come
    out once where they had to be exploded and as they are otherwise; keys must tell different texts apart.
    Other columns, whatever their names, are not read. Long texts are exploded like any other: their code points
    are rows and their runs are untouched.
    """
    spark = df.sparkSession
    parts, composed = tables(spark)
    named = [f"_k{i}" for i in range(len(keys))]
    folded = F.translate(F.replace(F.regexp_replace(text, "\r\n", "\n"), F.lit("..."), F.lit("…")), WIDE_MARKS, NARROW_MARKS)
    src = df.select(*[F.col(k).alias(n) for k, n in zip(keys, named)], folded.alias("_t"))
    needs = F.col("_t").rlike(f"[^{PLAIN}]")
    done = src.filter(F.coalesce(~needs, F.lit(True))).select(*named, F.col("_t").alias(out))

    keep = rf"{EMOJI}\x{{FE0F}}?\x{{200D}}(?={EMOJI})|[\x{{94D}}\x{{9CD}}\x{{DCA}}\x{{E3A}}][\x{{200C}}\x{{200D}}]"
    cut = F.regexp_extract_all("_t", F.lit(rf"(?s)[{PLAIN}]+(?![\p{{M}}\x{{200D}}])|{keep}|{SYLLABLE}|."), F.lit(0))
    rows = src.filter(needs).select(*named, F.posexplode_outer(cut).alias("_pos", "piece"))  # the plain form would cut twice, to test for emptiness
    rows = rows.join(F.broadcast(parts), "piece", "left")
    rows = rows.select(*named, "_pos", F.posexplode_outer(F.coalesce("parts", F.array(F.struct(F.col("piece").alias("c"), F.lit(0).alias("ccc"))))).alias("_sub", "_part"))
    rows = rows.select(*named, (F.col("_pos") * 64 + F.coalesce("_sub", F.lit(0))).alias("_at"), F.coalesce("_part.c", F.lit("")).alias("_c"), F.coalesce("_part.ccc", F.lit(-1)).alias("_ccc"))
    # a mark belongs to the last character before it that is none
    rows = rows.withColumn("_cluster", F.max(F.when(F.col("_ccc") == 0, F.col("_at"))).over(Window.partitionBy(*named).orderBy("_at")))
    marks = F.array_sort(F.collect_set(F.struct("_ccc", "_at", "_c")))  # a set, as rows may be repeated
    clusters = rows.groupBy(*named, "_cluster").agg(F.array_join(F.transform(marks, lambda m: m["_c"]), "").alias("cluster"))
    clusters = clusters.join(F.broadcast(composed), "cluster", "left")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_cluster", F.coalesce("whole", "cluster").alias("c")))), lambda x: x["c"]), "")
    exploded = clusters.groupBy(*named).agg(F.replace(whole, F.lit("..."), F.lit("…")).alias(out))
    return done.unionByName(exploded).select(*[F.col(n).alias(k) for k, n in zip(keys, named)], out)


def lookalike_records(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(record_kind, id, text_hash, form_hash) of all questions and chunks, each pair of id and text once.

    Null ids and null texts have no row.
    """
    q = questions.select(F.lit("question").alias("record_kind"), F.col("qid").alias("id"), F.col("question").alias("text"))
    c = chunks.select(F.lit("chunk").alias("record_kind"), F.col("chunk_id").alias("id"), "text")
    both = q.unionByName(c).filter("id IS NOT NULL AND text IS NOT NULL").withColumn("text_hash", F.xxhash64("text"))
    forms = one_form(both, ["record_kind", "id", "text_hash"])
    return forms.select("record_kind", "id", "text_hash", F.md5(F.col("form").cast("binary")).alias("form_hash")).distinct()


def lookalike_pairs(records: DataFrame) -> DataFrame:
    """(record_kind, id_a, id_b): records whose texts look the same and are not the same characters.

    Texts are paired, not records, so exact copies cost nothing until the pairs of texts are known; records of
    texts without a look-alike are left out before any join.
    """
    records = cut_lineage(records)  # hashes only; read four times below
    texts = records.groupBy("record_kind", "form_hash", "text_hash").agg(F.lit(1).alias("_n"))
    several = texts.groupBy("record_kind", "form_hash").agg(F.count("*").alias("_texts")).filter("_texts > 1").select("record_kind", "form_hash")
    near = records.join(several, ["record_kind", "form_hash"], "left_semi")
    a = near.select("record_kind", "form_hash", F.col("text_hash").alias("_ta"), F.col("id").alias("id_a"))
    b = near.select("record_kind", "form_hash", F.col("text_hash").alias("_tb"), F.col("id").alias("id_b"))
    return a.join(b, ["record_kind", "form_hash"]).filter("_ta <> _tb AND id_a < id_b").select("record_kind", "id_a", "id_b").distinct()
