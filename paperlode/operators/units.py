"""Problem 1: one quantity recorded in different units.

What a row says about its unit is read in the order of trust: the printed form, the unit field, the passage that
the row names as evidence, the description of its source. Where only the source speaks, it does so by category
("amounts in thousands, ratios in per cent"); a calibrated tree ensemble tells the category of the row, and the
unit of rows about which nothing is stated, from magnitude, source, metric and neighbouring rows. Confident
assignments are converted, the others are routed to review.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlode.session import cut_lineage

#: The classifier is fitted and calibrated on at most so many labelled rows each, taken by a hash of their id.
TRAIN_ROWS, CALIBRATION_ROWS = 20_000, 10_000
CONFIDENT = 0.9

#: Names of scales and of units, with what they multiply.
SCALES = {"千": 1e3, "万": 1e4, "萬": 1e4, "百万": 1e6, "百萬": 1e6, "亿": 1e8, "億": 1e8, "十亿": 1e9, "十億": 1e9, "万亿": 1e12}
ENGLISH_SCALES = {"thousand": 1e3, "k": 1e3, "000": 1e3, "'000": 1e3, "ten thousand": 1e4, "10k": 1e4, "million": 1e6, "mn": 1e6, "m": 1e6, "hundred million": 1e8, "100m": 1e8, "100 million": 1e8, "billion": 1e9, "bn": 1e9}
HAN_UNITS = {"元": ("cny", 1), "圆": ("cny", 1), "圓": ("cny", 1), "人民币元": ("cny", 1), "美元": ("usd", 1), "千瓦时": ("kwh", 1), "度": ("kwh", 1), "千瓦": ("kw", 1), "吨": ("kg", 1e3), "平方米": ("m2", 1)}
PLAIN_UNITS = {
    "bp": {"基点": 1, "个基点": 1, "bp": 1, "bps": 1, "basis points": 1, "basis point": 1, "%": 100, "百分点": 100, "个百分点": 100, "pct": 100, "percent": 100, "per cent": 100, "percentage points": 100, "‰": 10, "per mille": 10, "倍": 10000, "times": 10000, "x": 10000},
    "month": {"月": 1, "个月": 1, "month": 1, "months": 1, "mths": 1, "年": 12, "周年": 12, "year": 12, "years": 12, "yr": 12, "yrs": 12, "季度": 3, "个季度": 3, "quarter": 3, "quarters": 3, "qtrs": 3},
    "day": {"天": 1, "日": 1, "day": 1, "days": 1, "d": 1, "周": 7, "星期": 7, "week": 7, "weeks": 7, "wks": 7, "小时": 1 / 24, "hour": 1 / 24, "hours": 1 / 24, "hrs": 1 / 24, "h": 1 / 24},
    "kg": {"公斤": 1, "千克": 1, "kg": 1, "kilograms": 1, "克": 1e-3, "g": 1e-3, "grams": 1e-3, "t": 1e3, "tonnes": 1e3, "10k tonnes": 1e7, "ten thousand tonnes": 1e7, "斤": 0.5, "市斤": 0.5, "jin": 0.5},
    "kwh": {"kwh": 1, "kilowatt-hours": 1, "mwh": 1e3, "兆瓦时": 1e3, "gwh": 1e6, "吉瓦时": 1e6, "10k kwh": 1e4, "ten thousand kwh": 1e4, "100m kwh": 1e8, "hundred million kwh": 1e8},
    "kw": {"kw": 1, "kilowatts": 1, "w": 1e-3, "watts": 1e-3, "瓦": 1e-3, "mw": 1e3, "megawatts": 1e3, "兆瓦": 1e3, "gw": 1e6, "gigawatts": 1e6, "吉瓦": 1e6, "10k kw": 1e4, "ten thousand kw": 1e4},
    "m2": {"m2": 1, "sqm": 1, "square metres": 1, "square meters": 1, "公顷": 1e4, "ha": 1e4, "hectares": 1e4, "平方公里": 1e6, "sq km": 1e6, "km2": 1e6, "square kilometres": 1e6},
}
DIGITS = {ch: i for group in ("零一二三四五六七八九", "〇壹贰叁肆伍陆柒捌玖") for i, ch in enumerate(group)} | {"两": 2, "兩": 2, "貳": 2, "參": 3, "陸": 6}
PLACES = {"十": 10, "拾": 10, "百": 100, "佰": 100, "千": 1000, "仟": 1000}
LARGE = {"万": 10**4, "萬": 10**4, "亿": 10**8, "億": 10**8}
#: A metric counts for a figure in its sentence or row, and so far from it beyond.
METRIC_GAP = 60

_NUMBER = r"[-−–]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:\s*[×xX*]\s*10\s*\^\s*-?\d+|[eE][+-]?\d+)?"
_NUM = re.compile(_NUMBER)
_QUALIFIER = re.compile(r"^(?:约|大约|合计|共计|近|approx\.?|about|total(?:ling)?|circa|ca\.|around)\s*", re.I)
_SPAN = re.compile(r"^(?:([\d.]+|[零〇一二三四五六七八九两十百]+)年(半)?(?:零?([\d.]+|[一二三四五六七八九两十]+)个月)?|(半年))$")
_HAN_NUMBER = re.compile(r"^(负)?([零〇一二三四五六七八九两十百千万亿壹贰叁肆伍陆柒捌玖拾佰仟萬億兩貳參陸]+)(.*)$")


@lru_cache(maxsize=1)
def unit_table() -> dict[str, tuple[str, float]]:
    """Every spelling of a unit, in lower case without blanks, with its common unit and factor: scales times names."""
    out = {name: (common, float(f)) for common, names in PLAIN_UNITS.items() for name, f in names.items()}
    for name, (common, f) in HAN_UNITS.items():
        out[name] = (common, float(f))
        for scale, g in SCALES.items():
            out[scale + name] = (common, f * g)
            if common == "cny" and not name.startswith("人民币"):
                out["人民币" + scale + name] = (common, f * g)
    out |= {s: ("cny", g) for s, g in SCALES.items() if s not in ("千",)}
    for common, names in (("cny", ("yuan", "rmb", "cny", "renminbi")), ("usd", ("us dollars", "usd", "us$", "dollars"))):
        for name in names:
            out[name] = (common, 1.0)
            for scale, g in ENGLISH_SCALES.items():
                out[f"{scale} {name}"] = out[f"{name} {scale}"] = (common, g)
                out[f"{scale}s of {name}"] = (common, g)
    out |= {"¥": ("cny", 1.0), "￥": ("cny", 1.0), "$": ("usd", 1.0), "人民币": ("cny", 1.0)}
    return {squeeze(k): v for k, v in out.items()}


def squeeze(unit: str) -> str:
    """A unit without blanks, brackets and case, in narrow form."""
    text = "".join(ch for ch in unicodedata.normalize("NFKC", unit) if unicodedata.category(ch) != "Cf")
    return re.sub(r"[\s()\[\]【】]", "", text).replace("’", "'").lower()


def unit_of(unit: str | None) -> tuple[str, float] | None:
    return unit_table().get(squeeze(unit)) if unit else None


def number(text: str) -> Decimal | None:
    text = re.sub(r"[,\s]", "", text).replace("−", "-").replace("–", "-")
    m = re.fullmatch(r"(-?[\d.]+)[×xX*]10\^(-?\d+)", text)
    try:
        return Decimal(m[1]).scaleb(int(m[2])) if m else Decimal(text)
    except InvalidOperation:
        return None


def han_number(text: str) -> Decimal | None:
    """A number written in Han numerals, plain or banker's."""
    total = section = digit = 0
    for ch in text:
        if ch in DIGITS:
            digit = DIGITS[ch]
        elif ch in PLACES:
            section += (digit or 1) * PLACES[ch]
            digit = 0
        elif ch in LARGE:
            section += digit
            if ch in "亿億" and total:
                total = (total + section) * LARGE[ch]
            else:
                total += (section or 1) * LARGE[ch]
            section = digit = 0
        else:
            return None
    return Decimal(total + section + digit)


def amount(text: str) -> Decimal | None:
    return number(text) if re.search(r"\d", text) else han_number(text)


@lru_cache(maxsize=100_000)
def printed(raw: str) -> tuple[Decimal | None, str | None, float | None]:
    """(number, common unit, factor) of a printed quantity; the unit parts are None where it prints no unit."""
    text = "".join(ch for ch in unicodedata.normalize("NFKC", raw) if unicodedata.category(ch) != "Cf").strip()
    text = _QUALIFIER.sub("", text).strip()
    text = _QUALIFIER.sub("", text).strip()
    if re.fullmatch(r"\(\s*" + _NUMBER + r"\s*\)", text):
        text = "-" + text.strip("() ")
    span = _SPAN.match(text)
    if span and (span[2] or span[3] or span[4]):  # 1年6个月, 一年半, 半年
        years = amount(span[1]) if span[1] else Decimal(0)
        months = amount(span[3]) if span[3] else Decimal(0)
        if years is not None and months is not None:
            return years * 12 + months + (6 if span[2] or span[4] else 0), "month", 1.0
    share = re.fullmatch(r"(负)?(?:百分之|千分之|万分之)(.+)|(.+)成(半)?", text)
    if share:
        n = amount(share[2] or share[3])
        if n is not None:
            per = {"百": 100.0, "千": 10.0, "万": 1.0}.get((text.lstrip("负"))[0], 1000.0) if share[2] else 1000.0
            return (-n if share[1] else n) + (Decimal("0.5") if share[4] else 0), "bp", per
    m = _NUM.search(text)
    if not m:
        head = re.sub(r"^人民币", "", text)
        m = _HAN_NUMBER.match(head)
        n = han_number(m[2]) if m else None
        if n is None:
            return None, None, None
        unit = unit_of(re.sub(r"[整正]$", "", m[3]) or ("元" if text != head else ""))
        return (-n if m[1] else n), *(unit or (None, None))
    parts = re.findall(rf"({_NUMBER})\s*(亿|億|万|萬|千)", text)
    if len(parts) > 1:  # 13亿216万元
        n = sum((number(p) or 0) * Decimal(SCALES[s]) for p, s in parts)
        rest = unit_of(text[text.rfind(parts[-1][1]) + 1 :]) or ("cny", 1.0)
        return (-abs(n) if text.lstrip("人民币¥").startswith("-") else n), *rest
    before, after = text[: m.start()].strip(), text[m.end() :].strip()
    n = number(m[0])
    if before.endswith("-") and n is not None and n > 0:
        n, before = -n, before[:-1].strip()
    for both in (f"{before} {after}", after, before):
        unit = unit_of(both) if both.strip() else None
        if unit:
            return n, *unit
    return n, None, None


@lru_cache(maxsize=1)
def unit_pattern() -> tuple[re.Pattern, re.Pattern]:
    """Patterns for a unit after a number (longest first) and for a currency before one, in NFKC text."""
    spelt = sorted({*unit_table(), *(k for names in PLAIN_UNITS.values() for k in names)} | {f"{s} {n}" for s in ENGLISH_SCALES for n in ("yuan", "rmb", "cny", "us dollars", "usd", "renminbi")} | {f"{n} {s}" for s in ENGLISH_SCALES for n in ("rmb", "cny", "usd", "us$")} | {"us dollars"}, key=len, reverse=True)
    one = "|".join(r"\s*".join(map(re.escape, s.split())) + (r"(?![a-z])" if s[-1].isalpha() and s[-1].isascii() else "") for s in spelt)
    return re.compile(rf"\s*({one})", re.I), re.compile(r"(人民币|rmb|cny|usd|us\$|[¥$￥])\s*$", re.I)


@lru_cache(maxsize=1)
def invisible() -> re.Pattern:
    """All format characters, from the Unicode character data."""
    return re.compile("[" + "".join(map(chr, (n for n in range(0x110000) if not 0xD800 <= n < 0xE000 and unicodedata.category(chr(n)) == "Cf"))) + "]")


@lru_cache(maxsize=256)
def prepared(passage: str) -> tuple[str, str, list[tuple[float, re.Match]], list[int], list[tuple[int, int]]]:
    """A passage without the line breaks that only fit the width, in lower case too, its numbers, where its sentences
    and rows begin, and (first cell, heading's beginning) of its tables. Kept, as the rows that name a passage come together."""
    text = invisible().sub("", unicodedata.normalize("NFKC", passage))
    text = re.sub(r"(?<=\d)[Oo](?=[\d,.])|(?<=[\d,.])[Oo](?=\d)", "0", text)
    text = re.sub(r"(?<=[\d,.])[lI](?=[\d,.])", "1", text)
    text = re.sub(r"(?<=[一-鿿\d，。；：、,.])[ \t]*\n[ \t]*(?=[一-鿿\d，。；：、,.%‰])(?!\d+\.\d+ )", "", text)
    flat = re.sub(r"[ \t]*\n[ \t]*(?![\n|])", " ", text)
    found = [(number(m[0]), m) for m in _NUM.finditer(flat)]
    begins = [0, *(m.end() for m in re.finditer(r"[。!?;！？；\n]|\.(?=\s)", flat))]
    return flat, flat.lower(), [(float(v), m) for v, m in found if v is not None], begins, tables_in(flat)


def tables_in(flat: str) -> list[tuple[int, int]]:
    """(first cell, beginning of the heading) of each table: a block of lines with cells, or what follows a table's number.
    A table without a number has for heading what stands before its first cell, back to the table before."""
    titles = [m.end() for m in re.finditer(r"(?:表|Table)\s*\d+", flat)]
    out: list[tuple[int, int]] = []
    last = 0
    for m in re.finditer(r"\|[^\n]*(?:\n[ \t]*\|[^\n]*)*", flat):
        pieces = [m.start(), *(t for t in titles if m.start() < t < m.end())]
        for n, at in enumerate(pieces):
            cell = at if n == 0 else flat.find("|", at)
            before = bisect_right(titles, cell) - 1
            out.append((cell, titles[before] if before >= 0 else last))
        last = m.end()
    return [x for x in out if x[0] >= 0]


def stated_in(passage: str, n: float, metric: str | None, year: int | None) -> tuple[str, float] | None:
    """The unit that a passage gives for a number, in the sentence or row of its metric; table cells take the unit of the
    table's heading, however far above it stands."""
    flat, low, numbers, begins, tables = prepared(passage)
    after, before = unit_pattern()
    want = unicodedata.normalize("NFKC", metric).lower() if metric else ""
    best = None
    for value, m in numbers:
        if abs(value - n) > 1e-9 * max(1.0, abs(n)):
            continue
        k = bisect_right(begins, m.start())
        first, stop = begins[k - 1], begins[k] if k < len(begins) else len(low)
        near = low[max(0, min(first, m.start() - METRIC_GAP)) : max(stop, m.end() + METRIC_GAP)]
        if want and want not in near and want.replace(" ", "") not in near.replace(" ", ""):
            continue
        cell = re.match(r"\s*\|", flat[m.end() :]) and flat[: m.start()].rstrip().endswith("|")
        if cell:
            line = flat[flat.rfind("\n", 0, m.start()) + 1 : m.end()].lower() if "\n" in flat[: m.start()] else near
            if want and want not in line:
                continue
            table = bisect_right(tables, (m.start(), 1 << 62)) - 1
            head = flat[tables[table][1] : tables[table][0]] if table >= 0 else ""
            said = [x for x in after.finditer(head) if len(x[1]) > 1 or not x[1].isascii()]
            said = [x for x in said if not re.match(r"[a-z]", head[x.start(1) - 1 : x.start(1)], re.I)]
            unit = unit_of(max((x[1] for x in said), key=len)) if said else None
            if unit:
                return unit
            continue
        money = before.search(flat, max(0, m.start() - 8), m.start())
        tail = after.match(flat, m.end())
        unit = None
        if money:
            scale = re.match(r"\s*(ten thousand|hundred million|100 million|thousand|million|billion|mn|bn|m|k|十亿元?|百万元?|百萬元?|万元?|萬元?|亿元?|億元?|千元?|元)(?![a-z])", flat[m.end() :], re.I)
            unit = unit_of(f"{money[1]} {scale[1]}") if scale and money[1].isascii() and money[1].isalpha() else None
            unit = unit or (unit_of(tail[1]) if tail and not money[1].isascii() else None) or unit_of(money[1] + (scale[1] if scale else "")) or unit_of(money[1])
        elif tail:
            unit = unit_of(tail[1])
        if unit and (year is None or str(year) in near):
            return unit
        best = best or unit
    return best


def source_units(text: str | None) -> dict[str, tuple[str, float]]:
    """What the description of a source says of amounts ("cny") and of ratios ("bp")."""
    out: dict[str, tuple[str, float]] = {}
    text = unicodedata.normalize("NFKC", text or "")
    for clause in re.split(r"[;；。,，]|\.(?=\s|$)", text):
        low = clause.lower()
        relative = re.search(r"ratio|relative|比率|利率|rate", low)
        if relative:
            if re.search(r"per ?cent|百分", low):
                out["bp"] = ("bp", 100.0)
            elif re.search(r"per ?mille|千分", low):
                out["bp"] = ("bp", 10.0)
            elif re.search(r"basis|基点|\bbps?\b", low):
                out["bp"] = ("bp", 1.0)
            elif re.search(r"decimal|fraction|小数|of one", low):
                out["bp"] = ("bp", 10000.0)
        elif "cny" not in out and re.search(r"amount|money|monetary|金额|yuan|renminbi|rmb|元", low):
            scale = re.search(r"(thousand|million|billion|hundred million|ten thousand)s?\s+(?:of\s+)?(?:yuan|renminbi|rmb)|(?:rmb|cny)\s*(mn|bn|k|m|million|billion|thousand)\b|((?:十亿|百万|百萬|千|万|萬|亿|億)?元)|whole (yuan)", low)
            if scale:
                found = next(g for g in scale.groups() if g)
                out["cny"] = unit_of(found) or unit_of(f"rmb {found}") or ("cny", 1.0)
    return out


def read_units(values: DataFrame) -> DataFrame:
    """Add number, unit, factor and stated_by (raw, unit or null) to rows of quantities."""

    @F.pandas_udf("number double, common string, factor double, stated_by string")
    def read(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for raw, unit, value in parts:
            rows = []
            for r, u, v in zip(raw, unit, value):
                n, common, factor = printed(r) if r else (None, None, None)
                by = "raw" if common and n is not None else None
                if by is None:
                    common, factor = unit_of(u) or (None, None)
                    n = v if v is not None and v == v else n
                    by = "unit" if common and n is not None else None
                rows.append((None if n is None else float(n), common if by else None, factor if by else None, by))
            yield pd.DataFrame(rows, columns=["number", "common", "factor", "stated_by"])

    return values.withColumn("_q", read("raw", "unit", "value")).select(*values.columns, "_q.*")


def stated_units(values: DataFrame, passages: DataFrame, sources: DataFrame) -> DataFrame:
    """One row for each value_id with number, common, factor, stated_by (raw, unit, passage, source or null) and, where
    only the source speaks, its factors for amounts and ratios (source_cny, source_bp)."""
    cols = ["value_id", "issuer", "doc_id", "evidence_id", "source", "metric", "year", "value", "unit", "raw"]
    rows = values.filter("value_id IS NOT NULL").select(cols)
    read = read_units(rows)
    told = read.filter(F.col("stated_by").isNotNull() | F.col("evidence_id").isNull() | F.col("number").isNull())
    # the plain spellings of units are sifted out before Python reads a row for the second time
    known = F.coalesce(F.lower(F.replace("unit", F.lit(" "), F.lit(""))).isin(*unit_table()), F.lit(False))
    maybe = read_units(rows.filter(F.col("evidence_id").isNotNull() & ~known))
    asks = maybe.filter(F.col("stated_by").isNull() & F.col("number").isNotNull())

    @F.pandas_udf("common string, factor double")
    def look(text: pd.Series, n: pd.Series, metric: pd.Series, year: pd.Series) -> pd.DataFrame:
        found = [stated_in(t, x, m, None if y is None or y != y else int(y)) if t else None for t, x, m, y in zip(text, n, metric, year)]
        return pd.DataFrame([f or (None, None) for f in found], columns=["common", "factor"])

    texts = passages.filter("chunk_id IS NOT NULL").select(F.col("chunk_id").alias("evidence_id"), F.col("text").alias("_text"))
    seen = asks.drop("common", "factor", "stated_by").join(texts, "evidence_id", "left")
    seen = seen.withColumn("_u", look("_text", "number", "metric", "year")).select(*cols, "number", "_u.common", "_u.factor")
    seen = seen.withColumn("stated_by", F.when(F.col("common").isNotNull(), "passage"))

    @F.pandas_udf("cny double, bp double")
    def describe(text: pd.Series) -> pd.DataFrame:
        said = [source_units(t) for t in text]
        return pd.DataFrame([(s["cny"][1] if "cny" in s else None, s["bp"][1] if "bp" in s else None) for s in said], columns=["cny", "bp"], dtype="float64")

    # one row for each source; the rows of values keep their place, only the small side is moved
    by_source = sources.filter("source IS NOT NULL").groupBy("source").agg(F.max("description").alias("description")).withColumn("_d", describe("description")).select("source", F.col("_d.cny").alias("source_cny"), F.col("_d.bp").alias("source_bp"))
    both = told.select(*seen.columns).unionByName(seen).join(by_source, "source", "left")
    return both.dropDuplicates(["value_id"])


COMMON_UNITS = (*PLAIN_UNITS, "cny", "usd")
FEATURES = ["size", "near", "neighbours", "negative", "broken", "metric_scale", "source_money", "source_ratio", *(f"as_{u}" for u in COMMON_UNITS)]


def _log(c: Column) -> Column:
    return F.log10(F.greatest(F.abs(c), F.lit(1e-9)))


def statistics(every: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sums over all rows that state their unit: of issuer and metric, of metric, of source. Made in one pass over the
    rows, and kept; a group is one row, however many rows of quantities it has."""
    told = every.filter("stated_by IS NOT NULL").select("issuer", "metric", "source", "common", _log(F.col("number") * F.col("factor")).alias("_s"), _log(F.col("factor")).alias("_f"))
    # the rows are summed up by all three keys first, which leaves few for the three tables
    of = lambda u, c: F.sum(F.when(F.col("common") == u, c))
    shared = cut_lineage(told.groupBy("issuer", "metric", "source", "common").agg(F.sum("_s").alias("_s"), F.sum("_f").alias("_f"), F.count("*").alias("_n")))
    own = shared.filter("metric IS NOT NULL AND issuer IS NOT NULL").groupBy("issuer", "metric").agg(F.sum("_s").alias("own_s"), F.sum("_n").alias("own_n"))
    metric = shared.filter("metric IS NOT NULL").groupBy("metric").agg(F.sum("_f").alias("metric_f"), F.sum("_n").alias("metric_n"), *[F.coalesce(of(u, F.col("_n")), F.lit(0)).alias(f"n_{u}") for u in COMMON_UNITS])
    source = shared.filter("source IS NOT NULL").groupBy("source").agg(*[x for u in ("cny", "bp") for x in (F.coalesce(of(u, F.col("_f")), F.lit(0.0)).alias(f"f_{u}"), F.coalesce(of(u, F.col("_n")), F.lit(0)).alias(f"c_{u}"))])
    return own, metric, source


def features(rows: DataFrame, sums: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """Add to rows what the classifier looks at: magnitude, decimals and sign; how the other rows of the metric are spread
    over the common units; the scales that the source uses in its other rows; the distance to the other rows of the
    issuer's metric. A row that states its unit is left out of what it is compared with, or it would tell its label."""
    own, metric, source = sums
    told = F.col("stated_by").isNotNull()
    mine = F.when(told, 1).otherwise(0)
    rows = rows.select(*[c for c in rows.columns if c not in FEATURES])
    both = rows.join(own, ["issuer", "metric"], "left").join(metric, "metric", "left").join(source, "source", "left")
    size, scale = _log(F.col("number") * F.col("factor")), _log(F.col("factor"))
    mean = lambda total, n, minus, less: F.when(n - less > 0, (total - F.when(less > 0, minus).otherwise(0.0)) / (n - less))
    unit = lambda u: F.when(told & (F.col("common") == u), 1).otherwise(0)
    return both.select(
        *rows.columns,
        _log(F.col("number")).alias("size"),
        F.coalesce(mean(F.col("own_s"), F.col("own_n"), size, mine) - _log(F.col("number")), F.lit(-99.0)).alias("near"),
        F.coalesce((F.col("own_n") - mine).cast("double"), F.lit(0.0)).alias("neighbours"),
        F.coalesce((F.col("number") < 0).cast("double"), F.lit(0.0)).alias("negative"),
        F.when(F.col("number") == F.floor("number"), 0.0).otherwise(1.0).alias("broken"),
        F.coalesce(mean(F.col("metric_f"), F.col("metric_n"), scale, mine), F.lit(-1.0)).alias("metric_scale"),
        F.coalesce(mean(F.col("f_cny"), F.col("c_cny"), scale, unit("cny")), F.lit(-1.0)).alias("source_money"),
        F.coalesce(mean(F.col("f_bp"), F.col("c_bp"), scale, unit("bp")), F.lit(-1.0)).alias("source_ratio"),
        *[F.coalesce(F.when(F.col("metric_n") - mine > 0, (F.col(f"n_{u}") - unit(u)) / (F.col("metric_n") - mine)), F.lit(-1.0)).alias(f"as_{u}") for u in COMMON_UNITS],
    )


def bounded(rows: DataFrame, most: int, salt: int) -> DataFrame:
    """About `most` rows, chosen by a hash of their id, the same on each run. The count is the only thing collected."""
    return below(rows, min(1.0, most / max(rows.count(), 1)), salt)


def below(rows: DataFrame, share: float, salt: int) -> DataFrame:
    """A share of the rows by all 63 bits of a hash of their id, so that the smallest share of the largest table is not nothing."""
    return rows if share >= 1 else rows.filter(F.shiftrightunsigned(F.xxhash64("value_id", F.lit(salt)), 1) < int(share * 2**63))


def predict(rows: DataFrame, train_rows: int = TRAIN_ROWS, calibration_rows: int = CALIBRATION_ROWS) -> DataFrame:
    """Add predicted (common unit and factor), its calibrated probability, category and category_p to rows without a unit.

    rows are the result of `stated_units`. A random forest is fitted on a bounded sample of the rows that state
    their unit, and calibrated by isotonic regression on another. Without rows to learn from, nothing is predicted.
    """
    label = F.concat_ws("|", "common", F.col("factor").cast("string"))
    known = rows.filter("stated_by IN ('raw', 'unit', 'passage') AND number IS NOT NULL").withColumn("label", label)
    fold = F.pmod(F.xxhash64("value_id"), F.lit(4))
    sums = statistics(rows)
    train = cut_lineage(features(bounded(known.filter(fold != 0), train_rows, 1), sums))
    ask = features(rows.filter("stated_by IS NULL AND number IS NOT NULL"), sums)
    empty = F.lit(None)
    rest = rows.filter("stated_by IS NOT NULL OR number IS NULL")
    add = lambda df, p, q, c, d: df.select(*rows.columns, p.cast("string").alias("predicted"), q.cast("double").alias("probability"), c.cast("string").alias("category"), d.cast("double").alias("category_p"))
    if len(train.select("label").distinct().take(2)) < 2:
        return add(rows, empty, empty, empty, empty)
    stages = [
        StringIndexer(inputCol="label", outputCol="target", handleInvalid="skip", stringOrderType="alphabetAsc"),
        VectorAssembler(inputCols=FEATURES, outputCol="features"),
        RandomForestClassifier(labelCol="target", featuresCol="features", numTrees=20, maxDepth=10, maxBins=32, featureSubsetStrategy="0.5", seed=11, maxMemoryInMB=64),
    ]
    fitted = Pipeline(stages=stages).fit(train)
    labels = fitted.stages[0].labels
    units = sorted({x.split("|")[0] for x in labels})
    member = np.array([[x.split("|")[0] == u for u in units] for x in labels], dtype=float)

    @F.pandas_udf("top double, name string, unit string, unit_p double")
    def best(p: pd.Series) -> pd.DataFrame:
        p = np.stack(p.to_numpy()) if len(p) else np.zeros((0, len(labels)))
        by_unit = p @ member
        return pd.DataFrame({"top": p.max(axis=1), "name": np.take(labels, p.argmax(axis=1)), "unit": np.take(units, by_unit.argmax(axis=1)), "unit_p": by_unit.max(axis=1)})

    def scored(df: DataFrame) -> DataFrame:
        for stage in fitted.stages[1:]:
            df = stage.transform(df)
        # the probabilities leave the JVM once; as columns they would be computed anew for each use
        return df.withColumn("_b", best(vector_to_array("probability"))).drop("probability", "rawPrediction", "prediction", "features")

    held = cut_lineage(scored(features(bounded(known.filter(fold == 0), calibration_rows, 2), sums)).select("label", "_b.*", "common"))
    # scores are rounded to hundredths, so a fit is a table of 101 values
    fit = lambda score, right: table(held.select(F.round(score, 2).alias("score"), right.cast("double").alias("right")))
    unit_curve = fit(F.col("top"), F.col("name") == F.col("label"))
    category_curve = fit(F.col("unit_p"), F.col("unit") == F.col("common"))
    asked = scored(ask)
    asked = add(asked, F.col("_b.name"), calibrated(F.col("_b.top"), unit_curve), F.col("_b.unit"), calibrated(F.col("_b.unit_p"), category_curve))
    return asked.unionByName(add(rest, empty, empty, empty, empty))


def table(scores: DataFrame) -> list[float]:
    """Share of right assignments at each hundredth of the score, by isotonic regression; the score itself if nothing was held out."""
    model = IsotonicRegression(featuresCol="score", labelCol="right").fit(scores) if scores.take(1) else None
    return [model.predict(i / 100) if model else i / 100 for i in range(101)]


def calibrated(score: Column, steps: list[float]) -> Column:
    return F.get(F.array(*[F.lit(float(p)) for p in steps]), F.round(score * 100).cast("int"))


def common_units(values: DataFrame, passages: DataFrame, sources: DataFrame, confident: float = CONFIDENT) -> DataFrame:
    """(value_id, value, common_unit, common_value, stated_by, probability, route) of every value_id.

    route is `stated` where something states the unit, `predicted` where nothing does and the classifier is
    confident, `review` where it is not, and `none` where there is no number. Null fields are allowed anywhere; a
    re-delivered row counts once; unknown spellings of units count as no unit; empty tables give no rows.
    """
    kept = ["value_id", "issuer", "source", "metric", "value", "number", "common", "factor", "stated_by", "source_cny", "source_bp"]
    rows = predict(cut_lineage(stated_units(values, passages, sources).select(kept)))
    source_factor = F.when(F.col("category") == "cny", F.col("source_cny")).when(F.col("category") == "bp", F.col("source_bp"))
    by_source = F.col("stated_by").isNull() & source_factor.isNotNull() & (F.col("category_p") >= confident)
    rows = rows.withColumn("_by_source", F.coalesce(by_source, F.lit(False)))
    guess = F.split("predicted", r"\|")
    unit = F.when(F.col("stated_by").isNotNull(), F.col("common")).when(F.col("_by_source"), F.col("category")).otherwise(F.get(guess, 0))
    factor = F.when(F.col("stated_by").isNotNull(), F.col("factor")).when(F.col("_by_source"), source_factor).otherwise(F.get(guess, 1).cast("double"))
    by = F.when(F.col("_by_source"), F.lit("source")).otherwise(F.col("stated_by"))
    route = F.when(F.col("number").isNull(), "none").when(by.isNotNull(), "stated").when(F.col("probability") >= confident, "predicted").otherwise("review")
    common = F.when(route.isin("stated", "predicted"), F.round(F.col("number") * factor).cast("bigint"))
    return rows.select("value_id", "value", F.when(route != "none", unit).alias("common_unit"), common.alias("common_value"), by.alias("stated_by"), F.when(by.isNull(), F.col("probability")).alias("probability"), route.alias("route"))


def changed(units: DataFrame) -> DataFrame:
    """(value_id, common_unit, common_value) of rows whose stated quantity differs from the recorded value or has none."""
    off = F.col("value").isNull() | F.isnan("value") | (F.abs(F.col("value") - F.col("common_value")) > 1e-6 * F.greatest(F.lit(1.0), F.abs("common_value")))
    return units.filter((F.col("route") == "stated") & off & F.col("common_value").isNotNull()).select("value_id", "common_unit", "common_value")
