"""Quantities in different units."""

import pytest

from paperlode.operators import units as U

VALUE = "value_id long, issuer string, doc_id string, evidence_id string, source string, metric string, year int, value double, unit string, raw string"


@pytest.mark.parametrize(
    "raw,number,unit,factor",
    [
        ("1,123万", 1123, "cny", 1e4), ("619‰", 619, "bp", 10), ("约57.1183亿", 57.1183, "cny", 1e8), ("人民币伍拾柒亿壹仟壹佰捌拾叁万元整", 5711830000, "cny", 1),
        ("四亿四千二百九十四万元", 442940000, "cny", 1), ("13亿216万元", 1302160000, "cny", 1), ("RMB 9 ten thousand", 9, "cny", 1e4), ("approx. CNY 0.32 m", 0.32, "cny", 1e6),
        ("1.008423×10^10 元", 10084230000, "cny", 1), ("1.0e9 yuan", 1e9, "cny", 1), ("约-814,237万美元", -814237, "usd", 1e4), ("百分之七十六", 76, "bp", 100), ("一年半", 18, "month", 1),
        ("1年6个月", 18, "month", 1), ("3 km²", 3, "m2", 1e6), ("（1,234）元", 1234, "cny", 1), ("半年", 6, "month", 1), ("2016 小时", 2016, "day", 1 / 24), ("12", 12, None, None), ("", None, None, None), ("n/a", None, None, None),
    ],
)
def test_printed(raw, number, unit, factor):
    n, u, f = U.printed(raw)
    assert (n is None and number is None) or float(n) == pytest.approx(number)
    assert u == unit and (f is None and factor is None or f == pytest.approx(factor))


def test_every_spelling_once():
    assert U.unit_of("（百萬元）") == ("cny", 1e6) and U.unit_of(" 人　民币千元") == ("cny", 1e3) and U.unit_of("％") == ("bp", 100) and U.unit_of("?") is None and U.unit_of(None) is None


def test_passages():
    assert U.stated_in("公司披露2024年退保率6\n19‰。", 619, "退保率", 2024) == ("bp", 10)
    assert U.stated_in("表1 主要数据\n单位：人民币亿元\n| 保费收入 | 2026 | 11.659 |", 11.659, "保费收入", 2026) == ("cny", 1e8)
    assert U.stated_in("Table 6 Main figures\nUnit: RMB thousand\n| revenue | 2024 | 4459370 |", 4459370, "revenue", 2024) == ("cny", 1e3)
    assert U.stated_in("nothing here", 5, "revenue", 2024) is None


def test_descriptions():
    assert U.source_units("All monetary fields: RMB mn. Ratio fields carry per cent figures.") == {"cny": ("cny", 1e6), "bp": ("bp", 100.0)}
    assert U.source_units(None) == {} and U.source_units("Mixed desk entry; see each record.") == {}


def rows(n=300):
    out = []
    for i in range(n):
        money = i % 2
        out.append((i, f"i{i % 7}", "d", None, "s", "revenue" if money else "margin", 2020, float(100 + i), "万元" if money else "%", None))
    return out


def run(spark, values, chunks=(), feeds=()):
    v = spark.createDataFrame(values, VALUE)
    c = spark.createDataFrame(list(chunks), "chunk_id string, text string")
    f = spark.createDataFrame(list(feeds), "source string, description string")
    return {r["value_id"]: r for r in U.common_units(v, c, f).collect()}


def test_order_of_trust_and_review(spark):
    values = [
        *rows(),
        (1000, "i1", "d", "c1", "s", "revenue", 2020, 5.0, "元", "7千元"),
        (1001, "i1", "d", "c1", "s", "revenue", 2020, 5.0, "千元", "5"),
        (1002, "i1", "d", "c1", "s", "revenue", 2021, 9.0, None, "9"),
        (1003, "i1", "d", None, "desk", "revenue", 2021, 120.0, None, None),
        (1004, "i1", "d", None, "desk", "margin", 2021, 0.25, None, None),
        (1005, None, None, None, None, None, None, None, None, None),
        (1006, "i1", "d", None, "s", "revenue", 2020, None, None, "3亿元"),
        (1006, "i1", "d", None, "s", "revenue", 2020, None, None, "3亿元"),
        (1007, "i1", "d", "gone", "s", "revenue", 2020, 150.0, None, None),
        (None, "i1", "d", None, "s", "revenue", 2020, 1.0, "元", None),
    ]
    got = run(spark, values, [("c1", "2021年revenue为9亿元。"), ("c1", "2021年revenue为9亿元。"), (None, None)], [("desk", "Amounts are delivered in thousands of renminbi. Ratios are plain decimals."), ("s", None)])
    assert (got[1000]["stated_by"], got[1000]["common_value"]) == ("raw", 7000)
    assert (got[1001]["stated_by"], got[1001]["common_value"]) == ("unit", 5000)
    assert (got[1002]["stated_by"], got[1002]["common_value"]) == ("passage", 900000000)
    assert (got[1003]["stated_by"], got[1003]["common_unit"], got[1003]["common_value"]) == ("source", "cny", 120000)
    assert (got[1004]["common_unit"], got[1004]["common_value"]) == ("bp", 2500)
    assert got[1005]["route"] == "none" and got[1006]["common_value"] == 300000000
    assert got[1007]["route"] in ("predicted", "review") and got[1007]["common_unit"] == "cny"
    assert None not in got and len(got) == 300 + 8


def test_changed_rows_only(spark):
    v = spark.createDataFrame([(1, "i", "d", None, "s", "m", 2020, 100.0, "元", None), (2, "i", "d", None, "s", "m", 2020, 1.0, "万元", None), (3, "i", "d", None, "s", "m", 2020, None, None, "5%")], VALUE).selectExpr("*", "1 AS number", "'x' AS common")
    e = spark.createDataFrame([], "chunk_id string, text string"), spark.createDataFrame([], "source string, description string")
    got = sorted(map(tuple, U.changed(U.common_units(v.drop("number", "common"), *e)).collect()))
    assert got == [(2, "cny", 10000), (3, "bp", 500)]
    assert U.changed(U.common_units(spark.createDataFrame([], VALUE), *e)).count() == 0


def test_held_out_accuracy(spark):
    """Units of rows whose unit is hidden are told from the other rows of their metric."""
    shown = rows(600)
    hidden = [(10_000 + r[0], *r[1:8], None, None) for r in shown[:80]]
    got = run(spark, shown + hidden)
    right = sum(got[h[0]]["common_unit"] == ("cny" if h[5] == "revenue" else "bp") for h in hidden)
    assert right >= 76


def test_headings_and_metrics_far_away():
    """A cell 10,000 characters below its table's heading, and a metric at the other end of a long sentence."""
    rows = "\n".join(f"| item {i} | {2000 + i % 20} | {i}.5 |" for i in range(500))
    passage = f"表1 其他\n单位：元\n| a | 2020 | 7 |\n\n表2 主要数据\n单位：人民币亿元\n{rows}\n| 保费收入 | 2026 | 11.659 |"
    assert len(passage) > 10_000 and U.stated_in(passage, 11.659, "保费收入", 2026) == ("cny", 1e8) and U.stated_in(passage, 7, None, 2020) == ("cny", 1)
    unnumbered = f"以下金额单位为万元\n{rows}\n| 保费收入 | 2026 | 11.659 |"
    assert U.stated_in(unnumbered, 11.659, "保费收入", 2026) == ("cny", 1e4)
    assert U.stated_in("2024年营业收入" + "经审计确认且" * 30 + "为12.5亿元。", 12.5, "营业收入", 2024) == ("cny", 1e8)


def test_small_share_of_a_huge_table(spark):
    """At 10^12 labelled rows the share of 20,000 is 2e-8; a sample is still taken."""
    from pyspark.sql import functions as F

    ids = spark.range(3_000_000).withColumnRenamed("id", "value_id")
    assert 20 <= U.below(ids, 2e-5, 1).count() <= 120
    rows = spark.range(1).select(F.lit(int(2e-8 * 2**63)).alias("bound")).first()
    assert rows["bound"] > 10**11 and U.below(ids, 1.0, 1).count() == 3_000_000


def test_a_row_does_not_tell_its_own_label(spark):
    """In a group of one there is nothing to compare with; in a group of two there is the other row."""
    rows = spark.createDataFrame([(1, "i", "m", "s", 5.0, "cny", 1e8, "unit"), (2, "j", "m", "s", 7.0, "bp", 100.0, "unit"), (3, "j", "m", "t", 9.0, "bp", 100.0, "raw"), (4, "i", "m", "s", 6.0, None, None, None)], "value_id long, issuer string, metric string, source string, number double, common string, factor double, stated_by string")
    got = {r["value_id"]: r for r in U.features(rows, U.statistics(rows)).collect()}
    assert got[1]["near"] == -99 and got[1]["neighbours"] == 0 and got[1]["source_money"] == -1 and got[1]["as_cny"] == 0 and got[1]["as_bp"] == 1
    assert got[2]["near"] == pytest.approx(2.954243 - 0.845098, abs=1e-5) and got[2]["neighbours"] == 1 and got[2]["as_cny"] == 0.5
    assert got[4]["near"] == pytest.approx(8.69897 - 0.778151, abs=1e-5) and got[4]["source_money"] == 8


def test_predictions_on_held_out_rows_are_right_and_calibrated(spark, sf_dir):
    """Units that the given rows state are hidden from a fifth of them: what is predicted with confidence is right in nine
    cases of ten, and the stated probability is near the share of right ones."""
    from pyspark.sql import functions as F

    values, chunks, feeds = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("numeric_values", "chunks", "feeds"))
    truth = {r["value_id"]: (r["common"], r["factor"]) for r in U.read_units(values.dropDuplicates(["value_id"])).filter("stated_by = 'unit' AND value_id % 5 = 0").collect()}
    hide = F.col("value_id").isin(*truth)
    for c in ("unit", "raw", "evidence_id", "source"):
        values = values.withColumn(c, F.when(~hide, F.col(c)))
    got = [r for r in U.predict(U.stated_units(values, chunks, feeds)).filter(hide & F.col("probability").isNotNull()).collect()]
    sure = [r for r in got if r["probability"] >= U.CONFIDENT]
    right = lambda r: (lambda u, f: (u, float(f)) == truth[r["value_id"]])(*r["predicted"].split("|"))
    assert len(got) >= 50 and (not sure or sum(map(right, sure)) >= 0.9 * len(sure))
    assert abs(sum(r["probability"] for r in got) - sum(map(right, got))) <= 0.12 * len(got)
