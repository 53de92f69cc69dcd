import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import dates, ids, layers, money, text


def values(spark, rows, f):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c string")
    return [r.v for r in df.select("i", f(F.col("c")).alias("v")).orderBy("i").collect()]


def test_amounts(spark):
    cases = {"1,77,000.00": 177000, "20,00": 20, "1,234,56": 1234.56, "₹ 1,234.50": 1234.5, "Rs. 500/-": 500, "(1,200.00)": 1200, "INR 1,000": 1000, "-34.50": -34.5, "1.2.3": 0, "abc": 0, "": 0}
    assert values(spark, cases, money.amount) == list(cases.values())


def test_dates(spark):
    cases = {"02/04/2026": "02/04/2026", "04/13/2026": "13/04/2026", "11-Feb-26": "11/02/2026", "July 2, 2025": "02/07/2025", "1.2.2026": "01/02/2026", " 31/02/2026 ": "31/02/2026", "2026-04-05": "05/04/2026", "soon": "soon"}
    assert values(spark, cases, dates.normal_date) == list(cases.values())
    assert values(spark, ["2026-04-05", "2026-04-25"], lambda c: dates.normal_date(c, strict_compat=True)) == ["04/05/2026", "25/04/2026"]


def test_fiscal_period(spark):
    rows = [dt.date(2026, 4, 28), dt.date(2026, 3, 31), dt.date(2025, 7, 2), None]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(rows)], "i int, d date")
    assert [r.p for r in df.select("i", dates.fiscal_period(F.col("d")).alias("p")).orderBy("i").collect()] == ["2026/001", "2025/012", "2025/004", ""]


def test_gstin(spark):
    cases = {"33AABCR7I06G1ZQ": "33AABCR7106G1ZQ", "33AABCR7106G12Q": "33AABCR7106G1ZQ", "33AABCR71O6G1ZQ": "33AABCR7106G1ZQ", "33AABCR7106G1OQ": "33AABCR7106G1OQ", "33aabcr7106g1zq": "33AABCR7106G1ZQ"}
    got = values(spark, cases, ids.normal_gstin)
    assert got == list(cases.values())
    assert values(spark, got, ids.normal_gstin) == got
    assert values(spark, ["33AABCR7106G1ZQ", "33AABCR7106G1Z", ""], ids.is_gstin) == [True, False, False]
    assert values(spark, ["x 33AABCR7106G1ZQ y 33AABCR7I06G1ZQ"], ids.gstins) == [["33AABCR7106G1ZQ"]]


def test_hashed_code(spark):
    assert values(spark, ["33AABCR7106G1ZQ"], ids.hashed_code) == ["CMS3308552"]


def test_first_match_lets_an_empty_group_win(spark):
    got = values(spark, ["a: \nb: 2", "b: 2", "c"], lambda c: text.first_match(c, [r"a:([^\n]*)", r"b: (\d)"]))
    assert got == ["", "2", None]


def test_percent_is_exact(spark):
    df = spark.sql("select cast(10858.50 as decimal(18,2)) b, 5 r")
    assert str(df.select(money.percent(F.col("b"), F.col("r")).alias("v")).first().v) == "542.93"


@pytest.mark.parametrize("n", [1, 3])
def test_computed_replaces_and_keeps(spark, n):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, c string").repartition(n)
    got = layers.computed(df, {"c": F.upper("c"), "d": layers.let(F.col("i"), lambda x: x + x)}).orderBy("i").collect()
    assert [(r.i, r.c, r.d) for r in got] == [(1, "A", 2), (2, None, 4)]


def test_arguments_are_worked_out_once(spark):
    """What a function takes may be a search in a long text: a lambda's argument isn't shared by Spark."""
    from tallyforge.operators import tables

    asked = F.regexp_extract("t", "(.+)", 1)
    df = spark.createDataFrame([("a.b Qty RATE",), (None,), ("27AAB0I1234K1Z5",), ("",)], "t string")
    for made in (ids.normal_gstin(asked), ids.hashed_code(asked), text.contains_any(asked, ("q", "x.y", "Qty")), tables.column_field(asked)):
        plan = df.select(made.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract(") == 1
    got = df.select(text.contains_any(F.col("t"), ("a.b",)).alias("a"), text.contains_any(F.col("t"), ("a.c", ".B")).alias("b"), text.contains_any(F.col("t"), ()).alias("none"), text.count_of(F.col("t"), ("a.b", ".b", "Q", "z")).alias("n"))
    assert [tuple(r) for r in got.collect()] == [(True, False, False, 3), (None, None, False, None), (False, False, False, 0), (False, False, False, 0)]
