"""Plain words and numbers of a line are told by one search each, and mean what the cleaning would have made of them."""

from pyspark.sql import functions as F

from tallyforge.operators import lines


def test_plain_numbers_are_not_cleaned(spark):
    rows = [("| 1 steel bolt 9912, 12 Nos. 7:50 1234.50",), ("‘2’ nut 2025 123456789 3 KG  1,234.50 (6)",), ("12345678 . 5. .5 12kg SET/ -3 \u0663",), (None,)]
    df = spark.createDataFrame(rows, "line string").select("*", lines.parsed_line(F.col("line")).alias("p"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert lines._PLAIN in plan and lines._LIKE_HSN in plan and lines._LIKE_UNIT in plan
    a, b, c, d = (r.p for r in df.collect())
    assert (a.hsn_i, a.unit_i, [(n.v, n.i) for n in a.numbers]) == (3, 5, [(1.0, 0), (12.0, 4), (7.5, 6), (1234.5, 7)])
    assert (b.hsn_i, b.unit_i, [n.v for n in b.numbers]) == (-1, 5, [2.0, 2025.0, 123456789.0, 3.0, 1234.5, 6.0])
    assert (c.hsn_i, c.unit_i, [n.v for n in c.numbers]) == (0, 4, [5.0, 5.0, 12.0, 3.0]) and d.toks is None
