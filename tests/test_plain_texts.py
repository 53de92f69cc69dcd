"""Plain texts are told by a plain look."""

from pyspark.sql import functions as F

from tallyforge.functions import text


def test_plain_texts_are_not_rewritten(spark):
    docs = spark.createDataFrame([("a\r\nb\rc d",), (" ",), ("x\r",), ("plain\n",), (None,)], "t string")
    out = docs.select(text.normalised(F.col("t")).alias("n"))
    assert [r.n for r in out.collect()] == ["a\nb\nc d", " ", "x\n", "plain\n", None]
    assert out._jdf.queryExecution().optimizedPlan().toString().lower().count("contains(t") >= 2
