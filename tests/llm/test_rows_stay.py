"""The pipeline's stages on plans in which no small table may be broadcast: texts travel once at most."""

import contextlib

from pyspark.sql import functions as F

from tallyforge.llm import line_dedup, mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@contextlib.contextmanager
def large(spark):
    """As if no table were small enough for a broadcast that nobody asks for."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_mixed_rows_do_not_travel(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 9), "en", "ab"[i % 2], 1) for i in range(200)], SCHEMA)
    with large(spark):
        out = mixing.stage(spark, docs, "")
        assert "SortMergeJoin" not in plan_of(out)
        assert out.count() > 0


def test_line_dedup_moves_a_text_once(spark):
    docs = spark.createDataFrame([(i, None if i == 3 else f"common\nown {i}", "en", "a", 1) for i in range(12)], SCHEMA)
    with large(spark):
        out = line_dedup.dedup_lines(docs)
        # Read as bytes for the lines of both sides of the join, not for the rows that travel to it.
        assert out._jdf.queryExecution().optimizedPlan().toString().count("as binary") == 2
        got = {r.doc_id: bytes(r.kept) for r in out.select("own.doc_id", "kept").collect()}
    assert got == {i: b"" if i == 3 else f"own {i}".encode() for i in range(12)}
    assert out.where(F.col("n_lines") == 1).count() == 1
