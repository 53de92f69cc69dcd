"""Work that is done once: an invoice is put together once for both ways of validation, a date is read once, states are shared."""

import datetime as dt

import duckdb
from pyspark.sql import functions as F

from tallyforge.functions.dates import to_date
from tallyforge.operators import validate
from tallyforge.plans import branches, catalogue
from tallyforge.streaming import invoices

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_invoices_are_validated_in_one_pass(spark):
    joins = lambda df: plan_of(df).count("Join ")
    assert joins(branches.q_gst_valid(spark, SF)) == joins(catalogue._invoices(spark, SF))


def test_a_date_is_read_once(spark):
    docs = spark.createDataFrame([("05/06/1990",), ("99/99/2000",), ("",), ("1.2.2090",)], "v string")
    issue = docs.select(validate.date_issue(F.col("v"), "Date", F.lit("2003-06-01").cast("date")).alias("i"))
    reads = lambda df: plan_of(df).lower().count("as date")
    assert reads(issue) <= reads(docs.select(to_date(F.col("v")))) + 1 and "gettimestamp" not in plan_of(issue).lower()
    assert [r.i and r.i.issue.split(":")[0] for r in issue.collect()] == ["Date is more than 5 years old", "Cannot parse date", "Date not found", "Date is in the future"]


def test_a_journals_balance_needs_no_line_text(spark):
    assert "APR.26" not in plan_of(catalogue.q_journal_balance(spark, SF))


def test_numbers_share_states(spark, tmp_path):
    """300 numbers in five states: repeats within and across batches are as a window has them, and numbers are forgotten one by one."""
    day = lambda n: dt.datetime(2026, 1, 1) + dt.timedelta(days=n)
    schema = "number string, source_file string, arrived timestamp"
    batches = [[(f"n{i % 300}", f"f{i:04}", day(0)) for i in range(400)], [(f"n{i}", f"g{i:04}", day(3)) for i in range(0, 300, 2)], [("late", "h", day(40))], [("later", "k", day(41))], [(f"n{i}", f"m{i:04}", day(42)) for i in range(300)]]
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        rows = invoices.repeated_numbers(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "30 days", shares=5)
        q = rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.lastProgress is None or q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 5
    got = spark.read.parquet(f"{tmp_path}/out").toPandas()
    con = duckdb.connect()
    every = con.from_df(spark.createDataFrame([r for b in batches[:4] for r in b], schema).toPandas())  # noqa: F841
    expected = con.sql("SELECT source_file, lag(source_file) OVER (PARTITION BY number ORDER BY arrived, source_file) AS earlier FROM every").fetchall()
    # What came last on day 0 or 3 is forgotten by day 42, so the last batch's files repeat nothing.
    expected += [(f, None) for _, f, _ in batches[4]]
    assert sorted(map(str, expected)) == sorted(str((f, None if e != e or e is None else e)) for f, e in zip(got["source_file"], got["earlier"], strict=True))
