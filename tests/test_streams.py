"""Streams of files: repeats of numbers across micro-batches, damaged files, batches tried again."""

import datetime as dt
import os

from pyspark.sql import functions as F

from tallyforge.sources import pdf_print
from tallyforge.streaming import invoices

SCHEMA = "number string, source_file string, arrived timestamp"


def when(day, hour=0):
    return dt.datetime(2026, 1, 1) + dt.timedelta(days=day, hours=hour)


def run(spark, at, batches, keep):
    """Each batch is a file of its own and a query of its own, which goes on from the checkpoint."""
    for b in batches:
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(f"{at}/in")
        rows = spark.readStream.schema(SCHEMA).parquet(f"{at}/in")
        q = invoices.repeated_numbers(rows, keep).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True)
        q.start().awaitTermination()
    return sorted(map(tuple, spark.read.parquet(f"{at}/out").select("source_file", "earlier").collect()))


def test_flags_are_the_batchs(spark, tmp_path):
    rows = [(("A", "B", "C", None, "")[i % 5] if i != 7 else "A", f"f{i:02}", when(i // 4, i % 4)) for i in range(24)]
    last, expected = {}, []
    for n, f, _ in rows:
        expected.append((f, last.get(n) if n else None))
        last[n] = f
    for name, cuts in (("three", [rows[:9], rows[9:10], rows[10:]]), ("one", [rows[::-1]])):
        assert run(spark, tmp_path / name, cuts, "300 days") == sorted(expected)


def test_numbers_are_forgotten(spark, tmp_path):
    got = run(spark, tmp_path, [[("A", "a1", when(0)), ("B", "b1", when(0))], [("A", "a2", when(3))], [("C", "c1", when(20))], [("C", "c2", when(21))], [("A", "a3", when(22)), ("C", "c3", when(22))]], "5 days")
    assert got == [("a1", None), ("a2", "a1"), ("a3", None), ("b1", None), ("c1", None), ("c2", "c1"), ("c3", "c2")]


def test_files_to_statuses(spark, tmp_path):
    """Every file once: statuses or quarantine; an epoch that is tried again replaces what it had written."""
    at = str(tmp_path)
    os.makedirs(f"{at}/in")
    page = lambda n: [{"x": 60, "y": 60 + 20 * i, "x2": None, "y2": None, "size": 10, "text": t} for i, t in enumerate(["TAX INVOICE", "Acme Traders", f"Invoice No: INV/{n}", "Invoice Date: 12/05/2026", "Total Amount 118.00 and some more words"])]
    for n in range(3):
        (tmp_path / f"in/{n}.pdf").write_bytes(pdf_print.printed([page(n)], pdf_print.FORMS[n]))
    (tmp_path / "in/bad.pdf").write_bytes(b"%PDF-1.4 and nothing else")
    start = lambda: invoices.file_statuses(invoices.arriving_files(spark, f"{at}/in", 2), f"{at}/out", f"{at}/bad", f"{at}/checkpoint", "2026-06-01").awaitTermination()
    start()
    # The last epoch's commit is lost: the epoch is tried again.
    commits = sorted((f for f in os.listdir(f"{at}/checkpoint/commits") if f.isdigit()), key=int)
    for name in (commits[-1], f".{commits[-1]}.crc"):
        os.remove(f"{at}/checkpoint/commits/{name}")
    (tmp_path / "in/3.pdf").write_bytes(pdf_print.printed([page(3)], "table"))
    start()
    read = lambda kind: spark.read.option("recursiveFileLookup", "false").parquet(*(f"{at}/{kind}/{e}" for e in os.listdir(f"{at}/{kind}") if e.startswith("epoch")))
    assert sorted((r.source_file, r.number) for r in read("out").collect()) == [(f"{n}.pdf", f"INV/{n}") for n in range(4)]
    (bad,) = read("bad").where(F.col("path").isNotNull()).collect()
    assert bad.source_file == "bad.pdf" and bad.error.startswith("Pipeline error") and bytes(bad.content).startswith(b"%PDF")
