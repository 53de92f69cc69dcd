"""Vendors by keyword against a loop over the list, and dates in other words against a table of cases."""

import random

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import dates
from tallyforge.operators import journal


def test_vendors_against_a_loop(spark):
    """The first row in file order whose keyword is in the name; 100,000 keywords, also short, empty-ish, null and repeated ones, without a nested loop."""
    rng = random.Random(1)
    word = lambda n: "".join(rng.choices("ABCDEFGHIJ", k=n))
    keywords = [word(rng.choice([1, 2, 3, 5, 6, 7])) if i % 50 == 0 else word(rng.randint(6, 9)) for i in range(100_000)]
    keywords = [k for k in keywords if len(k) > 2 or k in ("AJ", "J")] + ["é x", None, "Co. ", "AJ"]
    vendors = spark.createDataFrame([(i, k, f"V{i}", i, f"T{i}") for i, k in enumerate(keywords)], "seq int, keyword string, vendor_code string, gl_code long, journal_type string")
    names = [" ".join(word(rng.randint(2, 12)).lower() for _ in range(3)) for _ in range(300)] + ["", None, "É X ltd", "zz", "j", "some co. ltd", "same", "same"]
    invoices = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "doc_id long, seller string")
    out = journal.vendor_match(invoices, vendors)
    got = {r.doc_id: r["_v"] and r["_v"].vendor_code for r in out.collect()}
    first = lambda n: next((f"V{i}" for i, k in enumerate(keywords) if n is not None and k is not None and k.upper() in n.upper()), None)
    assert got == {i: first(n) for i, n in enumerate(names)}
    assert "NestedLoop" not in out._jdf.queryExecution().toString()
    every = journal.vendor_match(invoices, vendors.union(spark.createDataFrame([(-1, "", "ALL", 1, "T")], vendors.schema)))
    assert {r["_v"] and r["_v"].vendor_code for r in every.where("seller IS NOT NULL").collect()} == {"ALL"}


CASES = {
    "Thursday, 2nd of January 1996": "02/01/1996", "Jan 2, 1996": "02/01/1996", "1996 January 02": "02/01/1996", "2 Jan 96": "02/01/1996", "2. 1. 1996": "02/01/1996", "1996.1.2": "02/01/1996", "25 12 2020": "25/12/2020",
    "12 25 2020": "25/12/2020", "May 2024": "15/05/2024", "February 2024": "15/02/2024", "7 sept": "07/09/2001", "3/2024": "15/03/2024", "at 10:45 on 3 March 2024": "03/03/2024", "Issued 03.04.24 10:15:00 PM": "03/04/2024",
    "5 6": "05/06/2001", "30 feb 2024": "30 feb 2024", "no date": "no date", "May": "May", "17": "17", "": "", "99999 1 2": "01/02/2001", "DECEMBER 31ST, 1999": "31/12/1999",
}


@pytest.mark.parametrize("strict", [False, True])
def test_fuzzy_dates(spark, strict):
    df = spark.createDataFrame([(k,) for k in CASES], "t string")
    got = {r.t: r.d for r in df.select("t", dates.normal_date(F.col("t"), strict, F.lit("2001-08-15").cast("date")).alias("d")).collect()}
    assert got == CASES
