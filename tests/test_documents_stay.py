"""Invoices are put together by one dealing of lines, and what is asked of a document is told in its own row."""

from pyspark.sql import functions as F

from tallyforge.plans import branches, catalogue, star

SF = "/root/testdata/sf0.001"


def exchanges(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in x]


def test_lines_are_dealt_once(spark):
    """Without broadcasts (as of large tables): lines go to their part and to their order, orders to their buyer and to their lines."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4k")
    try:
        for q in (catalogue.q_section_state, catalogue.q_bank, catalogue.q_text_items, branches.q_gst_valid, catalogue.q_tax_rows, catalogue.q_status_counts, catalogue.q_parties):
            found = exchanges(q(spark, SF))
            assert len(found) <= 7 and sum("l_orderkey" in x for x in found) == 1 and not any("doc_id" in x for x in found)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_documents_are_heads_with_their_items(spark):
    d = star.documents(spark, SF)
    item = ("pos", "quantity", "base", "gst_rate", "hsn", "description")
    mine = d.select("doc_id", F.explode("items").alias("x")).select("doc_id", *(F.col(f"x.{c}") for c in item))
    assert mine.exceptAll(star.items(spark, SF).select("doc_id", *item)).isEmpty() and mine.count() == star.items(spark, SF).count()
    assert d.select(*star.heads(spark, SF).columns).exceptAll(star.heads(spark, SF)).isEmpty()

