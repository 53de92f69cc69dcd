"""Queries for the rarer branches of the parser: each prints what the branch must read, so SQL knows what it reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import fields, invoice, journal, layout, lines, pages, taxes, validate
from . import catalogue, star
from . import constants as K
from .catalogue import query
from .star import read

_S = star.SQL


def _lines(*parts):
    return F.concat_ws("\n", *parts)


@query(
    _S + "SELECT doc_id, pos, description, CASE WHEN l_orderkey % 3 < 2 THEN hsn ELSE '' END AS hsn_sac, CASE WHEN l_orderkey % 3 = 0 THEN gst_rate ELSE 0 END::DOUBLE AS gst_rate, quantity::DOUBLE AS quantity, 'nos' AS unit, "
    "CASE WHEN abs(quantity * round(base / quantity, 1) - base) > 2 THEN quantity * round(base / quantity, 1) ELSE base END::DECIMAL(18,2)::DOUBLE AS amount FROM i"
)
def q_legacy_items(spark, d):
    """Items by whole-line shapes: with code and rate, with code, with neither; wrong amounts are worked out again."""
    i = star.items(spark, d)
    price = F.round(F.col("base") / F.col("quantity"), 1).cast("decimal(18,2)").cast("string")
    k = F.pmod("l_orderkey", F.lit(3))
    middle = F.when(k == 0, F.concat_ws(" ", "hsn", F.concat(F.col("gst_rate").cast("string"), F.lit("%")))).when(k == 1, F.col("hsn"))
    line = F.concat_ws(" ", F.lit("1"), "description", middle, F.col("quantity").cast("string"), F.lit("nos"), price, F.lit("pc"), F.col("base").cast("string"))
    x = i.select("doc_id", "pos", F.explode(lines.legacy_items(_lines(F.lit("Remarks"), line))).alias("x"))
    return x.select("doc_id", "pos", "x.description", "x.hsn_sac", "x.gst_rate", "x.quantity", "x.unit", F.round("x.taxable_amount", 2).alias("amount"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN left(concat('Consulting work of ', o_orderpriority, ' class in region and beyond'), 50) ELSE 'SERVICE EXPENSES' END AS description, lpad((o_orderkey % 10000)::VARCHAR, 6, '9') AS hsn_sac, o_totalprice AS amount FROM orders")
def q_consolidated_item(spark, d):
    """One item for a document of which only the sum is known."""
    words = F.when(F.pmod("o_orderkey", F.lit(2)) == 0, F.concat(F.lit("Consulting work of "), "o_orderpriority", F.lit(" class in region and beyond"))).otherwise(F.lit("Goods"))
    o = read(spark, d, "orders").withColumn("t", _lines(F.lit("Bill"), words, F.lpad(F.pmod("o_orderkey", F.lit(10000)).cast("string"), 6, "9")))
    x = o.select("o_orderkey", lines.consolidated_item(F.col("t"), F.col("o_totalprice")).alias("x"))
    return x.select("o_orderkey", "x.description", "x.hsn_sac", F.col("x.taxable_amount").alias("amount"))


@query(
    _S + ", r AS (SELECT doc_id, pos, base, CASE l_orderkey % 4 WHEN 0 THEN 18 WHEN 1 THEN 24 WHEN 2 THEN 0 ELSE 5 END AS rate, l_orderkey % 2 = 0 AS away FROM i) SELECT doc_id, pos, rate::DOUBLE AS rate, "
    "CASE WHEN away THEN round(base * rate * 0.01, 2) ELSE 0 END::DOUBLE AS igst, CASE WHEN away THEN 0 ELSE round(base * rate * 0.005, 2) END::DOUBLE AS half, "
    "(base + CASE WHEN away THEN round(base * rate * 0.01, 2) ELSE 2 * round(base * rate * 0.005, 2) END)::DECIMAL(18,2)::DOUBLE AS total FROM r"
)
def q_item_taxes(spark, d):
    """Rates of items: the single rate of the tax rows (a low one doubled), none of several, the one of the item's own code; taxes by state."""
    i, k = star.items(spark, d), F.pmod("l_orderkey", F.lit(4))
    zero = F.lit(0.0)
    item = F.array(F.struct(F.lit(1), "description", F.col("hsn"), F.col("quantity").cast("double"), F.lit("pc"), zero, zero, F.col("base").cast("double"), zero, zero, zero, zero, F.col("base").cast("double")).cast(lines.ITEM))
    row = lambda rate: F.struct(F.lit("CGST"), F.lit(float(rate)), zero, F.lit(1.0)).cast(taxes.DETAIL)
    details = F.when(k == 0, F.array(row(9))).when(k == 1, F.array(row(12), row(12))).otherwise(F.array(row(6), row(9)))
    rates = F.when(k == 1, F.array(F.struct(F.col("hsn").alias("hsn"), F.lit(24.0).alias("rate")))).when(k == 3, F.array(F.struct(F.col("hsn").alias("hsn"), F.lit(5.0).alias("rate")))).otherwise(F.array(F.struct(F.lit("0000").alias("hsn"), F.lit(1.0).alias("rate"))))
    x = i.select("doc_id", "pos", F.explode(taxes.enriched_items(item, details, rates, F.pmod("l_orderkey", F.lit(2)) == 0)).alias("x"))
    return x.select("doc_id", "pos", F.col("x.gst_rate").alias("rate"), F.col("x.igst_amount").alias("igst"), F.col("x.cgst_amount").alias("half"), F.round("x.total_amount", 2).alias("total"))


@query(
    "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN b ELSE a END AS seller_gstin, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN a WHEN c_custkey % 4 = 2 THEN b ELSE 'X' END AS buyer_gstin FROM "
    "(SELECT c_custkey, concat(c_nationkey + 10, 'AABCA', lpad((c_custkey % 10000)::VARCHAR, 4, '0'), 'K1Z', c_custkey % 10) AS a, concat(c_nationkey + 10, 'AABCB', lpad((c_custkey % 10000)::VARCHAR, 4, '0'), 'K1Z', c_custkey % 10) AS b FROM customer) WHERE c_custkey % 4 <> 0 "
    "UNION ALL SELECT c_custkey, '', '' FROM customer WHERE c_custkey % 4 = 0"
)
def q_assigned_gstins(spark, d):
    """Identifiers of both sides from all of a text: none there, the buyer's known, neither known, the buyer's known and another one."""
    k = F.pmod("c_custkey", F.lit(4))
    a, b = (star.gstin(F.col("c_nationkey"), x, F.col("c_custkey")) for x in ("AABCA", "AABCB"))
    text = F.when(k == 0, F.lit("no code")).otherwise(F.concat(F.lit("from "), a, F.lit(" to "), b, F.lit(" again "), a))
    buyer = F.when(k == 1, a).when(k == 3, F.lit("X")).otherwise(F.lit(""))
    out = read(spark, d, "customer").select("c_custkey", fields.assigned_gstins(text, F.lit(""), buyer).alias("g"))
    return out.select("c_custkey", F.col("g.seller").alias("seller_gstin"), F.col("g.buyer").alias("buyer_gstin"))


@query(
    "SELECT o_orderkey, concat('Five Hundred ', o_orderkey % 90, ' Only') AS words, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE (o_orderkey % 100 - 50) / 100.0 END::DOUBLE AS round_off, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'Yes' ELSE 'No' END AS reverse FROM orders"
)
def q_small_fields(spark, d):
    """Amount in words, round-off and reverse charge."""
    k = F.col("o_orderkey")
    words = F.concat(F.element_at(F.array(F.lit("Amount Chargeable (in words)\n"), F.lit("Total In Words\n")), (F.pmod(k, F.lit(2)) + 1).cast("int")), F.lit("INR Five Hundred "), F.pmod(k, F.lit(90)).cast("string"), F.lit(" Only"))
    off = F.when(F.pmod(k, F.lit(3)) != 0, F.concat(F.lit("Round Off: "), ((F.pmod(k, F.lit(100)) - 50) / 100).cast("decimal(5,2)").cast("string")))
    reverse = F.when(F.pmod(k, F.lit(5)) != 0, F.concat(F.lit("Reverse Charge - "), F.when(F.pmod(k, F.lit(2)) == 0, "Yes").otherwise("No")))
    t = _lines(F.lit("Invoice"), words, off, reverse)
    return read(spark, d, "orders").select("o_orderkey", fields.or_blank(t, K.WORDS_PATTERNS).alias("words"), fields.round_off(t).alias("round_off"), fields.first_match(t, K.REVERSE_PATTERNS).alias("reverse"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE strftime(o_orderdate, '%d/%m/%Y') END AS invoice_date FROM orders")
def q_date_stages(spark, d):
    """Dates by label, on the line of the word, up to three lines below it, and anywhere; null without one."""
    k, day = F.pmod("o_orderkey", F.lit(5)), lambda f: F.date_format("o_orderdate", f)
    t = (
        F.when(k == 0, F.concat(F.lit("Invoice Date : "), day("dd-MM-yyyy")))
        .when(k == 1, F.concat(F.lit("this is dated (as agreed) "), day("d MMM yyyy"), F.lit("\n01/01/1999")))
        .when(k == 2, F.concat(F.lit("05.05.1998\nDate\nof\nissue\n"), day("MMM d, yyyy")))
        .when(k == 3, F.concat(F.lit("no label\n\n\n\n"), day("yyyy-MM-dd")))
        .otherwise("no day at all 12.5")
    )
    return read(spark, d, "orders").select("o_orderkey", fields.invoice_date(t).alias("invoice_date"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN concat('AB/25-26/', lpad((o_orderkey % 10000)::VARCHAR, 4, '0')) WHEN 1 THEN concat('ABC-2526-', lpad((o_orderkey % 10000)::VARCHAR, 4, '0')) WHEN 2 THEN concat('QX', lpad((o_orderkey % 10000)::VARCHAR, 4, '0')) ELSE NULL END AS number FROM orders")
def q_number_stages(spark, d):
    """Numbers by the shape of a fiscal year and below a header; null without one."""
    k, n = F.pmod("o_orderkey", F.lit(4)), F.lpad(F.pmod("o_orderkey", F.lit(10000)).cast("string"), 4, "0")
    t = (
        F.when(k == 0, F.concat(F.lit("Our ref\nAB/25-26/"), n))
        .when(k == 1, F.concat(F.lit("Our ref\nABC-2526-"), n))
        .when(k == 2, F.concat(F.lit("TAX INVOICE\n12 Long Road A12345\nDelivery\n(QX"), n, F.lit(") and more")))
        .otherwise("Nothing to see")
    )
    return read(spark, d, "orders").select("o_orderkey", fields.invoice_number(t).alias("number"))


@query("SELECT p_partkey // 5 AS page, (p_partkey % 5 - min(p_partkey % 5) OVER (PARTITION BY p_partkey // 5))::INT AS row_no, c::INT AS column_no, CASE c WHEN 0 THEN concat('k', p_partkey, ' left') WHEN 1 THEN p_brand ELSE p_size::VARCHAR END AS cell FROM part, range(3) t(c) QUALIFY count(*) OVER (PARTITION BY p_partkey // 5) >= 9")
def q_grid(spark, d):
    """Words of a page as a table: rows by anchors, columns by gaps, words of a cell in order."""
    p = read(spark, d, "part")
    page, y = F.expr("p_partkey div 5"), (F.pmod("p_partkey", F.lit(5)) * 20).cast("double")
    word = lambda text, x, dy=0.0: F.struct(text.cast("string").alias("text"), F.lit(float(x)).alias("x0"), (y + dy).alias("y0"))
    words = F.array(word(F.lit("left"), 22, 3.0), word(F.concat(F.lit("k"), "p_partkey"), 10), word(F.col("p_brand"), 120, 4.0), word(F.col("p_size"), 300, 2.0))
    w = p.select(page.alias("page"), F.explode(words).alias("w")).select("page", "w.*")
    t = layout.grid(w, ["page"]).select("page", F.posexplode("table").alias("row_no", "r"))
    return t.select("page", "row_no", F.posexplode("r").alias("column_no", "cell"))


@query("SELECT p_partkey // 5 AS page, (p_partkey % 5 - min(p_partkey % 5) OVER (PARTITION BY p_partkey // 5))::INT AS row_no, concat('k', p_partkey, '|', p_brand, '|', p_size) AS cells FROM part QUALIFY p_size % 2 = 1")
def q_box_rows(spark, d):
    """Cell boxes in rows by their anchor; rows of fewer than three cells go."""
    p = read(spark, d, "part")
    y = (F.pmod("p_partkey", F.lit(5)) * 40).cast("double")
    box = lambda text, x, dy: F.struct(text.cast("string").alias("text"), F.lit(float(x)).alias("x0"), (y + dy).alias("y0"))
    boxes = F.array(box(F.col("p_brand"), 120, 14.0), box(F.concat(F.lit("k"), "p_partkey"), 10, 0.0))
    boxes = F.when(F.col("p_size") % 2 == 1, F.array_append(boxes, box(F.col("p_size"), 300, 7.0))).otherwise(boxes)
    w = p.select(F.expr("p_partkey div 5").alias("page"), F.explode(boxes).alias("w")).select("page", "w.*")
    return layout.box_grid(w, ["page"]).select("page", "row_no", F.array_join("cells", "|").alias("cells"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 1 THEN 7.5 ELSE (o_orderkey % 3)::DECIMAL(18,2) END::DECIMAL(18,2) AS base FROM orders")
def q_slab_base(spark, d):
    """A single slab without a base takes the subtotal."""
    k = F.pmod("o_orderkey", F.lit(3)).cast("decimal(18,2)")
    base = journal.slab_base(F.pmod("o_orderkey", F.lit(2)), k, F.lit(7.5).cast("decimal(18,2)"))
    return read(spark, d, "orders").select("o_orderkey", base.cast("decimal(18,2)").alias("base"))


@query(
    catalogue._CHECKED + ", x AS (SELECT k.*, (SELECT count(*) FROM i WHERE i.doc_id = k.doc_id) AS n FROM k), f AS ("
    "SELECT doc_id, 2 AS rule, 'Seller GSTIN' AS field_name, 'Invalid GSTIN format: ''12BAD'' (expected 15-char pattern)' AS issue, 'WARNING' AS severity, 'NN AAAAA NNNN A N Z X' AS expected, '12BAD' AS actual FROM x WHERE doc_seq % 13 = 0 "
    "UNION ALL SELECT doc_id, 3, 'Invoice Date', concat('Date is more than 5 years old: ', strftime(invoice_date, '%d/%m/%Y')), 'WARNING', NULL, strftime(invoice_date, '%d/%m/%Y') FROM x WHERE invoice_date < DATE '2003-06-01' - 1825 "
    "UNION ALL SELECT doc_id, 3, 'Invoice Date', concat('Date is in the future: ', strftime(invoice_date, '%d/%m/%Y')), 'WARNING', NULL, strftime(invoice_date, '%d/%m/%Y') FROM x WHERE invoice_date > DATE '2003-06-02' "
    "UNION ALL SELECT doc_id, 5, 'Subtotal', concat('Sum of items (', format('{:.2f}', base::DOUBLE), ') ≠ subtotal (', format('{:.2f}', stated::DOUBLE), ')'), 'WARNING', format('{:.2f}', base::DOUBLE), format('{:.2f}', stated::DOUBLE) FROM x WHERE doc_seq % 7 = 0 "
    "UNION ALL SELECT doc_id, 6, 'Grand Total', concat('subtotal(', format('{:.2f}', stated::DOUBLE), ') + tax(', format('{:.2f}', tax::DOUBLE), ') = ', format('{:.2f}', (stated + tax)::DOUBLE), ' ≠ grand_total(', format('{:.2f}', total::DOUBLE), ')'), 'WARNING', format('{:.2f}', (stated + tax)::DOUBLE), format('{:.2f}', total::DOUBLE) FROM x WHERE doc_seq % 7 = 0 AND tax > 0 "
    "UNION ALL SELECT doc_id, 7, 'Invoice Number', 'Required field ''Invoice Number'' is missing', 'FAIL', NULL, NULL FROM x WHERE doc_seq % 11 = 0) SELECT doc_id, field_name, issue, severity, expected, actual FROM f"
)
def q_issues(spark, d):
    """Names, texts and values of issues; those of lines are in q_line_issues."""
    v = validate.validated(catalogue._invoices(spark, d), F.lit(catalogue._AS_OF).cast("date"))
    return v.select("doc_id", F.explode("validation.issues").alias("x")).where("NOT startswith(x.field_name, 'Line Item ')").select("doc_id", "x.*")


@query("SELECT l_orderkey, l_linenumber, l_partkey, 'Line Item 1' AS field_name, concat('qty(', format('{:.1f}', l_quantity), ') × rate(1.5) = ', format('{:.2f}', l_quantity * 1.5), ' ≠ amount(', format('{:.1f}', l_quantity * 2), ')') AS issue FROM lineitem WHERE abs(l_quantity * 1.5 - l_quantity * 2) > 2")
def q_line_issues(spark, d):
    zero, q = F.lit(0.0), F.col("l_quantity")
    item = F.array(F.struct(F.lit(1), F.lit("x"), F.lit(""), q, F.lit("pc"), F.lit(1.5), zero, q * 2, zero, zero, zero, zero, q * 2).cast(lines.ITEM))
    x = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.explode(validate.line_issues(item)).alias("x"))
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "x.field_name", "x.issue")


@query(_S + "SELECT doc_id, doc_seq % 13 <> 0 AS gst_valid, true AS compat_valid FROM h JOIN t USING (doc_id)")
def q_gst_valid(spark, d):
    v, on = catalogue._invoices(spark, d), F.lit(catalogue._AS_OF).cast("date")
    # Both ways in the invoice's own row: it is put together once and meets nothing.
    both = validate.validated(validate.validated(v, on).withColumnRenamed("validation", "own"), on, True)
    return both.select("doc_id", F.col("own.gst_valid").alias("gst_valid"), F.col("validation.gst_valid").alias("compat_valid"))


_WS = catalogue._WS


@query(
    f"WITH c AS (SELECT conv_id, count(*) AS n, count_if(length({_WS}) >= 50) AS g FROM conversations GROUP BY conv_id) SELECT conv_id AS doc_id, CASE WHEN g = n THEN 'pdfplumber' WHEN g = 0 THEN 'ocr' ELSE 'mixed' END AS recommended_extractor, "
    "CASE WHEN g = n THEN concat('All ', n, ' pages have embedded text layer') WHEN g = 0 THEN concat('All ', n, ' pages are image-only (no text layer)') ELSE concat(g, ' digital + ', n - g, ' scanned pages') END AS reason FROM c"
)
def q_classify_reasons(spark, d):
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text")
    return pages.classify(pages.page_profile(c)).select("doc_id", "recommended_extractor", "reason")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'lattice' WHEN o_orderkey % 4 = 1 THEN 'stream' WHEN o_orderkey % 4 = 2 THEN 'clustered' ELSE 'none' END AS source, CASE WHEN o_orderkey % 4 = 3 THEN 0 ELSE 1 END::INT AS n_tables FROM orders")
def q_table_tiers(spark, d):
    k = F.pmod("o_orderkey", F.lit(4))
    one, none = F.array(F.array(F.array(F.lit("a"), F.lit("b")))), F.array().cast("array<array<array<string>>>")
    tables, source = pages.first_tables({"lattice": F.when(k == 0, one).otherwise(none), "stream": F.when(k <= 1, one), "bordered": none, "clustered": F.when(k <= 2, one).otherwise(none)})
    return read(spark, d, "orders").select("o_orderkey", source.alias("source"), F.size(tables).alias("n_tables"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE coalesce('DUPLICATE: Same invoice # found in ' || lag(concat('f', o_orderkey)) OVER (PARTITION BY CASE WHEN o_orderkey % 5 = 0 THEN concat('x', o_orderkey) ELSE o_custkey::VARCHAR END ORDER BY o_orderkey), '') END AS errors FROM orders")
def q_duplicate_errors(spark, d):
    number = F.when(F.pmod("o_orderkey", F.lit(5)) != 0, F.col("o_custkey").cast("string"))
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").alias("doc_seq"), F.concat(F.lit("f"), "o_orderkey").alias("source_file"), F.struct(number.alias("value")).alias("invoice_number"), F.array().cast("array<string>").alias("processing_errors"))
    return validate.duplicate_errors(o).select("o_orderkey", F.array_join("processing_errors", ";").alias("errors"))


@query("SELECT concat('f', o_orderkey) AS source_file, o_orderkey % 3 <> 0 AS number_right, o_orderkey % 2 = 0 AS total_right, o_orderkey % 5 <> 0 AS items_right, o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0 AS \"right\" FROM orders WHERE o_orderkey % 7 <> 0")
def q_against_expected(spark, d):
    """What was read against what should have been; documents without an expectation are left out."""
    k = lambda n: F.pmod("o_orderkey", F.lit(n)) == 0
    o = read(spark, d, "orders").withColumn("source_file", F.concat(F.lit("f"), "o_orderkey"))
    found = o.select("source_file", F.when(~k(3), F.col("o_custkey").cast("string")).alias("number"), F.when(k(2), "1.00").otherwise("2.00").alias("total"), F.when(k(5), 1).otherwise(2).alias("n_items"))
    expected = o.where(~k(7)).select("source_file", F.col("o_custkey").cast("string").alias("number"), F.lit("1.00").alias("total"), F.lit(2).alias("n_items"))
    return validate.against_expected(found, expected)


@query(_S + "SELECT doc_id, 'No text extracted' AS errors, 0::DOUBLE AS confidence FROM h")
def q_blank_documents(spark, d):
    """Documents without a text have one error and no field."""
    p = invoice.parse(star.heads(spark, d).select("doc_id", F.lit(None).cast("string").alias("text")))
    return p.select("doc_id", F.array_join("processing_errors", ";").alias("errors"), F.col("overall_confidence").alias("confidence"))


@query(
    "WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d, o_orderkey % 12 AS k FROM orders) SELECT o_orderkey, strftime(CASE WHEN k = 5 THEN make_date(year(d), month(d), least(30, day(last_day(d)))) "
    "WHEN k = 6 THEN make_date(2001, month(d), least(day(d), day(last_day(make_date(2001, month(d), 1))))) WHEN k = 7 THEN make_date(year(d), month(d), least(30, day(last_day(d)))) ELSE d END, '%d/%m/%Y') AS normal_date FROM o WHERE NOT (k = 6 AND month(d) = 2 AND day(d) = 29)"
)
def q_date_fuzzy(spark, d):
    """Dates among other words: weekdays, ordinals, times, parts in any order, and parts that are missing."""
    o = read(spark, d, "orders").withColumn("k", F.pmod("o_orderkey", F.lit(12)))
    f = lambda p: F.date_format("o_orderdate", p)
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    shown = [
        say("due on ", f("EEEE"), ", the ", f("d"), "th of ", f("MMMM"), " in ", f("yyyy")), say(f("yyyy"), " ", f("MMM"), " ", f("d")), say(f("MMM"), " the ", f("d"), " '", f("yy"), " at 10:45 pm"), say(f("yyyy"), " . ", f("M"), " . ", f("d")),
        say("day ", f("d"), " month ", f("M"), " year ", f("yyyy")), say("for ", f("MMMM"), " ", f("yyyy")), say(f("d"), " ", f("MMMM"), " only"), say("period ", f("MM"), "/", f("yyyy")),
        say("on ", f("yyyy"), ", ", f("MMMM"), " ", f("d")), say(f("dd"), " / ", f("MM"), " / ", f("yyyy"), " 09:00:00"), say(f("EEE"), " ", f("d"), " ", f("MMM"), " 08:15 ", f("yyyy")), say("issued ", f("MMMM"), " ", f("dd"), " of the year ", f("yyyy")),
    ]
    text = shown[0]
    for i, s in enumerate(shown):
        text = F.when(F.col("k") == i, s).otherwise(text)
    # 29 February without its year is no date of the default's year.
    o = o.where(~((F.col("k") == 6) & (f("MM-dd") == "02-29")))
    return o.select("o_orderkey", dates.normal_date(text, default=F.lit("2001-01-30").cast("date")).alias("normal_date"))


@query(
    "WITH RECURSIVE e AS (SELECT user_id, event_id, ((value - 3) + (value + 3)) / 2 AS c, CASE WHEN event_id % 3 = 0 THEN '|' ELSE concat(event_type, event_id) END AS t, row_number() OVER (PARTITION BY user_id ORDER BY ((value - 3) + (value + 3)) / 2, event_id) AS n FROM events), "
    "r AS (SELECT user_id, event_id, t, n, c AS mean, 1 AS k, 0 AS line FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.event_id, e.t, e.n, CASE WHEN abs(mean - c) > 0.35 THEN c ELSE mean + (c - mean) / (k + 1) END, "
    "CASE WHEN abs(mean - c) > 0.35 THEN 1 ELSE k + 1 END, line + CASE WHEN abs(mean - c) > 0.35 THEN 1 ELSE 0 END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1), "
    "l AS (SELECT user_id, line, string_agg(t, ' ' ORDER BY event_id) AS line_text FROM r GROUP BY ALL) "
    "SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY line) - 1)::INT AS line_no, line_text FROM l WHERE line_text <> '|'"
)
def q_ocr_lines(spark, d):
    """Recognised words to lines by running means, without a Python worker."""
    e = read(spark, d, "events")
    t = F.when(F.pmod("event_id", F.lit(3)) == 0, "|").otherwise(F.concat("event_type", F.col("event_id").cast("string")))
    words = e.select(F.col("user_id").alias("doc_id"), F.lit(1).alias("page_no"), t.alias("text"), F.col("event_id").cast("double").alias("x0"), (F.col("value") - 3).alias("y0"), (F.col("value") + 3).alias("y1"))
    return layout.ocr_lines(words, dpi=3).select(F.col("doc_id").alias("user_id"), "line_no", F.col("line").alias("line_text"))


@query(
    "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'E1' WHEN 2 THEN 'E1; E2' ELSE 'E1; E2; E3' END AS errors, concat(round(100 * (o_orderkey % 101) / 100.0)::INT, '%') AS confidence, "
    "coalesce(CASE WHEN o_orderkey % 4 < 3 THEN ['PASS', 'WARNING', 'FAIL'][(o_orderkey % 4 + 1)::INT] END, 'N/A') AS status FROM orders"
)
def q_summary_errors(spark, d):
    """The summary's first three of any number of errors, statuses of what was never checked, and confidences."""
    k, none = F.col("o_orderkey"), F.lit(None).cast("string")
    value = lambda v: F.struct(v.alias("value"))
    status = F.get(F.array(F.lit("PASS"), F.lit("WARNING"), F.lit("FAIL")), F.pmod(k, F.lit(4)).cast("int"))
    errors = F.slice(F.array(*(F.lit(f"E{i}") for i in range(1, 6))), 1, F.pmod(k, F.lit(6)).cast("int"))
    i = read(spark, d, "orders").select(
        k.alias("doc_seq"), k.alias("o_orderkey"), F.lit("f").alias("source_file"), F.lit("digital").alias("pdf_type"), value(none).alias("invoice_number"), value(none).alias("invoice_date"), F.struct(none.alias("name"), none.alias("gstin")).alias("seller"),
        F.struct(none.alias("gstin")).alias("buyer"), F.lit(0.0).alias("subtotal"), F.lit(0.0).alias("total_tax"), F.lit(0.0).alias("grand_total_value"), F.array().alias("line_items"), (F.pmod(k, F.lit(101)) / 100).alias("overall_confidence"), errors.alias("processing_errors"), status.alias("status"),
    )
    s = invoice.summary(i, F.col("status"))
    return s.select((F.col("ordinal") - 1).alias("o_orderkey"), "errors", "confidence", "status")
