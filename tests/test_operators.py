import json
import zipfile

from pyspark.sql import functions as F

from tallyforge.operators import fields, invoice, journal, layout, lines, pages, tables, taxes, validate, vision
from tallyforge.plans import constants as K
from tallyforge.sources import pdf, reports, vendors, workbook

PAGE = """TAX INVOICE
Green Clean Supplies
12 Lake View
State Name: Tamil Nadu, Code: 33
GSTIN: 33AABCR7I06G1ZQ
Invoice No: GC/25-26/0042
Dated: 17-Apr-26
Bill To
Acme Holdings
GSTIN: 27AAACA1234A1Z5
Place of Supply: Tamil Nadu
Sl No Description of Goods HSN Qty Rate Amount
1 Soap bar 3402 10 5.00 50.00
2 Floor mop 9603 4 pcs 25.00 100.00
Sub Total 150.00
CGST 9% 13.50
SGST 9% 13.50
Grand Total: 177.00
Bank Name: STATE BANK
A/c No: 12345678
Branch & IFS Code: Main & SBIN0001234
Declaration
3 Pen 9608 1 1.00 1.00
"""


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")


def items_of(spark, *item_lines):
    body = "Particulars\n" + "\n".join(item_lines)
    rows = lines.text_items(docs(spark, body)).orderBy("line_no").collect()
    return [(r["item"].sr_no, r["item"].description, r["item"].hsn_sac, r["item"].quantity, r["item"].unit_price, r["item"].taxable_amount) for r in rows]


def test_whole_document(spark):
    r = invoice.parse(docs(spark, PAGE)).first()
    assert r.invoice_number.value == "GC/25-26/0042" and r.invoice_date.value == "17/04/2026" and r.overall_confidence == 0.95
    assert (r.seller.name, r.seller.gstin, r.seller.state, r.seller.state_code) == ("Green Clean Supplies", "33AABCR7106G1ZQ", "Tamil Nadu", "33")
    assert (r.buyer.name, r.buyer.gstin) == ("Acme Holdings", "27AAACA1234A1Z5")
    assert [(x.description, x.hsn_sac, x.quantity, x.taxable_amount, x.gst_rate, x.cgst_amount) for x in r.line_items] == [("Soap bar", "3402", 10, 50, 18, 4.5), ("Floor mop", "9603", 4, 100, 18, 9)]
    assert r.grand_total_value == 177 and r.subtotal == 150 and r.total_tax == 27 and not r.inter_state
    assert (r.bank.bank_name, r.bank.account_number, r.bank.ifsc) == ("STATE BANK", "12345678", "SBIN0001234")


def test_empty_document(spark):
    r = invoice.parse(docs(spark, None)).first()
    assert r.processing_errors == ["No text extracted"] and r.invoice_number.value is None and r.invoice_number.needs_review and r.line_items == []


def test_decision_table(spark):
    got = items_of(spark, "1 Pen 9608 10 5.00 50.00", "2 Pen 9608 10 512.50 125.00", "3 Pen 9608 10 5.00 60.00", "4 Pen 9608 7000 20 90.00", "5 Pen 9608 10 80.00", "6 Pen 9608 800.00 1600.00", "7 Pen 9608 45.00")
    assert [x[3:] for x in got] == [(10, 5, 50), (10, 512.5, 5125), (10, 6, 60), (20, 4.5, 90), (10, 8, 80), (2, 800, 1600), (1, 45, 45)]
    assert [x[0] for x in got] == [1, 2, 3, 4, 5, 6, 7]


def test_sections(spark):
    none = "Declaration\nParticulars\n1 Pen 9608 10 5.00 50.00"
    kept = "Particulars\n1 Pen 9608 10 5.00 50.00\nTotal 12 55.00 660.00\nTotal 60.00\n2 Ink 9608 1 5.00 5.00"
    skipped = "Particulars\nCGST 9% 4.50\n12 Long Road\n1 Pen 9608 10 5.00 50.00"
    got = lines.text_items(docs(spark, none, kept, skipped)).groupBy("doc_id").agg(F.sort_array(F.collect_list("item.description")).alias("x")).collect()
    assert {r.doc_id: r.x for r in got} == {"d1": ["Pen", "Total"], "d2": ["Pen"]}


def test_legacy_items(spark):
    r = docs(spark, "1 Blue ink 9608 18% 2 pcs 50.00 100.00\n2 Red ink 9608 18% 1 pcs 10.00 0").select(lines.legacy_items(F.col("text")).alias("x")).first()
    assert [(x.sr_no, x.description, x.gst_rate, x.quantity, x.taxable_amount) for x in r.x] == [(1, "Blue ink", 18, 2, 100), (2, "Red ink", 18, 1, 10)]


def test_tables(spark):
    head = ["Sl No", "Description", "HSN/SAC", "Qty", "Rate", "Amount"]
    rows = [["x"], head, ["1.", "Pen\nblue", "9608", "10", "5.00\nper pc", "50.00"], ["", "", "", "", "", ""], ["2", "", "9608", "1", "1", "1"], ["Total", "", "", "", "", "50.00"]]
    df = spark.createDataFrame([(rows,), ([head],)], "t array<array<string>>")
    got = [r.x for r in df.select(tables.table_items(F.col("t")).alias("x")).collect()]
    assert [(x.sr_no, x.description, x.quantity, x.unit_price, x.taxable_amount) for x in got[0]] == [(1, "Pen | blue", 10, 5, 50)] and got[1] == []
    r = df.select(tables.column_map(F.array(F.lit("CGST"), F.lit("Qty"), F.lit("Unit Price"))).alias("strict"), tables.column_map(F.array(F.lit("CGST"), F.lit("Qty"), F.lit("Unit Price")), False).alias("own")).first()
    assert r.strict == {"gst_rate": 0, "quantity": 1} and r.own == {"cgst": 0, "quantity": 1, "rate": 2}
    blank = spark.createDataFrame([([["a", ""], [None, " "]],)], "t array<array<string>>").select(tables.fill_ratio(F.col("t")).alias("f"), tables.keeps_table(F.col("t"), "bordered").alias("k")).first()
    assert (blank.f, blank.k) == (0.25, True)


def test_taxes(spark):
    r = docs(spark, "CGST 9% 348.39\nOUTPUT@CGST 354.37\nSGST9 (9%) 13,500.00").select(taxes.tax_details(F.col("text")).alias("x")).first()
    assert {x.tax_type: x.tax_amount for x in r.x} == {"CGST": 354.37, "SGST": 13500.0}
    rates = docs(spark, "0402 1,375.00 | 2.50% 34.38\n3402 3,863.00 9% 347.67").select(taxes.hsn_rates(F.col("text")).alias("r"))
    get = lambda code: rates.select(taxes.match_rate(F.lit(code), F.col("r")).rate.alias("v")).first().v
    assert [get(c) for c in ("3402", "13402", "340200", "0402", "9999")] == [18, 18, 18, 5, None]


def test_journal(spark):
    heads = spark.createDataFrame([("a", 1, "N1", "2026-04-28", False, 0.0), ("b", 2, "N2", "2026-03-31", True, 0.0), ("c", 3, "N3", None, False, 0.0)], "doc_id string, doc_seq long, number string, d string, inter_state boolean, subtotal double")
    heads = heads.withColumns({"invoice_date": F.col("d").cast("date"), "seller": F.lit("Clean Co"), "seller_gstin": F.lit(""), "buyer_gstin": F.lit("B"), "source_file": F.lit("f.pdf"), "reverse_charge": F.lit("No")})
    items = spark.createDataFrame([("a", 1, 18, "3402", 150000.0, "HK Material/x 1"), ("b", 1, 18, "3402", 150000.0, "Soap"), ("c", 1, 0, "3402", 10.0, "Soap")], "doc_id string, pos int, gst_rate int, hsn string, base double, description string")
    rows = journal.journal(heads, items.withColumn("base", F.col("base").cast("decimal(18,2)"))).orderBy("doc_seq", "leg_seq").collect()
    legs = lambda k: [(r.dr_cr, float(r.amount)) for r in rows if r.doc_id == k]
    assert legs("a") == [("D", 150000), ("D", 13500), ("D", 13500), ("C", 150000), ("C", 27000)]
    assert legs("b") == [("D", 150000), ("D", 27000), ("C", 150000), ("C", 27000)] and legs("c") == [("D", 10), ("C", 10)]
    assert rows[0].line_text == "APR.26/HK/MATERIAL/X/1" and rows[0].l_id == "1;3;6;7" and rows[1].l_id == "6;7"
    wide = journal.upload_format(journal.journal(heads, items.withColumn("base", F.col("base").cast("decimal(18,2)"))))
    assert len(wide.columns) == 58 == len(K.JOURNAL_COLUMNS) + 2


def test_vendor_first_row_wins(spark, tmp_path):
    (tmp_path / "v.csv").write_text("Keyword,Vendor_Code,GL_Code,Journal_Type\nclean,V1,12,HEXPS\nClean Co,V2,x,SEXPS\n")
    v = vendors.vendor_master(spark, str(tmp_path / "v.csv"))
    s = spark.createDataFrame([("Clean Co", ""), ("Other", "")], "seller string, seller_gstin string")
    got = {r.seller: (r.vendor_code, r.gl_code) for r in journal.with_vendor(s, v).collect()}
    assert got["Clean Co"] == ("V1", "12") and got["Other"][0].startswith("CMS")
    assert vendors.vendor_master(spark, None).count() == 0


def test_rules(spark):
    as_of = F.lit("2026-06-01").cast("date")
    d = spark.createDataFrame([("02/06/2026",), ("03/06/2026",), ("03/06/2021",), ("01/06/2021",), ("",), ("soon",)], "c string")
    got = [r.x and r.x.issue.split(":")[0] for r in d.select(validate.date_issue(F.col("c"), "d", as_of).alias("x")).collect()]
    assert got == [None, "Date is in the future", None, "Date is more than 5 years old", "Date not found", "Cannot parse date"]
    m = spark.createDataFrame([(1.0, 10.0, 12.0), (1.0, 10.0, 12.01), (0.0, 10.0, 99.0)], "q double, p double, a double")
    assert [r.x for r in m.select(validate.line_math(F.col("q"), F.col("p"), F.col("a")).alias("x")).collect()] == [False, True, False]


def test_status_of_an_empty_document(spark):
    v = validate.validated(invoice.parse(docs(spark, "")), F.lit("2026-06-01").cast("date")).first().validation
    assert v.status == "FAIL" and not v.complete and [i.field_name for i in v.issues][:3] == ["Seller GSTIN", "Buyer GSTIN", "Invoice Date"]


def test_duplicates(spark):
    rows = [(i, f"f{i}", n) for i, n in enumerate(["a", "a", "", "a", None], 1)]
    got = validate.duplicates(spark.createDataFrame(rows, "doc_seq int, source_file string, number string")).orderBy("doc_seq").collect()
    assert [r.duplicate_of for r in got] == [None, "f1", None, "f2", None]


def test_classification(spark):
    rows = [("a", 1, "x" * 50, None), ("a", 2, "x" * 49, None), ("b", 1, "x" * 50, None), ("c", 1, " ", None), ("d", None, None, None), ("e", None, None, "broken")]
    p = pages.page_profile(spark.createDataFrame(rows, "doc_id string, page_no int, text string, error string"))
    assert {r.doc_id: r.pdf_type for r in pages.classify(p).collect()} == {"a": "hybrid", "b": "digital", "c": "scanned", "d": "digital", "e": "corrupt"}


def test_layout(spark):
    rows = [("p", t, x, y) for t, x, y in [("a", 10.0, 100.0), ("b", 60.0, 104.0), ("c", 80.0, 106.0), ("d", 20.0, 120.0), ("e", 34.0, 120.0)]]
    words = spark.createDataFrame(rows, "page string, text string, x0 double, y0 double")
    assert {r.text: r.row_no for r in layout.cluster_rows(words, ["page"]).collect()} == {"a": 0, "b": 0, "c": 1, "d": 2, "e": 2}
    assert [r.bound for r in layout.column_bounds(words, ["page"]).orderBy("bound").collect()] == [10, 60, 80]
    assert layout.grid(words, ["page"]).first().table == [["a", "b", ""], ["", "", "c"], ["d e", "", ""]]
    ocr = spark.createDataFrame([("d", 1, "one", 0.0, 0.0, 9.0, 20.0), ("d", 1, "two", 20.0, 30.0, 29.0, 50.0), ("d", 1, "|", 0.0, 200.0, 1.0, 220.0), ("d", 1, "far", 0.0, 400.0, 9.0, 420.0)], "doc_id string, page_no int, text string, x0 double, y0 double, x1 double, y1 double")
    assert [r.line for r in layout.ocr_lines(ocr).orderBy("line_no").collect()] == ["one two", "far"]


def test_vision(spark):
    def reply(total, **more):
        return json.dumps({"invoice_number": " N1 ", "invoice_date": "01/04/2026", "seller": {"gstin": "33A"}, "buyer": {"gstin": "27B"}, "line_items": [{"description": "x", "taxable_amount": 100.0, "gst_rate": 18}], "grand_total": total} | more)

    df = spark.createDataFrame([("kept", reply(118.99)), ("over", reply(119.01)), ("null", reply(118, invoice_number=None)), ("bad", "{")], "doc_id string, reply_json string")
    got = {r.doc_id: r for r in vision.vision_invoices(df).collect()}
    assert (got["kept"].grand_total_value, got["over"].grand_total_value) == (118.99, 118.0)
    assert got["kept"].inter_state and got["kept"].line_items[0].quantity == 1 and got["kept"].line_items[0].igst_amount == 18 and got["kept"].invoice_number.value == "N1"
    assert got["null"].error and got["bad"].error and not got["kept"].error


def test_sources_and_workbook(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for n in ("b.pdf", "a.pdf", "c.txt"):
        (folder / n).write_bytes(n.encode())
    files = pdf.document_files(spark, str(folder))
    assert [(r.source_file, r.doc_seq) for r in pdf.in_order(files).orderBy("doc_seq").collect()] == [("a.pdf", 0), ("b.pdf", 1)]

    def backend(content):
        if content == b"a.pdf":
            raise ValueError("no")
        return [{"page_no": 1, "text": content.decode(), "has_images": False}]

    got = {r.doc_id: (r.text, r.error) for r in pdf.extracted_pages(files, backend, "source_file").collect()}
    assert got == {"a.pdf": (None, "ValueError: no"), "b.pdf": ("b.pdf", None)}

    spark.dataSource.register(workbook.Workbook)
    rows = workbook.as_sheet(spark.createDataFrame([(2, "b & c"), (1, "a")], "seq int, head string"), F.lit(0), F.lit("Sum/mary"), F.col("seq"), ["head"], ["head"])
    rows.write.format("workbook").mode("append").option("path", str(tmp_path / "out.xlsx")).save()
    with zipfile.ZipFile(tmp_path / "out.xlsx") as z:
        sheet, book = z.read("xl/worksheets/sheet1.xml").decode(), z.read("xl/workbook.xml").decode()
    assert sheet.index("head") < sheet.index(">a<") < sheet.index("b &amp; c") and "Sum-mary" in book


def test_whole_batch_to_a_workbook(spark, tmp_path):
    d = docs(spark, PAGE, "").withColumns({"doc_seq": F.regexp_extract("doc_id", r"(\d+)", 1).cast("long"), "source_file": F.concat("doc_id", F.lit(".pdf")), "pdf_type": F.lit("digital")})
    v = validate.validated(invoice.parse(d), F.lit("2026-06-01").cast("date"))
    heads, items = reports.journal_input(v)
    legs = journal.journal(heads, items)
    sides = {r.dr_cr: float(r.s) for r in legs.where("doc_id = 'd0'").groupBy("dr_cr").agg(F.sum("amount").alias("s")).collect()}
    assert sides == {"D": 177.0, "C": 177.0}
    spark.dataSource.register(workbook.Workbook)
    reports.workbook_rows(v, legs).write.format("workbook").mode("append").option("path", str(tmp_path / "batch.xlsx")).save()
    with zipfile.ZipFile(tmp_path / "batch.xlsx") as z:
        book = z.read("xl/workbook.xml").decode()
        sheets = [z.read(f"xl/worksheets/sheet{i}.xml").decode() for i in range(1, 6)]
    assert [book.index(n) for n in ("Summary", "GC-25-26-0042", "Invoice-2", "details to be captured", "upload format")] == sorted(book.index(n) for n in ("Summary", "GC-25-26-0042", "Invoice-2", "details to be captured", "upload format"))
    assert "Grand Total (₹)" in sheets[0] and "Soap bar" in sheets[1] and "Respective GL code" in sheets[3] and "1;3;6;7" in sheets[4]


def test_emails(spark):
    assert docs(spark, "to a.b@c.de or x").select(fields.emails(F.col("text")).alias("e")).first().e == ["a.b@c.de"]


def test_stream(spark, tmp_path):
    from tallyforge.streaming import invoices

    src = docs(spark, PAGE, PAGE.replace("0042", "0043")).withColumns({"source_file": F.lit("f"), "arrived": F.current_timestamp()})
    src.union(src).write.parquet(str(tmp_path / "in"))
    q = invoices.statuses(invoices.arriving(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), "2026-06-01")
    q.awaitTermination(120)
    assert sorted(r.number for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["GC/25-26/0042", "GC/25-26/0043"]


def test_batch_from_bytes(spark, tmp_path):
    """Digital, scanned, hybrid, broken and duplicate files in one call, up to the workbook's rows."""
    from tallyforge.sources import batch, pdf

    one = PAGE
    own = {b"digital": [one], b"copy": [one], b"scanned": [""], b"hybrid": [one, ""]}

    def backend(content):
        return [{"page_no": i, "text": t} for i, t in enumerate(own[bytes(content)])]

    def ocr(content):
        return [{"page_no": i, "text": "Invoice No: SC-77\nDate: 01/02/2026\n" + "recognised " * 9} for i in range(len(own[bytes(content)]))]

    files = pdf.uploaded(spark, [("a.pdf", b"digital"), ("b.pdf", b"copy"), ("c.pdf", b"scanned"), ("d.pdf", b"hybrid"), ("e.pdf", b"broken")])
    found, rows = batch.process(files, backend, F.lit("2026-06-01").cast("date"), ocr, folder=str(tmp_path / "kept"))
    got = {r.source_file: r for r in found.collect()}
    assert [got[f"{x}.pdf"].pdf_type for x in "abcde"] == ["digital", "digital", "scanned", "hybrid", "corrupt"]
    assert got["b.pdf"].processing_errors == ["DUPLICATE: Same invoice # found in a.pdf"] and got["a.pdf"].processing_errors == []
    assert got["c.pdf"].invoice_number.value == "SC-77" and got["d.pdf"].processing_errors[-1] == "DUPLICATE: Same invoice # found in b.pdf"
    assert got["e.pdf"].processing_errors[0].startswith("Pipeline error: Cannot open PDF: KeyError")
    assert rows.where("sheet = 'Summary'").count() == 6 if "sheet" in rows.columns else rows.count() > 6


def test_repeated_ids_keep_their_own_items(spark):
    """Two rows of one id, and rows without an id, are documents of their own."""
    d = docs(spark, PAGE, PAGE.replace("Invoice No", "Invoice Number"), "nothing").withColumn("doc_id", F.when(F.col("doc_id") != "d2", "same") if dict(docs(spark, PAGE).dtypes)["doc_id"] == "string" else F.lit(None).cast("long"))
    sizes = sorted(len(r.line_items) for r in invoice.parse(d).select("line_items").collect())
    assert len(sizes) == 3 and sizes[0] == 0 and sizes[1] == sizes[2] == len(invoice.parse(docs(spark, PAGE)).first().line_items)


def test_heads_are_met_once(spark):
    """Taxes of printed and of structured invoices don't work out the invoices' heads a second time."""
    from tallyforge.plans import catalogue, star

    d = "/root/testdata/sf0.001"
    for frame in (star.printed(spark, d), catalogue._invoices(spark, d)):
        assert frame._jdf.queryExecution().optimizedPlan().toString().count("Relation [c_custkey") == 1
