"""PDF files from bytes: forms of files, damaged ones, and tables of ruled lines."""

import pytest
from pyspark.sql import functions as F

from tallyforge.sources import batch, pdf, pdf_objects, pdf_pages, pdf_print


def text(x, y, t, size=10):
    return {"x": x, "y": y, "x2": None, "y2": None, "size": size, "text": t}


def line(x, y, x2, y2):
    return {"x": x, "y": y, "x2": x2, "y2": y2, "size": None, "text": None}


def box(x0, y0, x1, y1):
    return [line(x0, y0, x1, y0), line(x0, y1, x1, y1), line(x0, y0, x0, y1), line(x1, y0, x1, y1)]


def files(spark, **pages):
    return pdf.uploaded(spark, [(n, b if isinstance(b, bytes) else pdf_print.printed(b, "packed")) for n, b in pages.items()])


@pytest.mark.parametrize("form", pdf_print.FORMS)
def test_forms(form):
    page = [text(72, 100, r"a\b (c) d)e"), line(10, 10, 90, 10)]
    got = list(pdf_objects.drawn(pdf_print.printed([page, [], page], form)))
    assert [(n, w, h, len(s)) for n, w, h, s in got] == [(1, 595, 842, 4), (2, 595, 842, 0), (3, 595, 842, 4)]
    assert [s[5] for s in got[0][3] if s[0] == "piece"] == [r"a\b", "(c)", "d)e"]
    assert got[0][3][0][1:5] == pytest.approx((72, 92, 90, 102))


def test_objects():
    parse = lambda b: pdf_objects.parse(b, 0)[0]
    assert parse(b"<< /A [1 -2.5 (x(y)\\)\\101\\\nz) <4a4B5> true] /B#20C 3 0 R >> ") == {"A": [1, -2.5, b"x(y)Az".replace(b"A", b")A"), b"JKP", True], "B C": 3}
    assert parse(b"% note\n/Name(") == "Name" and parse(b"") is None


def test_content_operators():
    font = b"<< /Type /Font /Subtype /Type1 /BaseFont /F /FirstChar 65 /Widths [1000 500] /Encoding << /Differences [65 /B /rupee] >> >>"
    content = b"q 2 0 0 2 10 20 cm BT /F1 10 Tf 5 TL 1 Tc 50 Tz 0 100 Td (A) Tj T* [(A) -3000 (B)] TJ (A) ' ET Q /X Do BI /W 1 ID abc EI BT /F1 10 Tf (A) Tj ET 0 0 m 10 0 l 10 10 l h S 5 5 20 20 re n"
    form = b"<< /Subtype /Form /Matrix [1 0 0 1 7 0] /Length 35 >>\nstream\nBT /F1 10 Tf 1 0 0 1 3 4 Tm (A) Tj ET \nendstream"
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Kids [3 0 R] /MediaBox [0 0 500 500] >>", b"<< /Type /Page /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> /XObject << /X 6 0 R >> >> >>"]
    objects += [b"<< /Length %d >>\nstream\n%s\nendstream" % (len(content), content), font, form]
    data = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1)) + b"trailer << /Root 1 0 R >>"
    ((_, _, _, shapes),) = pdf_objects.drawn(data)
    pieces = [(s[5], round(s[1], 2), round(500 - s[4] - (-0.2 * 20 if i < 4 else -2), 2)) for i, s in enumerate(x for x in shapes if x[0] == "piece")]
    assert pieces == [("B", 10, 220), ("B", 10, 210), ("₹", 51, 210), ("B", 10, 200), ("B", 10, 4), ("B", 0, 0)]
    assert sum(s[0] == "line" for s in shapes) == 3 and sum(s[0] == "image" for s in shapes) == 1


def test_damaged_files_are_rows(spark):
    whole = pdf_print.printed([[text(72, 100, "fine")]], "table")
    given = files(spark, good=whole, none=b"no file", cut=whole[: len(whole) // 3], lost=whole.replace(b"startxref\n", b"startxref\n9"), empty=[])
    got = {r.doc_id: r for r in pdf_pages.pages(given).collect()}
    assert got["good"].text == got["lost"].text == "fine" and got["good"].error is None
    assert got["none"].page_no is None and "no PDF header" in got["none"].error and got["cut"].error and got["empty"].page_no is None and got["empty"].error is None


def test_merged_cells_and_several_tables(spark):
    """Cells over two rows and over two columns; another table below, one beside it; a frame without cells is none."""
    page = box(50, 50, 350, 110) + [line(150, 50, 150, 110), line(250, 70, 250, 110), line(150, 70, 350, 70), line(150, 90, 350, 90)]
    page += [text(54, 64, "tall"), text(54, 104, "cell"), text(154, 64, "wide head"), *(text(x, y, f"{x}/{y}") for x in (154, 254) for y in (84, 104))]
    page += box(50, 200, 150, 240) + [line(50, 220, 150, 220), line(100, 200, 100, 240), text(54, 214, "a"), text(104, 214, "b"), text(54, 234, "c"), text(104, 234, "d")]
    page += box(300, 200, 400, 240) + [line(300, 220, 400, 220), text(304, 214, "e"), text(304, 234, "f")]
    page += [*box(20, 20, 580, 820), line(60, 700, 60, 760), text(54, 500, "outside")]
    shapes = pdf_pages.drawn(files(spark, x=[page]))
    inner = pdf_pages.cells(pdf_pages.rulings(shapes))
    got = [r.table for r in pdf_pages.tables(inner.where("x1 - x0 < 500"), pdf_pages.words(shapes)).orderBy("table_no").collect()]
    assert got == [[["tall\ncell", "wide head", ""], ["", "154/84", "254/84"], ["", "154/104", "254/104"]], [["a", "b"], ["c", "d"]], [["e"], ["f"]]]


def test_batch_without_a_backend(spark):
    items = ["TAX INVOICE", "Acme Traders", "GSTIN: 27AABCS1234K1Z5", "Invoice No: INV/77", "Invoice Date: 12/05/2026", "Bill To", "Beta Stores", "Total Amount 118.00"]
    given = files(spark, bill=[[text(60, 60 + 20 * i, t) for i, t in enumerate(items)]], broken=b"%PDF-1.4 nothing")
    got = {r.doc_id: r for r in batch.invoices(batch.documents(given), F.lit("2026-06-01").cast("date")).collect()}
    assert got["bill"].pdf_type == "digital" and got["bill"].invoice_number.value == "INV/77" and got["broken"].pdf_type == "corrupt"
    assert got["broken"].processing_errors[0].startswith("Pipeline error")


def test_files_dealt_to_tasks(spark):
    """Orders lie in one row group, and so would their files in one task."""
    from tallyforge.plans import documents

    for frame in (documents.letters(spark, "/root/testdata/sf0.001"), documents.ruled(spark, "/root/testdata/sf0.001")):
        assert frame.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        assert sum(n > 0 for n in frame.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) > 1


def test_packed_objects_are_unpacked_once(monkeypatch):
    seen = []
    decoded = pdf_objects.File._decoded
    monkeypatch.setattr(pdf_objects.File, "_decoded", lambda self, head, body: seen.append(head.get("Type")) or decoded(self, head, body))
    assert len(list(pdf_objects.drawn(pdf_print.printed([[text(72, 100, "a")]] * 3, "packed")))) == 3
    assert seen.count("ObjStm") == 1
