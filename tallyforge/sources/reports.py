"""The workbook of a batch: summary, a sheet for each invoice, the guide and the journal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.invoice import detail_pairs, summary
from ..operators.journal import guide, upload_format
from ..plans import constants as K
from .workbook import as_sheet

#: Sheets after the invoices' own.
GUIDE, JOURNAL = 2**31 - 3, 2**31 - 2
ITEM_COLUMNS = ("sr_no", "description", "hsn_sac", "quantity", "unit", "unit_price", "taxable_amount", "gst_rate", "cgst_amount", "sgst_amount", "igst_amount", "total_amount")


def sheet_of(number: str = "number", ordinal: str = "ordinal") -> F.Column:
    """An invoice's sheet: its number, cut to twenty characters, else its place in the batch."""
    own = F.left(F.replace(F.col(number), F.lit("/"), F.lit("-")), F.lit(20))
    return F.when(F.coalesce(F.col(number), F.lit("")) != "", own).otherwise(F.concat(F.lit("Invoice-"), F.col(ordinal).cast("string")))


def summary_sheet(invoices: DataFrame) -> DataFrame:
    rows = summary(invoices, F.col("validation.status"))
    return as_sheet(rows, F.lit(0), F.lit("Summary"), F.col("ordinal"), rows.columns, list(K.SUMMARY_COLUMNS))


def invoice_sheets(invoices: DataFrame) -> DataFrame:
    """Key and value rows, then items, tax rows and issues, each part under its own headings."""
    named = invoices.select("*", (F.col("doc_seq") + 1).alias("ordinal"), F.col("invoice_number.value").alias("number"))
    heads = named.select("doc_id", "ordinal", sheet_of().alias("sheet"))
    number, name = F.col("ordinal"), F.col("sheet")
    pairs = detail_pairs(invoices).join(heads, "doc_id")
    parts = [as_sheet(pairs, number, name, F.col("seq"), ["name", "value"])]

    def part(array: str, columns: tuple[str, ...], begin: int) -> None:
        rows = named.select("ordinal", sheet_of().alias("sheet"), F.posexplode(array).alias("pos", "x")).select("ordinal", "sheet", "pos", *(F.col(f"x.{c}").alias(c) for c in columns))
        titles = rows.select("ordinal", "sheet").distinct().select("*", *(F.lit(c).alias(c) for c in columns))
        parts.append(as_sheet(titles, number, name, F.lit(begin), list(columns)))
        parts.append(as_sheet(rows, number, name, F.col("pos") + begin + 1, list(columns)))

    part("line_items", ITEM_COLUMNS, 1_000)
    part("tax_details", ("tax_type", "rate", "taxable_amount", "tax_amount"), 1_000_000)
    part("validation.issues", ("field_name", "issue", "severity", "expected", "actual"), 2_000_000)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def journal_sheet(rows: DataFrame) -> DataFrame:
    """Journal rows in order, a blank row after each invoice."""
    wide = upload_format(rows)
    columns = [c for c in wide.columns if c.startswith("c")]
    blank = wide.select("doc_seq").distinct().select("doc_seq", F.lit(999_999).alias("leg_seq"), *(F.lit(None).cast("string").alias(c) for c in columns))
    wide = wide.select("doc_seq", "leg_seq", *(F.col(c).cast("string").alias(c) for c in columns)).union(blank)
    return as_sheet(wide, F.lit(JOURNAL), F.lit("upload format"), F.col("doc_seq") * 1_000_000 + F.col("leg_seq"), columns, list(K.JOURNAL_COLUMNS))


def workbook_rows(invoices: DataFrame, journal_rows: DataFrame | None = None) -> DataFrame:
    """All sheets' rows; without journal rows neither the guide nor the journal."""
    out = summary_sheet(invoices).union(invoice_sheets(invoices))
    if journal_rows is None:
        return out
    g = guide(invoices.sparkSession)
    return out.union(as_sheet(g, F.lit(GUIDE), F.lit("details to be captured"), F.col("seq"), ["head", "details"], ["Head", "Details"])).union(journal_sheet(journal_rows))


def journal_input(invoices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed invoices as the journal takes them: heads and items."""
    from ..functions.dates import to_date

    heads = invoices.select(
        "doc_id", "doc_seq", F.coalesce("invoice_number.value", F.lit("")).alias("number"), to_date(F.coalesce("invoice_date.value", F.lit(""))).alias("invoice_date"), F.col("seller.name").alias("seller"),
        F.col("seller.gstin").alias("seller_gstin"), F.col("buyer.gstin").alias("buyer_gstin"), "inter_state", "source_file", "reverse_charge", "subtotal",
    )
    # An invoice of tax rows without items has a slab for each, based on its subtotal.
    tax = F.transform("tax_details", lambda t: F.struct(F.when(t.tax_type.contains("IGST"), t.rate).otherwise(t.rate * 2).alias("gst_rate"), F.lit("").alias("hsn_sac"), F.col("subtotal").alias("taxable_amount"), F.lit(K.JOURNAL["no_items"]).alias("description")))
    own = F.transform("line_items", lambda x: F.struct(x.gst_rate.alias("gst_rate"), x.hsn_sac.alias("hsn_sac"), x.taxable_amount.alias("taxable_amount"), x.description.alias("description")))
    rows = invoices.select("doc_id", F.posexplode(F.when(F.size("line_items") > 0, own).otherwise(tax)).alias("pos", "x"))
    return heads, rows.select("doc_id", "pos", F.col("x.gst_rate").cast("decimal(9,4)").alias("gst_rate"), F.col("x.hsn_sac").alias("hsn"), F.col("x.taxable_amount").cast("decimal(18,2)").alias("base"), F.col("x.description").alias("description"))
