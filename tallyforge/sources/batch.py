"""A batch of document files from bytes to checked invoices and the rows of their workbook, in one call each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import invoice, journal, pages, validate
from . import pdf, pdf_pages, reports
from .shared import kept

Backend = pdf.Backend


def documents(files: DataFrame, backend: Backend | None = None, ocr: Backend | None = None, folder: str | None = None) -> DataFrame:
    """(doc_id, doc_seq, source_file, pdf_type, text, tables, failure) of files: classified, and read by the way of their kind.

    Digital documents go by their own text, scanned ones by the second backend,
    hybrid ones by their own text and the recognised text of pages without any.
    A file that can't be opened has a failure and an empty text; it stops no other.
    Without a backend files are read by ``pdf_pages``. Pages are written to the folder, or
    where the session checkpoints, so that each file is read once.
    """
    found = pdf_pages.pages(files, kept=lambda df: kept(df, folder, "drawn")) if backend is None else pdf.extracted_pages(files, backend)
    found = kept(found.select(*pdf.PAGE_COLUMNS), folder, "pages")
    kinds = pages.classify(pages.page_profile(found)).select("doc_id", "pdf_type", "reason")
    own = found.where("page_no IS NOT NULL").join(kinds.where("pdf_type IN ('digital', 'hybrid')").select("doc_id"), "doc_id", "left_semi").select("doc_id", "page_no", "text", "tables")
    if ocr is not None:
        ask = files.join(kinds.where("pdf_type IN ('scanned', 'hybrid')").select(F.col("doc_id").alias("path")), "path", "left_semi")
        read = kept(pdf.extracted_pages(ask, ocr), folder, "recognised").where("page_no IS NOT NULL").select("doc_id", "page_no", "text", "tables")
        own = own.where(F.trim(F.coalesce("text", F.lit(""))) != "").union(pages.hybrid_pages(own, read))
    texts = pages.full_text(own)
    names = pdf.in_order(files).withColumnRenamed("path", "doc_id")
    out = names.join(kinds, "doc_id").join(texts, "doc_id", "left")
    failure = F.when(F.col("pdf_type") == "corrupt", F.concat(F.lit("Pipeline error: "), F.col("reason")))
    return out.select("doc_id", "doc_seq", "source_file", "pdf_type", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("tables", F.array().cast("array<array<array<string>>>")).alias("tables"), failure.alias("failure"))


def invoices(docs: DataFrame, as_of: Column, strict_compat: bool = False) -> DataFrame:
    """Parsed, checked and compared invoices of documents()."""
    out = validate.validated(invoice.parse(docs, strict_compat=strict_compat), as_of, strict_compat)
    errors = F.when(F.col("failure").isNotNull(), F.array("failure")).otherwise(F.col("processing_errors"))
    return validate.duplicate_errors(out.withColumn("processing_errors", errors)).drop("failure")


def process(files: DataFrame, backend: Backend | None, as_of: Column, ocr: Backend | None = None, vendors: DataFrame | None = None, strict_compat: bool = False, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Invoices of files, and the rows of their workbook; with vendors, journal and guide are among them. Pages and invoices are written once, to the folder or where the session checkpoints."""
    found = kept(invoices(documents(files, backend, ocr, folder), as_of, strict_compat), folder, "invoices")
    legs = journal.journal(*reports.journal_input(found), vendors) if vendors is not None else None
    return found, reports.workbook_rows(found, legs)
