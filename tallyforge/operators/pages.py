"""Documents from pages: what kind they are, which pages count, their text and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip, tokens
from ..plans import constants as K


def page_profile(pages: DataFrame, text: str = "text") -> DataFrame:
    """pages with char_count, has_text and word_count."""
    bare = strip(F.coalesce(text, F.lit("")))
    return pages.withColumns({"char_count": F.length(bare), "has_text": F.length(bare) >= K.PAGE_CHARS, "word_count": F.size(tokens(bare))})


def classify(profiles: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One row a document: pages by kind, pdf_type, recommended extractor and reason. Partial counts; no page moves.

    A document of no pages is a row with a null page number; one that could not
    be opened has an error there and is corrupt.
    """
    real = F.col("page_no").isNotNull()
    out = profiles.groupBy(doc).agg(
        F.count_if(real).alias("page_count"),
        F.count_if(real & F.col("has_text")).alias("digital_pages"),
        F.count_if(real & ~F.col("has_text")).alias("scanned_pages"),
        (F.max(F.col("error").isNotNull() & ~real) if "error" in profiles.columns else F.lit(False)).alias("corrupt"),
        (F.max(F.when(~real, F.col("error"))) if "error" in profiles.columns else F.lit(None).cast("string")).alias("failure"),
    )
    kind = F.when(F.col("corrupt"), "corrupt").when(F.col("digital_pages") == F.col("page_count"), "digital").when(F.col("digital_pages") == 0, "scanned").otherwise("hybrid")
    out = out.withColumn("pdf_type", kind)
    # fixed values: extractors and reasons, as reports quote them
    extractor = {"corrupt": "none", "digital": "pdfplumber", "scanned": "ocr", "hybrid": "mixed"}
    reasons = {
        "corrupt": F.concat(F.lit("Cannot open PDF: "), F.coalesce("failure", F.lit(""))), "digital": F.format_string("All %d pages have embedded text layer", F.col("page_count")),
        "scanned": F.format_string("All %d pages are image-only (no text layer)", F.col("page_count")), "hybrid": F.format_string("%d digital + %d scanned pages", F.col("digital_pages"), F.col("scanned_pages")),
    }
    by_kind = reason = F.lit(None).cast("string")
    for name, value in extractor.items():
        by_kind = F.when(F.col("pdf_type") == name, value).otherwise(by_kind)
        reason = F.when(F.col("pdf_type") == name, reasons[name]).otherwise(reason)
    return out.withColumns({"recommended_extractor": by_kind, "reason": reason}).drop("corrupt", "failure")


def hybrid_pages(digital: DataFrame, ocr: DataFrame, doc: str = "doc_id", all_ocr: bool = False) -> DataFrame:
    """Recognised pages that count beside digital ones: those without digital text, or all of them."""
    if all_ocr:
        return ocr
    own = digital.where(strip(F.coalesce("text", F.lit(""))) != "").select(doc, "page_no")
    return ocr.join(own, [doc, "page_no"], "left_anti")


def mean_confidence(pages: DataFrame, doc: str = "doc_id", confidence: str = "confidence") -> DataFrame:
    """Mean of a document's positive page confidences, to three places; 0 without any."""
    c = F.col(confidence)
    return pages.groupBy(doc).agg(F.round(F.coalesce(F.avg(F.when(c > 0, c)), F.lit(0.0)), 3).alias("ocr_confidence"))


def word_confidence(words: DataFrame, keys: list[str], confidence: str = "conf") -> DataFrame:
    """Mean of words' confidences from 0 on, as a share, to three places; blank words and negative confidences don't count."""
    kept = words.where((F.col(confidence) >= 0) & (F.trim("text") != ""))
    return kept.groupBy(*keys).agg(F.round(F.avg(confidence) / 100, 3).alias("confidence"))


def full_text(pages: DataFrame, doc: str = "doc_id", drop_blank: bool = False) -> DataFrame:
    """Texts of a document's pages joined by a blank line, and its tables, in order of pages."""
    kept = pages.where(strip(F.coalesce("text", F.lit(""))) != "") if drop_blank else pages
    tables = F.coalesce("tables", F.array().cast("array<array<array<string>>>")) if "tables" in pages.columns else F.array().cast("array<array<array<string>>>")
    all_ = F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("text"), tables.alias("tables"))))
    out = kept.groupBy(doc).agg(all_.alias("p"))
    return out.select(doc, F.array_join(F.transform("p", lambda x: x.text), "\n\n").alias("text"), F.flatten(F.transform("p", lambda x: x.tables)).alias("tables"))


def wants_clustering(words: Column, has_tables: Column) -> Column:
    """Whether a page's words are clustered into a table: no table was found and there are more than twenty words."""
    return ~has_tables & (words > 20)


def first_tables(tiers: dict[str, Column]) -> tuple[Column, Column]:
    """Tables of the first tier that has any, and its name; tiers in order of trial, null or empty where one found none."""
    tables, source = F.array().cast("array<array<array<string>>>"), F.lit("none")
    for name, found in reversed(tiers.items()):
        some = F.size(F.coalesce(found, F.array().cast("array<array<array<string>>>"))) > 0
        tables, source = F.when(some, found).otherwise(tables), F.when(some, name).otherwise(source)
    return tables, source
