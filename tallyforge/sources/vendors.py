"""The vendor master: keywords and the codes of the vendors whose names contain them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VENDORS = "seq int, keyword string, vendor_code string, gl_code long, journal_type string"


def vendor_master(spark: SparkSession, path: str | None) -> DataFrame:
    """Rows of a CSV with a header, in file order; none without a path. A code that is no number is null, not an error."""
    if path is None:
        return spark.createDataFrame([], VENDORS)
    # A whole small file is one row, so that the order of its lines is known whatever reads it.
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\r\n?", "\n"), "\n")).alias("seq", "line"))
    row = F.from_csv("line", F.lit("keyword string, vendor_code string, gl_code string, journal_type string"))
    out = text.where("seq > 0 AND trim(line) <> ''").select("seq", row.alias("r"))
    return out.select("seq", "r.keyword", "r.vendor_code", F.col("r.gl_code").try_cast("long").alias("gl_code"), "r.journal_type")
