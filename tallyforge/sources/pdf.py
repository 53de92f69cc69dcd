"""Document files as pages.

Files are read by Spark's own reader, wherever they are. What is inside comes
from a backend, a picklable function from a file's bytes to its pages, called in
Arrow batches; a file that it fails on is a row with an error, not a failed job.
Files with text of their own need no backend: ``pdf_pages`` reads those. Others,
for recognition or a library's own reading, are given by the caller.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

PAGE = "page_no int, text string, has_images boolean, tables array<array<array<string>>>, table_source string"
PAGE_COLUMNS = ["doc_id", "page_no", "text", "has_images", "tables", "table_source", "error"]
PAGES = f"doc_id string, {PAGE}, error string"
#: From a file's bytes to dicts with the fields of PAGE.
Backend = Callable[[bytes], list[dict]]


def document_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, source_file, length, content) of one ``.pdf`` file, or of those right in a folder."""
    reader = spark.read.format("binaryFile")
    files = reader.load(path) if path.lower().endswith(".pdf") else reader.option("pathGlobFilter", "*.pdf").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("source_file"), "length", "content")


def uploaded(spark: SparkSession, files: list[tuple[str, bytes]]) -> DataFrame:
    """The same of files at hand."""
    return spark.createDataFrame([(n, n, len(b), bytearray(b)) for n, b in files], "path string, source_file string, length long, content binary")


def in_order(files: DataFrame) -> DataFrame:
    """(path, source_file, doc_seq): files numbered in order of their paths, from names alone; contents stay where they are.

    Names are dealt by range and numbered within their range; only the ranges' sizes meet in one task.
    """
    names = files.select("path", "source_file")
    n = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = names.repartitionByRange(n, "path").withColumn("_p", F.spark_partition_id())
    inside = spread.withColumn("_n", F.row_number().over(W.partitionBy("_p").orderBy("path")))
    sizes = inside.groupBy("_p").agg(F.max("_n").alias("_size"))
    before = sizes.select(F.col("_p").alias("_q"), F.coalesce(F.sum("_size").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return inside.join(F.broadcast(before), F.col("_p") == F.col("_q")).select("path", "source_file", (F.col("_before") + F.col("_n") - 1).cast("long").alias("doc_seq"))


def extracted_pages(files: DataFrame, backend: Backend, key: str = "path") -> DataFrame:
    """PAGES of files; a file without pages, or one that fails, has one row with a null page_no."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["page_no", "text", "has_images", "tables", "table_source"]
        for f in frames:
            rows = []
            for name, content in zip(f[key], f["content"], strict=True):
                try:
                    found = [tuple(p.get(c) for c in columns) for p in backend(bytes(content))]
                    rows += [(name, *p, None) for p in found] or [(name, *[None] * 5, None)]
                except Exception as e:
                    rows.append((name, *[None] * 5, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc_id", *columns, "error"])

    return files.select(key, "content").mapInPandas(run, PAGES)
