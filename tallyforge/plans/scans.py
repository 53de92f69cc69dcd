"""Queries over drawn pages: each supplier's page is drawn in a task, and read back from its pixels."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout, rasters
from .catalogue import query
from .star import read, spread


def _drawn(spark: SparkSession, d: str, draw: Callable[[int], np.ndarray]) -> DataFrame:
    def run(key: int) -> list[tuple]:
        g = draw(key)
        return [(g.shape[1], g.shape[0], g.tobytes())]

    keys = spread(read(spark, d, "supplier").select("s_suppkey"), "s_suppkey")
    page = F.udf(run, "array<struct<width: int, height: int, grey: binary>>", useArrow=False)("s_suppkey")
    return keys.select(F.col("s_suppkey").cast("string").alias("doc_id"), F.lit(1).alias("page_no"), F.inline(page))


def ruled_page(key: int) -> np.ndarray:
    """A table of 2 + key % 4 rows and 3 + key % 3 columns on uneven paper, with specks and writing in its cells."""
    h, w = 300, 400
    grey = 200 + 40 * np.linspace(0, 1, w)[None, :] + np.zeros((h, 1))
    rows, columns = 2 + key % 4, 3 + key % 3
    for i in range(rows + 1):
        grey[40 + 30 * i : 42 + 30 * i, 50 : 52 + 80 * columns if columns < 5 else 52 + 60 * columns] = 20
    for j in range(columns + 1):
        x = 50 + (80 if columns < 5 else 60) * j
        grey[40 : 42 + 30 * rows, x : x + 2] = 20
    grey[50:58, 60:80] = 60
    grey[280, 7 :: 13 + key % 5] = 30
    return grey.astype(np.uint8)


def turned_page(key: int) -> np.ndarray:
    """Lines of writing turned by key % 9 - 4 degrees, with specks."""
    grey = np.full((300, 400), 235, np.uint8)
    for y in range(60, 250, 16):
        for x in range(50 + y % 7, 330, 9):
            grey[y : y + 6, x : x + 6] = 40
    page = rasters.turned(grey, -float(key % 9 - 4))
    page[:: 23 + key % 3, :: 19] = 0
    return page


@query(
    "WITH s AS (SELECT s_suppkey AS k, 2 + s_suppkey % 4 AS r, 3 + s_suppkey % 3 AS c FROM supplier), b AS (SELECT k, i, j, CASE WHEN c < 5 THEN 80 ELSE 60 END AS w FROM (SELECT *, unnest(range(r)) AS i FROM s) x, LATERAL (SELECT unnest(range(c)) AS j)) "
    "SELECT k AS s_suppkey, i::INT AS row_no, j::INT AS column_no, (52 + w * j)::DOUBLE AS x0, (42 + 30 * i)::DOUBLE AS y0, (50 + w * (j + 1))::DOUBLE AS x1, (40 + 30 * (i + 1))::DOUBLE AS y1 FROM b"
)
def q_image_cells(spark, d):
    """Cells of bordered tables from pixels, by row and column."""
    c = rasters.cells(_drawn(spark, d, ruled_page)).withColumn("text", F.concat_ws(" ", *(F.col(x).cast("string") for x in ("x0", "y0", "x1", "y1"))))
    grid = layout.box_grid(c.select("doc_id", "page_no", "text", "x0", "y0"), ["doc_id", "page_no"])
    one = grid.select(F.col("doc_id").cast("long").alias("s_suppkey"), F.col("row_no").cast("int").alias("row_no"), F.posexplode("cells").alias("column_no", "_c"))
    at = F.split("_c", " ")
    return one.select("s_suppkey", "row_no", "column_no", *(F.get(at, k).cast("double").alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))))


@query("SELECT s_suppkey, (s_suppkey % 9 - 4)::INT AS degrees, true AS straight FROM supplier")
def q_image_skew(spark, d):
    """Skew of drawn pages to the nearest degree, and whether what straightening gives has less than half a degree left."""
    once = rasters.straightened(_drawn(spark, d, turned_page))
    again = rasters.straightened(once.withColumnRenamed("skew", "first"))
    return again.select(F.col("doc_id").cast("long").alias("s_suppkey"), F.round("first").cast("int").alias("degrees"), (F.abs("skew") <= 0.5).alias("straight"))
