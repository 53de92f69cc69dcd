"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Between words: space and the ASCII controls tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share; one of our own only where none is set."""
    at = spark.sparkContext._jsc.sc().getCheckpointDir()
    if at.isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="tallyforge-")
        spark.sparkContext.setCheckpointDir(folder)
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
    return at.get()


@contextlib.contextmanager
def once(spark: SparkSession) -> Iterator[None]:
    """What is shuffled for a query in here isn't needed after it, so its files go at its end and not when the driver happens to collect garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


#: Folders that cut() has written, for each settled() that is going on.
_WRITTEN: list[list[str]] = []


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: the lineage ends here, lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with once(spark):
        df.write.parquet(path)
    if _WRITTEN:
        _WRITTEN[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete what cut() wrote for these, once no result reads it any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, folder)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """cut() of what make() gives; what it has cut on the way is deleted, as only the result is read from here on."""
    _WRITTEN.append([])
    try:
        df = make()
    finally:
        written = _WRITTEN.pop()
    out = cut(df, name)
    for folder in written:
        _delete(df.sparkSession, folder)
    return out


def raw(text: str) -> F.Column:
    """A text column as UTF-8 bytes, null as empty: Python then never has to decode it."""
    return F.coalesce(F.col(text).cast("binary"), F.lit(b""))


def parts(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches in parts, so that a worker holds the Python objects of few rows at a time; what it has freed goes back to the system in the end."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
    released()


def released() -> None:
    """Gives a worker's free memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tasks(spark: SparkSession) -> int:
    """Partitions for work whose cost is in Python, so that its bytes say little: as many as the session's shuffles."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bits of a bitmap: from the least to the most, 16 for each value where that is between; words of 64 bits that come to the driver as one row.
LEAST_BITS, MOST_BITS, STRETCH = 1 << 16, 1 << 28, 1 << 13


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each stretch's words as bytes, of its words that aren't zero and their places."""
    for batch in parts(batches, 16):
        out = []
        for at, marks in zip(batch.column(1), batch.column(2), strict=True):
            words = np.zeros(STRETCH, np.int64)
            words[at.values.to_numpy()] = marks.values.to_numpy()
            out.append(words.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["s", "words"])


def bitmap(hashes: DataFrame, most: int = MOST_BITS) -> np.ndarray:
    """Words of 64 bits, one bit for each value of hashes(h) by its highest bits.

    Stretches of words are put together by tasks: at most ``most`` / 8 bytes, 32 MB in
    512 rows, reach the driver, where a row for each word would be millions of objects.
    Far beyond ``most`` values it fills up and tells less; who asks must be right for any answer.
    """
    bits = LEAST_BITS
    wanted = min(most, 16 * hashes.count())
    while bits < wanted:
        bits *= 2
    word = (bits // 64).bit_length() - 1
    marks = hashes.selectExpr(f"shiftrightunsigned(h, {64 - word}) AS w", f"shiftleft(1L, CAST(shiftrightunsigned(h, {58 - word}) & 63 AS int)) AS m")
    words = marks.groupBy("w").agg(F.bit_or("m").alias("m")).selectExpr(f"w DIV {STRETCH} AS s", f"CAST(w % {STRETCH} AS int) AS i", "m")
    # The two lists of a stretch are in the same order, as one pass fills both.
    held = words.groupBy("s").agg(F.collect_list(F.struct("i", "m")).alias("l")).select("s", "l.i", "l.m")
    out = np.zeros(max(bits // 64, STRETCH), np.int64)
    for r in held.mapInArrow(_stretches, "s long, words binary").collect():
        out[r.s * STRETCH : (r.s + 1) * STRETCH] = np.frombuffer(r.words, np.int64)
    return out[: bits // 64].view(np.uint64)


def marked(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    word = np.uint64(len(words).bit_length() - 1)
    h = h.view(np.uint64)
    return (words[h >> (np.uint64(64) - word)] >> ((h >> (np.uint64(58) - word)) & np.uint64(63))) & np.uint64(1) == 1


def among(words: np.ndarray):
    """A column function: whether a long may be among a bitmap's."""
    return F.pandas_udf(lambda h: pd.Series(marked(words, h.to_numpy(np.int64))), "boolean")


#: Rows of the commonest keys that every task may know.
HOT = 1 << 16


def heaviest(counts: DataFrame, hot: int = HOT) -> int:
    """The lowest power of two such that at most ``hot`` rows of counts(n) have so large an n."""
    sizes = {r.p: r.k for r in counts.groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count(F.lit(1)).alias("k")).collect()}
    p, total = max(sizes, default=-1) + 1, 0
    while p > 0 and total + sizes.get(p - 1, 0) <= hot:
        p -= 1
        total += sizes.get(p, 0)
    return 1 << p


def joined_by_weight(rows: DataFrame, table: DataFrame, on: list[str], hot: int = HOT) -> DataFrame:
    """rows left-joined with table(on, n, ...), n the number of rows of each key: the heaviest keys are broadcast, so those that are shuffled have few rows each."""
    least = heaviest(table, hot)
    often = table.where(F.col("n") >= least)
    met = rows.join(F.broadcast(often), on)
    rest = rows.join(F.broadcast(often.select(*on)), on, "left_anti").join(table.where(F.col("n") < least), on, "left")
    return met.unionByName(rest)


def links_to_components(links: DataFrame) -> DataFrame:
    """Connected components of links(a, b) as (node, root), root the smallest node reachable.

    Alternates the large-star and small-star steps until every component is a
    star around its smallest node, which one grouping tells: a node has no
    smaller neighbour, or has that neighbour only. Each step takes per-node
    minima, which combine map-side, and joins them back to the edges; a node
    with many neighbours is split by the skew join. Edges stay distributed; only
    one node that isn't settled reaches the driver.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:  # each round joins something
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        if both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).where("m < u AND n > 1").isEmpty():
            break
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        edges = cut(
            small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(),
            "edges",
        )
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
