"""Near copies by SimHash, found by multi-index hashing.

A text's fingerprint is a majority vote, bit by bit, over the XXH64 values of
its three-word shingles. Fingerprints link when they differ in at most two
bits. Of two halves of such a pair one differs in at most one bit, so each half
has a table of its own, and a fingerprint asks it for the 33 values in the ball
of radius one around its half; whole fingerprints are then compared.

Equal fingerprints are one row from the start, so exact copies make no pairs. A
half that more than ``bucket`` distinct fingerprints share is not looked up
that way. Fingerprints that hold or ask for such a half meet instead at their
midpoints: two fingerprints are within two bits of each other exactly if some
64-bit value is within one bit of both. Each sends itself and its 64 one-bit
neighbours, a midpoint sees 65 fingerprints at most, and links all of them to
the smallest. No link is lost and no group of near copies is paired out.

Defined results: a null, empty or blank text has fingerprint zero and is linked
like any other; fewer than three words are one shingle; rows that repeat a
document id have a row each and share their component if their texts are near;
null ids are never a component's id unless it has no other; very long texts are
hashed whole; extra columns of any name are not read; an empty table gives an empty
table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, links_to_components, parts, raw, table

SEED, WORDS, BUCKET = 42, 3, 64


def fingerprint(text: bytes, n: int = WORDS) -> int:
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= n:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-n])).tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(line[a:b], SEED) for a, b in zip(starts, (ends[n - 1 :] - 1).tolist(), strict=True)], np.uint64))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    set_bits = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        set_bits += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(h), bitorder="little").view(np.uint64)[0])


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches):
        known: dict[bytes, int] = {}
        out = [known[t] if t in known else known.setdefault(t, fingerprint(t)) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(out, np.uint64).view(np.int64))], ["doc_id", "print"])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, print): the 64 bits as a signed long."""
    return docs.select(F.col(doc_id).alias("doc_id"), raw(text)).mapInArrow(_prints, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, print long")


def _bit(i: int) -> int:
    return 1 << i if i < 63 else -(1 << 63)


def near_links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints of prints(print) that join all within two bits of each other."""
    p = F.col("print")
    halves = F.array(p.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(p, 32) + F.lit(1 << 32))
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << i).cast("long") for i in range(32)))
    held = prints.select(F.explode(halves).alias("half"), p.alias("other"))
    asked = prints.select("print", F.explode(halves).alias("own")).select("print", F.explode(F.transform(flips, lambda x: F.col("own").bitwiseXOR(x))).alias("half"))
    full = held.groupBy("half").count().where(F.col("count") > bucket).select("half", F.lit(True).alias("full"))
    # Spark takes what is asked for as small as the fingerprints it is made of, and would send 66 rows of each to the driver and all tasks.
    asked = asked.hint("merge").join(full, "half", "left")
    met = asked.where("full IS NULL").hint("merge").join(held, "half").where("print < other AND bit_count(print ^ other) <= 2")
    met = met.select(F.col("print").alias("a"), F.col("other").alias("b"))

    rest = asked.where("full").select("print").distinct()
    points = F.array(p, *(p.bitwiseXOR(F.lit(_bit(i)).cast("long")) for i in range(64)))
    at = rest.select("print", F.explode(points).alias("point"))
    least = at.groupBy("point").agg(F.collect_list("print").alias("all")).where(F.size("all") > 1)
    star = least.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a < b")
    return met.union(star).distinct()


def components(prints: DataFrame) -> DataFrame:
    """(print, component_id) from prints(doc_id, print): one row for each distinct fingerprint."""
    classes = cut(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "prints")
    roots = links_to_components(near_links(classes.select("print")))
    named = classes.join(roots, classes.print == roots.node, "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    # Only what is linked needs the smallest id of its group; groups come together by partial minima.
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(least, "root").select("print", "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, print, component_id), one row for each row of docs."""
    prints = cut(fingerprints(docs), "fingerprints")
    return prints.join(components(prints), "print")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each of op6's components the row with the smallest (doc_id, row) stays, null ids last. The pipeline goes by near_copies."""
    # The key of a row is settled by writing it, as ids may be null or repeated.
    rows = cut(docs.select(F.struct("*").alias("own")).withColumn("row", F.monotonically_increasing_id()), "rows")
    keyed = rows.select(F.struct("own.doc_id", "row").alias("key"), "own.text")
    prints = cut(fingerprints(keyed, doc_id="key"), "fingerprints")
    found = prints.join(components(prints.select("print", F.struct(F.col("doc_id.doc_id").isNull().alias("none"), "doc_id.*").alias("doc_id"))), "print")
    kept = found.groupBy("component_id").agg(F.first("component_id.row").alias("row")).select("row")
    return rows.join(kept, "row", "left_semi").select("own.*")
