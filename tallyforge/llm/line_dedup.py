"""Lines that many documents share are taken out of all of them.

A line is what stands between line feeds; its key is the line without white
space at both ends and with A-Z in lower case. Keys found in at least
``min_docs`` documents lose every line, wherever it stands.

Each document sends a 128-bit hash of every distinct key, once. Pairs of hash
and document are made distinct before they are counted, so a frequent line is
spread over all tasks by its documents, and only partial counts meet. Lines to
drop come back as positions per row, by a key that is written with the row, and
the text is put together again from the lines that stay.

Defined results: a null or empty text is one empty line, and an empty key is
never dropped; rows that repeat a document id, or have none, count as one
document and each gets its own result; a very long text is held whole by the task
of its row; columns of the input are kept whatever their names; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, parts, raw, table

BLANK = b" \t\n\x0b\x0c\r"
MIN_DOCS, MIN_CHARS, SALTS = 10, 1, 16


def line_keys(text: bytes) -> list[bytes]:
    return [line.strip(BLANK).lower() for line in text.split(b"\n")]


def _lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            rows, docs, hashes, at = [], [], [], []
            for row, doc, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                places: dict[bytes, list[int]] = {}
                for i, key in enumerate(line_keys(text)):
                    if len(key) >= min_chars and len(key.decode("utf-8", "replace")) >= min_chars:
                        places.setdefault(key, []).append(i)
                rows += [row] * len(places)
                docs += [doc] * len(places)
                hashes += map(xxhash.xxh3_128_digest, places)
                at += places.values()
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(docs, batch.column(1).type), pa.array(hashes, pa.binary()), pa.array(at, pa.list_(pa.int32()))], ["row", "doc", "hash", "at"])

    return run


def _rebuild(column: str):
    """Rows without their common lines; the text is read where it stands in its row, so it travels once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = pc.struct_field(batch.column("own"), column).cast(pa.binary())
            yield _without(batch.column("own"), [t or b"" for t in texts.to_pylist()], batch.column("at").to_pylist())

    return run


def _without(own: pa.Array, texts: list[bytes], at: list) -> pa.RecordBatch:
    n_lines, n_dropped, kept = [], [], []
    for text, dropped in zip(texts, at, strict=True):
        lines, gone = text.split(b"\n"), {i for part in dropped or () for i in part}
        n_lines.append(len(lines))
        n_dropped.append(len(gone))
        kept.append(b"\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text)
    return pa.RecordBatch.from_arrays([own, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary())], ["own", "n_lines", "n_dropped", "kept"])


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(own, n_lines, n_dropped, kept): the row as it was, as a struct, and the UTF-8 bytes of the lines that stay."""
    key = docs.schema[doc_id].dataType
    # The key of a row is settled by writing it, as ids may be null or repeated.
    rows = cut(docs.select(F.struct("*").alias("own"), F.monotonically_increasing_id().alias("row")), "rows")
    lines = rows.select("row", F.col("own")[doc_id].alias("doc"), raw(f"own.`{text}`").alias("text")).mapInArrow(_lines(min_chars), T.StructType([T.StructField("row", T.LongType()), T.StructField("doc", key), T.StructField("hash", T.BinaryType()), T.StructField("at", T.ArrayType(T.IntegerType()))]))
    pairs = lines.select("doc", "hash").distinct()
    common = pairs.groupBy("hash").count().where(F.col("count") >= min_docs).select("hash")
    # The lines of a frequent hash are dealt to several tasks by their rows.
    common = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    lines = lines.withColumn("salt", F.pmod(F.hash("row"), F.lit(SALTS)))
    gone = lines.join(common, ["hash", "salt"], "left_semi").groupBy("row").agg(F.collect_set("at").alias("at"))
    rows = rows.join(gone, "row", "left").select("own", "at")
    schema = T.StructType([T.StructField("own", docs.schema), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.BinaryType())])
    return rows.mapInArrow(_rebuild(text), schema)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("own.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents with the common lines gone and n_chars of what is left; other columns as they were."""
    out = dedup_lines(docs)
    text = F.when(F.col("own.text").isNull(), None).otherwise(F.col("kept").cast("string"))
    own = F.col("own").withField("text", text)
    return out.select(own.withField("n_chars", F.char_length(text).cast("long")).alias("own")).select("own.*")


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
k AS (SELECT doc_id, pos, line,
         translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(c.key) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c USING (key) GROUP BY doc_id
"""
