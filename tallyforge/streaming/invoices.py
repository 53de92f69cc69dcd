"""Documents as they arrive: the batch operators on a stream of page files or of PDF files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.invoice import parse
from ..operators.validate import validated
from ..sources import batch as files_batch


#: States that numbers are dealt to.
SHARES = 1024


def arriving(spark: SparkSession, path: str, schema: str = "doc_id string, source_file string, text string, arrived timestamp") -> DataFrame:
    """Parquet files of documents in a folder, each document once within an hour of its first arrival."""
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.withWatermark("arrived", "1 hour").dropDuplicatesWithinWatermark(["doc_id"])


def statuses(docs: DataFrame, out: str, checkpoint: str, as_of: str) -> StreamingQuery:
    """Parse and validate each batch and append its statuses as Parquet; a batch that is tried again replaces its own folder."""

    def write(batch: DataFrame, epoch: int) -> None:
        parsed = validated(parse(batch), F.lit(as_of).cast("date"))
        parsed.select("doc_id", F.col("invoice_number.value").alias("number"), "grand_total_value", "validation.status").write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Documents by window and status."""
    return events.withWatermark("arrived", late).groupBy(F.window("arrived", every), "status").count()


def repeated_numbers(rows: DataFrame, keep: str = "30 days", late: str = "1 hour", shares: int = SHARES) -> DataFrame:
    """(number, source_file, arrived, earlier) of a stream with these columns: the file that had the number before, null for the first.

    The state of a number is its last file. It goes when the watermark has passed
    its last arrival by ``keep``; a number that comes again after that is new. Numbers
    share a state by their hash, ``shares`` of them, as a call of Python costs as much
    for one number as for hundreds; a state's size is its numbers' by ``shares``. A
    checkpoint goes with its ``shares``.
    Files of a micro-batch count in order of arrival and name, so any cut into
    micro-batches gives the same, and a restart goes on from the checkpoint. Rows
    without a number are none's repeat and pass beside the state.
    """
    hold = int(pd.Timedelta(keep).total_seconds() * 1000)

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = pd.DataFrame(dict(zip(("number", "last", "seen"), state.get if state.exists else ([], [], []), strict=True))).astype({"seen": "int64"}).set_index("number")
        passed = state.getCurrentWatermarkMs()
        latest = known
        if not state.hasTimedOut:
            own = pd.concat(list(frames)).sort_values(["arrived", "source_file"], kind="stable")[["number", "source_file", "arrived"]]
            by = own.groupby("number", sort=False)
            before = by["source_file"].shift().astype(object)
            first = by.cumcount() == 0
            before[first] = own["number"][first].map(known["last"])
            yield own.assign(earlier=before.where(before.notna(), None))
            came = pd.DataFrame({"last": by["source_file"].last(), "seen": by["arrived"].max().astype("datetime64[ms]").astype("int64")})
            came["seen"] = came["seen"].combine(known["seen"].reindex(came.index, fill_value=0), max)
            latest = pd.concat([came, known.drop(came.index, errors="ignore")])
            # What came in this batch stays at least to the next one, even within its lateness.
            kept_on = latest.index.isin(came.index)
        else:
            kept_on = False
        latest = latest[(latest["seen"] + hold >= passed) | kept_on]
        if latest.empty:
            state.remove()
            return
        state.update((latest.index.tolist(), latest["last"].tolist(), latest["seen"].tolist()))
        # A time-out may not lie before the watermark.
        state.setTimeoutTimestamp(max(int(latest["seen"].min()) + hold, passed + 1))

    rows = rows.select("number", "source_file", "arrived").withWatermark("arrived", late)
    blank = F.trim(F.coalesce("number", F.lit(""))) == ""
    schema = "number string, source_file string, arrived timestamp, earlier string"
    share = F.pmod(F.xxhash64("number"), F.lit(shares))
    state = "number array<string>, last array<string>, seen array<long>"
    found = rows.where(~blank).withColumn("share", share).groupBy("share").applyInPandasWithState(follow, schema, state, "append", GroupStateTimeout.EventTimeTimeout)
    return found.unionByName(rows.where(blank).withColumn("earlier", F.lit(None).cast("string")))


def arriving_files(spark: SparkSession, path: str, at_once: int | None = None) -> DataFrame:
    """PDF files of a folder as they arrive, as ``pdf.document_files`` has them, and their time of modification; ``at_once`` of them in a micro-batch at most."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.pdf")
    rows = (reader if at_once is None else reader.option("maxFilesPerTrigger", at_once)).load(path)
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("source_file"), "length", "content", F.col("modificationTime").alias("arrived"))


def file_statuses(files: DataFrame, out: str, quarantine: str, checkpoint: str, as_of: str, backend=None) -> StreamingQuery:
    """From files' bytes to statuses, a micro-batch at a time: statuses of what can be read to ``out``, what can't be to ``quarantine`` with its error and bytes.

    Each epoch has a folder of its own in both, written anew when the epoch is tried
    again, so every file has one row in one of them.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        work = f"{out}/_work/epoch={epoch}"
        docs = files_batch.documents(batch.select("path", "source_file", "length", "content"), backend, folder=work)
        parsed = files_batch.kept(files_batch.invoices(docs, F.lit(as_of).cast("date")), work, "invoices")
        good = parsed.where("pdf_type <> 'corrupt'")
        good.select("source_file", "pdf_type", F.col("invoice_number.value").alias("number"), "grand_total_value", "validation.status").write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        bad = parsed.where("pdf_type = 'corrupt'").select(F.col("doc_id").alias("path"), F.get("processing_errors", 0).alias("error"))
        bad.join(batch.select("path", "source_file", "content", "arrived"), "path").write.mode("overwrite").parquet(f"{quarantine}/epoch={epoch}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
