"""Streaming ingest of export files with a checkpoint as the ledger.

Each micro-batch is deduplicated against the snapshot of what is stored, so state doesn't grow with history, and
is written under its batch id; a batch that runs again after a failure overwrites its own output only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tarrafa.plans.ingest import ledger, new_events
from tarrafa.schemas import EVENTS
from tarrafa.session import exists
from tarrafa.sources.readers import export_rows, unzipped_lines

def stored_events(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """All batches under ``root``, or those before a batch id; an empty table where there are none."""
    if not exists(spark, root):
        return spark.createDataFrame([], EVENTS)
    stored = T.StructType([*EVENTS.fields, T.StructField("batch", T.LongType())])
    rows = spark.read.option("basePath", root).schema(stored).parquet(root)
    return (rows if before is None else rows.where(F.col("batch") < before)).drop("batch")


def ingest_stream(spark: SparkSession, landing: str, root: str, checkpoint: str, files_per_batch: int = 16, hosts: list[str] | None = None, ledger_root: str | None = None) -> StreamingQuery:
    """Take in all files that lie in ``landing`` and stop; later calls go on where this one ended.

    With ``ledger_root`` each batch's files are put into the ledger there under the same batch id, after its rows: a
    batch that failed in between writes both anew.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.zip").option("maxFilesPerTrigger", files_per_batch).load(landing)

    def write(batch: DataFrame, batch_id: int) -> None:
        raw = export_rows(unzipped_lines(batch))
        fresh = new_events(raw, stored_events(spark, root, batch_id), hosts=hosts)
        fresh.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")
        if ledger_root:
            listed = batch.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("path").alias("url"))
            ledger(listed).write.mode("overwrite").parquet(f"{ledger_root}/batch={batch_id}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(stream: DataFrame, key: str = "sourceurl", event_time: str | None = None, watermark: str | None = None) -> DataFrame:
    """The first row of each key in a stream; with a watermark, within it (bounded state)."""
    if event_time and watermark:
        return stream.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark([key])
    return stream.dropDuplicates([key])


def skipping_known(batch: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows of a micro-batch whose key a snapshot lacks."""
    return batch.join(known.select(key).distinct(), key, "left_anti")


def due(stream: DataFrame, now: str = "now") -> DataFrame:
    """Retries that are due at the row's ``now``."""
    return stream.where(F.col("title_next_retry_at").isNull() | (F.col("title_next_retry_at") <= F.col(now)))
