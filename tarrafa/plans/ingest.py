"""Event ingest: filter, deduplicate, leave out what is stored, coerce, append.

The order matters for what is kept and for cost: rows are filtered before they are deduplicated, and numbers
are read last, of surviving rows only.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarrafa.functions.numbers import lenient_double, lenient_integer
from tarrafa.functions.url import allowed_source
from tarrafa.operators.dedup import first_per_key
from tarrafa.operators.upsert import insert_ignore
from tarrafa.schemas import EVENT_COLUMNS, EVENTS, FLOAT_COLUMNS, INT_COLUMNS, LONG_COLUMNS
from tarrafa.session import checkpointed, names
from tarrafa.sources.fetching import Get
from tarrafa.sources.readers import export_rows, unzipped_lines


def coerced(rows: DataFrame) -> DataFrame:
    """Strings to the types of the stored table; text columns keep empty strings."""
    def value(c: str):
        if c in LONG_COLUMNS:
            return lenient_integer(F.col(c), "long")
        if c in INT_COLUMNS:
            return lenient_integer(F.col(c), "int")
        return lenient_double(F.col(c)) if c in FLOAT_COLUMNS else F.col(c)

    kept = [c for c in rows.columns if c not in EVENT_COLUMNS]
    return rows.select(*kept, *[value(c).alias(c) for c in EVENT_COLUMNS])


def new_events(raw: DataFrame, stored: DataFrame, ingested_at: datetime | None = None, hosts: list[str] | None = None) -> DataFrame:
    """The rows of raw exports (source_file, line_no, 61 strings) that are to be appended to ``stored``.

    Of an address the first row by file and line counts; addresses that are stored already are left out, as are
    rows that would break the key (source_file, globaleventid, sourceurl).
    """
    mine = raw.where(allowed_source(F.col("sourceurl"), hosts))
    first = first_per_key(mine, ["sourceurl"], "source_file", "line_no")
    unseen = first.join(stored.select("sourceurl").distinct(), "sourceurl", "left_anti").select(*raw.columns)
    typed = coerced(unseen).drop("line_no")
    at = F.current_timestamp() if ingested_at is None else F.lit(ingested_at)
    return insert_ignore(stored, typed, ["source_file", "globaleventid", "sourceurl"]).withColumn("ingested_at", at)


def ingest_files(spark: SparkSession, files: DataFrame, get: Get, root: str, ledger_root: str, hosts: list[str] | None = None) -> int:
    """Fetch the exports ``files`` (url, file_name) names, append their new rows and put them into the ledger; returns how many came.

    A file whose fetch failed stays out of the ledger, so it is pending again. Rows and ledger are written under the
    next batch number, the ledger last: a batch without one is overwritten by the next run.
    """
    from tarrafa.sources.readers import fetch

    taken = checkpointed(fetch(files, lambda url: (*get(url), None)).join(files, "url").where("body is not null"))
    done = [int(n.removeprefix("batch=")) for n in names(spark, ledger_root) if n.startswith("batch=")]
    number = max(done, default=-1) + 1
    batches = [f"{root}/batch={n}" for n in done]
    stored = spark.read.option("basePath", root).parquet(*batches).drop("batch") if batches else spark.createDataFrame([], EVENTS)
    raw = export_rows(unzipped_lines(taken.select(F.concat(F.lit("/"), "file_name").alias("path"), F.col("body").alias("content"))))
    new_events(raw, stored, hosts=hosts).write.mode("overwrite").parquet(f"{root}/batch={number}")
    ledger(taken).write.mode("overwrite").parquet(f"{ledger_root}/batch={number}")
    return taken.count()


def ledger(files: DataFrame, at: datetime | None = None) -> DataFrame:
    """Rows of the ledger of processed files for a batch (file_name, url)."""
    return files.select("file_name", F.col("url").alias("file_url"), (F.current_timestamp() if at is None else F.lit(at)).alias("processed_at"))
