"""Incremental ingestion of transaction files with Structured Streaming.

The reference loads its transaction file once and then prepares it in place.
Here new CSV files dropped into a folder are prepared with the very same
column expressions as the batch path (sources.prepare) and appended to a
Parquet table partitioned by year-month. Rows with values that cannot be read
also go, as they came, to a reject table.

Both tables are written by ``foreachBatch``, each batch to partitions of its own
(``batch``), which the batch overwrites: one that runs again after a failure
replaces what it had left, so both tables hold every row once. The checkpoint
tells a restarted run which files belong to which batch, and a lost executor
only re-runs its tasks.
"""

from __future__ import annotations

import uuid
import warnings

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.dates import year_month
from ..schema import RAW_TRANSACTIONS, TRANSACTION_INTS, TRANSACTION_MONEY
from ..sources.prepare import prepare_transactions, unreadable

NO_MONTH = "unknown"


def raw_transaction_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Text rows of CSV files arriving in ``source_dir``.

    A stream's schema is fixed, so the columns are bound by position; every
    file's header is compared with it (``enforceSchema=false``), and a file
    with other names or another order fails the query instead of shifting
    columns.
    """
    reader = (spark.readStream.schema(RAW_TRANSACTIONS).option("header", True).option("encoding", "UTF-8")
              .option("enforceSchema", False))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.csv(source_dir)


def transaction_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Prepared transactions from CSV files arriving in ``source_dir``."""
    return prepare_transactions(raw_transaction_stream(spark, source_dir, max_files_per_trigger))


def write_batch(raw: DataFrame, batch: int, table_dir: str, rejects_dir: str | None) -> int:
    """One batch of text rows to the table and, those with unreadable values, to the rejects; returns how many these are.

    Idempotent: partitions of this batch are overwritten, others are left alone.
    """
    raw = raw.persist(StorageLevel.MEMORY_AND_DISK)  # the files are read once for both tables
    try:
        seen = Observation(f"batch-{batch}-{uuid.uuid4().hex}")
        bad = unreadable(raw, TRANSACTION_MONEY, TRANSACTION_INTS)
        tx = prepare_transactions(raw.observe(seen, F.count_if(bad).alias("bad")))
        tx = tx.withColumn("year_month", F.coalesce(year_month(F.col("temp_date")), F.lit(NO_MONTH)))
        _overwrite(tx, batch, table_dir, "year_month")
        rejected = seen.get["bad"]
        if rejects_dir:
            _overwrite(raw.filter(bad), batch, rejects_dir)
        return rejected
    finally:
        raw.unpersist()


def _overwrite(rows: DataFrame, batch: int, folder: str, *by: str) -> None:
    (rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*by, "batch").parquet(folder))


def start_ingest(spark: SparkSession, source_dir: str, table_dir: str, checkpoint_dir: str,
                 available_now: bool = True, max_files_per_trigger: int | None = None,
                 rejects_dir: str | None = None) -> StreamingQuery:
    """Append newly arrived transaction files to the partitioned table at ``table_dir``.

    Rows with a number or date that cannot be read keep NULL in its place in the table; they are counted in a warning
    and written to ``rejects_dir`` as they came. ``available_now`` processes everything present and stops (scheduled
    batch-style runs); otherwise the query keeps polling the folder. ``checkpoint_dir`` must be a shared, durable
    folder, and the tables belong to it: start another table with another checkpoint.
    """
    def batch(raw: DataFrame, number: int) -> None:
        rejected = write_batch(raw, number, table_dir, rejects_dir)
        if rejected:
            warnings.warn(f"{source_dir}, batch {number}: {rejected} rows hold values that cannot be read and are NULL"
                          + (f"; the rows are in {rejects_dir}" if rejects_dir else ""), stacklevel=2)

    stream = raw_transaction_stream(spark, source_dir, max_files_per_trigger)
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def read_ingested(spark: SparkSession, table_dir: str) -> DataFrame:
    """The ingested transactions as a batch frame (input for ``sales_analysis``)."""
    return spark.read.parquet(table_dir).drop("year_month", "batch")


def read_rejects(spark: SparkSession, rejects_dir: str) -> DataFrame:
    """The rejected rows as text, with the number of their ``batch``."""
    return spark.read.parquet(rejects_dir)
