"""Writing results and the prepared view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import year_month


def assert_unique_columns(df: DataFrame) -> None:
    """File formats need distinct column names (case-insensitive), e.g. the reference's
    panel queries repeat ``Total_Shipping_Cost`` and ``Ratio``."""
    seen: dict[str, str] = {}
    for c in df.columns:
        if c.lower() in seen:
            raise ValueError(f"duplicate output column {c!r} (also {seen[c.lower()]!r})")
        seen[c.lower()] = c


def write_report(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """Write an analysis result (small) as Parquet or CSV with a header."""
    assert_unique_columns(df)
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)
    return path


# Tasks that share a month: a month's files stay few, and a large month is not one task's work.
MONTH_SPLITS = 8


def write_sales_table(sales: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Write the sales view partitioned by year-month, so time-bounded analyses read only their months.

    Rows are gathered by month and a part of the transaction id first, so a month gets at most
    ``MONTH_SPLITS`` files instead of one from every task.
    """
    out = sales.withColumn("year_month", year_month(F.col("transaction_date")))
    out = out.repartition("year_month", F.pmod(F.xxhash64("transaction_id"), F.lit(MONTH_SPLITS)))
    out.write.mode(mode).partitionBy("year_month").parquet(path)
    return path
