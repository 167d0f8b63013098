"""The preparation steps end to end on text columns, as a file would bring them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import year_month
from ..functions.ordering import asc
from ..schema import TRANSACTION_INTS, TRANSACTION_MONEY
from ..sources.prepare import prepare_transactions


def as_text(tx: DataFrame) -> DataFrame:
    """Typed transactions as the text of a file: dates as dd/MM/yyyy, money and whole numbers as digits."""
    texts = {c: F.col(c).cast("string") for c in [*TRANSACTION_MONEY, *TRANSACTION_INTS] if c in tx.columns}
    texts["transaction_date"] = F.date_format("transaction_date", "dd/MM/yyyy")
    return tx.select([texts[c].alias(c) if c in texts else F.col(c) for c in tx.columns])


def monthly_from_text(raw: DataFrame) -> DataFrame:
    """Transactions written as text and prepared again: rows, units and money per month and return reason."""
    tx = prepare_transactions(as_text(raw))
    g = tx.groupBy(year_month(F.col("temp_date")).alias("YearMonth"), F.col("return_reason").alias("Return_Reason")).agg(
        F.count(F.lit(1)).alias("Total_Rows"), F.sum("quantity").alias("Total_Units"),
        F.sum("gross_sales").alias("Total_Revenue"), F.sum("shipping_cost").alias("Total_Shipping_Cost"))
    return g.orderBy(asc("YearMonth"), asc("Return_Reason"))
