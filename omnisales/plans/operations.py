"""Operational analyses (Q19-Q23): returns, delivery status, warehouses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import asc, desc
from ..functions.text import money_text
from ..operators.aggregates import PANEL_STATUSES, share_text, status_panel
from ..operators.rollup import ROWS, totals
from ..sources.prepare import NO_REASON


def returned_flag_share(sales: DataFrame) -> DataFrame:
    """Q19: rows and share per returned flag (0 digits)."""
    g = sales.groupBy("returned_flag").agg(F.count("returned_flag").alias("Total_Returned_Flag"))
    g = share_text(g, "Total_Returned_Flag", 0)
    return g.select(F.col("returned_flag").alias("Returned_Flag"), "Total_Returned_Flag", "Ratio")


def delivery_status_share(sales: DataFrame) -> DataFrame:
    """Q20: rows and share per delivery status (1 digit)."""
    known = F.when(F.col("delivery_status").isNull(), F.lit(0)).otherwise(F.col(ROWS)).cast("long")
    g = totals(sales, "delivery_status").select("delivery_status", known.alias("Total_Returned_Flag"))
    g = share_text(g, "Total_Returned_Flag", 1)
    return g.select(F.col("delivery_status").alias("Cancelled_Transaction"), "Total_Returned_Flag", "Ratio")


def warehouse_shipping(sales: DataFrame, numeric_order: bool = False) -> DataFrame:
    """Q21: units and shipping cost (money text, 0 digits) per warehouse.

    Faithful order: units, then the cost *text* ('Rp 9' sorts after 'Rp 10');
    ``numeric_order`` sorts ties by the cost amount instead.
    """
    g = sales.groupBy("warehouse_origin").agg(F.sum("quantity").alias("Total_Shipping"),
                                              F.sum("shipping_cost").alias("_cost"))
    out = g.select(F.col("warehouse_origin").alias("Warehouse_Origin"), "Total_Shipping",
                   money_text(F.col("_cost"), 0).alias("Total_Shipping_Cost"), "_cost")
    second = desc("_cost") if numeric_order else desc("Total_Shipping_Cost")
    return out.orderBy(desc("Total_Shipping"), second, asc("Warehouse_Origin")).drop("_cost")


def warehouse_status_panel(sales: DataFrame) -> DataFrame:
    """Q22: per status, warehouses ranked by units with shipping cost and unit share, side by side.

    As in the reference, the warehouse shown is the cancelled list's; the
    returned and delivered numbers belong to the same rank of their own
    lists. The repeated output names get the status as prefix.
    """
    p = status_panel(sales, "warehouse_origin",
                     {"Shipping": F.sum("quantity"), "Total_Shipping_Cost": F.sum("shipping_cost")},
                     rank_measure="Shipping", ratio_measure="Shipping", ratio_digits=0)
    cols = [F.col(f"{PANEL_STATUSES[0]}.warehouse_origin").alias("Warehouse_Origin")]
    for s in PANEL_STATUSES:
        cols += [F.col(f"{s}.Shipping").alias(f"{s}_Shipping"),
                 F.col(f"{s}.Total_Shipping_Cost").alias(f"{s}_Total_Shipping_Cost"),
                 F.col(f"{s}.Ratio").alias(f"{s}_Ratio")]
    return p.orderBy("rn").select(*cols)


def return_reasons(sales: DataFrame) -> DataFrame:
    """Q23: rows per return reason, without 'No' (NULL reasons drop out too)."""
    return (sales.filter(F.col("return_reason") != NO_REASON).groupBy("return_reason")
            .agg(F.count("return_reason").alias("Total_return"))
            .orderBy(desc("Total_return"), asc("return_reason")))
