"""Metrics the reference quotes in its written findings without a query of their own."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import percent
from ..functions.ordering import asc, desc
from ..functions.text import pct_text
from ..operators.aggregates import share_text
from ..operators.ranking import rank_rows
from ..operators.rollup import summed_by, totals
from .customer import AT_RISK, rfm_segmentation
from .timeseries import revenue_moving_average

# Fixed value: the spend limit the findings use for high-value At-Risk customers.
HIGH_VALUE_SPEND = 300_000
FAILED_STATUSES = ("Cancelled", "Returned")


def platform_cost_ratios(sales: DataFrame) -> DataFrame:
    """Shipping and platform fee as % of revenue, and margin %, per platform."""
    revenue = F.col("gross_sales")
    return totals(sales, "platform").select(
        F.col("platform").alias("Platform"),
        pct_text(percent(F.col("shipping_cost"), revenue, 2, 2, 2)).alias("Shipping_Ratio"),
        pct_text(percent(F.col("platform_fee"), revenue, 2, 2, 2)).alias("Platform_Fee_Ratio"),
        pct_text(percent(F.col("net_profit"), revenue, 2, 2, 2)).alias("Margin_Ratio"))


def platform_revenue_share(sales: DataFrame) -> DataFrame:
    """Revenue share per platform and cumulative share in revenue order."""
    g = totals(sales, "platform").select("platform", F.col("gross_sales").alias("Total_Revenue"))
    g = rank_rows(g, [desc("Total_Revenue"), asc("platform")])
    total = F.sum("Total_Revenue").over(Window.partitionBy())
    running = F.sum("Total_Revenue").over(Window.orderBy("Ranking").rowsBetween(Window.unboundedPreceding, 0))
    return g.select("Ranking", F.col("platform").alias("Platform"), "Total_Revenue",
                    pct_text(percent(F.col("Total_Revenue"), total, 2, 2, 2)).alias("Revenue_Share"),
                    pct_text(percent(running, total, 2, 2, 2)).alias("Cumulative_Share")).orderBy("Ranking")


def failed_delivery_share(sales: DataFrame) -> DataFrame:
    """Cancelled + returned units per warehouse as a share of all such units."""
    failed = totals(sales, "warehouse_origin", "delivery_status").filter(F.col("delivery_status").isin(*FAILED_STATUSES))
    g = summed_by(failed, F.col("warehouse_origin"), "warehouse_origin", "quantity").withColumnRenamed("quantity", "Failed_Units")
    g = share_text(g, "Failed_Units", 0, "Failed_Share")
    return g.select(F.col("warehouse_origin").alias("Warehouse_Origin"), "Failed_Units", "Failed_Share") \
            .orderBy(desc("Failed_Units"), asc("Warehouse_Origin"))


def _status_pivot(sales: DataFrame, entity: str, statuses, measures: dict) -> DataFrame:
    """One row per entity, measures per status, plus each status's unit share (pivot, not rank alignment).

    ``measures`` maps an output name to (aggregate function, column). The pivot
    is one aggregate of conditional sums (one shuffle), not a two-phase pivot.
    """
    status = F.col("delivery_status")
    g = sales.filter(status.isin(*statuses)).groupBy(entity).agg(
        *[fn(F.when(status == s, F.col(col))).alias(f"{s}_{name}")
          for s in statuses for name, (fn, col) in measures.items()])
    out = [F.col(entity)]
    for s in statuses:
        units = F.col(f"{s}_Shipping")
        total = F.sum(units).over(Window.partitionBy())
        out += [F.coalesce(units, F.lit(0)).alias(f"{s}_Shipping")]
        out += [F.col(f"{s}_{m}") for m in measures if m != "Shipping"]
        out += [pct_text(percent(F.coalesce(units, F.lit(0)), total, 0)).alias(f"{s}_Ratio")]
    return g.select(*out)


def city_failure_rates(sales: DataFrame) -> DataFrame:
    """Per city, its share of all cancelled and of all returned units (one row per city)."""
    p = _status_pivot(sales, "city", FAILED_STATUSES, {"Shipping": (F.sum, "quantity")})
    return p.withColumnRenamed("city", "City").orderBy(desc("Cancelled_Shipping"), asc("City"))


def at_risk_high_value(sales: DataFrame, as_of: _dt.date, min_spend: int) -> DataFrame:
    """At-Risk customers whose spend exceeds ``min_spend`` (``HIGH_VALUE_SPEND`` in the findings), with days
    since their last order."""
    r = rfm_segmentation(sales, as_of, segments=[AT_RISK])
    return r.filter(F.col("total_belanja") > F.lit(min_spend))


def moving_average_cross(sales: DataFrame) -> DataFrame:
    """Days where the 7-row moving average crosses the 30-row one.

    'below' when MA7 was above MA30 the day before and is not any more,
    'above' for the opposite; the first rows, where both averages cover the
    same days and are equal, are no crossing.
    """
    ma = revenue_moving_average(sales)
    diff = F.signum(F.col("Ma_7_Days") - F.col("Ma_30_Days"))
    w = Window.orderBy(asc("Dates"))
    m = ma.withColumn("_s", diff).withColumn("_p", F.lag("_s").over(w))
    cross = F.when((F.col("_p") > 0) & (F.col("_s") <= 0), "below").when((F.col("_p") < 0) & (F.col("_s") >= 0), "above")
    return m.select("Dates", "Ma_7_Days", "Ma_30_Days", cross.alias("Cross")).filter(F.col("Cross").isNotNull()) \
            .orderBy(asc("Dates"))


def tier_share(sales: DataFrame) -> DataFrame:
    """Units and unit share per membership tier."""
    g = totals(sales, "membership_tier").select("membership_tier", F.col("quantity").alias("Total_Units"))
    g = share_text(g, "Total_Units", 0)
    return g.select(F.col("membership_tier").alias("Membership_Tier"), "Total_Units", "Ratio") \
            .orderBy(desc("Total_Units"), asc("Membership_Tier"))
