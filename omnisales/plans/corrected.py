"""Corrected variants (C1-C8), named separately; the faithful analyses stay the default.

Each one fixes a place where the reference's text and its stated intent
disagree (see the docstrings); none replaces a faithful analysis.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import year_month_of_index
from ..functions.exact import percent, quotient, rounded_avg
from ..functions.ordering import asc, desc
from ..functions.text import pct_text
from ..operators.activity import month_bitmaps
from ..operators.aggregates import PANEL_STATUSES, moving_average
from ..operators.ranking import ntile_maxima, rank_rows
from ..operators.rollup import SCALED, totals
from .customer import COHORT_MONTHS, rfm_segmentation
from .findings import _status_pivot
from .marketplace import band_repeat_rate
from .timeseries import daily_revenue


def cohort_retention_first_purchase(sales: DataFrame, months: int = COHORT_MONTHS) -> DataFrame:
    """cohort = a customer's first month (keyed by year-month); share active k months later.

    Per customer (reduced map-side): a bitmap of the active months; the first is its lowest bit, "active k months
    later" that bit shifted; one small aggregate per cohort.
    """
    d = "transaction_date"
    known = sales.select("customer_id", d).filter(F.col("customer_id").isNotNull() & F.col(d).isNotNull())
    maps = month_bitmaps(known, "customer_id", d)
    per = maps.rows.select(maps.first_month().alias("first"),
                           *[maps.active_after_first(k).cast("long").alias(f"m{k}") for k in range(months)])
    g = per.groupBy("first").agg(F.count(F.lit(1)).alias("total_user_baru"), *[F.sum(f"m{k}").alias(f"m{k}") for k in range(months)])
    pct = [pct_text(percent(F.col(f"m{k}"), F.col("total_user_baru"), 0)).alias(f"bulan_{k}") for k in range(months)]
    return g.select(year_month_of_index(F.col("first")).alias("Cohort_Month"), "total_user_baru", *pct).orderBy(asc("Cohort_Month"))


def rfm_segmentation_best_high(sales: DataFrame, as_of: _dt.date) -> DataFrame:
    """RFM with score 5 = best on every axis, so the segment rules mean what they say."""
    return rfm_segmentation(sales, as_of, best_high=True)


def warehouse_status_pivot(sales: DataFrame) -> DataFrame:
    """One row per warehouse, units / shipping cost / unit share per status (no rank alignment)."""
    p = _status_pivot(sales, "warehouse_origin", PANEL_STATUSES,
                      {"Shipping": (F.sum, "quantity"), "Total_Shipping_Cost": (F.sum, "shipping_cost")})
    return p.withColumnRenamed("warehouse_origin", "Warehouse_Origin") \
            .orderBy(desc("Cancelled_Shipping"), asc("Warehouse_Origin"))


def city_status_pivot(sales: DataFrame) -> DataFrame:
    """One row per city, units and unit share per status (no rank alignment)."""
    p = _status_pivot(sales, "city", PANEL_STATUSES, {"Shipping": (F.sum, "quantity")})
    return p.withColumnRenamed("city", "City").orderBy(desc("Cancelled_Shipping"), asc("City"))


def restock_by_reorder_point(sales: DataFrame) -> DataFrame:
    """C4: per catalogue product, stock counted once, units sold, remaining stock and a reorder flag."""
    # the name depends on the code: grouping by both keeps a hash aggregate (no string MAX)
    g = sales.groupBy("product_code", F.col("product_name").alias("Product_Name")).agg(
        F.sum("quantity").alias("Total_Selling"),
        F.max("stock_qty").alias("Stock_Qty"), F.max("reorder_point").alias("Reorder_Point"))
    remaining = F.col("Stock_Qty") - F.col("Total_Selling")
    flag = F.when(remaining.isNull(), F.lit(None)).when(remaining <= F.col("Reorder_Point"), "Yes").otherwise("No")
    return g.select(F.col("product_code").alias("Product_Code"), "Product_Name", "Total_Selling", "Stock_Qty",
                    remaining.alias("Remaining_Stock"), "Reorder_Point", flag.alias("Needs_Restock")) \
            .orderBy(desc("Total_Selling"), asc("Product_Code"))


def discount_band_quartiles(sales: DataFrame) -> DataFrame:
    """Real quartiles (NTILE(4) maxima), top band above the third; repeat = customer has > 1 row."""
    positive = sales.select("discount_amount").filter(F.col("discount_amount") > 0)
    limits = ntile_maxima(positive, "discount_amount", 4)[:3]
    return band_repeat_rate(sales, limits, repeat_per_product=False)


def product_reviews_once(sales: DataFrame) -> DataFrame:
    """Category ranking with review count and rating taken once per sold product, not per row."""
    per_product = sales.groupBy("category", "product_code").agg(
        F.sum("quantity").alias("qty"), F.sum("gross_sales").alias("rev"), F.sum("net_profit").alias("prof"),
        F.max("rating_average").alias("rating"), F.max("review_count").alias("reviews"))
    g = per_product.groupBy("category").agg(
        F.sum("qty").alias("Total_Terjual"), F.sum("rev").alias("Total_Revenue"),
        F.sum("prof").alias("Penjualan_Bersih"), rounded_avg("rating", 2, precision=3, scale=1).alias("Product_Rating"),
        F.sum("reviews").alias("Review_Count"))
    r = rank_rows(g, [desc("Total_Terjual"), asc("category")])
    return r.select("Ranking", F.col("category").alias("Category"), "Total_Terjual", "Total_Revenue",
                    "Penjualan_Bersih", "Product_Rating", "Review_Count").orderBy("Ranking")


def unit_scaled_profit(sales: DataFrame) -> DataFrame:
    """Platform profitability with production cost multiplied by the units sold."""
    g = totals(sales, "platform").select("platform", F.col("gross_sales").alias("Total_Revenue"), F.col(SCALED).alias("Total_Profit"))
    margin = F.round(quotient(F.col("Total_Profit"), F.col("Total_Revenue"), 2, 2) * F.lit(100), 2)
    return g.select(F.col("platform").alias("Platform"), "Total_Revenue", "Total_Profit",
                    margin.alias("Margin_Percentage")).orderBy(desc("Total_Profit"), asc("Platform"))


def revenue_moving_average_calendar(sales: DataFrame) -> DataFrame:
    """7- and 30-day moving averages over calendar days (days without sales count as 0).

    The day spine spans the first to the last sale date (bounded by the
    calendar, not by the data volume) and is built from a one-row aggregate.
    """
    daily = daily_revenue(sales).filter(F.col("Dates").isNotNull())
    bounds = daily.agg(F.min("Dates").alias("lo"), F.max("Dates").alias("hi"))
    spine = bounds.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("Dates"))
    days = spine.join(daily, "Dates", "left").select(
        "Dates", F.coalesce(F.col("Total_Revenue"), F.lit(0).cast("decimal(28,2)")).alias("Total_Revenue"))
    return days.select("Dates", "Total_Revenue",
                       moving_average(days, "Dates", "Total_Revenue", 7, "Ma_7_Days"),
                       moving_average(days, "Dates", "Total_Revenue", 30, "Ma_30_Days")).orderBy(asc("Dates"))

