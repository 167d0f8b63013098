"""Time analyses (Q28-Q31): weekday and month growth, day parts, moving averages.

All windows here run over aggregated rows whose count is bounded by the
calendar (7 weekdays, one row per month or day), so an unpartitioned window
is one small task whatever the fact size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import WEEKDAYS, seconds_of_day, weekday_name, year_month
from ..functions.exact import growth_percent
from ..functions.ordering import asc, desc, field_position
from ..functions.text import pct_text
from ..operators.aggregates import moving_average, share_text
from ..operators.ranking import rank_rows
from ..operators.rollup import summed_by, totals

# Growth text when there is no value, and day-part names with
# their limits in seconds after midnight [start, end) - the afternoon end is inclusive.
NO_DATA = "New / No Data"
MORNING, NOON, AFTERNOON, NIGHT = "Pagi", "Siang", "Sore", "Malam"
MORNING_FROM, NOON_FROM, AFTERNOON_FROM, AFTERNOON_TO = 4 * 3600, 10 * 3600, 15 * 3600, 18 * 3600


def weekday_growth(sales: DataFrame) -> DataFrame:
    """Q28: units per weekday against the previous weekday (weeks pooled).

    As in the reference the guard tests the current value, so the first
    weekday's growth is NULL rather than the no-data text.
    """
    days = totals(sales, "transaction_date")
    g = summed_by(days, weekday_name(F.col("transaction_date")), "day_of_week", "quantity")
    g = g.withColumnRenamed("quantity", "Current_DayofWeek_Sales")
    w = Window.orderBy(field_position(F.col("day_of_week"), WEEKDAYS), asc("day_of_week"))
    cur, prev = F.col("Current_DayofWeek_Sales"), F.lag("Current_DayofWeek_Sales").over(w)
    growth = F.when(cur.isNull(), F.lit(NO_DATA)).otherwise(pct_text(growth_percent(cur, prev, 2)))
    return g.select(F.col("day_of_week").alias("Day_of_Week"), "Current_DayofWeek_Sales",
                    growth.alias("DoD_Growth_Percentage"))


def month_growth(sales: DataFrame) -> DataFrame:
    """Q29: units per year-month against the previous month."""
    g = summed_by(totals(sales, "transaction_date"), year_month(F.col("transaction_date")), "YearMonth", "quantity")
    g = g.withColumnRenamed("quantity", "Current_Month_Sales")
    w = Window.orderBy(asc("YearMonth"))
    g = g.withColumn("_prev", F.lag("Current_Month_Sales").over(w))
    cur, prev = F.col("Current_Month_Sales"), F.col("_prev")
    growth = F.when(prev.isNull(), F.lit(NO_DATA)).otherwise(pct_text(growth_percent(cur, prev, 2)))
    return g.select("YearMonth", "Current_Month_Sales", F.coalesce(prev, F.lit(0)).alias("Previous_Month_Sales"),
                    growth.alias("MoM_Growth_Percentage")).orderBy(asc("YearMonth"))


def day_part(order_time: F.Column) -> F.Column:
    """Day part of an 'HH:MM:SS' time; unparsable or NULL times are night."""
    s = seconds_of_day(order_time)
    return (F.when((s >= MORNING_FROM) & (s < NOON_FROM), MORNING)
            .when((s >= NOON_FROM) & (s < AFTERNOON_FROM), NOON)
            .when((s >= AFTERNOON_FROM) & (s <= AFTERNOON_TO), AFTERNOON)
            .otherwise(NIGHT))


def day_part_demand(sales: DataFrame) -> DataFrame:
    """Q30: transactions, units and unit share per day part, ranked by transactions then units."""
    g = sales.groupBy(day_part(F.col("order_time")).alias("Time_Order")).agg(
        F.count("transaction_id").alias("Total_Transaction"),
        F.sum("quantity").alias("Total_Qty_OrderCustomer"))
    g = share_text(g, "Total_Qty_OrderCustomer", 0)
    r = rank_rows(g, [desc("Total_Transaction"), desc("Total_Qty_OrderCustomer"), asc("Time_Order")])
    return r.select("Ranking", "Time_Order", "Total_Transaction", "Total_Qty_OrderCustomer", "Ratio") \
            .orderBy("Ranking")


def daily_revenue(sales: DataFrame) -> DataFrame:
    return totals(sales, "transaction_date").select(F.col("transaction_date").alias("Dates"), F.col("gross_sales").alias("Total_Revenue"))


def revenue_moving_average(sales: DataFrame) -> DataFrame:
    """Q31: daily revenue with 7- and 30-row moving averages (rows, not calendar days)."""
    d = daily_revenue(sales)
    return d.select("Dates", "Total_Revenue",
                    moving_average(d, "Dates", "Total_Revenue", 7, "Ma_7_Days"),
                    moving_average(d, "Dates", "Total_Revenue", 30, "Ma_30_Days")).orderBy(asc("Dates"))
