"""City and province analyses (Q24-Q27)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import asc, desc
from ..operators.aggregates import PANEL_STATUSES, status_panel
from ..operators.ranking import rank_rows, top_k


def province_ranking(sales: DataFrame) -> DataFrame:
    """Q24: provinces ranked by units, then revenue."""
    g = sales.groupBy("province").agg(F.sum("quantity").alias("Total_Sell"),
                                      F.sum("shipping_cost").alias("Total_Shipping_Cost"),
                                      F.sum("gross_sales").alias("Total_Revenue"),
                                      F.sum("net_profit").alias("Total_Profit"))
    r = rank_rows(g, [desc("Total_Sell"), desc("Total_Revenue"), asc("province")])
    return r.select("Ranking", "province", "Total_Sell", "Total_Shipping_Cost", "Total_Revenue",
                    "Total_Profit").orderBy("Ranking")


def _city_top(sales: DataFrame, ascending: bool, k: int) -> DataFrame:
    g = sales.groupBy("city").agg(F.sum("quantity").alias("Total_Sell"), F.sum("gross_sales").alias("Total_Revenue"))
    order = ([asc("Total_Sell"), asc("Total_Revenue")] if ascending else
             [desc("Total_Sell"), desc("Total_Revenue")]) + [asc("city")]
    return top_k(g, order, k).select("Ranking", "city", "Total_Sell", "Total_Revenue").orderBy("Ranking")


def top_cities(sales: DataFrame, k: int = 10) -> DataFrame:
    """Q25: the k cities with most units (then revenue)."""
    return _city_top(sales, False, k)


def bottom_cities(sales: DataFrame, k: int = 10) -> DataFrame:
    """Q26: the k cities with fewest units (then revenue)."""
    return _city_top(sales, True, k)


def city_status_panel(sales: DataFrame) -> DataFrame:
    """Q27: per status, cities ranked by units with unit share, side by side (city of the cancelled list)."""
    p = status_panel(sales, "city", {"Shipping": F.sum("quantity")}, rank_measure="Shipping",
                     ratio_measure="Shipping", ratio_digits=0)
    cols = [F.col(f"{PANEL_STATUSES[0]}.city").alias("City")]
    for s in PANEL_STATUSES:
        cols += [F.col(f"{s}.Shipping").alias(f"{s}_Shipping"), F.col(f"{s}.Ratio").alias(f"{s}_Ratio")]
    return p.orderBy("rn").select(*cols)
