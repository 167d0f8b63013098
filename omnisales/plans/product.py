"""Product analyses (Q06-Q11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exact import quotient, rounded_avg
from ..functions.ordering import asc, desc
from ..operators.aggregates import status_panel
from ..operators.ranking import rank_rows, top_k


def _product_measures() -> list:
    return [F.sum("quantity").alias("Total_Terjual"),
            F.sum("gross_sales").alias("Total_Revenue"),
            F.sum("net_profit").alias("Penjualan_Bersih"),
            rounded_avg("rating_average", 2, precision=3, scale=1).alias("Product_Rating"),
            F.sum("review_count").alias("Review_Count")]


def category_ranking(sales: DataFrame) -> DataFrame:
    """Q06: categories ranked by units (review_count and rating repeat per transaction row)."""
    g = sales.groupBy("category").agg(*_product_measures())
    r = rank_rows(g, [desc("Total_Terjual"), asc("category")])
    return r.select("Ranking", F.col("category").alias("Category"), "Total_Terjual", "Total_Revenue",
                    "Penjualan_Bersih", "Product_Rating", "Review_Count").orderBy("Ranking")


def product_margin_ranking(sales: DataFrame) -> DataFrame:
    """Q07: products ranked by profit / revenue (4 digits), with margin % (2 digits)."""
    g = sales.groupBy("product_name").agg(F.sum("quantity").alias("total_quantity"),
                                          F.sum("gross_sales").alias("total_revenue"),
                                          F.sum("net_profit").alias("total_profit"))
    ratio = quotient(F.col("total_profit"), F.col("total_revenue"), 2, 2)
    g = g.withColumn("_ratio4", F.round(ratio, 4)).withColumn("profit_margin_pct", F.round(ratio * F.lit(100), 2))
    r = rank_rows(g, [desc("_ratio4"), asc("product_name")], bounded=False)
    return r.select("Ranking", "product_name", "total_quantity", "total_revenue", "total_profit",
                    "profit_margin_pct").orderBy("Ranking")


def _product_top(sales: DataFrame, ascending: bool, k: int) -> DataFrame:
    g = sales.groupBy("product_name").agg(*_product_measures())
    first = asc("Total_Terjual") if ascending else desc("Total_Terjual")
    r = top_k(g, [first, asc("product_name")], k)
    return r.select("Ranking", "product_name", "Total_Terjual", "Total_Revenue", "Penjualan_Bersih",
                    "Product_Rating", "Review_Count").orderBy("Ranking")


def top_products(sales: DataFrame, k: int = 10) -> DataFrame:
    """Q08: the k best-selling products by units."""
    return _product_top(sales, False, k)


def bottom_products(sales: DataFrame, k: int = 10) -> DataFrame:
    """Q09: the k least-selling products by units (the unmatched-product group can appear)."""
    return _product_top(sales, True, k)


def product_status_panel(sales: DataFrame) -> DataFrame:
    """Q10: cancelled / returned / delivered product lists by units, side by side on rank."""
    p = status_panel(sales, "product_name", {"Qty": F.sum("quantity")}, rank_measure="Qty", bounded=False)
    return p.orderBy("rn").select(
        F.col("Cancelled.product_name").alias("Cancelled_Product"), F.col("Cancelled.Qty").alias("Cancelled_Qty"),
        F.col("Returned.product_name").alias("Returned_Product"), F.col("Returned.Qty").alias("Returned_Qty"),
        F.col("Delivered.product_name").alias("Delivered_Product"), F.col("Delivered.Qty").alias("Delivered_Qty"))


def product_status_ranking(sales: DataFrame, status: str = "Delivered") -> DataFrame:
    """Products of one delivery status ranked by units."""
    g = sales.filter(F.col("delivery_status") == status).groupBy("product_name") \
             .agg(F.sum("quantity").alias("Total_Product"))
    r = rank_rows(g, [desc("Total_Product"), asc("product_name")], bounded=False)
    return r.select("Ranking", F.col("product_name").alias("Product_Name"),
                    F.lit(status).alias("Delivery_Status"), "Total_Product").orderBy("Ranking")


def restock_priority(sales: DataFrame) -> DataFrame:
    """Q11: units sold against stock (stock summed once per transaction row, as the reference)."""
    g = sales.groupBy("product_name").agg(F.sum("quantity").alias("Total_Selling"),
                                          F.sum("stock_qty").alias("Stock_Qty_Awal"))
    return (g.select(F.col("product_name").alias("Product_Name"), "Total_Selling", "Stock_Qty_Awal",
                     (F.col("Stock_Qty_Awal") - F.col("Total_Selling")).alias("Stock_Qty_Akhir"))
            .orderBy(desc("Total_Selling"), asc("Product_Name")))
