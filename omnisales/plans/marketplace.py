"""Marketplace, campaign and discount analyses (Q01-Q05)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ..functions.exact import percent, quotient, rounded_mean
from ..functions.ordering import asc, desc
from ..functions.text import pct_text
from ..operators.ranking import ntile_maxima, rank_rows
from ..operators.rollup import RATED, totals

# Discount band names, largest band first, and the no-discount band.
DISCOUNT_BANDS = ["Diskon Sangat Besar", "Diskon Besar", "Diskon Sedang", "Diskon Kecil"]
NO_DISCOUNT = "Tanpa Diskon"


def platform_profitability(sales: DataFrame) -> DataFrame:
    """Q01: revenue, profit and margin % per platform, by profit."""
    g = totals(sales, "platform").select("platform", F.col("gross_sales").alias("Total_Revenue"),
                                         F.col("net_profit").alias("Total_Profit"))
    margin = F.round(quotient(F.col("Total_Profit"), F.col("Total_Revenue"), 2, 2) * F.lit(100), 2)
    return (g.select(F.col("platform").alias("Platform"), "Total_Revenue", "Total_Profit",
                     margin.alias("Margin_Percentage"))
            .orderBy(desc("Total_Profit"), asc("Platform")))


def campaign_performance(sales: DataFrame) -> DataFrame:
    """Q02: campaigns ranked by units sold."""
    g = totals(sales, "campaign_name").select("campaign_name", F.col("quantity").alias("Total_Sell"),
                                              F.col("gross_sales").alias("Total_Revenue"))
    r = rank_rows(g, [desc("Total_Sell"), asc("campaign_name")])
    return r.select("Ranking", F.col("campaign_name").alias("Campaign_Name"), "Total_Sell", "Total_Revenue") \
            .orderBy("Ranking")


def discount_thresholds(sales: DataFrame, tiles: int = 3) -> list:
    """Maxima of the NTILE(tiles) buckets of positive discounts (Q1, Q2, Q3 of the reference)."""
    positive = sales.select("discount_amount").filter(F.col("discount_amount") > 0)
    return ntile_maxima(positive, "discount_amount", tiles)


def discount_band(limits: list) -> F.Column:
    """Band of a row's discount by how many of the ascending limits it exceeds; NULL or <= 0 is no discount.

    A limit that does not exist (fewer discounts than tiles) is exceeded by nothing.
    """
    d = F.col("discount_amount")
    band = F.when(F.coalesce(d <= 0, F.lit(True)), NO_DISCOUNT)
    for limit, name in zip(reversed(limits), DISCOUNT_BANDS):
        band = band.when(d > F.lit(limit).cast(DecimalType(18, 2)), name)
    return band.otherwise(DISCOUNT_BANDS[-1])


def band_repeat_rate(sales: DataFrame, limits: list, repeat_per_product: bool = True) -> DataFrame:
    """Customers, repeat customers and repeat rate per discount band.

    A customer counts in every band one of their rows falls in, and is a
    repeat customer of a band when one of those rows belongs to a (customer,
    product) pair - or, with ``repeat_per_product=False``, a customer - with
    more than one transaction. The row-level window COUNT(...) OVER
    (PARTITION BY ...) becomes partial aggregates: rows -> (customer[,
    product]) with a row count and band flags -> customer -> one global row.
    A heavy customer is reduced map-side before any shuffle, and no group
    ever holds raw rows.
    """
    bands = DISCOUNT_BANDS + [NO_DISCOUNT]
    rows = sales.select("customer_id", "product_name", "transaction_id", discount_band(limits).alias("band"))
    keys = ["customer_id", "product_name"] if repeat_per_product else ["customer_id"]
    per_key = rows.groupBy(*keys).agg(
        F.count("transaction_id").alias("n"),
        *[F.max((F.col("band") == b).cast("int")).alias(f"in{i}") for i, b in enumerate(bands)])
    repeat = F.col("n") > 1
    per_customer = per_key.groupBy("customer_id").agg(
        *[F.max(f"in{i}").alias(f"in{i}") for i in range(len(bands))],
        *[F.max(F.when(repeat, F.col(f"in{i}")).otherwise(0)).alias(f"rp{i}") for i in range(len(bands))])
    known = F.col("customer_id").isNotNull()
    totals = per_customer.agg(
        *[F.sum(F.when(known, F.col(f"in{i}")).otherwise(0)).cast("long").alias(f"c{i}") for i in range(len(bands))],
        *[F.sum(F.when(known, F.col(f"rp{i}")).otherwise(0)).cast("long").alias(f"r{i}") for i in range(len(bands))],
        *[F.max(f"in{i}").alias(f"e{i}") for i in range(len(bands))])
    per_band = totals.select(F.explode(F.array(*[
        F.struct(F.lit(b).alias("kategori_diskon"), F.col(f"c{i}").alias("total_pelanggan"),
                 F.col(f"r{i}").alias("jumlah_repeat_customer"), F.col(f"e{i}").alias("present"))
        for i, b in enumerate(bands)])).alias("b")).select("b.*")
    rate = pct_text(percent(F.col("jumlah_repeat_customer"), F.col("total_pelanggan"), 2))
    return (per_band.filter(F.col("present") == 1)
            .select("kategori_diskon", "total_pelanggan", "jumlah_repeat_customer", rate.alias("repeat_rate_persen"))
            .orderBy(desc("total_pelanggan"), asc("kategori_diskon")))


def discount_band_repeat_rate(sales: DataFrame, limits: list | None = None) -> DataFrame:
    """Q03: repeat rate per discount band, bands from the NTILE(3) maxima of positive discounts.

    Faithful: repeat is counted per customer AND product name; the top band
    (above the largest discount) is always empty.
    """
    limits = discount_thresholds(sales) if limits is None else limits
    return band_repeat_rate(sales, limits, repeat_per_product=True)


def platform_comparison(sales: DataFrame) -> DataFrame:
    """Q04: cost and revenue components per platform, ranked by revenue."""
    g = totals(sales, "platform").select(
        "platform", F.col("selling_price").alias("Total_HargaJual_Barang"),
        F.col("quantity").alias("Total_Terjual"),
        F.col("production_cost").alias("Total_Biaya_Produksi"),
        F.col("shipping_cost").alias("Total_Biaya_Pengiriman"),
        F.col("platform_fee").alias("Total_Platform_Fee"),
        F.col("discount_amount").alias("Total_discount_amount"),
        F.col("gross_sales").alias("Total_Revenue"),
        F.col("net_profit").alias("Total_Profit"),
        rounded_mean(F.col("customer_rating"), F.col(RATED), 2).alias("Avg_Rating_Customer"))
    r = rank_rows(g, [desc("Total_Revenue"), asc("platform")])
    cols = ["Ranking", F.col("platform").alias("Platform")] + [c for c in g.columns if c != "platform"]
    return r.select(*cols).orderBy("Ranking")


def platform_gender_sales(sales: DataFrame) -> DataFrame:
    """Q05: units, revenue, profit and rating per platform and gender, ranked by revenue."""
    g = totals(sales, "platform", "customer_gender").select(
        "platform", "customer_gender", F.col("quantity").alias("Total_Terjual"),
        F.col("gross_sales").alias("Total_Revenue"),
        F.col("net_profit").alias("Total_Profit"),
        rounded_mean(F.col("customer_rating"), F.col(RATED), 2).alias("Avg_Rating_Customer"))
    r = rank_rows(g, [desc("Total_Revenue"), asc("platform"), asc("customer_gender")])
    return r.select("Ranking", F.col("platform").alias("Platform"), F.col("customer_gender").alias("Customer_Gender"),
                    "Total_Terjual", "Total_Revenue", "Total_Profit", "Avg_Rating_Customer").orderBy("Ranking")
