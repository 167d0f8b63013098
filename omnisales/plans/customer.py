"""Customer analyses (Q12-Q18): skin type, size, gender, tier, age, cohorts, RFM."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import MONTHS
from ..functions.exact import percent, rounded_mean
from ..functions.ordering import asc, desc, field_position
from ..functions.text import money_text, pct_text
from ..operators.activity import month_bitmaps
from ..operators.aggregates import share_text
from ..operators.ranking import rank_rows, tile_ends
from ..operators.rollup import RATED, ROWS, totals
from ..operators.selection import Axis, rows_at_ranks, tile_number
from ..session import stored_copy

# Month order of the cohort report (months after it sort first).
COHORT_ORDER = ["January", "February", "March", "April", "May"]
COHORT_MONTHS = 6  # month_0 .. month_5

# RFM segment names.
CHAMPIONS, LOYAL, AT_RISK, HIBERNATING, NEEDS_ATTENTION = (
    "Champions", "Loyal Customers", "At-Risk", "Hibernating", "Customers Needing Attention")
RFM_TILES = 5


def skin_type_orders(sales: DataFrame) -> DataFrame:
    """Q12: rows per skin type (the unmatched group counts 0)."""
    return (sales.groupBy("skin_type_target").agg(F.count("skin_type_target").alias("Total_Sales"))
            .orderBy(desc("Total_Sales"), asc("skin_type_target")))


def size_orders(sales: DataFrame) -> DataFrame:
    """Q13: rows per size, grouped by skin type and size (skin type not shown, sizes repeat)."""
    g = sales.groupBy("skin_type_target", "size_ml").agg(F.count("size_ml").alias("Total_Sold"))
    return g.orderBy(desc("Total_Sold"), asc("skin_type_target"), asc("size_ml")) \
            .select(F.col("size_ml").alias("Size_Ml"), "Total_Sold")


def gender_share(sales: DataFrame) -> DataFrame:
    """Q14: units, revenue, rating and unit share per gender."""
    g = totals(sales, "customer_gender").select(
        "customer_gender", F.col("quantity").alias("Total_Order"), F.col("gross_sales").alias("Total_Revenue"),
        rounded_mean(F.col("customer_rating"), F.col(RATED), 2).alias("Customer_Rating"))
    g = share_text(g, "Total_Order", 0)
    return g.select(F.col("customer_gender").alias("Customer_Gender"), "Total_Order", "Total_Revenue",
                    "Customer_Rating", "Ratio")


def tier_gender_share(sales: DataFrame) -> DataFrame:
    """Q15: membership tier x gender ranked by units, revenue as money text, unit share."""
    g = totals(sales, "membership_tier", "customer_gender").select(
        "membership_tier", "customer_gender", F.col("quantity").alias("Total_Product_Terjual"),
        F.col("gross_sales").alias("_revenue"),
        rounded_mean(F.col("customer_rating"), F.col(RATED), 2).alias("Customer_Rating"))
    g = share_text(g, "Total_Product_Terjual", 0)
    r = rank_rows(g, [desc("Total_Product_Terjual"), asc("membership_tier"), asc("customer_gender")])
    return r.select("Ranking", F.col("membership_tier").alias("Membership_Tier"),
                    F.col("customer_gender").alias("Customer_Gender"), "Total_Product_Terjual",
                    money_text(F.col("_revenue"), 2).alias("Total_Revenue"), "Customer_Rating", "Ratio") \
            .orderBy("Ranking")


def age_rating(sales: DataFrame) -> DataFrame:
    """Q16: rows and average rating per customer age."""
    g = totals(sales, "customer_age").select(
        "customer_age", F.when(F.col("customer_age").isNull(), F.lit(0)).otherwise(F.col(ROWS)).cast("long").alias("Distribution_Age"),
        rounded_mean(F.col("customer_rating"), F.col(RATED), 2).alias("Customer_Rating"))
    return g.select(F.col("customer_age").alias("Customer_Age"), "Distribution_Age", "Customer_Rating") \
            .orderBy(asc("Customer_Age"))


def _cohort_counts(sales: DataFrame, months: int) -> DataFrame:
    """Per cohort month name: users and, for k in 0..months-1, users active k months later.

    The reference's cohort CTE has no MIN: every active month of a customer is
    a cohort, and its self-join pairs all rows of a customer before counting
    distinct customers. Only distinct customers are counted, so each customer
    is reduced (map-side first) to a bitmap of its months; a month with
    activity k months later is a shift and an AND, folded to the twelve names.
    A customer then counts once in each of its names (no pairs, no self-join).
    A NULL date forms its own NULL cohort with no activity after.
    """
    d = "transaction_date"
    known = sales.select("customer_id", d).filter(F.col("customer_id").isNotNull())
    maps = month_bitmaps(known, "customer_id", d, F.max(F.col(d).isNull().cast("long")).alias("undated"))
    folded = maps.rows.select("undated", *[maps.calendar_months(k).alias(f"m{k}") for k in range(months)])
    # Of each customer its cohorts: the names of its months (0 to 11), and 12 for rows without a date.
    cohorts = folded.select("*", F.explode(F.expr(
        "filter(sequence(0, 12), j -> if(j = 12, undated = 1, shiftright(m0, j) & 1 = 1))")).alias("j"))
    counts = cohorts.groupBy("j").agg(F.count(F.lit(1)).alias("total_user_baru"), *[
        F.expr(f"sum(if(j = 12, 0L, shiftright(m{k}, j) & 1L))").alias(f"bulan_{k}") for k in range(months)])
    name = F.when(F.col("j") < 12, F.element_at(F.lit([*MONTHS, ""]), F.col("j") + 1))
    counts = counts.select(name.alias("Bulan_Akuisis"), "total_user_baru", *[f"bulan_{k}" for k in range(months)])
    order_no = field_position(F.col("Bulan_Akuisis"), COHORT_ORDER)
    month_no = field_position(F.col("Bulan_Akuisis"), MONTHS)
    return counts.orderBy(order_no, month_no, asc("Bulan_Akuisis"))


def cohort_retention(sales: DataFrame, months: int = COHORT_MONTHS) -> DataFrame:
    """Q17: per cohort month name, users and the share active 0..5 months later (0 digits)."""
    c = _cohort_counts(sales, months)
    pct = [pct_text(percent(F.col(f"bulan_{i}"), F.col("total_user_baru"), 0)).alias(f"bulan_{i}")
           for i in range(months)]
    return c.select("Bulan_Akuisis", "total_user_baru", *pct)


def cohort_counts(sales: DataFrame, months: int = COHORT_MONTHS) -> DataFrame:
    """The same cohorts with plain user counts."""
    return _cohort_counts(sales, months)


def rfm_raw(sales: DataFrame, as_of: _dt.date) -> DataFrame:
    """Recency (days since the last order), frequency (distinct orders), monetary (list price sum)."""
    return sales.groupBy("customer_id").agg(
        F.datediff(F.lit(as_of), F.max("transaction_date")).alias("recency"),
        F.count_distinct("transaction_id").alias("frequency"),
        F.sum("selling_price").alias("monetary"))


def rfm_segment(r: F.Column, f: F.Column, m: F.Column) -> F.Column:
    return (F.when((r >= 4) & (f >= 4) & (m >= 4), CHAMPIONS)
            .when((r >= 3) & (f >= 3) & (m >= 3), LOYAL)
            .when((r <= 2) & (f >= 3) & (m >= 3), AT_RISK)
            .when((r <= 2) & (f <= 2) & (m <= 2), HIBERNATING)
            .otherwise(NEEDS_ATTENTION))


def _rfm_axes(best_high: bool) -> list[tuple[str, str, bool]]:
    """Score, measure and whether the order is descending; ``best_high`` turns all orders round."""
    return [("r_score", "recency", best_high), ("f_score", "frequency", not best_high), ("m_score", "monetary", not best_high)]


def _axis(measure: str, kind: T.DataType, descending: bool) -> Axis:
    """NULLs go first ascending and last descending; the measure as a whole number (amounts in their smallest unit)."""
    unit = f" * {10 ** kind.scale}" if isinstance(kind, T.DecimalType) and kind.scale else ""
    nulls = f"{measure} is null" if descending else f"{measure} is not null"
    return Axis(f"cast({nulls} as int)", f"coalesce({'-' if descending else ''}cast({measure}{unit} as long), 0L)")


def rfm_scores(sales: DataFrame, as_of: _dt.date, best_high: bool = False) -> DataFrame:
    """Customer table with the three NTILE(5) scores.

    Faithful orders: recency ASC, frequency DESC, monetary DESC (tile 1 is the
    best customer), ties by customer. ``best_high`` reverses them so that 5 is
    the best. The customer table is written once and never sorted: the
    customers that end the tiles of all axes are found by counting
    (``rows_at_ranks``); a score is then 1 + the number of tile ends the
    customer comes after, a plain expression per row. Amounts are exact below
    9.2e18 of their smallest unit.
    """
    raw = stored_copy(rfm_raw(sales, as_of), "rfm")
    measures = _rfm_axes(best_high)
    axes = [_axis(measure, raw.schema[measure].dataType, descending) for _, measure, descending in measures]

    def inner_ends(total: int) -> list[int]:
        return [e for e in tile_ends(total, RFM_TILES)[:-1] if 0 < e < total]

    total, cuts = rows_at_ranks(raw, axes, "customer_id", lambda n: sorted(set(inner_ends(n))))
    ends = inner_ends(total)
    scores = [tile_number(axis, "customer_id", [(at[e], ends.count(e)) for e in sorted(at)]).alias(score)
              for (score, _, _), axis, at in zip(measures, axes, cuts)]
    return raw.select("*", *scores)


def rfm_segmentation(sales: DataFrame, as_of: _dt.date, segments: list[str] | None = None,
                     best_high: bool = False) -> DataFrame:
    """Q18: RFM code and segment per customer, by spend (optionally only some segments).

    ``as_of`` is the day recency is counted to (the reference's current date).
    """
    s = rfm_scores(sales, as_of, best_high)
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    out = s.select("customer_id",
                   F.col("recency").alias("hari_sejak_belanja_terakhir"),
                   F.col("frequency").alias("total_transaksi"),
                   F.col("monetary").alias("total_belanja"),
                   F.concat(r.cast("string"), f.cast("string"), m.cast("string")).alias("kode_rfm"),
                   rfm_segment(r, f, m).alias("segmen_pelanggan"))
    if segments:
        out = out.filter(F.col("segmen_pelanggan").isin(*segments))
    return out.orderBy(desc("total_belanja"), asc("customer_id"))
