"""Registry of the analyses: name -> plan over the test tables.

Each registered callable takes ``(spark, sf_dir)``, builds the sales view
from the given tables and returns the analysis with report types: whole
numbers as BIGINT, exact decimals as DOUBLE (converted once, after exact
arithmetic), dates as ISO text. The library functions themselves keep
DECIMAL and DATE.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ByteType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType,
                               ShortType)

from ..operators.rollup import rollup, with_rollup
from ..session import stored_copy
from ..sources.testdata import raw_transactions
from . import corrected, customer, findings, geography, marketplace, operations, preparation, product, timeseries
from .sales_view import testdata_sales
from .store import stored_sales

# Values bound for the test tables only: their last order is 2001-08-01, and their prices are on
# another scale than the findings' limit of Rp 300,000 (this is about the median customer spend).
TEST_PARAMETERS = {"as_of": _dt.date(2001, 8, 31), "min_spend": 36_000}
REVIEWS = ("Review_Count",)


def report(df: DataFrame, as_double: tuple[str, ...] = ()) -> DataFrame:
    """Engine-neutral output types: BIGINT, DOUBLE, text.

    ``as_double`` names whole-number columns that can hold NULL (catalogue
    values of the unmatched-product group); they are reported as DOUBLE so
    that NULL has one representation in every client (a nullable BIGINT comes
    back as float in some clients and as a nullable integer in others).
    """
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if f.name in as_double:
            c = c.cast(DoubleType())
        elif isinstance(t, (ByteType, ShortType, IntegerType)):
            c = c.cast(LongType())
        elif isinstance(t, (DecimalType, FloatType)):
            c = c.cast(DoubleType())
        elif isinstance(t, DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        cols.append(c.alias(f.name))
    return df.select(cols)


@dataclass(frozen=True)
class Analysis:
    name: str
    plan: Callable[..., DataFrame]
    needs_products: bool
    extra_product_fields: tuple[str, ...] = ()
    as_double: tuple[str, ...] = ()
    needs: tuple[str, ...] = ()  # parameters that have no default
    raw: bool = False  # runs on unprepared transactions, not on the sales view

    def result(self, sales: DataFrame, parameters: dict) -> DataFrame:
        """The analysis over a sales view, with report types."""
        missing = [n for n in self.needs if parameters.get(n) is None]
        if missing:
            raise ValueError(f"{self.name} needs {', '.join(missing)}")
        return report(self.plan(sales, **{n: parameters[n] for n in self.needs}), self.as_double)

    def run(self, spark: SparkSession, sf_dir: str, stored: bool = True) -> DataFrame:
        """The analysis over ``sf_dir``: from the materialised view (default) or from the raw tables."""
        if self.raw:
            sales = raw_transactions(spark, sf_dir)
        elif stored:
            sales = stored_sales(spark, sf_dir)
        else:
            sales = testdata_sales(spark, sf_dir, with_products=self.needs_products,
                                   extra_product_fields=self.extra_product_fields)
        return self.result(sales, TEST_PARAMETERS)


ANALYSES: list[Analysis] = [
    Analysis("s4_text_preparation", preparation.monthly_from_text, False, raw=True),
    Analysis("q01_platform_profitability", marketplace.platform_profitability, True),
    Analysis("q02_campaign_performance", marketplace.campaign_performance, False),
    Analysis("q03_discount_band_repeat_rate", marketplace.discount_band_repeat_rate, True),
    Analysis("q04_platform_comparison", marketplace.platform_comparison, True),
    Analysis("q05_platform_gender_sales", marketplace.platform_gender_sales, True),
    Analysis("q06_category_ranking", product.category_ranking, True, as_double=REVIEWS),
    Analysis("q07_product_margin_ranking", product.product_margin_ranking, True),
    Analysis("q08_top_products", product.top_products, True, as_double=REVIEWS),
    Analysis("q09_bottom_products", product.bottom_products, True, as_double=REVIEWS),
    Analysis("q10_product_status_panel", product.product_status_panel, True),
    Analysis("q10b_product_status_ranking", product.product_status_ranking, True),
    Analysis("q11_restock_priority", product.restock_priority, True,
             as_double=("Stock_Qty_Awal", "Stock_Qty_Akhir")),
    Analysis("q12_skin_type_orders", customer.skin_type_orders, True),
    Analysis("q13_size_orders", customer.size_orders, True, as_double=("Size_Ml",)),
    Analysis("q14_gender_share", customer.gender_share, False),
    Analysis("q15_tier_gender_share", customer.tier_gender_share, False),
    Analysis("q16_age_rating", customer.age_rating, False),
    Analysis("q17_cohort_retention", customer.cohort_retention, False),
    Analysis("q17b_cohort_counts", customer.cohort_counts, False),
    Analysis("q18_rfm_segmentation", customer.rfm_segmentation, True, needs=("as_of",)),
    Analysis("q19_returned_flag_share", operations.returned_flag_share, False),
    Analysis("q20_delivery_status_share", operations.delivery_status_share, False),
    Analysis("q21_warehouse_shipping", operations.warehouse_shipping, False),
    Analysis("q22_warehouse_status_panel", operations.warehouse_status_panel, False),
    Analysis("q23_return_reasons", operations.return_reasons, False),
    Analysis("q24_province_ranking", geography.province_ranking, True),
    Analysis("q25_top_cities", geography.top_cities, False),
    Analysis("q26_bottom_cities", geography.bottom_cities, False),
    Analysis("q27_city_status_panel", geography.city_status_panel, False),
    Analysis("q28_weekday_growth", timeseries.weekday_growth, False),
    Analysis("q29_month_growth", timeseries.month_growth, False),
    Analysis("q30_day_part_demand", timeseries.day_part_demand, False),
    Analysis("q31_revenue_moving_average", timeseries.revenue_moving_average, False),
    # metrics quoted in the findings
    Analysis("n1_platform_cost_ratios", findings.platform_cost_ratios, True),
    Analysis("n2_platform_revenue_share", findings.platform_revenue_share, False),
    Analysis("n3_failed_delivery_share", findings.failed_delivery_share, False),
    Analysis("n4_city_failure_rates", findings.city_failure_rates, False),
    Analysis("n5_at_risk_high_value", findings.at_risk_high_value, True, needs=("as_of", "min_spend")),
    Analysis("n6_moving_average_cross", findings.moving_average_cross, False),
    Analysis("n7_tier_share", findings.tier_share, False),
    # corrected variants (the faithful analyses above stay the default)
    Analysis("c1_cohort_retention_first_purchase", corrected.cohort_retention_first_purchase, False),
    Analysis("c2_rfm_segmentation_best_high", corrected.rfm_segmentation_best_high, True, needs=("as_of",)),
    Analysis("c3_warehouse_status_pivot", corrected.warehouse_status_pivot, False),
    Analysis("c3_city_status_pivot", corrected.city_status_pivot, False),
    Analysis("c4_restock_by_reorder_point", corrected.restock_by_reorder_point, True, ("reorder_point",),
             ("Stock_Qty", "Remaining_Stock", "Reorder_Point")),
    Analysis("c5_discount_band_quartiles", corrected.discount_band_quartiles, False),
    Analysis("c6_product_reviews_once", corrected.product_reviews_once, True, as_double=REVIEWS),
    Analysis("c7_unit_scaled_profit", corrected.unit_scaled_profit, True),
    Analysis("c8_revenue_moving_average_calendar", corrected.revenue_moving_average_calendar, False),
]


def registry() -> dict[str, Analysis]:
    return {a.name: a for a in ANALYSES}


def run_on(sales: DataFrame, names: list[str] | None = None, **parameters) -> dict[str, DataFrame]:
    """The analyses (all, or ``names``) over any sales view, e.g. one built from your own files.

    The view is written once (its files are parsed and joined once, not for every analysis).
    ``as_of`` (the day recency is counted to) and ``min_spend`` have to be given for the analyses
    that need them.
    """
    reg = registry()
    names = names or [n for n, a in reg.items() if not a.raw]
    for n in names:
        if reg[n].raw:
            raise ValueError(f"{n} runs on unprepared transactions")
        missing = [p for p in reg[n].needs if parameters.get(p) is None]
        if missing:
            raise ValueError(f"{n} needs {', '.join(missing)}")
    view = stored_copy(sales, "sales-view")
    view = with_rollup(view, stored_copy(rollup(view), "roll-up"))
    return {n: reg[n].result(view, parameters) for n in names}
