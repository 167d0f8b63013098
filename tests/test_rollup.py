"""The stored roll-up gives what grouping the view gives, and analyses read it instead of the view."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from omnisales.operators import rollup as R
from omnisales.plans.catalog import registry
from omnisales.plans.store import materialize_sales, stored_sales
from omnisales.session import stored_copy

SF = "/root/testdata/sf0.001"
SMALL = ["q01_platform_profitability", "q02_campaign_performance", "q04_platform_comparison", "q05_platform_gender_sales",
         "q14_gender_share", "q15_tier_gender_share", "q16_age_rating", "q20_delivery_status_share", "q28_weekday_growth",
         "q29_month_growth", "q31_revenue_moving_average", "n1_platform_cost_ratios", "n2_platform_revenue_share",
         "n3_failed_delivery_share", "n6_moving_average_cross", "n7_tier_share", "c7_unit_scaled_profit",
         "c8_revenue_moving_average_calendar"]


def view(spark):
    """The test view with nulls in keys and measures."""
    sales = spark.read.parquet(materialize_sales(spark, SF))
    n = F.xxhash64("transaction_id", "product_code")
    for c in ("platform", "customer_gender", "customer_age", "transaction_date", "delivery_status", "net_profit", "customer_rating"):
        sales = sales.withColumn(c, F.when(F.pmod(F.xxhash64(n, F.lit(c)), F.lit(7)) > 0, F.col(c)))
    all_null = F.col("membership_tier") == "Gold"  # a group without any value
    return stored_copy(sales.withColumn("quantity", F.when(~all_null, F.col("quantity"))), "nulls")


@pytest.mark.parametrize("keys", [("platform",), ("platform", "customer_gender"), ("customer_gender",), ("campaign_name",),
                                  ("customer_age",), ("membership_tier",), ("transaction_date",), ("delivery_status",),
                                  ("delivery_status", "warehouse_origin"), ("city",), ("platform", "campaign_name")])
def test_totals_equal_grouping_the_view(spark, keys):
    sales = view(spark)
    direct = R.totals(sales, *keys)
    rolled = R.totals(R.with_rollup(sales.select("*"), stored_copy(R.rollup(sales), "rolled")), *keys)
    assert direct.columns == rolled.columns and direct.dtypes == rolled.dtypes
    assert sorted(map(str, direct.collect())) == sorted(map(str, rolled.collect()))


@pytest.mark.parametrize("name", SMALL)
def test_analyses_read_the_rollup(spark, name):
    stored, plain = stored_sales(spark, SF), spark.read.parquet(materialize_sales(spark, SF))
    plan = registry()[name].plan
    with_it, without = plan(stored), plan(plain)
    shown = with_it._jdf.queryExecution().executedPlan().toString()
    assert "_set" in shown and "_set" not in without._jdf.queryExecution().executedPlan().toString()
    assert with_it.columns == without.columns
    assert sorted(map(str, with_it.collect())) == sorted(map(str, without.collect()))


def test_the_rollup_is_one_scan_and_small(spark):
    sales = stored_sales(spark, SF)
    plan = R.rollup(sales)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Expand" in plan
    stored = getattr(sales, R._ROLLUP)
    days = sales.select("transaction_date").distinct().count()
    assert days < stored.count() < days + 500


def test_a_copy_without_a_rollup_is_grouped(spark):
    sales = spark.read.parquet(materialize_sales(spark, SF))
    assert "_set" not in sales.columns and sales.count() == stored_sales(spark, SF).count()
    assert registry()["q01_platform_profitability"].plan(sales).count() == 5
