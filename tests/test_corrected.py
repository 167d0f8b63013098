"""Faithful analyses against their corrected variants on fixtures where they must differ."""

import datetime

from omnisales.plans import corrected, customer, geography, operations, product
from omnisales.plans.catalog import registry
from omnisales.plans.store import stored_sales

from .conftest import sales_of

DAY = datetime.date(2026, 12, 31)
SF = "/root/testdata/sf0.001"


def test_rfm_faithful_tile_one_is_best_corrected_five_is_best(spark):
    rows = []
    for i in range(10):  # customer i buys i + 1 times, the later ones more recently
        for j in range(i + 1):
            rows.append({"transaction_id": f"{i}-{j}", "customer_id": f"C{i:02d}",
                         "transaction_date": f"{1 + i:02d}/0{1 + j % 9}/2026"})
    s = sales_of(spark, rows)
    faithful = {r.customer_id: r.kode_rfm for r in customer.rfm_segmentation(s, DAY).collect()}
    fixed = {r.customer_id: r.kode_rfm for r in corrected.rfm_segmentation_best_high(s, DAY).collect()}
    assert faithful["C09"][1] == "1" and fixed["C09"][1] == "5"  # most frequent buyer


def test_panel_misaligns_entities_pivot_does_not(spark):
    rows = [{"transaction_id": "1", "warehouse_origin": "A", "delivery_status": "Cancelled", "quantity": "9"},
            {"transaction_id": "2", "warehouse_origin": "B", "delivery_status": "Cancelled", "quantity": "1"},
            {"transaction_id": "3", "warehouse_origin": "B", "delivery_status": "Returned", "quantity": "7"},
            {"transaction_id": "4", "warehouse_origin": "A", "delivery_status": "Returned", "quantity": "2"},
            {"transaction_id": "5", "warehouse_origin": "A", "delivery_status": "Delivered", "quantity": "5"},
            {"transaction_id": "6", "warehouse_origin": "B", "delivery_status": "Delivered", "quantity": "3"}]
    s = sales_of(spark, rows)
    panel = {r.Warehouse_Origin: r for r in operations.warehouse_status_panel(s).collect()}
    pivot = {r.Warehouse_Origin: r for r in corrected.warehouse_status_pivot(s).collect()}
    assert panel["A"].Returned_Shipping == 7  # B's returned units shown on A's row (rank alignment)
    assert pivot["A"].Returned_Shipping == 2 and pivot["B"].Returned_Shipping == 7


def test_restock_counts_stock_once_per_product(spark):
    rows = [{"transaction_id": str(i), "quantity": "1"} for i in range(3)]
    s = sales_of(spark, rows)
    faithful = product.restock_priority(s).collect()[0]
    assert faithful.Stock_Qty_Awal == 300  # 100 per transaction row
    from omnisales.plans.sales_view import sales_analysis
    from omnisales.sources.prepare import prepare_products, prepare_transactions
    from .conftest import raw_products, raw_tx
    s2 = sales_analysis(prepare_transactions(raw_tx(spark, rows)), prepare_products(raw_products(spark, [{}])),
                        extra_product_fields=("reorder_point",))
    fixed = corrected.restock_by_reorder_point(s2).collect()[0]
    assert fixed.Stock_Qty == 100 and fixed.Remaining_Stock == 97 and fixed.Needs_Restock == "No"


def test_cohort_first_purchase_differs_from_every_month_cohort(spark):
    rows = [{"transaction_id": "1", "customer_id": "A", "transaction_date": "10/01/2026"},
            {"transaction_id": "2", "customer_id": "A", "transaction_date": "10/02/2026"}]
    s = sales_of(spark, rows)
    faithful = {r.Bulan_Akuisis: r.total_user_baru for r in customer.cohort_counts(s).collect()}
    fixed = {r.Cohort_Month: r for r in corrected.cohort_retention_first_purchase(s).collect()}
    assert faithful == {"January": 1, "February": 1}  # every active month is a cohort
    assert list(fixed) == ["2026-01"] and fixed["2026-01"].bulan_1 == "100%"


def test_calendar_moving_average_counts_missing_days(spark):
    rows = [{"transaction_id": "1", "transaction_date": "01/01/2026", "gross_sales": "100"},
            {"transaction_id": "2", "transaction_date": "03/01/2026", "gross_sales": "200"}]
    out = corrected.revenue_moving_average_calendar(sales_of(spark, rows)).collect()
    assert [str(r.Dates) for r in out] == ["2026-01-01", "2026-01-02", "2026-01-03"]
    assert str(out[2].Ma_7_Days) == "100.000000"  # (100 + 0 + 200) / 3


def test_unit_scaled_profit_is_lower_for_multi_unit_rows(spark):
    s = sales_of(spark, [{"transaction_id": "1", "quantity": "3"}])
    faithful = registry()["q01_platform_profitability"].plan(s).collect()[0].Total_Profit
    fixed = corrected.unit_scaled_profit(s).collect()[0].Total_Profit
    assert faithful - fixed == 40000  # two more units of production cost 20000


def test_top_and_bottom_cities_are_ranked_1_to_k(spark):
    s = stored_sales(spark, SF)
    for fn in (geography.top_cities, geography.bottom_cities):
        assert [r.Ranking for r in fn(s, 3).collect()] == [1, 2, 3]


def test_optional_arguments_segments_and_status(spark):
    from pyspark.sql import functions as F
    s = stored_sales(spark, SF)
    full = customer.rfm_segmentation(s, DAY)
    champions = customer.rfm_segmentation(s, DAY, segments=["Champions"])
    assert {r.segmen_pelanggan for r in champions.collect()} <= {"Champions"}
    assert champions.count() == full.filter(F.col("segmen_pelanggan") == "Champions").count()
    returned = product.product_status_ranking(s, "Returned").collect()
    assert {r.Delivery_Status for r in returned} == {"Returned"}
    want = s.filter(F.col("delivery_status") == "Returned").agg(F.sum("quantity")).collect()[0][0]
    assert sum(r.Total_Product for r in returned) == want
