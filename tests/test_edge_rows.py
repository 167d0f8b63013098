
from pyspark.sql import functions as F

from omnisales.plans import marketplace, operations, timeseries
from omnisales.plans.catalog import registry

from .conftest import sales_of

SF = "/root/testdata/sf0.001"


def test_zero_gross_sales_gives_null_margin(spark):
    s = sales_of(spark, [{"transaction_id": "1", "platform": "X", "gross_sales": "0", "discount_amount": "0",
                          "shipping_cost": "0", "platform_fee": "0"}])
    row = marketplace.platform_profitability(s).collect()[0]
    assert row.Total_Revenue == 0 and row.Margin_Percentage is None


def test_discount_bands_at_limits_and_non_positive(spark):
    vals = ["10", "20", "30", "40", "50", "60"]  # terciles: maxima 20, 40, 60
    rows = [{"transaction_id": f"t{v}", "customer_id": f"c{v}", "discount_amount": v} for v in vals]
    rows += [{"transaction_id": "tn", "customer_id": "cn", "discount_amount": None},
             {"transaction_id": "t0", "customer_id": "c0", "discount_amount": "0"},
             {"transaction_id": "tm", "customer_id": "cm", "discount_amount": "-5"}]
    s = sales_of(spark, rows)
    limits = marketplace.discount_thresholds(s)
    assert [str(v) for v in limits] == ["20.00", "40.00", "60.00"]
    band = {r.transaction_id: r.b for r in s.select("transaction_id", marketplace.discount_band(limits).alias("b")).collect()}
    assert band["t20"] == "Diskon Kecil" and band["t40"] == "Diskon Sedang" and band["t60"] == "Diskon Besar"
    assert band["tn"] == band["t0"] == band["tm"] == "Tanpa Diskon"
    out = {r.kategori_diskon: r.total_pelanggan for r in marketplace.discount_band_repeat_rate(s).collect()}
    assert "Diskon Sangat Besar" not in out  # > max never holds (the reference's trap)
    assert out == {"Diskon Kecil": 2, "Diskon Sedang": 2, "Diskon Besar": 2, "Tanpa Diskon": 3}


def test_no_positive_discount_puts_everyone_in_no_discount(spark):
    s = sales_of(spark, [{"transaction_id": "1", "customer_id": "a", "discount_amount": "0"},
                         {"transaction_id": "2", "customer_id": "a", "discount_amount": "0"}])
    assert marketplace.discount_thresholds(s) == [None, None, None]
    out = marketplace.discount_band_repeat_rate(s).collect()
    assert [(r.kategori_diskon, r.total_pelanggan, r.jumlah_repeat_customer, r.repeat_rate_persen) for r in out] == \
        [("Tanpa Diskon", 1, 1, "100.00%")]


def test_warehouse_order_uses_text_of_the_cost(spark):
    rows = [{"transaction_id": "1", "warehouse_origin": "A", "quantity": "5", "shipping_cost": "9"},
            {"transaction_id": "2", "warehouse_origin": "B", "quantity": "5", "shipping_cost": "10"}]
    s = sales_of(spark, rows)
    out = [r.Warehouse_Origin for r in operations.warehouse_shipping(s).collect()]
    assert out == ["A", "B"]  # 'Rp 9' > 'Rp 10' as text, so A comes first in DESC order
    assert [r.Warehouse_Origin for r in operations.warehouse_shipping(s, numeric_order=True).collect()] == ["B", "A"]


def test_units_over_groups_sum_to_the_total(spark):
    from omnisales.plans.store import stored_sales
    s = stored_sales(spark, SF)
    units = s.agg(F.sum("quantity")).collect()[0][0]
    for name, col in [("q02_campaign_performance", "Total_Sell"), ("q14_gender_share", "Total_Order"),
                      ("q24_province_ranking", "Total_Sell"), ("q30_day_part_demand", "Total_Qty_OrderCustomer")]:
        assert sum(r[col] for r in registry()[name].run(spark, SF).collect()) == units


def test_moving_average_of_a_constant_series_is_constant(spark):
    rows = [{"transaction_id": str(d), "transaction_date": f"{d:02d}/01/2026", "gross_sales": "100"} for d in range(1, 20)]
    for r in timeseries.revenue_moving_average(sales_of(spark, rows)).collect():
        assert str(r.Ma_7_Days) == "100.000000" and str(r.Ma_30_Days) == "100.000000"
