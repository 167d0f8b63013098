"""Every analysis against the naive SQL on a hand-made view full of NULLs, ties and odd values.

The driver's tables have no NULL customers or dates, no negative discounts and
few ties; this fixture has all of them. The Spark plans run on the fixture
frame, DuckDB runs the oracle statements on the same rows written to Parquet.
"""

import os
import random

import duckdb
import pytest

from omnisales.oracle import oracle_queries
from omnisales.plans.catalog import TEST_PARAMETERS, registry
from omnisales.plans.sales_view import sales_analysis
from omnisales.sources.prepare import prepare_products, prepare_transactions

from .conftest import raw_products, raw_tx
from tools.compare import canon, families


def fixture_rows(seed=21, n=400):
    rnd = random.Random(seed)
    pick = rnd.choice
    rows = []
    for i in range(n):
        day = pick(["01", "15", "28", "31"])
        month = pick(["01", "02", "03", "05", "06", "12"])
        rows.append({
            "transaction_id": str(rnd.randint(1, n // 2)),  # repeated ids: several lines per order
            "transaction_date": pick([f"{day}/{month}/2025", f"{day}/{month}/2026", "31/02/2026", "", "5/3/2026"]),
            "order_time": pick(["03:59:59", "04:00:00", "09:59:59", "10:00:00", "15:00:00", "18:00:00", "18:00:01",
                                "23:10:00", None, "bad"]),
            "platform": pick(["Shopee", "TikTok Shop", "Website", None]),
            "customer_id": pick([f"C{rnd.randint(1, 25):02d}", None]),
            "customer_gender": pick(["Female", "Male", None]),
            "customer_age": str(rnd.randint(17, 20)),
            "city_uppercase": pick(["JAKARTA SELATAN", "MEDAN", "DENPASAR", None]),
            "province_true": pick(["DKI JAKARTA", "BALI", None]),
            "membership_tier": pick(["Bronze", "Silver", "Gold"]),
            "quantity": str(rnd.randint(1, 4)),
            "gross_sales": pick(["100000", "250000.50", "0", "99999.99"]),
            "discount_amount": pick(["0", "-5", None, "10000", "10000", "25000.25", "5000", "1.005"]),
            "shipping_cost": pick(["5000", "0", "12345.67"]),
            "platform_fee": pick(["2000", "0.01"]),
            "campaign_name": pick(["Flash Sale", "No Campaign", None]),
            "warehouse_origin": pick(["Medan", "Surabaya", "Jakarta", None]),
            "delivery_status": pick(["Delivered", "Delivered", "Returned", "Cancelled", None]),
            "customer_rating": pick(["1", "3", "5", None]),
            "returned_flag": pick(["Yes", "No", None]),
            "return_reason": pick(["No", "Late", "Damaged", None]),
            "product_code": pick(["P1", "P2", "P3", "P4", "ZZ", None]),
        })
    return rows


PRODUCTS = [{"product_code": "P1", "product_name": "Lip One", "category": "Lipstick", "size_ml": "5"},
            {"product_code": "P2", "product_name": "Lip Two", "category": "Lipstick", "size_ml": "5",
             "rating_average": "5.0", "review_count": "9589"},
            {"product_code": "P3", "product_name": "Glow", "category": "Cushion", "size_ml": None,
             "selling_price": "148402.00", "production_cost": "103810.00", "stock_qty": "867"},
            {"product_code": "P4", "product_name": None, "category": None, "skin_type_target": None}]


@pytest.fixture(scope="module")
def fixture_view(spark, scratch_dir):
    sales = sales_analysis(prepare_transactions(raw_tx(spark, fixture_rows())),
                           prepare_products(raw_products(spark, PRODUCTS)), extra_product_fields=("reorder_point",))
    path = os.path.join(scratch_dir, "adversarial_view")
    sales.write.mode("overwrite").parquet(path)
    stored = spark.read.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW fixture AS SELECT * FROM read_parquet('{path}/*.parquet')")
    return stored, con


@pytest.mark.parametrize("name", sorted(registry()))
def test_analysis_matches_naive_sql_on_adversarial_rows(fixture_view, name):
    stored, con = fixture_view
    analysis = registry()[name]
    df = analysis.result(stored, TEST_PARAMETERS)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(oracle_queries("sales_analysis AS (SELECT * FROM fixture)")[name])
    cols = [d[0] for d in res.description]
    want = res.fetchall()
    assert canon(df.columns, rows) == canon(cols, want)
    assert families(df.columns, rows) == families(cols, want)
