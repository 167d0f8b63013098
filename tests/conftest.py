from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from omnisales.schema import RAW_PRODUCTS, RAW_TRANSACTIONS  # noqa: E402
from omnisales.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    scratch = tempfile.mkdtemp(prefix="omnisales-tests-")
    s = local_session(4, shuffle_partitions=4, driver_memory="4g",
                      extra={"spark.checkpoint.dir": os.path.join(scratch, "ckpt")})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def scratch_dir():
    return tempfile.mkdtemp(prefix="omnisales-data-")


BASE_TX = {
    "transaction_id": "T1", "transaction_date": "05/03/2026", "order_time": "12:00:00", "platform": "Shopee",
    "order_source": "App", "customer_id": "C1", "customer_gender": "Female", "customer_age": "25",
    "city_uppercase": "JAKARTA SELATAN", "province_true": "DKI JAKARTA", "membership_tier": "Bronze",
    "quantity": "1", "gross_sales": "100000", "discount_amount": "0", "net_sales": "100000",
    "shipping_cost": "5000", "platform_fee": "2000", "campaign_name": "No Campaign",
    "warehouse_origin": "Jakarta", "delivery_status": "Delivered", "customer_rating": "4",
    "returned_flag": "No", "return_reason": "No", "product_code": "P1",
}

BASE_PRODUCT = {c: None for c in RAW_PRODUCTS.fieldNames()}
BASE_PRODUCT.update({"product_code": "P1", "product_name": "Lip One", "category": "Lipstick", "shade": "Red",
                     "skin_type_target": "Oily", "size_ml": "5", "production_cost": "20000",
                     "selling_price": "90000", "stock_qty": "100", "reorder_point": "10",
                     "rating_average": "4.5", "review_count": "100"})


def raw_tx(spark, rows):
    """Raw (all text) transactions from dicts overriding BASE_TX."""
    data = [tuple({**BASE_TX, **r}.get(c) for c in RAW_TRANSACTIONS.fieldNames()) for r in rows]
    return spark.createDataFrame(data, RAW_TRANSACTIONS)


def raw_products(spark, rows):
    data = [tuple({**BASE_PRODUCT, **r}.get(c) for c in RAW_PRODUCTS.fieldNames()) for r in rows]
    return spark.createDataFrame(data, RAW_PRODUCTS)


def sales_of(spark, tx_rows, product_rows=({},)):
    from omnisales.plans.sales_view import sales_analysis
    from omnisales.sources.prepare import prepare_products, prepare_transactions
    return sales_analysis(prepare_transactions(raw_tx(spark, tx_rows)),
                          prepare_products(raw_products(spark, list(product_rows))))
