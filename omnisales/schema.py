"""Explicit schemas of the two sources and of the sales view (no inference)."""

from __future__ import annotations

from pyspark.sql.types import DecimalType, StringType, StructField, StructType

MONEY = DecimalType(18, 2)
RATING = DecimalType(3, 1)

# Raw transaction file: every column arrives as text, types are hardened in
# sources.prepare so that a bad value becomes a rejected row, not a crash.
TRANSACTION_COLUMNS = [
    "transaction_id", "transaction_date", "order_time", "platform", "order_source", "customer_id",
    "customer_gender", "customer_age", "city_uppercase", "province_true", "membership_tier", "quantity",
    "gross_sales", "discount_amount", "net_sales", "shipping_cost", "platform_fee", "campaign_name",
    "warehouse_origin", "delivery_status", "customer_rating", "returned_flag", "return_reason", "product_code",
]
RAW_TRANSACTIONS = StructType([StructField(c, StringType(), True) for c in TRANSACTION_COLUMNS])

TRANSACTION_MONEY = ["gross_sales", "discount_amount", "net_sales", "shipping_cost", "platform_fee"]
TRANSACTION_INTS = ["customer_age", "quantity", "customer_rating"]

PRODUCT_COLUMNS = [
    "product_code", "product_name", "category", "sub_category", "shade", "finish_type", "skin_type_target",
    "size_ml", "launch_year", "product_status", "production_cost", "selling_price", "brand", "local_or_import",
    "halal_certified", "vegan_product", "bpom_registered", "supplier_name", "warehouse_location", "stock_qty",
    "reorder_point", "rating_average", "review_count",
]
RAW_PRODUCTS = StructType([StructField(c, StringType(), True) for c in PRODUCT_COLUMNS])
PRODUCT_MONEY = ["production_cost", "selling_price"]
PRODUCT_INTS = ["size_ml", "launch_year", "stock_qty", "reorder_point", "review_count"]

# Product fields carried into the sales view, in view order.
VIEW_PRODUCT_FIELDS = ["product_name", "product_code", "category", "shade", "skin_type_target", "size_ml",
                       "production_cost", "selling_price", "stock_qty", "rating_average", "review_count"]

# Fact fields of the sales view, in view order (net_profit needs the product).
VIEW_FACT_FIELDS = ["transaction_id", "transaction_date", "day_of_week", "order_time", "platform", "order_source",
                    "customer_id", "customer_gender", "customer_age", "city_uppercase", "city", "province",
                    "membership_tier", "quantity", "gross_sales", "discount_amount", "net_sales", "shipping_cost",
                    "platform_fee", "campaign_name", "warehouse_origin", "delivery_status", "customer_rating",
                    "returned_flag", "return_reason"]

