"""The denormalised ``sales_analysis`` view (fact LEFT JOIN catalogue + derived columns).

The frame is a lazy plan. ``plans/store.py`` writes it once per input as
Parquet and the registered analyses read that copy, pruned to the handful of
columns each one uses; used directly (or through ``register_view`` and
``spark.sql``), Catalyst inlines it into the query, prunes it and pushes
status / date filters below the join into the scans. The join is left to
Spark, which broadcasts the catalogue if its bytes allow it.

``products=None`` builds the view without catalogue fields. A LEFT JOIN on a
unique catalogue key never adds or removes fact rows, so queries that read no
catalogue field (and no net_profit) skip the join altogether; Catalyst does
not remove an outer join by itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import weekday_name
from ..functions.text import sentence_case
from ..schema import VIEW_PRODUCT_FIELDS
from ..sources.prepare import prepare_products, prepare_transactions
from ..sources.testdata import raw_products, table, transaction_rows, transactions_of

#: In front of the catalogue's names in rows that are joined to it already.
_PRODUCT = "_product_"


def sales_analysis(tx: DataFrame, products: DataFrame | None = None,
                   extra_product_fields: tuple[str, ...] = ()) -> DataFrame:
    """Prepared transactions (+ prepared catalogue) -> the 37-column sales view."""
    ft = tx.alias("ft")
    if products is None:
        return _view(ft)
    joined = ft.join(products.alias("pc"), F.col("ft.product_code") == F.col("pc.product_code"), "left")
    return _view(joined, "pc.", extra_product_fields)


def _view(ft: DataFrame, pc: str | None = None, extra_product_fields: tuple[str, ...] = ()) -> DataFrame:
    """The view's columns from transactions named ``ft``, with the catalogue's fields (named with ``pc`` in front)."""
    fact = [
        F.col("ft.transaction_id"),
        F.col("ft.temp_date").alias("transaction_date"),
        weekday_name(F.col("ft.temp_date")).alias("day_of_week"),
        F.col("ft.order_time"),
        F.col("ft.platform"),
        F.col("ft.order_source"),
        F.col("ft.customer_id"),
        F.col("ft.customer_gender"),
        F.col("ft.customer_age"),
        F.col("ft.city_uppercase"),
        sentence_case(F.col("ft.city_uppercase")).alias("city"),
        sentence_case(F.col("ft.province_true")).alias("province"),
        F.col("ft.membership_tier"),
        F.col("ft.quantity"),
        F.col("ft.gross_sales"),
        F.col("ft.discount_amount"),
        F.col("ft.net_sales"),
        F.col("ft.shipping_cost"),
        F.col("ft.platform_fee"),
    ]
    tail = [F.col(f"ft.{c}") for c in ("campaign_name", "warehouse_origin", "delivery_status", "customer_rating",
                                       "returned_flag", "return_reason")]
    if pc is None:
        return ft.select(*fact, *tail)
    profit = (F.col("ft.gross_sales") - F.col("ft.discount_amount") - F.col(f"{pc}production_cost")
              - F.col("ft.shipping_cost") - F.col("ft.platform_fee")).alias("net_profit")
    catalogue = [F.col(f"{pc}{c}").alias(c) for c in VIEW_PRODUCT_FIELDS + list(extra_product_fields)]
    return ft.select(*fact, profit, *tail, *catalogue)


def testdata_sales(spark: SparkSession, sf_dir: str, with_products: bool = True, extra_product_fields: tuple[str, ...] = (),
                   read: Callable[[SparkSession, str, str], DataFrame] = table,
                   arranged: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """The sales view over the driver's test tables (adapter -> preparation -> view); ``read`` gives each table.

    All tables are joined before anything is derived, so shuffles and ``arranged`` (a sort of the joined rows, by
    ``delivery_status`` or ``transaction_date``) move the tables' own columns. Lines meet their products first and their
    orders last: the lines of an order then lie together. Bucketed lines stay with their orders, products come behind.
    """
    if not with_products:
        return _view(prepare_transactions(transactions_of(arranged(transaction_rows(spark, sf_dir, read)))).alias("ft"))
    fields = [*VIEW_PRODUCT_FIELDS, *extra_product_fields]
    products = prepare_products(raw_products(spark, sf_dir)).select(*[F.col(c).alias(f"{_PRODUCT}{c}") for c in fields])

    def with_catalogue(rows: DataFrame) -> DataFrame:
        return rows.join(products, F.col("l_partkey") == F.col(f"{_PRODUCT}product_code"), "left")

    if read is table:
        rows = transaction_rows(spark, sf_dir, read, with_catalogue)
    else:
        rows = with_catalogue(transaction_rows(spark, sf_dir, read))
    tx = prepare_transactions(transactions_of(arranged(rows), *products.columns))
    return _view(tx.alias("ft"), f"ft.{_PRODUCT}", extra_product_fields)


def register_view(df: DataFrame, name: str = "sales_analysis") -> DataFrame:
    """Expose the view to ``spark.sql`` (CREATE OR REPLACE VIEW equivalent), together with the
    SQL functions that carry the reference's semantics (``functions/sql.py``)."""
    from ..functions.sql import register_sql_functions
    df.createOrReplaceTempView(name)
    register_sql_functions(df.sparkSession)
    return df
