"""Adapter: the driver's TPC-H-like tables -> raw transactions + product catalogue.

The reference does not ship its transactions, so its 25-column fact table is
derived from lineitem / orders / customer / nation / region and its catalogue
from part. The mapping rules below are fixed values shared with the DuckDB
oracle; changing one changes every expected result.

Scale notes:
* Only the columns a rule needs are read (Catalyst prunes further per query).
* Join order keeps the big-big join last: customer is first enriched with the
  25-row nation / 5-row region tables, then joined to orders on the customer
  key, and only then to lineitem on the order key. No side is hinted: Spark
  and AQE choose on bytes, and AQE splits skewed order keys.
* ``transaction_rows`` joins the tables' own columns; ``transactions_of``
  derives the transactions from a joined row. What is shuffled and sorted is
  so the narrow row: the derived one has about twice its bytes.
* Joins are left joins: a line without its order, customer or nation stays,
  with NULLs.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType, IntegerType

from ..functions.dates import hms
from ..schema import MONEY

# Fixed values of the adapter (shared with the oracle SQL).
STATUS_BY_RETURNFLAG = {"A": "Cancelled", "R": "Returned", "N": "Delivered"}
RETURN_REASON_BY_SUPPKEY_MOD4 = {0: "No", 1: "Damaged", 2: "Wrong item", 3: "Late"}  # 'No' is remapped to 'Unknow'
FEE_RATE_BY_PRIORITY_DIGIT = {"1": Decimal("0.13"), "2": Decimal("0.12"), "3": Decimal("0.05")}
FEE_RATE_OTHER = Decimal("0.02")
PRODUCTION_COST_RATE = Decimal("0.40")
NO_CAMPAIGN_LINE = 7
ORDER_TIME_MULTIPLIERS = (7919, 104729)

TABLES = ("region", "nation", "customer", "part", "orders", "lineitem")  # the tables the adapter reads


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _case(col: F.Column, mapping: dict, default=None) -> F.Column:
    expr = None
    for key, value in mapping.items():
        expr = F.when(col == F.lit(key), F.lit(value)) if expr is None else expr.when(col == F.lit(key), F.lit(value))
    return expr.otherwise(F.lit(default)) if default is not None else expr


def transaction_rows(spark: SparkSession, sf_dir: str, read: Callable[[SparkSession, str, str], DataFrame] = table,
                     with_lines: Callable[[DataFrame], DataFrame] = lambda lines: lines) -> DataFrame:
    """The joined rows of the test tables with their own columns, and the two columns that views are sorted by.

    ``read`` gives each table; ``with_lines`` may add columns to lineitem before its lines are joined to their orders.
    """
    li = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
        "l_tax", "l_returnflag")
    od = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    cu = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    na = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    rg = read(spark, sf_dir, "region").select("r_regionkey", "r_name")

    # Table by table, so that Spark knows the size of each and broadcasts those that are small enough.
    orders = (od.join(cu, od.o_custkey == cu.c_custkey, "left").join(na, cu.c_nationkey == na.n_nationkey, "left")
              .join(rg, na.n_regionkey == rg.r_regionkey, "left"))
    rows = with_lines(li).join(orders, F.col("l_orderkey") == orders.o_orderkey, "left")
    return (rows.withColumn("transaction_date", F.col("o_orderdate").cast(DateType()))
            .withColumn("delivery_status", _case(F.col("l_returnflag"), STATUS_BY_RETURNFLAG)))


def raw_transactions(spark: SparkSession, sf_dir: str,
                     read: Callable[[SparkSession, str, str], DataFrame] = table) -> DataFrame:
    """The reference's ``transactions`` table (before preparation) built from the test tables; ``read`` gives each."""
    return transactions_of(transaction_rows(spark, sf_dir, read))


def transactions_of(rows: DataFrame, *carried: str) -> DataFrame:
    """The raw transaction of each row of ``transaction_rows``, with the columns ``carried`` behind."""
    gross = F.col("l_extendedprice").cast(MONEY)
    scaled = DecimalType(18, 4)
    rate = _case(F.substring("o_orderpriority", 1, 1), FEE_RATE_BY_PRIORITY_DIGIT, FEE_RATE_OTHER).cast(DecimalType(4, 2))
    discount = (gross * F.col("l_discount").cast(DecimalType(4, 2))).cast(scaled)
    shipping = (gross * F.col("l_tax").cast(DecimalType(4, 2))).cast(scaled)
    fee = (gross * rate).cast(scaled)
    seconds = (F.col("l_orderkey") * ORDER_TIME_MULTIPLIERS[0] + F.col("o_custkey") * ORDER_TIME_MULTIPLIERS[1]) % 86400
    tier = F.col("c_custkey") % 10
    returned = F.col("l_returnflag") == "R"
    return rows.select(
        F.col("l_orderkey").alias("transaction_id"),
        "transaction_date",
        hms(seconds).alias("order_time"),
        F.col("o_orderpriority").alias("platform"),
        F.col("c_mktsegment").alias("order_source"),
        F.col("o_custkey").alias("customer_id"),
        F.when(F.col("c_custkey") % 2 == 0, "Female").otherwise("Male").alias("customer_gender"),
        (F.lit(17) + F.col("c_custkey") % 40).cast(IntegerType()).alias("customer_age"),
        F.upper("n_name").alias("city_uppercase"),
        F.col("r_name").alias("province_true"),
        F.when(tier < 6, "Bronze").when(tier < 9, "Silver").otherwise("Gold").alias("membership_tier"),
        F.col("l_quantity").cast(IntegerType()).alias("quantity"),
        gross.alias("gross_sales"),
        discount.alias("discount_amount"),
        (gross - discount).cast(scaled).alias("net_sales"),
        shipping.alias("shipping_cost"),
        fee.alias("platform_fee"),
        F.when(F.col("l_linenumber") == NO_CAMPAIGN_LINE, "No Campaign")
         .otherwise(F.concat(F.lit("Campaign "), F.col("l_linenumber").cast("string"))).alias("campaign_name"),
        F.concat(F.lit("Warehouse "), (F.col("l_suppkey") % 4).cast("string")).alias("warehouse_origin"),
        "delivery_status",
        (F.lit(1) + (F.col("l_orderkey") + F.col("l_linenumber")) % 5).cast(IntegerType()).alias("customer_rating"),
        F.when(returned, "Yes").otherwise("No").alias("returned_flag"),
        F.when(returned, _case(F.col("l_suppkey") % 4, RETURN_REASON_BY_SUPPKEY_MOD4)).otherwise("No").alias("return_reason"),
        F.col("l_partkey").alias("product_code"),
        *carried,
    )


def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference's ``product_code`` catalogue (before preparation) built from ``part``.

    p_partkey is the primary key of part, so the catalogue key is unique.
    Every part is listed; every fact row is kept by the view's LEFT JOIN.
    """
    p = table(spark, sf_dir, "part")
    price = F.col("p_retailprice").cast(MONEY)
    key = F.col("p_partkey")
    return p.select(
        key.alias("product_code"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.col("p_type").alias("sub_category"),
        F.col("p_brand").alias("shade"),
        F.col("p_brand").alias("skin_type_target"),
        F.col("p_size").cast(IntegerType()).alias("size_ml"),
        (price * F.lit(PRODUCTION_COST_RATE)).cast(DecimalType(18, 4)).alias("production_cost"),
        price.alias("selling_price"),
        (F.lit(100) + key % 900).cast(IntegerType()).alias("stock_qty"),
        (F.lit(50) + key % 200).cast(IntegerType()).alias("reorder_point"),
        ((F.lit(40) + key % 11).cast(DecimalType(4, 0)) * F.lit(Decimal("0.1"))).cast(DecimalType(3, 1)).alias("rating_average"),
        (F.lit(100) + (key * 37) % 14000).cast(IntegerType()).alias("review_count"),
    )
