"""Scans of catalogue and transaction files.

CSV columns are taken by their header names, all as text (no type
inference), so files with another column order or extra columns read
correctly; types are hardened in ``prepare``. A missing column is an error
that names it.
"""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schema import (PRODUCT_INTS, PRODUCT_MONEY, RAW_PRODUCTS, RAW_TRANSACTIONS, TRANSACTION_INTS,
                      TRANSACTION_MONEY)
from ..session import stored_copy
from .prepare import assert_unique_key, clean_header, prepare_products, prepare_transactions, unreadable

_RAW = "_raw"


def read_text_csv(spark: SparkSession, path: str | list[str], schema: StructType) -> DataFrame:
    """CSV with a header -> the columns of ``schema``, by name, as text (BOM-safe)."""
    raw = clean_header(spark.read.option("header", True).option("inferSchema", False)
                       .option("encoding", "UTF-8").csv(path))
    missing = [c for c in schema.fieldNames() if c not in raw.columns]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    return raw.select(*[F.col(c).cast("string").alias(c) for c in schema.fieldNames()])


def read_products_csv(spark: SparkSession, path: str, check_unique: bool = True, rejects: str | None = None) -> DataFrame:
    """Catalogue CSV (header, comma, optional BOM) -> typed products; read once, unreadable values as for transactions."""
    raw = read_text_csv(spark, path, RAW_PRODUCTS)
    bad = unreadable(raw, PRODUCT_MONEY, PRODUCT_INTS, ("rating_average",))
    products = _read_once(raw, bad, prepare_products, "products", path, rejects)
    if check_unique:
        assert_unique_key(products, "product_code")
    return products


def _read_once(raw: DataFrame, bad: Column, prepare: Callable[[DataFrame], DataFrame], name: str, path: str | list[str],
               rejects: str | None) -> DataFrame:
    """``prepare(raw)``, from a copy that one pass over the text files writes.

    The same pass counts the rows that are ``bad`` (observed) and keeps them as they came beside their typed form, so
    that the rejects are written from the copy and the text is parsed once, however many analyses follow. Bad rows stay in
    the result with NULL in place of the value, as the preparation defines it; their number is a warning. The copy lies
    with the session's intermediate steps (``session.drop_steps``).
    """
    seen = Observation(f"rejects-{uuid.uuid4().hex}")
    kept = F.when(bad, F.struct(*raw.columns)).alias(_RAW)
    typed = prepare(raw.select("*", kept)).observe(seen, F.count_if(F.col(_RAW).isNotNull()).alias("bad"))
    copy = stored_copy(typed, name)
    n = seen.get["bad"]
    if rejects:
        copy.filter(F.col(_RAW).isNotNull()).select(f"{_RAW}.*").write.mode("overwrite").parquet(rejects)
    if n:
        warn_of_rejects(path, n, rejects)
    return copy.drop(_RAW)


def warn_of_rejects(path: str | list[str], n: int, rejects: str | None = None) -> None:
    warnings.warn(f"{path}: {n} rows hold values that cannot be read and are NULL"
                  + (f"; the rows are in {rejects}" if rejects else ""), stacklevel=3)


def read_transactions_csv(spark: SparkSession, path: str | list[str], rejects: str | None = None) -> DataFrame:
    """Transaction CSV files (a folder or glob scales out over files) -> prepared transactions, read once.

    Rows with a number or date that cannot be read are counted, and written to the folder ``rejects`` (Parquet).
    """
    raw = read_text_csv(spark, path, RAW_TRANSACTIONS)
    bad = unreadable(raw, TRANSACTION_MONEY, TRANSACTION_INTS)
    return _read_once(raw, bad, prepare_transactions, "transactions", path, rejects)


#: Marks rows of ``scan_transactions_csv`` with a value that cannot be read.
UNREADABLE = "_unreadable"


def scan_transactions_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """As ``read_transactions_csv``, but a plain scan of the files (no copy, no report), with the flag ``UNREADABLE``."""
    raw = read_text_csv(spark, path, RAW_TRANSACTIONS)
    return prepare_transactions(raw.withColumn(UNREADABLE, unreadable(raw, TRANSACTION_MONEY, TRANSACTION_INTS)))


def read_transactions_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet transactions (schema from the files) -> prepared transactions."""
    return prepare_transactions(spark.read.parquet(path))
