"""Data preparation (header repair, type hardening, value repair, date parsing).

The reference patches tables in place with ALTER / UPDATE. Here every step
is a column expression, so the whole preparation is one narrow projection
that Catalyst fuses into the scan stage (no shuffle, no extra pass).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegerType, StringType, TimestampNTZType, TimestampType

from ..functions.dates import parse_raw_date
from ..schema import MONEY, PRODUCT_INTS, PRODUCT_MONEY, RATING, TRANSACTION_INTS, TRANSACTION_MONEY

# A UTF-8 byte order mark, as a character and as its
# Latin-1 mis-decoding that sticks to the first header name.
BOM_MARKS = ("﻿", "ï»¿")

# Return flag / reason codes.
RETURNED_YES = "Yes"
NO_REASON = "No"
UNKNOWN_REASON = "Unknow"


def clean_header(df: DataFrame) -> DataFrame:
    """S3: strip a byte order mark stuck to the first column name."""
    first = df.columns[0]
    clean = first
    for mark in BOM_MARKS:
        if clean.startswith(mark):
            clean = clean[len(mark):]
    return df if clean == first else df.withColumnRenamed(first, clean)


def _typed(df: DataFrame, name: str, target) -> F.Column:
    c = F.col(name)
    if isinstance(df.schema[name].dataType, StringType):
        c = F.trim(c)
    return c.try_cast(target)


def _targets(money: Iterable[str], ints: Iterable[str], ratings: Iterable[str]) -> dict:
    return {**{c: MONEY for c in money}, **{c: IntegerType() for c in ints}, **{c: RATING for c in ratings}}


def harden_types(df: DataFrame, money: Iterable[str], ints: Iterable[str] = (), ratings: Iterable[str] = ()) -> DataFrame:
    """Money to DECIMAL(18,2) (half away from zero), integers, ratings to DECIMAL(3,1).

    ``try_cast`` keeps a malformed value from failing the job in ANSI mode;
    ``rejected_rows`` lists the rows where that happened.
    """
    targets = _targets(money, ints, ratings)
    return df.select([_typed(df, c, targets[c]).alias(c) if c in targets else F.col(c) for c in df.columns])


def unreadable(raw: DataFrame, money: Iterable[str], ints: Iterable[str] = (), ratings: Iterable[str] = ()) -> F.Column:
    """Whether a raw row has a non-empty value that type hardening or date parsing turns into NULL."""
    targets = _targets(money, ints, ratings)
    bad = F.lit(False)
    for c, target in targets.items():
        text = F.trim(F.col(c).cast("string"))
        bad = bad | (text.isNotNull() & (text != "") & _typed(raw, c, target).isNull())
    if "transaction_date" in raw.columns and isinstance(raw.schema["transaction_date"].dataType, StringType):
        text = F.trim(F.col("transaction_date"))
        bad = bad | (text.isNotNull() & (text != "") & parse_raw_date(F.col("transaction_date")).isNull())
    return bad


def rejected_rows(raw: DataFrame, money: Iterable[str], ints: Iterable[str] = (), ratings: Iterable[str] = ()) -> DataFrame:
    """The raw rows that are ``unreadable`` somewhere (one narrow pass)."""
    return raw.filter(unreadable(raw, money, ints, ratings))


def remap_return_reason(df: DataFrame) -> DataFrame:
    """A returned row whose reason says 'No' gets 'Unknow'; NULLs stay as they are."""
    cond = (F.col("returned_flag") == RETURNED_YES) & (F.col("return_reason") == NO_REASON)
    return df.withColumn("return_reason", F.when(cond, F.lit(UNKNOWN_REASON)).otherwise(F.col("return_reason")))


def with_temp_date(df: DataFrame) -> DataFrame:
    """S5 + S6 + S8: DATE column ``temp_date`` right after ``transaction_date``."""
    kind = df.schema["transaction_date"].dataType
    if isinstance(kind, StringType):
        parsed = parse_raw_date(F.col("transaction_date"))
    elif isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        parsed = F.col("transaction_date").cast(DateType())
    else:
        raise TypeError(f"transaction_date has unsupported type {kind}")
    cols = []
    for c in df.columns:
        if c == "temp_date":
            continue
        cols.append(F.col(c))
        if c == "transaction_date":
            cols.append(parsed.alias("temp_date"))
    return df.select(cols)


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns (e.g. ``return_reason``)."""
    return df.drop(*names)


def prepare_transactions(raw: DataFrame) -> DataFrame:
    """S3-S8 on a raw transaction frame (text or already typed columns)."""
    df = clean_header(raw)
    df = harden_types(df, TRANSACTION_MONEY, [c for c in TRANSACTION_INTS if c in df.columns])
    df = remap_return_reason(df)
    return with_temp_date(df)


def prepare_products(raw: DataFrame) -> DataFrame:
    """S3 + S4 on a raw catalogue frame."""
    df = clean_header(raw)
    ints = [c for c in PRODUCT_INTS if c in df.columns]
    ratings = [c for c in ("rating_average",) if c in df.columns]
    return harden_types(df, [c for c in PRODUCT_MONEY if c in df.columns], ints, ratings)


def assert_unique_key(df: DataFrame, key: str) -> None:
    """Fail when ``key`` repeats: a repeated catalogue key would multiply fact rows.

    One aggregate job; only a single offending key ever reaches the driver.
    """
    dup = df.groupBy(key).count().filter(F.col("count") > 1).limit(1).collect()
    if dup:
        raise ValueError(f"{key} is not unique, e.g. {dup[0][key]!r} appears {dup[0]['count']} times")
