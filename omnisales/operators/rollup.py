"""One roll-up of the sales view for the analyses that group it by a few small keys.

The roll-up holds, for each of a few sets of keys, one row per combination of their values with sums and counts of
the measures: a GROUPING SETS aggregate over a few wider sets in one scan of the view, summed up further and stored beside it. Its size follows the
dimensions and the calendar (platforms, campaigns, tiers, ages, warehouses, days), not the sales.

``totals`` gives the same table for any view: from the roll-up where the view has one and a set holds the keys (summed
up further if the set has more), else by grouping the view itself. Analyses are written against it once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType

#: The sets of keys, and the columns that are summed (those that a view has).
SETS = [("platform", "customer_gender"), ("membership_tier", "customer_gender"), ("campaign_name",), ("customer_age",),
        ("warehouse_origin", "delivery_status"), ("transaction_date",)]
SUMMED = ["quantity", "gross_sales", "net_profit", "selling_price", "production_cost", "shipping_cost", "platform_fee",
          "discount_amount", "customer_rating"]
COSTS = ["gross_sales", "discount_amount", "production_cost", "quantity", "shipping_cost", "platform_fee"]
#: Profit with the production cost of all units of a row.
UNIT_PROFIT = "gross_sales - discount_amount - production_cost * quantity - shipping_cost - platform_fee"
ROWS, RATED, SCALED = "rows", "rated", "unit_profit"
#: What one scan groups by: each set of keys is within one of these, which have few combinations themselves.
BASES = [("platform", "customer_gender", "membership_tier", "customer_age"),
         ("campaign_name", "warehouse_origin", "delivery_status"), ("transaction_date",)]
SHORT = 8  # digits of decimals whose sums Spark keeps in 64 bits
_SET = "_set"
_ROLLUP = "_omnisales_rollup"


def _measures(sales: DataFrame) -> list[Column]:
    found = [F.sum(c).alias(c) for c in SUMMED if c in sales.columns]
    if set(COSTS) <= set(sales.columns):
        found.append(F.sum(F.expr(UNIT_PROFIT)).alias(SCALED))
    if "customer_rating" in sales.columns:
        found.append(F.count("customer_rating").alias(RATED))
    return [*found, F.count(F.lit(1)).alias(ROWS)]


def _keys() -> list[str]:
    return list(dict.fromkeys(k for keys in SETS for k in keys))


def _number(keys: tuple[str, ...]) -> int:
    """GROUPING_ID of a set: a bit for each key that is not in it."""
    return sum(1 << i for i, k in enumerate(reversed(_keys())) if k not in keys)


def _home(keys: tuple[str, ...]) -> tuple[str, ...]:
    """The base that holds a set."""
    return next(b for b in BASES if set(keys) <= set(b))


def _added(name: str, kind: DataType) -> Column:
    """The sum of a measure. Decimals that fit 8 digits are added as 64-bit numbers, several times faster; the few beyond
    are added as decimals. Both sums are exact."""
    if not isinstance(kind, DecimalType) or kind.precision <= SHORT or kind.scale > SHORT:
        return F.expr(f"sum({name})")
    short = f"try_cast({name} as decimal({SHORT},{kind.scale}))"
    fits = f"abs({name}) < {10 ** (SHORT - kind.scale)}BD"
    few, most = f"sum({name}) filter (where not {fits})", f"sum({short}) filter (where {fits})"
    return F.expr(f"if({few} is null, {most}, if({most} is null, {few}, {few} + {most}))")


def rollup(sales: DataFrame) -> DataFrame:
    """The roll-up of a view: the number of the set, all keys, the measures.

    One scan groups the rows by the ``BASES``; their few groups are then summed up to the ``SETS`` that each holds.
    """
    kinds = {f.name: f.dataType for f in sales.groupBy().agg(*_measures(sales)).schema.fields}
    summed = [m for m in kinds if m not in (RATED, ROWS)]
    values = [F.expr(UNIT_PROFIT).alias(SCALED) if m == SCALED else F.col(m) for m in summed]
    rated = [F.when(F.col("customer_rating").isNotNull(), 1).alias(RATED)] if RATED in kinds else []
    keys = _keys()
    rows = sales.select(*keys, *values, *rated)
    sums = [_added(m, rows.schema[m].dataType).cast(kinds[m]).alias(m) for m in summed]
    counts = [F.count(RATED).alias(RATED)] if rated else []
    bases = rows.groupingSets([[F.col(k) for k in b] for b in BASES], *[F.col(k) for k in keys]).agg(
        F.grouping_id().alias("_base"), *sums, *counts, F.count(F.lit(1)).alias(ROWS))
    held = " ".join(f"when {_number(b)} then array({', '.join(f'{_number(s)}L' for s in SETS if _home(s) == b)})" for b in BASES)
    sets = bases.withColumn(_SET, F.explode(F.expr(f"case _base {held} end")))
    shown = [F.when(F.col(_SET).isin(*[_number(s) for s in SETS if k in s]), F.col(k)).alias(k) for k in keys]
    totals_ = sets.groupBy(*shown, _SET).agg(*[F.sum(m).cast(k).alias(m) for m, k in kinds.items()])
    return totals_.select(*keys, _SET, *kinds).coalesce(1)


def with_rollup(sales: DataFrame, stored: DataFrame) -> DataFrame:
    """``sales``, of which ``totals`` reads the stored ``rollup``."""
    setattr(sales, _ROLLUP, stored)
    return sales


def totals(sales: DataFrame, *keys: str) -> DataFrame:
    """One row for each combination of ``keys``: these, the sums of ``SUMMED`` under their names, ``unit_profit``,
    ``rated`` (rows with a rating) and ``rows``."""
    stored = getattr(sales, _ROLLUP, None)
    fitting = [s for s in SETS if set(keys) <= set(s)] if stored is not None else []
    if not fitting:
        return sales.groupBy(*keys).agg(*_measures(sales))
    best = min(fitting, key=len)
    own = stored.where(F.col(_SET) == _number(best))
    measures = [f for f in stored.schema.fields if f.name not in (_SET, *_keys())]
    if set(best) == set(keys):
        return own.select(*keys, *[f.name for f in measures])
    return own.groupBy(*keys).agg(*[F.sum(f.name).cast(f.dataType).alias(f.name) for f in measures])


def summed_by(grouped: DataFrame, key: Column, name: str, *measures: str) -> DataFrame:
    """Rows of ``totals`` summed further by an expression of their keys (weekday or month of a day)."""
    kinds = {f.name: f.dataType for f in grouped.schema.fields}
    return grouped.groupBy(key.alias(name)).agg(*[F.sum(m).cast(kinds[m]).alias(m) for m in measures])
