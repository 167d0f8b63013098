"""Exact decimal arithmetic with the reference's (MySQL) rounding rules.

Rules reproduced here:

* ``a / b`` on exact values yields ``scale(a) + 4`` fraction digits, rounded
  half away from zero; a zero divisor gives NULL (not an error).
* ``AVG`` of an exact column yields ``scale + 4`` digits, same rounding.
* ``ROUND(x, d)`` rounds half away from zero.

Spark's ``round`` on decimals is HALF_UP (away from zero). The quotient is
computed in integer arithmetic on DECIMAL(38,0) units - round(a / b) half
away from zero is ``(2|a| + |b|) div 2|b|`` with the sign put back - so it
is exact for every operand in range, with no intermediate rounding. AVG uses
Spark's decimal average, which divides with at least 18 fraction digits and
so rounds once for any row count below 10**14.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

# Fixed value: extra fraction digits of an exact division / average
# (MySQL ``div_precision_increment`` default).
DIV_EXTRA_SCALE = 4

_UNITS = DecimalType(38, 0)


def dec(col: Column | str, precision: int, scale: int) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.cast(DecimalType(precision, scale))


def quotient(num: Column, den: Column, num_scale: int = 0, den_scale: int = 0) -> Column:
    """``num / den`` rounded once to ``num_scale + 4`` digits; NULL when den is 0 or NULL.

    ``num`` and ``den`` hold exact numbers with the given fraction digits;
    they are taken as whole units (``a``, ``b``) and the result in units of
    10**-(num_scale + 4) is round(a * 10**(den_scale + 4) / b), computed as
    an integer. Operands and the unscaled result must stay below 10**32.
    """
    digits = num_scale + DIV_EXTRA_SCALE
    a = (num * F.lit(10 ** num_scale)).cast(_UNITS)
    b = (den * F.lit(10 ** den_scale)).cast(_UNITS)
    x = F.abs(a) * F.lit(2 * 10 ** (den_scale + DIV_EXTRA_SCALE)) + F.abs(b)
    y = F.nullif(F.abs(b) * F.lit(2), F.lit(0))  # a zero divisor gives NULL, never an error
    whole = ((x - x % y) / y).cast(_UNITS)        # exact: x - x % y is a multiple of y
    signed = F.when((a < 0) != (b < 0), -whole).otherwise(whole)
    return (signed * F.lit(Decimal(1).scaleb(-digits))).cast(DecimalType(38, digits))


def percent(num: Column, den: Column, digits: int, num_scale: int = 0, den_scale: int = 0) -> Column:
    """``ROUND(num / den * 100, digits)`` as a decimal with ``digits`` fraction digits."""
    return F.round(quotient(num, den, num_scale, den_scale) * F.lit(100), digits)


def growth_percent(current: Column, previous: Column, digits: int = 2, scale: int = 0) -> Column:
    """``ROUND((cur - prev) / prev * 100, digits)``; NULL when prev is NULL or 0."""
    return percent(current - previous, previous, digits, scale, scale)


def rounded_avg(col: Column | str, digits: int, precision: int = 10, scale: int = 0) -> Column:
    """``ROUND(AVG(col), digits)`` with the average kept exact at ``scale + 4`` digits."""
    return F.round(F.avg(dec(col, precision, scale)), digits)


def rounded_mean(total: Column, n: Column, digits: int, scale: int = 0) -> Column:
    """``rounded_avg`` of values whose sum and number are known; no value gives NULL."""
    return F.round(quotient(total, n, scale, 0), digits).cast(DecimalType(14, digits))
