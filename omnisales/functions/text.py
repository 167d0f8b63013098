"""Text formatting used in the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: currency prefix of money text.
MONEY_PREFIX = "Rp "


def sentence_case(col: Column) -> Column:
    """First character upper case, the rest lower case ('JAKARTA SELATAN' -> 'Jakarta selatan')."""
    return F.concat(F.upper(col.substr(1, 1)), F.lower(col.substr(F.lit(2), F.length(col))))


def pct_text(value: Column) -> Column:
    """Decimal value followed by '%'; NULL stays NULL (CONCAT semantics)."""
    return F.concat(value.cast("string"), F.lit("%"))


def money_text(value: Column, digits: int) -> Column:
    """'Rp ' + value rounded half away from zero with thousands separators."""
    return F.concat(F.lit(MONEY_PREFIX), F.format_number(F.round(value, digits), digits))
