"""Ordering helpers with the reference's NULL and list-position rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def field_position(col: Column, values: Sequence[str]) -> Column:
    """1-based position of ``col`` in ``values``; 0 when absent or NULL (SQL FIELD)."""
    return F.coalesce(F.array_position(F.array(*[F.lit(v) for v in values]), col), F.lit(0))


def asc(col: Column | str) -> Column:
    """Ascending, NULLs first (NULL is the smallest value)."""
    c = F.col(col) if isinstance(col, str) else col
    return c.asc_nulls_first()


def desc(col: Column | str) -> Column:
    """Descending, NULLs last."""
    c = F.col(col) if isinstance(col, str) else col
    return c.desc_nulls_last()
