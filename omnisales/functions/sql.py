"""Spark SQL functions with the reference's (MySQL) semantics.

For SQL written against the registered ``sales_analysis`` view: the
reference's statements port almost line by line, e.g.
``CONCAT(ROUND(SUM(q) / SUM(SUM(q)) OVER () * 100, 0), '%')`` becomes
``concat(round(div4(sum(q), sum(sum(q)) OVER ()) * 100, 0), '%')`` and
``FIELD(x, 'a', 'b')`` becomes ``field_position(x, array('a', 'b'))``.
They are SQL-bodied temporary functions: Spark inlines them into the plan
(whole-stage codegen, no Python). When a function's arguments are plain
aggregates, round its result in an outer SELECT over the grouped subquery
(Spark's analyzer otherwise treats the ``round`` digits as non-constant).
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .dates import MONTHS, RAW_DATE_PATTERN, WEEKDAYS
from .text import MONEY_PREFIX


def _array(values: list[str]) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


SQL_FUNCTIONS = {
    # FIELD(x, ...): 1-based position, 0 when absent or NULL
    "field_position": "(x STRING, items ARRAY<STRING>) RETURNS INT RETURN coalesce(array_position(items, x), 0)",
    # a / b on whole numbers: 4 fraction digits, half away from zero, NULL for 0
    "div4": "(a DECIMAL(22,0), b DECIMAL(22,0)) RETURNS DECIMAL(38,4) RETURN round(try_divide(a, b), 4)",
    # a / b on money (2 fraction digits): 6 fraction digits
    "div6": "(a DECIMAL(22,2), b DECIMAL(22,2)) RETURNS DECIMAL(38,6) RETURN round(try_divide(a, b), 6)",
    "sentence_case": "(s STRING) RETURNS STRING RETURN concat(upper(substr(s, 1, 1)), lower(substr(s, 2)))",
    "dmy_date": f"(s STRING) RETURNS DATE RETURN try_to_date(s, '{RAW_DATE_PATTERN}')",
    "weekday_name": f"(d DATE) RETURNS STRING RETURN element_at({_array(WEEKDAYS)}, weekday(d) + 1)",
    "month_name": f"(d DATE) RETURNS STRING RETURN element_at({_array(MONTHS)}, month(d))",
    # CONCAT('Rp ', FORMAT(x, 0 | 2))
    "money0": f"(x DECIMAL(38,2)) RETURNS STRING RETURN concat('{MONEY_PREFIX}', format_number(round(x, 0), 0))",
    "money2": f"(x DECIMAL(38,2)) RETURNS STRING RETURN concat('{MONEY_PREFIX}', format_number(round(x, 2), 2))",
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Create (or replace) the functions for this session; returns their names."""
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(SQL_FUNCTIONS)
