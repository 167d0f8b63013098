"""The registered SQL functions on literal rows, against values worked out by hand."""

from decimal import Decimal

import pytest

from omnisales.functions.sql import register_sql_functions


@pytest.fixture(scope="module")
def view(spark):
    register_sql_functions(spark)


@pytest.mark.parametrize("expr, want", [
    ("div4(1, 3)", Decimal("0.3333")), ("div4(2, 3)", Decimal("0.6667")), ("div4(-2, 3)", Decimal("-0.6667")),
    ("div4(1, 0)", None), ("div4(NULL, 3)", None), ("div6(1.00, 7.00)", Decimal("0.142857")), ("div6(1.00, 0.00)", None),
    ("money0(1234567.50)", "Rp 1,234,568"), ("money2(1234.50)", "Rp 1,234.50"), ("money2(NULL)", None),
    ("field_position('c', array('a', 'b', 'c'))", 3), ("field_position('x', array('a'))", 0),
    ("sentence_case('kOTA bARU')", "Kota baru"), ("sentence_case('')", ""), ("month_name(DATE'2026-12-31')", "December"),
    ("weekday_name(DATE'2026-03-01')", "Sunday"), ("CAST(dmy_date('01/12/2026') AS STRING)", "2026-12-01"),
    ("dmy_date('2026-12-01')", None),
])
def test_sql_function(spark, view, expr, want):
    df = spark.sql(f"SELECT {expr} AS v")
    assert df.collect()[0].v == want
    assert "PythonUDF" not in df._jdf.queryExecution().executedPlan().toString()


def test_sql_functions_over_groups(spark, view):
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "k string, n int").createOrReplaceTempView("few")
    rows = spark.sql("""SELECT k, concat(round(div4(n, all_n) * 100, 0), '%') AS share
                        FROM (SELECT k, sum(n) AS n, sum(sum(n)) OVER () AS all_n FROM few GROUP BY k)""").collect()
    assert {r.k: r.share for r in rows} == {"a": "38%", "b": "63%"}


def test_sql_helpers(spark, view):
    row = spark.sql("""SELECT field_position('Tuesday', array('Monday', 'Tuesday')) AS f,
                              field_position(NULL, array('a')) AS f0, sentence_case('JAKARTA SELATAN') AS c,
                              dmy_date('5/3/2026') AS d, dmy_date('31/02/2026') AS bad,
                              weekday_name(DATE'2026-01-02') AS w, month_name(DATE'2026-01-02') AS m,
                              div4(1, 0) AS z, div4(2, 3) AS q""").collect()[0]
    assert (row.f, row.f0, row.c, str(row.d), row.bad, row.w, row.m, row.z, str(row.q)) == \
        (2, 0, "Jakarta selatan", "2026-03-05", None, "Friday", "January", None, "0.6667")
