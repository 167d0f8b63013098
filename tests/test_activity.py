"""Month bitmaps against plain sets of months."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from omnisales.operators.activity import MOST_AHEAD, SPAN, month_bitmaps
from omnisales.plans import corrected, customer


def rows_of(rnd, keys, years):
    out = []
    for key in range(keys):
        for _ in range(rnd.randint(0, 25)):
            day = dt.date(rnd.randint(*years), rnd.randint(1, 12), rnd.randint(1, 28))
            out.append((key, None if rnd.random() < 0.05 else day))
    return [*out, (None, dt.date(years[0], 1, 1)), (keys, None)]


def months_of(rows):
    found = {}
    for key, day in rows:
        found.setdefault(key, set())
        if day:
            found[key].add(12 * day.year + day.month)
    return found


@pytest.mark.parametrize("years", [(1999, 1999), (1992, 1998), (1900, 2024)])
def test_bitmaps_equal_sets_of_months(spark, years):
    rows = rows_of(random.Random(years[1]), 40, years)
    df = spark.createDataFrame(rows, "key long, day date").repartition(3)
    maps = month_bitmaps(df, "key", "day", F.count("day").alias("dated"))
    assert maps.words == -(-12 * (years[1] - years[0] + 1) // SPAN)
    ahead = (0, 1, 5, MOST_AHEAD)
    got = maps.rows.select("key", "dated", maps.first_month().alias("first"),
                           *[maps.calendar_months(k).alias(f"c{k}") for k in ahead],
                           *[maps.active_after_first(k).alias(f"a{k}") for k in ahead]).collect()
    want = months_of(rows)
    assert {r.key for r in got} == set(want)
    for r in got:
        months = want[r.key]
        assert r.first == min(months, default=None) and r.dated == sum(k == r.key and d is not None for k, d in rows)
        for k in ahead:
            again = {(m - 1) % 12 for m in months if m + k in months}
            assert r[f"c{k}"] == sum(1 << j for j in again)
            assert r[f"a{k}"] == bool(months and min(months) + k in months)


def test_cohorts_equal_pairs_of_months(spark):
    rnd = random.Random(3)
    rows = rows_of(rnd, 60, (1996, 2003))
    sales = spark.createDataFrame(rows, "customer_id long, transaction_date date")
    want = {}
    for key, months in months_of(rows).items():
        if key is None:
            continue
        names = {}
        for m in months:
            for k in range(6):
                names.setdefault((m - 1) % 12 + 1, set()).update({k} if m + k in months else ())
        for name, after in names.items():
            counts = want.setdefault(name, [0] * 7)
            counts[0] += 1
            for k in after:
                counts[k + 1] += 1
    undated = {k for k, d in rows if d is None and k is not None}
    got = {r.Bulan_Akuisis: [r.total_user_baru, *(r[f"bulan_{k}"] for k in range(6))] for r in customer.cohort_counts(sales).collect()}
    assert got.pop(None) == [len(undated), 0, 0, 0, 0, 0, 0]
    assert got == {customer.MONTHS[m - 1]: c for m, c in want.items()}


def test_cohorts_make_no_list_and_no_row_per_month(spark):
    sales = spark.createDataFrame([(1, dt.date(2020, 1, 1))], "customer_id long, transaction_date date")
    plan = customer.cohort_counts(sales)._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "posexplode" not in plan and "bit_or" in plan


@pytest.mark.parametrize("rows", [[], [(None, dt.date(2020, 1, 1))], [(1, None)]])
def test_cohorts_of_nothing(spark, rows):
    sales = spark.createDataFrame(rows, "customer_id long, transaction_date date")
    assert customer.cohort_counts(sales).count() == (1 if rows and rows[0][0] else 0)
    assert corrected.cohort_retention_first_purchase(sales).count() == 0
