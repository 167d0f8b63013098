"""Rows at ranks against a sort in plain Python."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from omnisales.operators import selection
from omnisales.operators.selection import Axis, rows_at_ranks
from omnisales.plans import customer


def table(spark, rnd, n, text):
    ids = rnd.sample(range(-10 * n, 10 * n), n)
    if text:
        ids = [*{f"C{abs(i):06d}" + rnd.choice(["", "\0", "é", "x" * 9]) for i in ids}, "C", "C\0", "", "漢字"]
    rows = [(None if rnd.random() < 0.1 else rnd.choice([0, 1, 1, 1, 2, -3, rnd.randint(-10**12, 10**12)]),
             rnd.choice([5, 5, 5, 5, None, 10**15 + rnd.randint(0, 3)]), i) for i in [*ids, None]]
    df = spark.createDataFrame(rows, f"a long, b long, id {'string' if text else 'long'}").repartition(3)
    return rows, df


def in_order(rows, column, descending, text):
    def key(r):
        v = r[column]
        nulls = (v is None) if descending else (v is not None)
        i = r[2]
        return nulls, (0 if v is None else -v if descending else v), i is not None, (i.encode() if text else i) if i is not None else 0
    return sorted(rows, key=key)


@pytest.mark.parametrize("text", [False, True])
@pytest.mark.parametrize("digits, fetched", [(12, 4096), (2, 1), (5, 7)])
def test_rows_at_ranks_equal_a_sort(spark, monkeypatch, text, digits, fetched):
    monkeypatch.setattr(selection, "DIGITS", digits)
    monkeypatch.setattr(selection, "FETCHED", fetched)
    rows, df = table(spark, random.Random(digits), 120, text)
    orders = [(0, False), (1, True), (0, True)]
    axes = []
    for column, descending in orders:
        c = "ab"[column]
        axes.append(Axis(f"cast({c} is {'' if descending else 'not'} null as int)", f"coalesce({'-' if descending else ''}{c}, 0L)"))
    ranks = [1, 2, 17, 40, 41, 60, 100, len(rows)]
    total, found = rows_at_ranks(df, axes, "id", lambda n: ranks)
    assert total == len(rows)
    for (column, descending), at in zip(orders, found):
        want = in_order(rows, column, descending, text)
        assert [at[r].id for r in ranks] == [want[r - 1][2] for r in ranks]
        for r in ranks:
            v = want[r - 1][column]
            assert at[r].value == (0 if v is None else -v if descending else v)


def test_no_rows(spark):
    df = spark.createDataFrame([], "a long, id long")
    assert rows_at_ranks(df, [Axis("0", "a")], "id", lambda n: []) == (0, [{}])


def test_other_ids_are_refused(spark):
    df = spark.createDataFrame([(1, 1.5)], "a long, id double")
    with pytest.raises(TypeError):
        rows_at_ranks(df, [Axis("0", "a")], "id", lambda n: [1])


@pytest.mark.parametrize("best_high", [False, True])
@pytest.mark.parametrize("text", [False, True])
def test_rfm_scores_equal_ntile(spark, best_high, text):
    rnd = random.Random(8)
    rows = []
    for i in range(83):
        for k in range(rnd.choice([1, 1, 2, 3])):
            rows.append((f"c{i % 7}-{i}" if text else i, None if rnd.random() < 0.1 else dt.date(2024, 1, rnd.randint(1, 5)),
                         f"t{i}-{k}", None if rnd.random() < 0.1 else rnd.choice([10, 10, 25, 99])))
    rows.append((None, dt.date(2024, 1, 2), "t", 10))
    sales = spark.createDataFrame(rows, f"customer_id {'string' if text else 'long'}, transaction_date date, transaction_id string, price long") \
        .withColumn("selling_price", (F.col("price") / 4).cast("decimal(18,2)"))
    raw = customer.rfm_raw(sales, dt.date(2024, 2, 1)).collect()
    got = {r.customer_id: (r.r_score, r.f_score, r.m_score) for r in customer.rfm_scores(sales, dt.date(2024, 2, 1), best_high).collect()}
    want = {r.customer_id: [] for r in raw}
    for measure, descending in (("recency", best_high), ("frequency", not best_high), ("monetary", not best_high)):
        def key(r, measure=measure, descending=descending):
            v, i = r[measure], r.customer_id
            return ((v is None) if descending else (v is not None), 0 if v is None else -v if descending else v,
                    i is not None, i if i is not None else 0)
        size, extra = divmod(len(raw), 5)
        tiles = [t for t in range(1, 6) for _ in range(size + (t <= extra))]
        for tile, r in zip(tiles, sorted(raw, key=key)):
            want[r.customer_id].append(tile)
    assert got == {i: tuple(t) for i, t in want.items()}


def test_customers_are_not_sorted(spark):
    sales = spark.createDataFrame([(i, dt.date(2024, 1, 1), str(i), 1) for i in range(20)],
                                  "customer_id long, transaction_date date, transaction_id string, selling_price long")
    plan = customer.rfm_scores(sales, dt.date(2024, 2, 1))._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan and "Generate" not in plan
