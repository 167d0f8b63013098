import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from omnisales.functions.ordering import asc, desc
from omnisales.operators import ranking
from omnisales.operators.aggregates import status_panel
from omnisales.operators.ranking import ntile_maxima, positions, rank_rows, rows_at, tile_ends

from .conftest import sales_of


@pytest.mark.parametrize("tiles", [3, 5])
def test_tile_ends_equal_window_ntile(spark, tiles):
    for n in [1, 2, 3, 4, 5, 7, 13, 39]:
        df = spark.range(1, n + 1)
        want = {r.id: r.t for r in df.withColumn("t", F.ntile(tiles).over(Window.orderBy("id"))).collect()}
        ends = tile_ends(n, tiles)
        assert {i: 1 + sum(i > e for e in ends) for i in range(1, n + 1)} == want, (n, tiles)


def test_positions_and_rows_at_equal_window(spark):
    rnd = random.Random(7)
    rows = [(i, rnd.choice([None, *range(6)])) for i in range(500)]  # heavy ties, unique id breaks them
    df = spark.createDataFrame(rows, "id long, v long")
    order = [desc("v"), asc("id")]
    want = {r.id: r.t for r in df.withColumn("t", F.row_number().over(Window.orderBy(*order))).collect()}
    assert {r.id: r.p for r in positions(df, order, "p").collect()} == want
    by_place = {t: i for i, t in want.items()}
    total, got = rows_at(df, order, lambda n: [1, 77, n, n + 1])
    assert total == 500 and {p: r["id"] for p, r in got.items()} == {p: by_place[p] for p in (1, 77, 500)}
    assert positions(df.limit(0), order, "p").count() == 0 and rows_at(df.limit(0), order, lambda n: [1]) == (0, {})


def test_ntile_maxima_matches_naive(spark):
    rnd = random.Random(3)
    vals = [rnd.choice([1, 2, 2, 3, 5, 8, 8, 8, 13]) for _ in range(100)]
    df = spark.createDataFrame([(v,) for v in vals], "v long")
    naive = df.withColumn("k", F.ntile(3).over(Window.orderBy("v"))).groupBy("k").agg(F.max("v").alias("m"))
    want = [r.m for r in naive.orderBy("k").collect()]
    assert ntile_maxima(df, "v", 3) == want
    as_double = df.select(F.col("v").cast("double").alias("v"))  # sorted, not counted
    assert ntile_maxima(as_double, "v", 3) == [float(x) for x in want]
    two = spark.createDataFrame([(4,), (9,)], "v long")
    assert ntile_maxima(two, "v", 3) == [4, 9, None]
    assert ntile_maxima(df.filter("v < 0"), "v", 3) == [None, None, None]


@pytest.mark.parametrize("parts, bits", [(10_000, 12), (3, 2), (1, 1)])
def test_tile_limits_do_not_hang_on_the_sketch(spark, monkeypatch, parts, bits):
    """Coarse sketches and counts take more scans and give the same limits."""
    monkeypatch.setattr(ranking, "SKETCH_PARTS", parts)
    monkeypatch.setattr(ranking, "ROUND_BITS", bits)
    rnd = random.Random(parts)
    for vals in ([rnd.randint(-50, 10**12) for _ in range(301)], [7] * 40 + [9], [-5, -5, 3], [10**15 + k for k in range(64)],
                 [rnd.choice([0, 0, 0, 1, 10**9]) for _ in range(200)]):
        vals.sort()
        df = spark.createDataFrame([(v,) for v in vals], "v long")
        for tiles in (2, 3, 4):
            ends = tile_ends(len(vals), tiles)
            want = [vals[e - 1] if e and (not k or e > ends[k - 1]) else None for k, e in enumerate(ends)]
            assert ntile_maxima(df, "v", tiles) == want


def test_limits_take_two_scans(spark):
    df = spark.range(100_000).selectExpr("cast(id * 7919 % 1000003 / 100 as decimal(18,2)) as v")
    seen = []
    real = ranking._count_intervals
    ranking._count_intervals = lambda *a: seen.append(1) or real(*a)
    try:
        got = ntile_maxima(df, "v", 4)
    finally:
        ranking._count_intervals = real
    vals = sorted(i * 7919 % 1000003 for i in range(100_000))
    assert got == [Decimal(vals[k * 25_000 - 1]).scaleb(-2) for k in (1, 2, 3, 4)] and len(seen) == 1


def test_status_panel_stops_at_shortest_list(spark):
    rows = []
    for i, status in enumerate(["Cancelled"] * 3 + ["Returned"] * 2 + ["Delivered"] * 5):
        rows.append({"transaction_id": str(i), "warehouse_origin": f"W{i}", "delivery_status": status,
                     "quantity": str(10 - i)})
    s = sales_of(spark, rows)
    p = status_panel(s, "warehouse_origin", {"Qty": F.sum("quantity")}, "Qty", "Qty", 0)
    out = p.orderBy("rn").collect()
    assert len(out) == 2
    assert out[0]["Cancelled"]["warehouse_origin"] == "W0" and out[0]["Returned"]["warehouse_origin"] == "W3"
    assert out[1]["Delivered"]["warehouse_origin"] == "W6"


def test_grid_selection_on_decimals_with_wide_range(spark):
    from decimal import Decimal
    rnd = random.Random(11)
    vals = [Decimal(rnd.randint(-10 ** 9, 10 ** 12)) / 100 for _ in range(3000)] + [Decimal("5.55")] * 1000
    df = spark.createDataFrame([(v,) for v in vals], "v decimal(18,2)")
    naive = df.withColumn("k", F.ntile(5).over(Window.orderBy("v"))).groupBy("k").agg(F.max("v").alias("m"))
    want = [r.m for r in naive.orderBy("k").collect()]
    assert ntile_maxima(df, "v", 5) == want


def test_unbounded_rank_rows_distributed_equals_window(spark):
    rnd = random.Random(5)
    df = spark.createDataFrame([(f"p{i:03d}", rnd.randint(0, 9)) for i in range(300)], "k string, v long")
    order = [desc("v"), asc("k")]
    want = {r.k: r.Ranking for r in rank_rows(df, order).collect()}
    assert {r.k: r.Ranking for r in rank_rows(df, order, bounded=False).collect()} == want


def test_unbounded_status_panel_distributed_equals_window(spark):
    rnd = random.Random(9)
    statuses = ["Cancelled", "Returned", "Delivered"]
    rows = [{"transaction_id": str(i), "warehouse_origin": f"W{rnd.randint(0, 40)}",
             "delivery_status": statuses[rnd.randint(0, 2)], "quantity": str(rnd.randint(1, 5))} for i in range(600)]
    s = sales_of(spark, rows)
    args = (s, "warehouse_origin", {"Qty": F.sum("quantity")}, "Qty", "Qty", 0)
    want = sorted(map(str, status_panel(*args).collect()))
    got = sorted(map(str, status_panel(*args, bounded=False).collect()))
    assert got == want and len(want) > 10


def test_wide_decimals_are_sorted(spark):
    from decimal import Decimal
    vals = [Decimal(10) ** 25 + i for i in range(10)]  # beyond 64 bits on the grid
    df = spark.createDataFrame([(v,) for v in vals], "v decimal(30,0)")
    assert ntile_maxima(df, "v", 3) == [vals[3], vals[6], vals[9]]


def test_rfm_tiles_equal_window_ntile(spark):
    import datetime

    from omnisales.plans.customer import rfm_raw, rfm_scores
    rnd = random.Random(1)
    for n in (0, 1, 3, 23):
        rows = [{"transaction_id": f"{c}-{k}", "customer_id": f"C{c:02d}", "transaction_date": f"{rnd.randint(1, 3):02d}/03/2026"}
                for c in range(n) for k in range(rnd.randint(1, 3))]
        s = sales_of(spark, rows + [{"customer_id": None, "transaction_date": None}] * (n > 3))
        day = datetime.date(2026, 4, 1)
        raw = rfm_raw(s, day)
        for best_high in (False, True):
            a, b = (desc, asc) if best_high else (asc, desc)
            orders = {"r_score": a("recency"), "f_score": b("frequency"), "m_score": b("monetary")}
            want = raw.select("customer_id", *[F.ntile(5).over(Window.orderBy(o, asc("customer_id"))).alias(c) for c, o in orders.items()])
            got = rfm_scores(s, day, best_high).select("customer_id", *orders)
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), n
