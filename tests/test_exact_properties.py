"""Exact arithmetic against Python's decimal module on thousands of random cases (one Spark job each)."""

import random
from decimal import ROUND_HALF_UP, Context, Decimal, localcontext

from pyspark.sql import functions as F

from omnisales.functions.exact import percent, quotient, rounded_avg
from omnisales.functions.text import money_text


def half_up(x: Decimal, digits: int) -> Decimal:
    return x.quantize(Decimal(1).scaleb(-digits), rounding=ROUND_HALF_UP)


def cases(seed, n=4000):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        den = rnd.choice([0, 1, 3, 7, 8, 10, 100, 2000, rnd.randint(-10 ** 6, 10 ** 6), rnd.randint(1, 10 ** 12)])
        num = rnd.choice([0, den, -den, den // 2, rnd.randint(-10 ** 9, 10 ** 9), rnd.randint(-10 ** 13, 10 ** 13)])
        out.append((num, den))
    return out


def test_quotient_and_percent_on_whole_numbers(spark):
    rows = cases(1)
    df = spark.createDataFrame(rows, "a long, b long")
    got = df.select(quotient(F.col("a"), F.col("b")).alias("q"),
                    *[percent(F.col("a"), F.col("b"), d).alias(f"p{d}") for d in (0, 1, 2)]).collect()
    with localcontext(Context(prec=60)):
        for (a, b), r in zip(rows, got):
            if b == 0:
                assert r.q is None and r.p0 is None
                continue
            q4 = half_up(Decimal(a) / Decimal(b), 4)  # quotient keeps scale + 4 digits
            assert r.q == q4, (a, b, r.q, q4)
            for d in (0, 1, 2):
                assert r[f"p{d}"] == half_up(q4 * 100, d), (a, b, d)


def test_quotient_on_money(spark):
    rnd = random.Random(2)
    rows = [(Decimal(rnd.randint(-10 ** 12, 10 ** 12)).scaleb(-2), Decimal(rnd.choice([1, 3, rnd.randint(-10 ** 10, 10 ** 10)])).scaleb(-2))
            for _ in range(4000)]
    df = spark.createDataFrame(rows, "a decimal(18,2), b decimal(18,2)")
    got = df.select(quotient(F.col("a"), F.col("b"), 2, 2).alias("q"),
                    percent(F.col("a"), F.col("b"), 2, 2, 2).alias("p")).collect()
    with localcontext(Context(prec=60)):
        for (a, b), r in zip(rows, got):
            q6 = half_up(a / b, 6)
            assert r.q == q6 and r.p == half_up(q6 * 100, 2), (a, b, r)


def test_rounded_average_per_group(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 300), rnd.choice([1, 2, 3, 4, 5])) for _ in range(6000)]
    df = spark.createDataFrame(rows, "g int, v int")
    got = {r.g: r.a for r in df.groupBy("g").agg(rounded_avg("v", 2).alias("a")).collect()}
    sums, counts = {}, {}
    for g, v in rows:
        sums[g] = sums.get(g, 0) + v
        counts[g] = counts.get(g, 0) + 1
    with localcontext(Context(prec=60)):
        for g in sums:
            assert got[g] == half_up(half_up(Decimal(sums[g]) / counts[g], 4), 2), g


def test_money_text_matches_python_format(spark):
    rnd = random.Random(4)
    rows = [(Decimal(rnd.randint(-10 ** 11, 10 ** 11)).scaleb(-3),) for _ in range(3000)]
    df = spark.createDataFrame(rows, "x decimal(18,3)")
    got = df.select(money_text(F.col("x"), 0).alias("m0"), money_text(F.col("x"), 2).alias("m2")).collect()
    for (x,), r in zip(rows, got):
        for d, text in ((0, r.m0), (2, r.m2)):
            v = half_up(x, d)
            want = "Rp " + ("-" if v < 0 else "") + f"{abs(v):,.{d}f}"
            assert text == want, (x, d, text, want)
