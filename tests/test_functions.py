from decimal import Decimal

from pyspark.sql import functions as F

from omnisales.functions.dates import parse_raw_date, seconds_of_day, weekday_name
from omnisales.functions.exact import growth_percent, percent, quotient, rounded_avg
from omnisales.functions.ordering import field_position
from omnisales.functions.text import money_text, pct_text, sentence_case
from omnisales.plans.timeseries import day_part


def one(spark, expr, schema="x string", rows=((None,),)):
    return [r[0] for r in spark.createDataFrame(list(rows), schema).select(expr.alias("v")).collect()]


def test_round_half_away_from_zero(spark):
    rows = [(Decimal("2.5"),), (Decimal("-2.5"),), (Decimal("12.345"),)]
    got = one(spark, F.round(F.col("x"), 0), "x decimal(10,3)", rows)
    assert got == [Decimal("3"), Decimal("-3"), Decimal("12")]
    assert one(spark, F.round(F.col("x"), 2), "x decimal(10,3)", rows)[2] == Decimal("12.35")


def test_quotient_keeps_scale_plus_four_then_rounds(spark):
    # 1/3 -> 0.3333 (scale 0 + 4); 2/3 -> 0.6667; division by zero is NULL, not an error
    rows = [(1, 3), (2, 3), (5, 0)]
    got = [r.v for r in spark.createDataFrame(rows, "a long, b long")
           .select(quotient(F.col("a"), F.col("b")).alias("v")).collect()]
    assert got == [Decimal("0.3333"), Decimal("0.6667"), None]


def test_percent_double_rounding_like_the_reference(spark):
    # 1249/10000 = 0.1249 -> 12.49 -> 12 ; 12495/100000 = 0.12495 -> 0.1250 (4 digits) -> 12.50 -> 13
    rows = [(1249, 10000), (12495, 100000)]
    got = [r.v for r in spark.createDataFrame(rows, "a long, b long")
           .select(percent(F.col("a"), F.col("b"), 0).alias("v")).collect()]
    assert got == [Decimal("12"), Decimal("13")]


def test_pct_text_digits(spark):
    rows = [(1, 8), (1, 3), (3, 1)]
    df = spark.createDataFrame(rows, "a long, b long")
    got = [r.v for r in df.select(pct_text(percent(F.col("a"), F.col("b"), 2)).alias("v")).collect()]
    assert got == ["12.50%", "33.33%", "300.00%"]
    got0 = [r.v for r in df.select(pct_text(percent(F.col("a"), F.col("b"), 0)).alias("v")).collect()]
    assert got0 == ["13%", "33%", "300%"]


def test_growth_guards(spark):
    rows = [(85, 100), (100, None), (5, 0)]
    df = spark.createDataFrame(rows, "c long, p long")
    got = [r.v for r in df.select(pct_text(growth_percent(F.col("c"), F.col("p"))).alias("v")).collect()]
    assert got == ["-15.00%", None, None]


def test_rounded_avg_of_ints(spark):
    df = spark.createDataFrame([(1,), (2,), (2,)], "r int")
    assert df.agg(rounded_avg("r", 2).alias("v")).collect()[0].v == Decimal("1.67")


def test_money_text_rounds_before_formatting(spark):
    rows = [(Decimal("1234567.5"),), (Decimal("2.5"),), (Decimal("-1234.565"),)]
    df = spark.createDataFrame(rows, "x decimal(18,3)")
    assert [r.v for r in df.select(money_text(F.col("x"), 0).alias("v")).collect()] == \
        ["Rp 1,234,568", "Rp 3", "Rp -1,235"]
    assert [r.v for r in df.select(money_text(F.col("x"), 2).alias("v")).collect()][2] == "Rp -1,234.57"


def test_sentence_case_is_not_initcap(spark):
    assert one(spark, sentence_case(F.col("x")), rows=[("JAKARTA SELATAN",), (None,)]) == ["Jakarta selatan", None]


def test_raw_dates(spark):
    got = one(spark, parse_raw_date(F.col("x")), rows=[("31/02/2026",), ("5/3/2026",), ("",), ("05/03/2026",)])
    assert [str(v) if v else None for v in got] == [None, "2026-03-05", None, "2026-03-05"]
    assert one(spark, weekday_name(parse_raw_date(F.col("x"))), rows=[("02/01/2026",)]) == ["Friday"]


def test_field_position_missing_and_null_are_zero(spark):
    got = one(spark, field_position(F.col("x"), ["Monday", "Tuesday"]), rows=[("Tuesday",), ("Sunday",), (None,)])
    assert got == [2, 0, 0]


def test_day_part_limits(spark):
    times = ["03:59:59", "04:00:00", "09:59:59", "10:00:00", "15:00:00", "18:00:00", "18:00:01", None, "x", "7:5:9"]
    want = ["Malam", "Pagi", "Pagi", "Siang", "Sore", "Sore", "Malam", "Malam", "Malam", "Pagi"]
    assert one(spark, day_part(F.col("x")), rows=[(t,) for t in times]) == want
    assert one(spark, seconds_of_day(F.col("x")), rows=[("25:00:00",)]) == [None]


def test_scale_settings(spark):
    from omnisales.session import input_bytes, scale_settings
    s = scale_settings(100 << 40, cores=8000)  # 100 TB on 1000 executors x 8 cores
    assert int(s["spark.sql.shuffle.partitions"]) == 102400
    assert int(scale_settings(1 << 20, cores=8)["spark.sql.shuffle.partitions"]) == 16
    assert input_bytes(spark, ["/root/testdata/sf0.001/nation.parquet"]) > 0
