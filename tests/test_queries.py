"""Every registered analysis against its DuckDB oracle, plus the reference's traps."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from compare import canon, duck  # noqa: E402

from omnisales.plans import customer, timeseries  # noqa: E402
from omnisales.plans.catalog import registry  # noqa: E402

from .conftest import sales_of  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(registry()))
def test_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    res = con.execute(entry.oracle_sql()[name])
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == \
        canon([d[0] for d in res.description], res.fetchall())


@pytest.mark.parametrize("name", ["q03_discount_band_repeat_rate", "q17_cohort_retention", "q18_rfm_segmentation",
                                  "q22_warehouse_status_panel", "q01_platform_profitability"])
def test_raw_path_equals_stored_path(spark, name):
    a = registry()[name]
    x, y = a.run(spark, SF, stored=True), a.run(spark, SF, stored=False)
    assert canon(x.columns, [tuple(r) for r in x.collect()]) == canon(y.columns, [tuple(r) for r in y.collect()])


def test_entry_smoke(spark):
    out = entry.entry(spark).collect()
    assert len(out) > 0 and {"Platform", "Margin_Percentage"} <= set(out[0].asDict())


def test_result_independent_of_partition_count(spark):
    a = registry()["q18_rfm_segmentation"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = sorted(map(tuple, a.run(spark, SF).collect()))
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        eight = sorted(map(tuple, a.run(spark, SF).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert one == eight


def test_cohort_month0_is_always_full(spark):
    for r in registry()["q17_cohort_retention"].run(spark, SF).collect():
        assert r.bulan_0 == "100%"


def test_cohort_years_merge_and_gaps(spark):
    rows = [{"transaction_id": "1", "customer_id": "A", "transaction_date": "10/01/2026"},
            {"transaction_id": "2", "customer_id": "A", "transaction_date": "10/03/2026"},
            {"transaction_id": "3", "customer_id": "B", "transaction_date": "10/02/2025"},
            {"transaction_id": "4", "customer_id": "B", "transaction_date": "10/02/2026"}]
    got = {r.Bulan_Akuisis: r for r in customer.cohort_counts(sales_of(spark, rows)).collect()}
    assert got["January"].total_user_baru == 1 and got["January"].bulan_2 == 1 and got["January"].bulan_1 == 0
    assert got["February"].total_user_baru == 1  # two Februaries of one customer merge
    assert got["March"].bulan_0 == 1


def test_weekday_growth_first_row_null_and_month_growth_no_data(spark):
    rows = [{"transaction_id": str(i), "transaction_date": d, "quantity": q}
            for i, (d, q) in enumerate([("05/01/2026", "10"), ("06/01/2026", "5"), ("06/02/2026", "0")])]
    s = sales_of(spark, rows)
    wk = {r.Day_of_Week: r.DoD_Growth_Percentage for r in timeseries.weekday_growth(s).collect()}
    assert wk["Monday"] is None and wk["Tuesday"] == "-50.00%"
    mo = {r.YearMonth: r for r in timeseries.month_growth(s).collect()}
    assert mo["2026-01"].MoM_Growth_Percentage == "New / No Data" and mo["2026-01"].Previous_Month_Sales == 0
    assert mo["2026-02"].MoM_Growth_Percentage == "-100.00%"


def test_month_growth_previous_zero_is_null(spark):
    rows = [{"transaction_id": "1", "transaction_date": "05/01/2026", "quantity": "0"},
            {"transaction_id": "2", "transaction_date": "05/02/2026", "quantity": "3"}]
    mo = {r.YearMonth: r for r in timeseries.month_growth(sales_of(spark, rows)).collect()}
    assert mo["2026-02"].MoM_Growth_Percentage is None


def test_moving_average_counts_rows_not_days(spark):
    rows = [{"transaction_id": "1", "transaction_date": "01/01/2026", "gross_sales": "100"},
            {"transaction_id": "2", "transaction_date": "10/01/2026", "gross_sales": "200"}]
    out = timeseries.revenue_moving_average(sales_of(spark, rows)).collect()
    assert str(out[1].Ma_7_Days) == "150.000000"


def test_shares_add_up(spark):
    for name in ["q14_gender_share", "q19_returned_flag_share", "q30_day_part_demand"]:
        vals = [int(r.Ratio.rstrip("%")) for r in registry()[name].run(spark, SF).collect()]
        assert 98 <= sum(vals) <= 102


def test_view_keeps_every_line_and_every_part(spark):
    from omnisales.sources.testdata import table
    from omnisales.plans.sales_view import testdata_sales
    view = testdata_sales(spark, SF)
    assert view.count() == table(spark, SF, "lineitem").count()
    assert view.filter("product_name IS NULL OR net_profit IS NULL OR customer_id IS NULL").count() == 0


def test_replaced_table_is_seen_in_the_same_session(spark, scratch_dir):
    import os
    import shutil

    from omnisales.plans.store import drop_old_copies, stored_sales
    folder = os.path.join(scratch_dir, "replaced")
    shutil.copytree("/root/testdata/sf0.001", folder, copy_function=shutil.copyfile)
    os.chmod(folder, 0o755)
    spark.read.parquet(f"{SF}/lineitem.parquet").write.parquet(f"{folder}/nested")
    os.replace(f"{folder}/lineitem.parquet", f"{folder}/old.parquet")
    os.makedirs(f"{folder}/lineitem.parquet/part=1")
    names = [n for n in os.listdir(f"{folder}/nested") if n.endswith(".parquet")]
    shutil.copy(f"{folder}/nested/{names[0]}", f"{folder}/lineitem.parquet/part=1/a.parquet")
    before = stored_sales(spark, folder).count()
    spark.read.parquet(f"{folder}/old.parquet").limit(3000).coalesce(1).write.parquet(f"{folder}/fewer")
    names = [n for n in os.listdir(f"{folder}/fewer") if n.endswith(".parquet")]
    shutil.copy(f"{folder}/fewer/{names[0]}", f"{folder}/lineitem.parquet/part=1/a.parquet")
    spark.catalog.refreshByPath(folder)
    assert before > 3000 and stored_sales(spark, folder).count() == 3000
    assert drop_old_copies(spark, folder) == 0  # yesterday's readers may still be at it
    assert drop_old_copies(spark, folder, older_than=0) == 1
    assert stored_sales(spark, folder).count() == 3000


@pytest.mark.parametrize("name, keys", [
    ("q18_rfm_segmentation", ("total_belanja",)), ("q12_skin_type_orders", ("Total_Sales",)),
])
def test_results_come_in_report_order(spark, name, keys):
    got = [tuple(r[k] for k in keys) for r in registry()[name].run(spark, SF).collect()]
    assert got == sorted(got, reverse=True)


def test_cohorts_come_in_listed_order(spark):
    months = [r.Bulan_Akuisis for r in registry()["q17_cohort_retention"].run(spark, SF).collect()]
    listed = ["January", "February", "March", "April", "May"]
    assert [m for m in months if m in listed] == listed and months[-5:] == listed
