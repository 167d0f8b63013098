"""Plan checks: no Python in the plans, pruned scans of the stored view, filters pushed to Parquet."""

import re

import pytest

from omnisales.plans.catalog import registry

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(registry()))
def test_plan_is_jvm_only_and_pruned(spark, name):
    plan = plan_of(registry()[name].run(spark, SF))
    assert not re.search(r"PythonUDF|BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas", plan)
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    assert scans, plan
    for cols in scans:
        most = 13 if "_set#" in cols else 11  # the roll-up: a few thousand rows
        assert "more fields" not in cols and cols.count(",") + 1 <= most, f"{name} reads too many columns: {cols}"


def test_status_filter_reaches_the_scan(spark):
    plan = plan_of(registry()["q22_warehouse_status_panel"].run(spark, SF))
    assert "PushedFilters: [In(delivery_status, [Cancelled,Delivered,Returned])]" in plan


def test_discount_filter_reaches_the_scan(spark):
    from pyspark.sql import functions as F

    from omnisales.plans.store import stored_sales
    df = stored_sales(spark, SF).select("discount_amount").filter(F.col("discount_amount") > 0)
    assert "GreaterThan(discount_amount,0" in plan_of(df)


def test_sql_over_the_registered_view(spark):
    from omnisales.plans import marketplace
    from omnisales.plans.sales_view import register_view
    from omnisales.plans.store import stored_sales
    register_view(stored_sales(spark, SF))
    sql = spark.sql("""
        SELECT platform AS Platform, SUM(gross_sales) AS Total_Revenue, SUM(net_profit) AS Total_Profit
        FROM sales_analysis GROUP BY platform""")
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", plan_of(sql))
    assert [{re.sub(r"#\d+L?$", "", c) for c in s.split(",")} for s in scans] == [{"platform", "gross_sales", "net_profit"}]
    want = {r.Platform: (r.Total_Revenue, r.Total_Profit)
            for r in marketplace.platform_profitability(stored_sales(spark, SF)).collect()}
    assert {r.Platform: (r.Total_Revenue, r.Total_Profit) for r in sql.collect()} == want


def _subtrees(plan: str, marker: str):
    """Text of every subtree whose root line contains ``marker``."""
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if marker in line:
            depth = len(line) - len(line.lstrip(" :+-|"))
            sub = []
            for nxt in lines[i + 1:]:
                if len(nxt) - len(nxt.lstrip(" :+-|")) <= depth:
                    break
                sub.append(nxt)
            yield "\n".join(sub)


@pytest.mark.parametrize("name", sorted(registry()))
def test_no_cross_join_and_no_raw_rows_into_one_partition(spark, name):
    df = registry()[name].run(spark, SF)
    df.collect()  # final adaptive plan
    plan = plan_of(df)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    for sub in _subtrees(plan, "Exchange SinglePartition"):
        assert re.search(r"HashAggregate|TakeOrderedAndProject|LocalLimit|FileScan parquet \[[^\]]*_set#", sub), \
            f"{name}: rows reach a single partition without aggregation:\n{sub}"


def test_single_partition_check_flags_a_raw_window(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from omnisales.plans.store import stored_sales
    bad = stored_sales(spark, SF).withColumn("r", F.row_number().over(Window.orderBy("gross_sales")))
    bad.collect()
    subs = list(_subtrees(plan_of(bad), "Exchange SinglePartition"))
    assert subs and not any(re.search(r"HashAggregate|TakeOrderedAndProject|LocalLimit", s)
                            for s in subs)
