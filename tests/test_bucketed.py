"""The view's big join over bucketed tables: same rows, no exchange."""

from __future__ import annotations

import os
import re

import pytest

from omnisales.plans.sales_view import testdata_sales as view_of
from omnisales.plans.store import facts_fingerprint
from omnisales.sources.bucketed import bucketed_tables, drop_bucketed_tables
from omnisales.sources.testdata import raw_transactions

SF = "/root/testdata/sf0.01"


@pytest.fixture
def read(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    # Customers and smaller tables may be broadcast, orders may not.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(os.path.getsize(f"{SF}/orders.parquet") // 2))
    mark = facts_fingerprint(spark, SF)
    try:
        yield bucketed_tables(spark, SF, 4, mark)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        assert len(drop_bucketed_tables(spark, mark)) == 2


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(plan):
    return len(re.findall(r"Exchange hashpartitioning", plan))


def test_the_big_join_has_no_exchange(spark, read):
    bucketed, plain = plan_of(raw_transactions(spark, SF, read)), plan_of(raw_transactions(spark, SF))
    assert exchanges(plain) >= 2 and "SortMergeJoin" in plain
    assert exchanges(bucketed) == 0 and "SortMergeJoin" in bucketed
    assert "SelectedBucketsCount: 4 out of 4" in bucketed


def test_bucketed_tables_give_the_same_view(spark, read):
    bucketed, plain = view_of(spark, SF, read=read), view_of(spark, SF)
    assert bucketed.columns == plain.columns
    assert sorted(map(str, bucketed.collect())) == sorted(map(str, plain.collect()))


def test_buckets_are_written_once(spark, read):
    again = bucketed_tables(spark, SF, 4, facts_fingerprint(spark, SF))
    assert again(spark, SF, "orders").inputFiles() == read(spark, SF, "orders").inputFiles()
    assert len(read(spark, SF, "lineitem").inputFiles()) <= 4
    assert read(spark, SF, "customer").columns[0] == "c_custkey"
