"""What the build of the stored view moves: narrow rows, in tasks of a size that does not grow with the input."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from omnisales.operators import rollup as R
from omnisales.plans import store
from omnisales.plans.incremental import clustered
from omnisales.plans.sales_view import testdata_sales as view_of
from omnisales.session import shuffle_partitions, small_tasks

INITIAL, ADVISORY = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
DERIVED = ("order_time", "campaign_name", "warehouse_origin", "membership_tier", "gross_sales", "net_profit", "city", "day_of_week")


@pytest.fixture
def tables(spark, tmp_path):
    """Orders without customers, lines without orders or products, keys that repeat and keys that are null."""
    day = dt.datetime(2000, 1, 1)
    rows = {
        "region": ("r_regionkey int, r_name string", [(0, "ASIA")]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(0, "JAPAN", 0), (1, "NOWHERE", 9)]),
        "customer": ("c_custkey long, c_nationkey int, c_mktsegment string", [(1, 0, "A"), (2, 1, "B"), (2, 0, "C")]),
        "part": ("p_partkey long, p_name string, p_type string, p_brand string, p_size int, p_retailprice double",
                 [(1, "one", "T", "X", 3, 10.5), (2, "two", "T", "Y", None, 20.0), (2, "twice", "U", "Y", 4, 2e7)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderpriority string",
                   [(1, 1, day, "1-URGENT"), (2, 2, None, "5-LOW"), (3, 7, day, None), (3, 1, day, "2-HIGH"), (None, 1, day, "3")]),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                     "l_discount double, l_tax double, l_returnflag string",
                     [(o, p, 4 * o + k if o else None, 1 + k, 2.0, 1e6 * k + 9.99, 0.05, 0.02, "RANX"[k])
                      for o in (1, 2, 3, 4, None) for p in (1, 2, 3, None) for k in range(4)])}
    for name, (schema, values) in rows.items():
        spark.createDataFrame(values, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_the_sort_before_the_write_holds_no_derived_column(spark, tables, monkeypatch):
    written = []
    whole = store.testdata_sales
    monkeypatch.setattr(store, "testdata_sales", lambda *a, **k: written.append(whole(*a, **k)) or written[0])
    store.materialize_sales(spark, tables)
    plan = written[0]._jdf.queryExecution().optimizedPlan()
    nodes = [plan.apply(i) for i in range(40) if plan.apply(i) is not None]
    sorts = [n for n in nodes if n.nodeName() == "Sort"]
    assert len(sorts) == 1 and "delivery_status" in sorts[0].simpleString(99)
    below = [sorts[0].output().apply(i).name() for i in range(sorts[0].output().size())]
    assert "l_extendedprice" in below and not set(DERIVED) & set(below)


def test_the_order_of_the_joins_does_not_change_the_view(spark, tables):
    def read(session, folder, name):
        return session.read.parquet(f"{folder}/{name}.parquet")

    extra = ("reorder_point",)
    lines_first, products_first = view_of(spark, tables, True, extra, read=read), view_of(spark, tables, True, extra, arranged=clustered)
    assert lines_first.dtypes == products_first.dtypes
    assert sorted(map(str, lines_first.collect())) == sorted(map(str, products_first.collect()))
    assert products_first.count() > spark.read.parquet(f"{tables}/lineitem.parquet").count()


def test_the_view_is_written_in_small_tasks(spark, tables, monkeypatch):
    seen = {}
    whole = store.small_tasks
    before = {k: spark.conf.get(k, None) for k in (INITIAL, ADVISORY)}

    def noted(session, data_bytes):
        seen["bytes"] = data_bytes
        return whole(session, data_bytes)

    monkeypatch.setattr(store, "small_tasks", noted)
    store.materialize_sales(spark, tables)
    assert seen["bytes"] > 0 and {k: spark.conf.get(k, None) for k in before} == before


def test_small_tasks_grow_in_number_with_the_input(spark):
    before = {k: spark.conf.get(k, None) for k in (INITIAL, ADVISORY)}
    with small_tasks(spark, 6 << 30):
        assert int(spark.conf.get(INITIAL)) == 1536 and int(spark.conf.get(ADVISORY)) == 32 << 20
    with pytest.raises(ValueError), small_tasks(spark, 1):
        assert int(spark.conf.get(INITIAL)) == shuffle_partitions(spark)
        raise ValueError
    assert {k: spark.conf.get(k, None) for k in before} == before
    spark.conf.set(ADVISORY, "8m")
    try:
        with small_tasks(spark, 1):
            assert int(spark.conf.get(ADVISORY)) == 8 << 20
        assert spark.conf.get(ADVISORY) == "8m"
    finally:
        spark.conf.unset(ADVISORY)


def test_rows_are_multiplied_by_the_bases_only(spark, tables):
    sales = spark.read.parquet(store.materialize_sales(spark, tables))
    plan = R.rollup(sales)._jdf.queryExecution().optimizedPlan()
    expands = [plan.apply(i) for i in range(40) if plan.apply(i) is not None and plan.apply(i).nodeName() == "Expand"]
    assert [e.projections().size() for e in expands] == [len(R.BASES)] and len(R.BASES) < len(R.SETS)
    assert all(any(set(s) <= set(b) for b in R.BASES) for s in R.SETS)


@pytest.mark.parametrize("amounts", [["999999.99", "-999999.99", "0.01"], ["1000000.00", "-1000000.00", "9999999999999999.99", "0.01"],
                                     ["1000000.00", "-9999999999999999.99"], [None, None], [None, "999999.99", "1000000.00"]])
def test_amounts_of_any_size_are_summed_exactly(spark, amounts):
    values = [(Decimal(a) if a else None,) for a in amounts]
    rows = spark.createDataFrame(values, "m decimal(18,2)")
    found = rows.agg(R._added("m", rows.schema["m"].dataType).alias("fast"), F.sum("m").alias("plain")).first()
    assert found["fast"] == found["plain"] == (sum(v for v, in values if v is not None) if any(amounts) else None)
