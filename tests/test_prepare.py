import os

import pytest
from pyspark.sql import functions as F

from omnisales.schema import PRODUCT_COLUMNS, TRANSACTION_COLUMNS, TRANSACTION_INTS, TRANSACTION_MONEY
from omnisales.sources.files import read_products_csv, read_transactions_csv
from omnisales.sources.prepare import clean_header, rejected_rows

from .conftest import BASE_PRODUCT, BASE_TX, sales_of


def write_csv(path, columns, rows, bom=True):
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(("﻿" if bom else "") + ",".join(columns) + "\n")
        for r in rows:
            fh.write(",".join("" if r.get(c) is None else str(r[c]) for c in columns) + "\n")


def test_bom_header_is_cleaned(spark):
    df = spark.createDataFrame([(1,)], ["﻿product_code"])
    assert clean_header(df).columns == ["product_code"]
    df2 = spark.createDataFrame([(1,)], ["ï»¿transaction_id"])
    assert clean_header(df2).columns == ["transaction_id"]


def test_csv_sources_with_bom_bad_dates_and_numbers(spark, scratch_dir):
    tx_path = os.path.join(scratch_dir, "tx.csv")
    rows = [{**BASE_TX, "transaction_id": "T1", "transaction_date": "31/02/2026"},
            {**BASE_TX, "transaction_id": "T2", "transaction_date": "5/3/2026", "gross_sales": "12.345"},
            {**BASE_TX, "transaction_id": "T3", "transaction_date": "", "gross_sales": "abc"}]
    write_csv(tx_path, TRANSACTION_COLUMNS, rows)
    tx = read_transactions_csv(spark, tx_path)
    assert tx.columns[0] == "transaction_id" and tx.columns[2] == "temp_date"
    got = {r.transaction_id: (r.temp_date, r.gross_sales) for r in tx.collect()}
    assert got["T1"][0] is None and str(got["T2"][0]) == "2026-03-05" and got["T3"][0] is None
    assert str(got["T2"][1]) == "12.35"  # half away from zero to 2 digits
    assert got["T3"][1] is None
    raw = spark.read.option("header", True).csv(tx_path)
    bad = rejected_rows(clean_header(raw), TRANSACTION_MONEY, TRANSACTION_INTS)
    assert sorted(r.transaction_id for r in bad.collect()) == ["T1", "T3"]  # an impossible date, a money text

    pc_path = os.path.join(scratch_dir, "pc.csv")
    write_csv(pc_path, PRODUCT_COLUMNS, [BASE_PRODUCT, {**BASE_PRODUCT, "product_code": "P2"}])
    products = read_products_csv(spark, pc_path)
    assert products.columns[0] == "product_code" and products.count() == 2


def test_duplicate_product_code_raises(spark, scratch_dir):
    pc_path = os.path.join(scratch_dir, "dup.csv")
    write_csv(pc_path, PRODUCT_COLUMNS, [BASE_PRODUCT, BASE_PRODUCT])
    with pytest.raises(ValueError):
        read_products_csv(spark, pc_path)


def test_return_reason_remap(spark):
    rows = [{"transaction_id": "a", "returned_flag": "Yes", "return_reason": "No"},
            {"transaction_id": "b", "returned_flag": "Yes", "return_reason": "Late"},
            {"transaction_id": "c", "returned_flag": "No", "return_reason": "No"},
            {"transaction_id": "d", "returned_flag": None, "return_reason": "No"}]
    s = sales_of(spark, rows)
    got = {r.transaction_id: r.return_reason for r in s.collect()}
    assert got == {"a": "Unknow", "b": "Late", "c": "No", "d": "No"}


def test_unmatched_product_keeps_row(spark):
    s = sales_of(spark, [{"transaction_id": "a", "product_code": "P1"}, {"transaction_id": "b", "product_code": "ZZ"}])
    got = {r.transaction_id: r for r in s.collect()}
    assert len(got) == 2
    assert got["b"].product_name is None and got["b"].net_profit is None
    # 100000 - 0 - 20000 - 5000 - 2000
    assert str(got["a"].net_profit) == "73000.00"
    assert got["a"].city == "Jakarta selatan" and got["a"].day_of_week == "Thursday"


def test_view_has_37_columns_in_order(spark):
    from omnisales.schema import VIEW_FACT_FIELDS, VIEW_PRODUCT_FIELDS
    cols = sales_of(spark, [{}]).columns
    assert len(cols) == 37
    assert cols == VIEW_FACT_FIELDS[:19] + ["net_profit"] + VIEW_FACT_FIELDS[19:] + VIEW_PRODUCT_FIELDS


def test_view_pushes_status_filter_into_scan(spark):
    from omnisales.plans.sales_view import testdata_sales
    df = testdata_sales(spark, "/root/testdata/sf0.001").filter(F.col("delivery_status") == "Cancelled") \
        .groupBy("platform").agg(F.sum("quantity"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan
    scan = [line for line in plan.splitlines() if "FileScan parquet [l_" in line][0]
    # the status filter runs in the lineitem scan, below every join
    assert "DataFilters: [CASE WHEN (l_returnflag" in scan


def test_parquet_transactions_and_drop_column(spark, scratch_dir):
    from omnisales.sources.files import read_transactions_parquet
    from omnisales.sources.prepare import drop_columns
    from .conftest import raw_tx
    path = os.path.join(scratch_dir, "raw_tx.parquet")
    raw_tx(spark, [{"transaction_id": "1", "transaction_date": "7/8/2026", "returned_flag": "Yes",
                    "return_reason": "No", "gross_sales": "10.005"}]).write.mode("overwrite").parquet(path)
    tx = read_transactions_parquet(spark, path)
    row = tx.collect()[0]
    assert str(row.temp_date) == "2026-08-07" and row.return_reason == "Unknow" and str(row.gross_sales) == "10.01"
    assert "return_reason" not in drop_columns(tx, "return_reason").columns


def test_csv_columns_are_taken_by_name(spark, scratch_dir):
    reordered = list(reversed(TRANSACTION_COLUMNS)) + ["extra_column"]
    path = os.path.join(scratch_dir, "reordered.csv")
    write_csv(path, reordered, [{**BASE_TX, "transaction_id": "R1", "quantity": "3", "extra_column": "x"}])
    row = read_transactions_csv(spark, path).collect()[0]
    assert row.transaction_id == "R1" and row.quantity == 3 and str(row.gross_sales) == "100000.00"
    short = os.path.join(scratch_dir, "short.csv")
    write_csv(short, TRANSACTION_COLUMNS[:-1], [BASE_TX])
    with pytest.raises(ValueError, match="product_code"):
        read_transactions_csv(spark, short)


def test_rejects_are_written_and_reported(spark, scratch_dir):
    path, rejects = os.path.join(scratch_dir, "bad_tx.csv"), os.path.join(scratch_dir, "rejects")
    write_csv(path, TRANSACTION_COLUMNS, [{**BASE_TX, "transaction_id": "T1", "gross_sales": "12;50"},
                                          {**BASE_TX, "transaction_id": "T2", "transaction_date": "31/02/2026"},
                                          {**BASE_TX, "transaction_id": "T3", "gross_sales": ""}])
    with pytest.warns(UserWarning, match="2 rows hold values that cannot be read"):
        tx = read_transactions_csv(spark, path, rejects)
    assert tx.count() == 3
    kept = {r.transaction_id: r for r in spark.read.parquet(rejects).collect()}
    assert sorted(kept) == ["T1", "T2"] and kept["T1"].gross_sales == "12;50"


def test_text_files_are_parsed_once(spark, scratch_dir):
    """The result reads the typed copy, not the CSV; rejects and their number come from the pass that wrote it."""
    path, rejects = os.path.join(scratch_dir, "once.csv"), os.path.join(scratch_dir, "once_rejects")
    write_csv(path, TRANSACTION_COLUMNS, [{**BASE_TX, "transaction_id": str(i), "quantity": "x" if i % 3 == 0 else "2"} for i in range(10)])
    with pytest.warns(UserWarning, match="4 rows"):
        tx = read_transactions_csv(spark, path, rejects)
    plan = tx._jdf.queryExecution().executedPlan().toString()
    assert "once.csv" not in plan and "parquet" in plan.lower()
    os.remove(path)
    assert tx.count() == 10 and tx.where("quantity is null").count() == 4
    assert {r.quantity for r in spark.read.parquet(rejects).collect()} == {"x"}
    assert "_raw" not in tx.columns
