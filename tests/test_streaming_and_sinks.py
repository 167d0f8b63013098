import datetime
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from omnisales.plans.catalog import registry, run_on
from omnisales.plans.sales_view import sales_analysis
from omnisales.plans.store import stored_sales
from omnisales.schema import RAW_TRANSACTIONS, TRANSACTION_COLUMNS
from omnisales.sources.files import read_text_csv, read_transactions_csv
from omnisales.sources.prepare import prepare_products
from omnisales.sources.sinks import write_report, write_sales_table
from omnisales.sources.testdata import raw_products as adapter_products
from omnisales.sources.testdata import raw_transactions
from omnisales.streaming.ingest import read_ingested, read_rejects, start_ingest, write_batch
from tools.compare import canon

from .conftest import BASE_TX, raw_products, sales_of
from .test_prepare import write_csv


def test_streaming_ingest_is_incremental_and_exactly_once(spark, scratch_dir):
    src = os.path.join(scratch_dir, "incoming")
    table = os.path.join(scratch_dir, "tx_table")
    ckpt = os.path.join(scratch_dir, "tx_ckpt")
    os.makedirs(src)
    write_csv(os.path.join(src, "a.csv"), TRANSACTION_COLUMNS,
              [{**BASE_TX, "transaction_id": "1", "transaction_date": "01/01/2026"},
               {**BASE_TX, "transaction_id": "2", "transaction_date": "02/02/2026",
                "returned_flag": "Yes", "return_reason": "No"}])
    q = start_ingest(spark, src, table, ckpt)
    q.awaitTermination(120)
    assert read_ingested(spark, table).count() == 2
    write_csv(os.path.join(src, "b.csv"), TRANSACTION_COLUMNS,
              [{**BASE_TX, "transaction_id": "3", "transaction_date": "5/3/2026"}])
    q = start_ingest(spark, src, table, ckpt)  # a second run only takes the new file
    q.awaitTermination(120)
    tx = read_ingested(spark, table)
    rows = {r.transaction_id: r for r in tx.collect()}
    assert sorted(rows) == ["1", "2", "3"]
    assert rows["2"].return_reason == "Unknow" and str(rows["3"].temp_date) == "2026-03-05"
    view = sales_analysis(tx, prepare_products(raw_products(spark, [{}])))
    assert view.count() == 3 and len(view.columns) == 37


def test_streaming_writes_rejects_once(spark, scratch_dir):
    """'12,50' is no number: NULL in the table, the row as it came in the rejects, also when a batch runs again."""
    src, table, rejects, ckpt = (os.path.join(scratch_dir, f"rej_{n}") for n in ("in", "table", "rejects", "ckpt"))
    os.makedirs(src)
    rows = [{**BASE_TX, "transaction_id": "1", "gross_sales": '"12,50"'}, {**BASE_TX, "transaction_id": "2"},
            {**BASE_TX, "transaction_id": "3", "transaction_date": "2026-13-01"}, {**BASE_TX, "transaction_id": "4", "quantity": ""}]
    write_csv(os.path.join(src, "a.csv"), TRANSACTION_COLUMNS, rows)
    start_ingest(spark, src, table, ckpt, rejects_dir=rejects).awaitTermination(120)
    write_csv(os.path.join(src, "b.csv"), TRANSACTION_COLUMNS, [{**BASE_TX, "transaction_id": "5", "platform_fee": "x"}])
    start_ingest(spark, src, table, ckpt, rejects_dir=rejects).awaitTermination(120)

    def check():
        got = {r.transaction_id: r for r in read_ingested(spark, table).collect()}
        assert sorted(got) == ["1", "2", "3", "4", "5"] and read_ingested(spark, table).count() == 5
        assert got["1"].gross_sales is None and got["3"].temp_date is None and got["2"].gross_sales is not None
        bad = {r.transaction_id: r for r in read_rejects(spark, rejects).collect()}
        assert sorted(bad) == ["1", "3", "5"] and read_rejects(spark, rejects).count() == 3
        assert bad["1"].gross_sales == "12,50" and bad["1"].batch == 0 and bad["5"].batch == 1
    check()
    raw = read_text_csv(spark, os.path.join(src, "a.csv"), RAW_TRANSACTIONS)
    assert write_batch(raw, 0, table, rejects) == 2  # the first batch again, as after a failure before its commit
    check()


def test_report_sink_rejects_duplicate_names(spark, scratch_dir):
    df = spark.createDataFrame([(1, 2)], ["Ratio", "ratio"])
    with pytest.raises(ValueError):
        write_report(df, os.path.join(scratch_dir, "dup"))
    ok = spark.createDataFrame([(1, "a")], ["n", "s"])
    path = write_report(ok, os.path.join(scratch_dir, "rep.csv"), fmt="csv")
    assert spark.read.option("header", True).csv(path).count() == 1


def test_partitioned_sales_table_prunes_months(spark, scratch_dir):
    s = sales_of(spark, [{"transaction_id": "1", "transaction_date": "01/01/2026"},
                         {"transaction_id": "2", "transaction_date": "01/02/2026"}])
    path = write_sales_table(s, os.path.join(scratch_dir, "sales_tbl"))
    t = spark.read.parquet(path).filter("year_month = '2026-02'")
    assert "PartitionFilters: [isnotnull(year_month" in t._jdf.queryExecution().executedPlan().toString()
    assert [r.transaction_id for r in t.collect()] == ["2"]


def test_all_analyses_run_on_csv_sources(spark, scratch_dir):
    """The reference's own inputs (a transaction CSV and the catalogue CSV) through every analysis."""
    import random

    from omnisales.schema import PRODUCT_COLUMNS
    from omnisales.sources.files import read_products_csv, read_transactions_csv
    from .conftest import BASE_PRODUCT
    rnd = random.Random(4)
    tx_rows = [{**BASE_TX, "transaction_id": str(i), "customer_id": f"C{rnd.randint(1, 6)}",
                "transaction_date": f"{rnd.randint(1, 28)}/{rnd.randint(1, 6)}/2026",
                "product_code": rnd.choice(["P1", "P2", "P9"]), "quantity": str(rnd.randint(1, 3)),
                "discount_amount": rnd.choice(["0", "1000", "2500.5"]),
                "delivery_status": rnd.choice(["Delivered", "Returned", "Cancelled"])} for i in range(60)]
    tx_path = os.path.join(scratch_dir, "own_tx.csv")
    pc_path = os.path.join(scratch_dir, "own_pc.csv")
    write_csv(tx_path, TRANSACTION_COLUMNS, tx_rows)
    write_csv(pc_path, PRODUCT_COLUMNS, [BASE_PRODUCT, {**BASE_PRODUCT, "product_code": "P2", "product_name": "Lip Two"}])
    sales = sales_analysis(read_transactions_csv(spark, tx_path), read_products_csv(spark, pc_path),
                           extra_product_fields=("reorder_point",))
    results = run_on(sales, as_of=datetime.date(2026, 6, 30), min_spend=0)
    days = [r.hari_sejak_belanja_terakhir for r in results["q18_rfm_segmentation"].collect()]
    assert days and min(days) >= 0
    assert len(results) == 49
    for name, df in results.items():
        df.collect()  # every analysis runs on CSV-sourced data
    assert sum(r.Total_Sell for r in results["q02_campaign_performance"].collect()) == \
        sum(int(r["quantity"]) for r in tx_rows)


def test_command_line_lists_and_runs(spark, scratch_dir, capsys):
    from omnisales.__main__ import main
    main(["list"])
    listed = [line for line in capsys.readouterr().out.splitlines() if line.strip()]
    assert len(listed) == 50 and listed[0].startswith("s4_text_preparation")
    out = os.path.join(scratch_dir, "cli_reports")
    main(["run", "q20_delivery_status_share", "--tables", "/root/testdata/sf0.001", "--out", out])
    assert spark.read.option("header", True).csv(os.path.join(out, "q20_delivery_status_share")).count() == 3


def test_command_line_keeps_a_store(spark, scratch_dir, capsys):
    from omnisales.__main__ import main
    from omnisales.schema import PRODUCT_COLUMNS

    from .conftest import BASE_PRODUCT
    base = os.path.join(scratch_dir, "cli_store")
    os.makedirs(f"{base}/tx")
    write_csv(f"{base}/tx/a.csv", TRANSACTION_COLUMNS, [BASE_TX])
    write_csv(f"{base}/pc.csv", PRODUCT_COLUMNS, [BASE_PRODUCT])
    run = ["run", "q20_delivery_status_share", "--transactions", f"{base}/tx", "--products", f"{base}/pc.csv",
           "--store", f"{base}/store", "--as-of", "2026-06-30", "--min-spend", "0"]
    main(run)
    assert "1 months written" in capsys.readouterr().out
    main(run)
    assert "0 months written" in capsys.readouterr().out


def test_reference_style_csv_inputs_give_the_same_results(spark, scratch_dir):
    """Test tables exported as the reference's raw files (text dates d/m/yyyy, text money, BOM header),
    read back through the CSV sources: every analysis equals the Parquet path."""
    sf = "/root/testdata/sf0.001"
    tx = raw_transactions(spark, sf).withColumn("transaction_date", F.date_format("transaction_date", "dd/MM/yyyy"))
    tx_dir, pc_dir = os.path.join(scratch_dir, "ref_tx"), os.path.join(scratch_dir, "ref_pc")
    tx.select([F.col(c).cast("string") for c in tx.columns]).write.option("header", True).csv(tx_dir)
    adapter_products(spark, sf).select(*[F.col(c).cast("string") for c in adapter_products(spark, sf).columns]) \
        .coalesce(1).write.option("header", True).csv(pc_dir)
    part = [os.path.join(pc_dir, f) for f in os.listdir(pc_dir) if f.endswith(".csv")][0]
    pc_file = os.path.join(scratch_dir, "ref_catalogue.csv")
    with open(part, encoding="utf-8") as src, open(pc_file, "w", encoding="utf-8") as dst:
        dst.write("﻿" + src.read())  # the catalogue file starts with a BOM
    # the catalogue here lacks some of the 23 columns, so read it as the adapter's catalogue does
    cols = adapter_products(spark, sf).columns
    products = prepare_products(read_text_csv(spark, pc_file, StructType([StructField(c, StringType()) for c in cols])))
    csv_sales = sales_analysis(read_transactions_csv(spark, tx_dir), products, extra_product_fields=("reorder_point",))
    ids = {"q18_rfm_segmentation", "c2_rfm_segmentation_best_high", "n5_at_risk_high_value",
           "c4_restock_by_reorder_point"}  # their output carries ids, text on this path
    names = [n for n, a in registry().items() if n not in ids and not a.raw]
    from_csv, from_parquet = run_on(csv_sales, names), run_on(stored_sales(spark, sf), names)
    for n in names:
        a, b = from_csv[n], from_parquet[n]
        assert canon(a.columns, [tuple(r) for r in a.collect()]) == canon(b.columns, [tuple(r) for r in b.collect()]), n


def test_stream_refuses_a_reordered_header(spark, scratch_dir):
    src = os.path.join(scratch_dir, "reordered")
    os.makedirs(src)
    write_csv(os.path.join(src, "a.csv"), TRANSACTION_COLUMNS[1:] + TRANSACTION_COLUMNS[:1], [BASE_TX])
    q = start_ingest(spark, src, os.path.join(scratch_dir, "re_table"), os.path.join(scratch_dir, "re_ckpt"))
    with pytest.raises(Exception, match="STREAM_FAILED"):
        q.awaitTermination(120)


def test_analyses_need_their_parameters(spark):
    with pytest.raises(ValueError, match="as_of"):
        run_on(sales_of(spark, [{}]), ["q18_rfm_segmentation"])
    with pytest.raises(ValueError, match="min_spend"):
        run_on(sales_of(spark, [{}]), ["n5_at_risk_high_value"], as_of=datetime.date(2026, 3, 31))


def test_master_is_passed_unchanged(monkeypatch):
    from omnisales import session
    seen = []

    class Builder:
        def appName(self, _):
            return self

        def master(self, m):
            seen.append(m)
            return self

        def config(self, *_):
            return self

        def getOrCreate(self):
            return "session"

    monkeypatch.setattr(session, "SparkSession", type("S", (), {"builder": Builder(), "getActiveSession": staticmethod(lambda: None)}))
    monkeypatch.setattr(session, "ensure_checkpoint_dir", lambda s: "")
    assert session.cli_session("yarn") == "session" and seen == ["yarn"]
