"""The store that is kept up month by month, and what its layout lets scans skip."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from omnisales.plans import incremental
from omnisales.plans.incremental import SalesStore, clustered
from omnisales.plans.sales_view import sales_analysis
from omnisales.schema import PRODUCT_COLUMNS, TRANSACTION_COLUMNS
from omnisales.sources.files import read_products_csv, read_transactions_csv

from .conftest import BASE_PRODUCT, BASE_TX
from .test_prepare import write_csv

STATUSES = ["Delivered", "Returned", "Cancelled"]


def transactions(first, n, months, seed=0):
    rnd = random.Random(seed)
    return [{**BASE_TX, "transaction_id": str(first + i), "transaction_date": f"{rnd.randint(1, 28)}/{rnd.choice(months)}",
             "delivery_status": rnd.choice(STATUSES), "product_code": rnd.choice(["P1", "P2", "P9"])} for i in range(n)]


class Inputs:
    def __init__(self, spark, base):
        self.spark, self.base = spark, base
        self.tx, self.pc = f"{base}/tx", f"{base}/pc.csv"
        os.makedirs(self.tx)
        self.catalogue("Lip Two")
        self.store = SalesStore(spark, f"{base}/store", self.tx, self.pc)

    def file(self, name, rows):
        write_csv(f"{self.tx}/{name}", TRANSACTION_COLUMNS, rows)

    def catalogue(self, name):
        write_csv(self.pc, PRODUCT_COLUMNS, [BASE_PRODUCT, {**BASE_PRODUCT, "product_code": "P2", "product_name": name}])

    def check(self):
        """The store equals the view built at once from all files."""
        want = sales_analysis(read_transactions_csv(self.spark, self.tx), read_products_csv(self.spark, self.pc), ("reorder_point",))
        got = self.store.read()
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))

    def files_of(self, months):
        now = self.store.manifest().months
        return {m: sorted((n, os.path.getmtime(f"{now[m].removeprefix('file:')}/{n}")) for n in os.listdir(now[m].removeprefix("file:")))
                for m in months}


@pytest.fixture
def inputs(spark, tmp_path):
    return Inputs(spark, str(tmp_path))


def test_an_appended_file_rewrites_only_its_months(inputs):
    inputs.file("a.csv", transactions(0, 40, ["1/2026", "2/2026"]))
    inputs.file("b.csv", transactions(100, 30, ["2/2026", "3/2026"], 1))
    first = inputs.store.refresh()
    assert first.written == ["2026-01", "2026-02", "2026-03"] and len(first.read_files) == 2
    inputs.check()
    before, folders = inputs.files_of(["2026-01", "2026-02"]), inputs.store.manifest().months
    inputs.file("c.csv", transactions(200, 20, ["3/2026", "4/2026"], 2))
    done = inputs.store.refresh()
    assert done.written == ["2026-03", "2026-04"] and not done.removed
    assert [os.path.basename(p) for p in done.read_files] == ["b.csv", "c.csv"]  # a.csv has none of these months
    assert inputs.files_of(["2026-01", "2026-02"]) == before
    now = inputs.store.manifest().months
    assert {m: now[m] for m in before} == {m: folders[m] for m in before} and now["2026-03"] != folders["2026-03"]
    inputs.check()
    assert inputs.store.refresh() == incremental.Refresh([], [], [])
    assert inputs.store.manifest().version == 2


def test_changed_and_removed_files(inputs):
    inputs.file("a.csv", transactions(0, 10, ["1/2026"]))
    inputs.file("b c%.csv", transactions(50, 10, ["2/2026"]))
    inputs.store.refresh()
    inputs.file("b c%.csv", transactions(50, 12, ["5/2026"]))  # February is gone, May comes
    done = inputs.store.refresh()
    assert done.written == ["2026-05"] and done.removed == ["2026-02"]
    inputs.check()
    os.remove(f"{inputs.tx}/a.csv")
    done = inputs.store.refresh()
    assert done.written == [] and done.removed == ["2026-01"] and done.read_files == []
    inputs.check()


def test_a_changed_catalogue_rewrites_all(inputs):
    inputs.file("a.csv", transactions(0, 20, ["1/2026", "2/2026"]))
    inputs.store.refresh()
    inputs.catalogue("A longer name than before")
    assert inputs.store.refresh().written == ["2026-01", "2026-02"]
    inputs.check()


def test_rows_without_a_date_and_months_read_alone(inputs):
    rows = transactions(0, 20, ["1/2026", "2/2026"])
    rows[3]["transaction_date"], rows[4]["transaction_date"] = "", "31/31/2026"
    inputs.file("a.csv", rows)
    with pytest.warns(UserWarning):
        assert "unknown" in inputs.store.refresh().written
    with pytest.warns(UserWarning):
        inputs.check()
    assert inputs.store.read(["unknown"]).count() == 2 and inputs.store.read(["1999-01"]).count() == 0
    got = inputs.store.read(["2026-02", "unknown"])
    assert got.where("transaction_date is not null").select(F.month("transaction_date")).distinct().collect() == [(2,)]


def test_an_interrupted_refresh_leaves_the_former_copy(inputs, monkeypatch):
    inputs.file("a.csv", transactions(0, 20, ["1/2026"]))
    inputs.store.refresh()
    inputs.file("b.csv", transactions(30, 20, ["1/2026"]))
    monkeypatch.setattr(SalesStore, "_commit", lambda self, manifest: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        inputs.store.refresh()
    monkeypatch.undo()
    assert inputs.store.read().count() == 20 and inputs.store.manifest().version == 1
    assert inputs.store.refresh().written == ["2026-01"]
    inputs.check()


def test_two_refreshes_at_once(inputs, monkeypatch):
    inputs.file("a.csv", transactions(0, 20, ["1/2026"]))
    inputs.store.refresh()
    inputs.file("b.csv", transactions(30, 20, ["2/2026"]))
    other = SalesStore(inputs.spark, inputs.store.folder, inputs.tx, inputs.pc)
    real = SalesStore._write

    def write(self, paths, rows):
        out = real(self, paths, rows)
        if self is inputs.store:
            other.refresh()
        return out
    monkeypatch.setattr(SalesStore, "_write", write)
    with pytest.raises(RuntimeError, match="another refresh"):
        inputs.store.refresh()
    inputs.check()


def test_replaced_folders_are_removed_later(inputs, monkeypatch):
    inputs.file("a.csv", transactions(0, 20, ["1/2026", "2/2026"]))
    inputs.store.refresh()
    old = inputs.store.manifest().months["2026-01"].removeprefix("file:")
    inputs.file("b.csv", transactions(30, 5, ["1/2026", "2/2026"]))
    inputs.store.refresh()
    assert os.path.exists(old)  # readers of the first manifest may still be at it
    monkeypatch.setattr(incremental, "KEEP_SECONDS", -60)
    inputs.file("c.csv", transactions(40, 5, ["3/2026"]))
    inputs.store.refresh()
    assert not os.path.exists(old) and len(inputs.store._manifests()) == 1
    inputs.check()


def scanned_rows(df):
    """Rows that the file scan of an executed query handed on."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName().startswith("AdaptiveSparkPlan"):
        plan = plan.executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_filters_skip_row_groups_and_pages(spark, tmp_path):
    rows = spark.range(200_000).selectExpr(
        "id as transaction_id", "date_add(date'2020-01-01', cast(id * 7919 % 1400 as int)) as transaction_date",
        "element_at(array('Delivered', 'Returned', 'Cancelled', 'Delivered'), cast(id % 4 + 1 as int)) as delivery_status",
        "sha2(cast(id as string), 256) as filler").repartition(2)
    path = str(tmp_path / "clustered")
    clustered(rows).write.option("parquet.block.size", 1 << 20).parquet(path)
    one = spark.read.parquet(path).where("delivery_status = 'Returned'").select("filler")
    assert 50_000 <= scanned_rows(one) < 100_000
    both = spark.read.parquet(path).where("delivery_status = 'Returned' and transaction_date < date'2020-02-01'").select("filler")
    assert scanned_rows(both) < 25_000
    plain = str(tmp_path / "plain")
    rows.write.option("parquet.block.size", 1 << 20).parquet(plain)
    assert scanned_rows(spark.read.parquet(plain).where("delivery_status = 'Returned'").select("filler")) == 200_000


def test_the_test_tables_copy_skips_pages(spark):
    from omnisales.plans.store import stored_sales
    sales = stored_sales(spark, "/root/testdata/sf0.01")
    total = sales.count()
    assert scanned_rows(sales.where("delivery_status = 'Cancelled'").select("quantity")) < 0.9 * total
