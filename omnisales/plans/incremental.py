"""A sales view of one's own files that is kept up month by month.

``SalesStore`` holds the view of a folder of transaction files and a catalogue as Parquet, one folder a month. Its
manifest lists each input file with length, modification time and the months (with row numbers) it brings, and the
folder that is the current copy of each month. On ``refresh`` only files that are new, changed or gone are looked
at: the months they bring or brought are written again, from just the files that hold such months, and all other
months keep their folders. A changed catalogue touches every row, so it writes all months.

Each refresh writes to folders of its own and counts when its manifest is there. An interrupted one leaves the former
copy as it was; of two that run at the same time the second to finish fails instead of undoing the first. Readers go
on with the folders of the manifest they read; folders that no manifest of the last day names are removed.

Layout: a month's rows are dealt to files by transaction, so that no month is one task's work, and sorted by delivery
status and date, so that Parquet's statistics of row groups and pages let scans skip what a filter rules out.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import year_month
from ..sources.files import UNREADABLE, read_products_csv, scan_transactions_csv, warn_of_rejects
from .sales_view import sales_analysis

#: Rows of a month for each of its files, bytes of a row group, and how long replaced folders are kept for readers.
ROWS_A_FILE, ROW_GROUP_BYTES, KEEP_SECONDS = 4_000_000, 32 << 20, 24 * 3600
NO_MONTH = "unknown"
CLUSTER_BY = ("delivery_status", "transaction_date")
_MONTH, _FILE, _SPLIT = "_sales_month", "_source_file", "_split"


@dataclass(frozen=True)
class InputFile:
    path: str
    length: int
    modified: int


@dataclass
class Manifest:
    """``files``: by path its length, modification time and rows by month; ``months``: by month its folder."""

    version: int = 0
    catalogue: list = field(default_factory=list)
    files: dict[str, dict] = field(default_factory=dict)
    months: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Refresh:
    """What a refresh did: the months it wrote, those that are gone, and the input files it read for them."""

    written: list[str]
    removed: list[str]
    read_files: list[str]


def clustered(sales: DataFrame, *by: str) -> DataFrame:
    """Rows sorted inside each task's files, so that filters on these columns skip row groups and pages."""
    return sales.sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in by or CLUSTER_BY])


class SalesStore:
    """The sales view of ``transactions`` and ``catalogue`` (folders, files or globs) below ``folder``.

    ``read_transactions`` gives prepared transactions of some files, ``read_products`` the prepared catalogue; CSV files
    unless told otherwise. Transactions have to be a plain file scan, as rows are traced to their files; where they have
    the flag ``UNREADABLE``, the pass that looks at new files also counts such rows and warns of them.
    """

    def __init__(self, spark: SparkSession, folder: str, transactions: str, catalogue: str,
                 read_transactions: Callable[[SparkSession, list[str]], DataFrame] = scan_transactions_csv,
                 read_products: Callable[[SparkSession, str], DataFrame] = read_products_csv,
                 extra_product_fields: tuple[str, ...] = ("reorder_point",)):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.transactions, self.catalogue = transactions, catalogue
        self.read_transactions, self.read_products = read_transactions, read_products
        self.extra_product_fields = extra_product_fields

    # --- files

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _listed(self, path: str) -> list[InputFile]:
        """All data files below a folder, file or glob."""
        fs, p = self._fs(path)
        found = []
        for root in fs.globStatus(p) or []:
            files = fs.listFiles(root.getPath(), True)
            while files.hasNext():
                st = files.next()
                if not st.getPath().getName().startswith(("_", ".")):
                    found.append(InputFile(st.getPath().toString(), st.getLen(), st.getModificationTime()))
        return sorted(found, key=lambda f: f.path)

    # --- manifests

    def _manifests(self) -> list[tuple[int, str]]:
        fs, p = self._fs(f"{self.folder}/manifests")
        if not fs.exists(p):
            return []
        names = [(st.getPath().getName(), st.getPath().toString()) for st in fs.listStatus(p)]
        return sorted((int(n.removesuffix(".json")), path) for n, path in names if n.endswith(".json") and n[0].isdigit())

    def _read_manifest(self, path: str) -> Manifest:
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Manifest(**json.loads(text))

    def manifest(self) -> Manifest:
        """The newest manifest, or an empty one."""
        found = self._manifests()
        return self._read_manifest(found[-1][1]) if found else Manifest()

    def _commit(self, manifest: Manifest) -> None:
        """The manifest is written aside and renamed, which fails where that version exists already."""
        fs, aside = self._fs(f"{self.folder}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        try:
            out.write(bytearray(json.dumps(manifest.__dict__).encode()))
        finally:
            out.close()
        _, final = self._fs(f"{self.folder}/manifests/{manifest.version:08d}.json")
        if fs.exists(final) or not fs.rename(aside, final):
            fs.delete(aside, False)
            raise RuntimeError(f"{self.folder}: another refresh has finished meanwhile; run it again")

    # --- refresh

    def refresh(self) -> Refresh:
        """Bring the store up to the input files as they are now."""
        old = self.manifest()
        catalogue = [[f.path, f.length, f.modified] for f in self._listed(self.catalogue)]
        now = {f.path: f for f in self._listed(self.transactions)}
        renewed = old.version == 0 or catalogue != old.catalogue
        same = {p for p, f in now.items() if not renewed and p in old.files and [f.length, f.modified] == old.files[p]["state"]}
        changed = [p for p in now if p not in same]
        gone = [p for p in old.files if p not in now]
        if not changed and not gone and not renewed:
            return Refresh([], [], [])
        brought = self._rows_by_month(changed) if changed else {}
        files = {p: old.files[p] for p in same}
        files |= {p: {"state": [now[p].length, now[p].modified], "rows": brought.get(p, {})} for p in changed}
        touched = {m for p in changed for m in files[p]["rows"]}
        touched |= {m for p in old.files if p not in same for m in old.files[p]["rows"]}
        rows: dict[str, int] = {}
        for entry in files.values():
            for month, n in entry["rows"].items():
                if month in touched:
                    rows[month] = rows.get(month, 0) + n
        readers = sorted(p for p, entry in files.items() if touched & set(entry["rows"]))
        months = {m: path for m, path in old.months.items() if m not in touched}
        if rows:
            months |= self._write(readers, rows)
        self._commit(Manifest(old.version + 1, catalogue, files, months))
        self._drop_replaced()
        return Refresh(sorted(rows), sorted(set(old.months) - set(months)), readers)

    def _dated(self, paths: Sequence[str]) -> DataFrame:
        tx = self.read_transactions(self.spark, list(paths))
        return tx.withColumn(_MONTH, F.coalesce(year_month(F.col("temp_date")), F.lit(NO_MONTH)))

    def _rows_by_month(self, paths: list[str]) -> dict[str, dict[str, int]]:
        """By file and month; a row of counts for each, as many as the files' months."""
        tx = self._dated(paths)
        bad = F.col(UNREADABLE) if UNREADABLE in tx.columns else F.lit(False)
        counted = (tx.select(F.col("_metadata.file_path").alias(_FILE), _MONTH, bad.alias("bad")).groupBy(_FILE, _MONTH)
                   .agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad")).collect())
        if any(r["bad"] for r in counted):
            warn_of_rejects(self.transactions, sum(r["bad"] for r in counted))
        jvm = self.spark.sparkContext._jvm
        names = {jvm.org.apache.hadoop.fs.Path(p).toUri().getPath(): p for p in paths}
        found: dict[str, dict[str, int]] = {}
        for r in counted:  # Spark gives the path of a row as an escaped address
            found.setdefault(names[jvm.java.net.URI(r[_FILE]).getPath()], {})[r[_MONTH]] = r["n"]
        return found

    def _write(self, paths: list[str], rows: dict[str, int]) -> dict[str, str]:
        """The view of the months in ``rows``, from the files that hold them; by month its new folder."""
        tx = self._dated(paths).where(F.col(_MONTH).isin(*rows))
        products = self.read_products(self.spark, self.catalogue)
        view = sales_analysis(tx, products, self.extra_product_fields)
        month = F.coalesce(year_month(F.col("transaction_date")), F.lit(NO_MONTH))
        files = F.lit(1)
        for m, n in rows.items():
            if n > ROWS_A_FILE:
                files = F.when(F.col(_MONTH) == m, F.lit(-(-n // ROWS_A_FILE))).otherwise(files)
        dealt = view.withColumn(_MONTH, month).withColumn(_SPLIT, F.pmod(F.xxhash64("transaction_id"), files))
        dealt = clustered(dealt.repartition(_MONTH, _SPLIT), _MONTH, *CLUSTER_BY).drop(_SPLIT)
        at = f"{self.folder}/data/{uuid.uuid4().hex}"
        (dealt.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES)
         .partitionBy(_MONTH).parquet(at))
        return {m: f"{at}/{_MONTH}={m}" for m in rows}

    # --- reading

    def read(self, months: Sequence[str] | None = None) -> DataFrame:
        """The stored view, or the given months of it (``yyyy-MM``; ``unknown``: rows without a date)."""
        current = self.manifest().months
        wanted = sorted(current) if months is None else [m for m in months if m in current]
        if not current:
            raise ValueError(f"{self.folder} holds no sales; refresh it first")
        sales = self.spark.read.parquet(*[current[m] for m in wanted or sorted(current)[:1]])
        return sales if wanted else sales.limit(0)

    def _drop_replaced(self) -> None:
        """Remove manifests older than ``KEEP_SECONDS`` but the newest, and data folders that none left names."""
        found = self._manifests()
        fs, data = self._fs(f"{self.folder}/data")
        before = (time.time() - KEEP_SECONDS) * 1000
        kept = []
        for k, (_, path) in enumerate(found):
            _, p = self._fs(path)
            # A manifest was in use until the next one came.
            if k + 1 < len(found) and fs.getFileStatus(self._fs(found[k + 1][1])[1]).getModificationTime() < before:
                fs.delete(p, False)
            else:
                kept.append(path)
        named = {folder.rstrip("/").rsplit("/", 2)[-2] for path in kept for folder in self._read_manifest(path).months.values()}
        for st in fs.listStatus(data) if fs.exists(data) else []:
            if st.getPath().getName() not in named and st.getModificationTime() < before:
                fs.delete(st.getPath(), True)
