"""A materialised copy of the sales view shared by all analyses.

Thirty-odd analyses read the same denormalised view. Re-running the
lineitem / orders / customer / nation / region / catalogue joins for each of
them would scan and shuffle the raw tables thirty times; instead the view is
written once as Parquet and every analysis scans only the columns it needs.

Copies live under the session's checkpoint folder (``spark.checkpoint.dir``,
a shared folder on a cluster), by input folder and by a fingerprint of its
files (path, length, modification time; listed again, recursively, on every
call), so changed input never meets an old copy. Each write goes to a folder
of its own and counts once its ``_SUCCESS`` marker exists: an interrupted
write is never read, and two applications that write at the same time leave
two whole copies instead of overwriting each other. Copies of earlier input
are removed a day after they were written.
"""

from __future__ import annotations

import hashlib
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.rollup import rollup, with_rollup
from ..session import ensure_checkpoint_dir, input_bytes, small_tasks
from ..sources.bucketed import KEYS, bucketed_tables
from ..sources.testdata import TABLES, table
from .incremental import ROW_GROUP_BYTES, clustered
from .sales_view import testdata_sales

# Catalogue fields carried beyond the 37 view columns (used by corrected variants).
EXTRA_FIELDS = ("reorder_point",)
KEEP_SECONDS = 24 * 3600
# Folder of the roll-up inside a copy; scans of the copy skip names like this.
ROLLUP = "_rollup"

# Scans of materialised copies, per (application, folder).
_READ: dict[tuple[str, str], DataFrame] = {}
# One writer per process: concurrent callers wait for the copy instead of writing it twice.
_WRITE_LOCK = threading.Lock()


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def facts_fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """Of the files of the bucketed tables only."""
    return fingerprint(spark, sf_dir, tuple(KEYS))


def fingerprint(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = TABLES) -> str:
    """Of all files of the tables the adapter reads, at any depth."""
    entries = []
    for name in tables:
        fs, p = _fs(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")
        files = fs.listFiles(p, True)
        while files.hasNext():
            st = files.next()
            entries.append(f"{st.getPath().toString()}|{st.getLen()}|{st.getModificationTime()}")
    return hashlib.sha1("\n".join(sorted(entries)).encode()).hexdigest()[:16]


def _input_folder(spark: SparkSession, sf_dir: str) -> str:
    name = hashlib.sha1(sf_dir.rstrip("/").encode()).hexdigest()[:16]
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/omnisales-sales-view/{name}"


def _newest_copy(spark: SparkSession, folder: str) -> str | None:
    """The last whole copy in a fingerprint's folder."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return None
    found = []
    for st in fs.listStatus(p):
        path = st.getPath().toString()
        marker_fs, marker = _fs(spark, f"{path}/_SUCCESS")
        if marker_fs.exists(marker):
            found.append((marker_fs.getFileStatus(marker).getModificationTime(), path))
    return max(found)[1] if found else None


def materialize_sales(spark: SparkSession, sf_dir: str, refresh: bool = False, buckets: int | None = None) -> str:
    """Write the sales view of ``sf_dir`` once per state of its files (Parquet) and return the copy's folder.

    ``refresh`` writes another copy beside the one there is; readers of that one are not disturbed. With ``buckets``
    the facts are read from tables bucketed by order (``sources.bucketed``, written where they are not there yet), for
    views that are built again and again, such as after changes of the smaller tables.
    """
    folder = f"{_input_folder(spark, sf_dir)}/{fingerprint(spark, sf_dir)}"
    path = None if refresh else _newest_copy(spark, folder)
    if path:
        return path
    with _WRITE_LOCK:
        path = None if refresh else _newest_copy(spark, folder)  # written by another caller meanwhile
        if path:
            return path
        path = f"{folder}/{uuid.uuid4().hex}"
        read = bucketed_tables(spark, sf_dir, buckets, facts_fingerprint(spark, sf_dir)) if buckets else table
        # Sorted in each file, so that filters on status or date skip row groups and pages; the joined rows are sorted,
        # and the view's columns derived from them as they are written.
        view = testdata_sales(spark, sf_dir, with_products=True, extra_product_fields=EXTRA_FIELDS, read=read,
                              arranged=clustered)
        # zstd: about a fifth smaller than snappy here at the same write and scan
        # speed, and every analysis scans this copy
        with small_tasks(spark, input_bytes(spark, [f"{sf_dir.rstrip('/')}/{name}.parquet" for name in TABLES])):
            (view.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES)
             .option("parquet.page.row.count.limit", 5000).parquet(path))  # small files have pages to skip, too
        rollup(spark.read.parquet(path)).write.parquet(f"{path}/{ROLLUP}")
    drop_old_copies(spark, sf_dir)
    return path


def drop_old_copies(spark: SparkSession, sf_dir: str, older_than: float = KEEP_SECONDS) -> int:
    """Remove copies of earlier states of ``sf_dir`` written more than ``older_than`` seconds ago; returns how many."""
    base = _input_folder(spark, sf_dir)
    now = fingerprint(spark, sf_dir)
    fs, p = _fs(spark, base)
    gone = 0
    for st in fs.listStatus(p) if fs.exists(p) else []:
        old = time.time() - st.getModificationTime() / 1000 >= older_than
        if st.getPath().getName() != now and old:
            gone += bool(fs.delete(st.getPath(), True))
    return gone


def stored_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sales view of ``sf_dir`` read from its materialised copy.

    The scan (file listing and footers) of a copy is reused within an
    application; changed input gives a new copy and so a new scan.
    """
    path = materialize_sales(spark, sf_dir)
    key = (spark.sparkContext.applicationId, path)
    if key not in _READ:
        sales = spark.read.parquet(path)
        marker_fs, marker = _fs(spark, f"{path}/{ROLLUP}/_SUCCESS")
        # A writer that was interrupted behind the view left no roll-up; analyses then group the view.
        _READ[key] = with_rollup(sales, spark.read.parquet(f"{path}/{ROLLUP}")) if marker_fs.exists(marker) else sales
    return _READ[key]
