"""Tables written between steps, in the folder that all executors share."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a local master gets a folder of its own (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and spark.sparkContext.getCheckpointDir():
        folder = spark.sparkContext.getCheckpointDir().rsplit("/", 1)[0]
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="omnisales-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_SCOPE: contextvars.ContextVar[str] = contextvars.ContextVar("scope", default="")


def _steps_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/omnisales-llm/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no earlier run has used."""
    return f"{_steps_folder(spark)}/{_SCOPE.get()}{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def own_steps(spark: SparkSession, name: str) -> Iterator[None]:
    """Tables written inside go to a folder of their own, which is removed at the end: what is to last has to be written
    or read to its end inside, and its own table outside."""
    scope = f"{name}-{uuid.uuid4().hex}/"
    token = _SCOPE.set(scope)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        remove(spark, f"{_steps_folder(spark)}/{scope}")


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_steps(spark: SparkSession) -> None:
    """Remove all tables this application has written between steps; results that read them must have been read or
    written elsewhere before."""
    remove(spark, _steps_folder(spark))


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` computed once: written as Parquet to the shared folder and read again, which also cuts its lineage."""
    path = path or new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A batch function that gives its memory back to the system when its task ends: the Python worker lives on, idle
    or for the next stage, beside others in the same executor."""
    def go(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()
    return go


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_SHIPPED: set[str] = set()
#: Rows of an Arrow batch where the application has set no number: rows hold whole texts, and executor and worker both
#: hold a batch.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the Python workers (once an application), wherever the driver was started from, and
    have the session cut batches of texts small where it has Spark's default."""
    sc = spark.sparkContext
    if spark.conf.get(_BATCH) == "10000" and not sc.getConf().contains(_BATCH):
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="omnisales-package-")) / "omnisales_package.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)
