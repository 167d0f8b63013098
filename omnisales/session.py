"""Spark session helpers.

The library never assumes a particular cluster: it reads the settings the
session already has and only fills in defaults that are unset (tests, bench).
"""

from __future__ import annotations

import contextlib
import math
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession

# Defaults for a fresh local session (tests / bench). On a cluster the
# cluster's own values win because ``builder.config`` is not used there.
LOCAL_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "omnisales",
                  driver_memory: str = "8g", extra: dict | None = None) -> SparkSession:
    """A local[N] session for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(LOCAL_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = driver_memory
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def cli_session(master: str | None) -> SparkSession:
    """The running session, or one for ``master`` (unchanged), or for the master that spark-submit set; else local[*]."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        builder = SparkSession.builder.appName("omnisales")
        if master or not SparkConf().contains("spark.master"):
            builder = builder.master(master or "local[*]")
        if (master or SparkConf().get("spark.master", "local")).startswith("local"):
            for key, value in LOCAL_DEFAULTS.items():
                builder = builder.config(key, value)
        spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make ``DataFrame.checkpoint()`` usable and return the folder in use.

    Order: a folder already set on the context, else ``spark.checkpoint.dir``
    from the session, else (local master only) a fresh scratch folder. A
    cluster without ``spark.checkpoint.dir`` is a configuration error: a
    machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS / object store) on a cluster")
    folder = tempfile.mkdtemp(prefix="omnisales-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(folder)
    return folder


def _steps_folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/omnisales-steps-{spark.sparkContext.applicationId}"


def stored_copy(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet below the shared checkpoint folder and read again.

    That cuts its lineage and computes it once; unlike an eager checkpoint it
    does not run the plan twice. The files survive executor loss. They are
    removed by ``drop_steps`` (or with the folder) once the results are read.
    """
    spark = df.sparkSession
    path = f"{_steps_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_steps(spark: SparkSession) -> None:
    """Remove this application's intermediate copies; results that read them must have been read or written before."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_steps_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def input_bytes(spark: SparkSession, paths: list[str]) -> int:
    """Total size of the files under ``paths`` (file system metadata only, no scan)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        total += p.getFileSystem(conf).getContentSummary(p).getLength()
    return total


def scale_settings(data_bytes: int, cores: int, split_bytes: int = 256 << 20,
                   shuffle_bytes_per_partition: int = 1 << 30) -> dict[str, str]:
    """Settings for a run over ``data_bytes`` of input on ``cores`` executor cores.

    * scan splits of ``split_bytes`` (256 MB: one task per split, a few per core);
    * shuffle partitions sized for the one big join (view build) at about 1 GB
      of shuffle input each, never fewer than 2 per core; AQE coalesces the
      small shuffles of the analyses down to ``advisory`` sized partitions and
      splits skewed join partitions;
    * the static broadcast threshold stays at Spark's default; Spark and AQE
      choose the broadcast side on bytes.
    """
    shuffle = max(2 * cores, math.ceil(data_bytes / shuffle_bytes_per_partition))
    return {
        "spark.sql.files.maxPartitionBytes": str(split_bytes),
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 << 20),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    }


def apply_settings(spark: SparkSession, settings: dict[str, str]) -> None:
    """Set runtime SQL settings on the session (they apply to the next query plans)."""
    for key, value in settings.items():
        spark.conf.set(key, value)


@contextlib.contextmanager
def small_tasks(spark: SparkSession, data_bytes: int, task_bytes: int = 32 << 20, input_bytes_per_partition: int = 4 << 20) -> Iterator[None]:
    """For a job over ``data_bytes`` of input that sorts and writes wide rows behind a shuffle.

    AQE joins shuffle partitions up to the advisory size, counted in compressed bytes; a sort of that many wide rows can
    take ten times as much and spill. Here partitions are made for ``input_bytes_per_partition`` of the input each and
    joined up to ``task_bytes``, so a task's memory stays the same however large the input is. Smaller advisory sizes and
    higher numbers of partitions of the session stay; its settings are put back at the end. Results do not depend on them.
    """
    initial, advisory = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = {key: spark.conf.get(key, None) for key in (initial, advisory)}
    partitions = max(int(before[initial] or shuffle_partitions(spark)), math.ceil(data_bytes / input_bytes_per_partition))
    least = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before[advisory] or f"{64 << 20}b")
    apply_settings(spark, {initial: str(partitions), advisory: str(min(least, task_bytes))})
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
