"""Fact tables bucketed by their join key, so that the view's big join moves no row of them.

``lineitem`` and ``orders`` are written once, with the same number of buckets, as tables of the session's catalogue (in
its warehouse, a shared folder on a cluster). A join on the order key then pairs bucket with bucket: no exchange, and no
row of the larger table crosses the network however often the view is built. Each bucket is one sorted file. Orders get
their customers before that join; where customers are too many to broadcast, it is the orders that are moved back to
their buckets, not the lines.

Tables are named after their input's files, so changed input never meets old buckets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .testdata import table

#: The bucketed tables and their key.
KEYS = {"lineitem": "l_orderkey", "orders": "o_orderkey"}


def bucketed_tables(spark: SparkSession, sf_dir: str, buckets: int, fingerprint: str) -> Callable[[SparkSession, str, str], DataFrame]:
    """Write the buckets where they are not there yet; returns a reader of the test tables that takes these from them.

    ``fingerprint`` names the state of the input (``plans.store.fingerprint``). About 1 GB of lines a bucket is a good size.
    """
    names = {}
    for name, key in KEYS.items():
        names[name] = f"omnisales_{name}_{fingerprint}_{buckets}"
        if not spark.catalog.tableExists(names[name]):
            rows = table(spark, sf_dir, name).repartition(buckets, F.col(key))
            rows.write.bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(names[name])

    def read(session: SparkSession, folder: str, name: str) -> DataFrame:
        return session.table(names[name]) if name in names and folder == sf_dir else table(session, folder, name)
    return read


def drop_bucketed_tables(spark: SparkSession, fingerprint: str | None = None) -> list[str]:
    """Remove the buckets of one state of the input, or of all; returns the tables' names."""
    prefixes = tuple(f"omnisales_{name}_{fingerprint + '_' if fingerprint else ''}" for name in KEYS)
    found = [t.name for t in spark.catalog.listTables() if t.name.startswith(prefixes)]
    for name in found:
        spark.sql(f"DROP TABLE {name}")
    return found
