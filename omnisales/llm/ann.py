"""Approximate nearest neighbours with a hash-prefix forest.

Each tree hashes a vector to a string of 32 bits, the signs of random projections of the centred vector.
A tree is the sorted array of these strings. A query descends in every tree to the longest prefix that it
shares with any entry; then all trees ascend together, one bit at a time, until the ranges under the
common prefix length hold enough entries. Entries that many trees hold are near: those that most trees hold are
compared exactly.

Rows are dealt to shards by a hash of the vector; a shard holds all trees over its vectors, so an index
never leaves a task. The number of shards grows with the square root of the rows, so that of (query,
shard) visits grows less than with their square. Queries come in blocks of bounded size that go to all
tasks; each block's result is written. Equal vectors are one entry with its smallest ids, as many as any
result can name: that loses nothing and bounds a vector that a third of all rows share.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import new_folder, written

BITS = 32
#: Trees; the entries summed over trees that end the ascent, and those of them that are compared, as shares of a shard.
#: Recall is measured with these on nearly unclustered vectors, the worst case; others need far less.
TREES, SHARE, COMPARED = 96, 6.0, 0.35
#: Shards: the square root of the rows over this; no shard has much more than MOST_ROWS.
ROWS_PER_ROOT, MOST_ROWS = 64, 500_000
#: Queries that go to all tasks at once.
QUERY_BLOCK = 10_000
#: Rows that the centre is estimated from.
CENTRE_SAMPLE = 10_000
OUT = "query_id long, vec_id long, score double"


def projections(dim: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, TREES * BITS)).astype(np.float32)


def strings(vectors: np.ndarray, centre: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Hash strings (rows by tree) as 32-bit numbers; the first projection is the highest bit."""
    out = np.empty((len(vectors), TREES), np.uint32)
    for a in range(0, len(vectors), 4096):
        signs = (vectors[a:a + 4096] - centre) @ planes > 0
        packed = np.packbits(signs.reshape(-1, TREES, BITS), axis=2)
        out[a:a + 4096] = np.ascontiguousarray(packed).view(">u4")[:, :, 0]
    return out


class Forest:
    def __init__(self, vectors: np.ndarray, centre: np.ndarray, planes: np.ndarray):
        keys = strings(vectors.astype(np.float32), centre, planes)
        self.order = np.argsort(keys, axis=0, kind="stable").astype(np.int32)
        self.keys = np.take_along_axis(keys, self.order, axis=0)

    def _ranges(self, queries: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By query and tree: the entries that share the first ``length`` bits with the query."""
        free = ((np.uint64(1) << (BITS - length).astype(np.uint64)) - np.uint64(1)).astype(np.uint32)[:, None]
        low, high = queries & ~free, queries | free
        begin, end = np.empty(queries.shape, np.int64), np.empty(queries.shape, np.int64)
        for t in range(TREES):
            column = np.ascontiguousarray(self.keys[:, t])
            begin[:, t] = np.searchsorted(column, low[:, t], "left")
            end[:, t] = np.searchsorted(column, high[:, t], "right")
        return begin, end

    def candidates(self, queries: np.ndarray, enough: int, compared: int) -> Iterator[np.ndarray]:
        """For each query string, of the entries under the longest common prefix length that yields enough of them in
        all trees, the ``compared`` ones that most trees hold, and those that as many hold."""
        low, high = np.zeros(len(queries), np.int64), np.full(len(queries), BITS, np.int64)
        while (low < high).any():  # the longest length with enough entries; 0 holds all
            middle = (low + high + 1) // 2
            begin, end = self._ranges(queries, middle)
            ok = (end - begin).sum(axis=1) >= enough
            low, high = np.where(ok, middle, low), np.where(ok, high, middle - 1)
        begin, end = self._ranges(queries, low)
        for q in range(len(queries)):
            held = np.concatenate([self.order[a:b, t] for t, (a, b) in enumerate(zip(begin[q], end[q], strict=True))])
            times = np.bincount(held, minlength=len(self.keys))
            least = 1
            if compared < len(times):
                least = max(int(np.partition(times, len(times) - compared)[len(times) - compared]), 1)
            yield np.flatnonzero(times >= least)


def _search(block: dict, k: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(shard: pd.DataFrame) -> pd.DataFrame:
        sent = block["sent"].value
        dim = int(shard["dim"].iloc[0])
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"),
                              "score": pd.Series(dtype="float64")})
        if dim not in sent:
            return empty
        ids, queries, centre = sent[dim]
        vectors = np.array(shard["vector"].tolist(), np.float64)
        members = shard["ids"].tolist()
        planes = projections(dim)
        forest = Forest(vectors, centre, planes)
        # So many entries are more than k + 1 different ones in any case.
        enough = min(TREES * len(vectors), max(TREES * 4 * (k + 1), math.ceil(SHARE * len(vectors))))
        compared = max(4 * (k + 1), math.ceil(COMPARED * len(vectors)))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        hashed = strings(queries.astype(np.float32), centre, planes)
        for q, entries in enumerate(forest.candidates(hashed, enough, compared)):
            distance = np.sqrt(((vectors[entries] - queries[q]) ** 2).sum(axis=1))
            if len(entries) > k + 1:  # all within the distance of the (k+1)-th: ties stay
                keep = distance <= np.partition(distance, k)[k]
                entries, distance = entries[keep], distance[keep]
            own = [members[e] for e in entries]
            vec = np.concatenate(own)
            score = np.repeat(distance, [len(m) for m in own])
            other = vec != ids[q]
            vec, score = vec[other], score[other]
            best = np.lexsort((vec, score))[:k]
            found.append((np.full(len(best), ids[q]), vec[best], score[best]))
        if not found:
            return empty
        query, vec, score = (np.concatenate(x) for x in zip(*found, strict=True))
        return pd.DataFrame({"query_id": query, "vec_id": vec, "score": score})
    return run


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id",
                       vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the ``k`` nearest found of each query, the own id left out.

    Nearness is Euclidean distance in double precision, ties go to the smaller id. Vectors that are null, zero or
    hold null or non-finite components, and rows with a null id, take no part on either side; vectors are compared
    with those of their own length. Rows that share an id: as queries one of them, the largest vector, is taken; as
    candidates all of them. Other columns are not read.
    """
    spark = vectors.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        return (df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
                .where("vec_id is not null and vector is not null").where(F.coalesce(finite, F.lit(False)))
                .where(F.exists("vector", lambda x: x != 0.0)))

    rows = usable(vectors)
    # Of equal vectors, the k + 1 smallest ids (a query is not its own result); limited before the shuffle, too.
    by_id = Window.partitionBy("vector").orderBy("vec_id")
    entries = (rows.distinct().withColumn("nth", F.row_number().over(by_id)).where(F.col("nth") <= k + 1)
               .groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
               .withColumn("dim", F.size("vector")))
    entries = written(entries, "vectors")
    n = entries.count()
    shards = max(1, math.ceil(max(math.sqrt(n) / ROWS_PER_ROOT, n / MOST_ROWS)))
    dealt = entries.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)))
    centres: dict[int, tuple[np.ndarray, int]] = {}
    for r in entries.orderBy(F.xxhash64("vector", F.lit(1))).limit(CENTRE_SAMPLE).select("vector", "dim").toLocalIterator():
        total, count = centres.get(r["dim"], (0.0, 0))
        centres[r["dim"]] = (total + np.array(r["vector"]), count + 1)
    found = []

    def search(block: list) -> None:
        sent = {}
        for dim in {len(v) for _, v in block}:
            own = [(i, v) for i, v in block if len(v) == dim]
            total, count = centres.get(dim, (np.zeros(dim), 1))
            sent[dim] = (np.array([i for i, _ in own], np.int64), np.array([v for _, v in own], np.float64),
                         (total / count).astype(np.float32))
        hits = dealt.groupBy("dim", "shard").applyInPandas(_search({"sent": spark.sparkContext.broadcast(sent)}, k), OUT)
        path = new_folder(spark, "neighbours")
        hits.write.parquet(path)
        found.append(path)

    block: list = []
    one = usable(queries).groupBy("vec_id").agg(F.max("vector").alias("vector"))
    for r in one.toLocalIterator():
        block.append((r["vec_id"], r["vector"]))
        if len(block) == QUERY_BLOCK:
            search(block)
            block = []
    if block or not found:
        search(block)
    hits = spark.read.schema(OUT).parquet(*found)
    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (hits.distinct().withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
