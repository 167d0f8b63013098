"""Removal of word passages that repeat across documents, by difference-cover anchors.

Two equal passages of ``window`` words need not start at the same position modulo
anything. A difference cover D modulo P mends that: for any two starts there is a
shift below P that takes both to positions in D. So only windows of
``window - P + 1`` words at positions in D (modulo P) are hashed, the anchors: two
equal passages of ``window`` words always have an equal pair of anchors, and 6 of
31 positions are enough for 50 words.

Texts that are whole copies of one with a smaller id are set aside by a digest first. Then three steps:

1. anchors: which of them occur in more than one document;
2. extension: around those, every full window gets a hash, and a window is removed
   where a document with a smaller id has an equal one;
3. the words under removed windows leave the text.

What one batch of documents settles for itself does not travel: of an anchor or
window that several documents of a batch hold, only one is sent on, so a passage
that a third of all documents share reaches the shuffle once per batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .words import Words, byte_class, chunks, mix, ranges, signed, window_hashes

#: Perfect difference sets: every difference modulo the period comes from one pair of members.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 6, 8, 18), 31: (1, 5, 11, 24, 25, 27)}
SPACE = byte_class("space")
OPEN = 1 << 31


def cover_for(window: int) -> tuple[int, np.ndarray]:
    """Period and cover for a window: anchors keep about two fifths of its words at least."""
    period = max(p for p in COVERS if p <= max(1, window * 5 // 8))
    return period, np.isin(np.arange(period), COVERS[period])


def _batch_words(column: pa.Array) -> Iterator[tuple[int, Words, np.ndarray, np.ndarray, np.ndarray]]:
    """By chunk: its first row, words, word hashes, each word's row in the chunk and position in its text."""
    for begin, end in chunks(column):
        words = Words(column.slice(begin, end - begin), SPACE)
        owner = words.owner()
        yield begin, words, words.hashes(), owner, np.arange(len(owner)) - words.first[owner]


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by key, where each group of equal keys starts in it, and the groups' sizes."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    return order, first, np.diff(np.append(first, len(k)))


def _least_doc(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """By entry: the smallest document with its key in this batch."""
    order, first, size = _groups(key)
    least = np.empty(len(key), np.int64)
    if len(key):
        least[order] = np.repeat(np.minimum.reduceat(doc[order], first), size)
    return least


def _runs(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs, ``same[i]`` telling whether entry i + 1 goes on with entry i."""
    n = len(same) + 1
    begins = np.flatnonzero(np.concatenate(([True], ~same)))
    return begins, np.diff(np.append(begins, n))


def _own_key(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A key of its own for an entry that needs no partner, so that such entries spread over all tasks."""
    return signed(mix(doc.astype(np.uint64) ^ mix(at.astype(np.uint64))))


def _where(print_: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """A word's place: 31 bits that tell texts of one id apart, and its position."""
    return (print_ << 32) | pos


def _anchors(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    period, cover = cover_for(window)
    size = window - period + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, prints = batch.column(0).to_numpy(False), batch.column(2).to_numpy(False)
            keys, docs, places = [], [], []
            for begin, words, h, owner, pos in _batch_words(batch.column(1)):
                w = window_hashes(h, size)
                n = len(w)
                long_enough = words.count >= window
                at = np.flatnonzero(cover[pos[:n] % period] & (pos[:n] + size <= words.count[owner[:n]])
                                    & long_enough[owner[:n]])
                row = begin + owner[at]
                keys.append(w[at])
                docs.append(ids[row])
                places.append(_where(prints[row], pos[at]))
            if not keys:
                continue
            key, doc, place = np.concatenate(keys), np.concatenate(docs), np.concatenate(places)
            # Keys that this batch has more than once, be it in one document, need no partner to be looked at.
            order, first, size_of = _groups(key)
            several = np.empty(len(key), bool)
            several[order] = np.repeat(size_of > 1, size_of)
            known, mark, open_ = np.flatnonzero(several), key[order[first[size_of > 1]]], np.flatnonzero(~several)
            out = pa.table({
                "key": np.concatenate([signed(key[open_]), _own_key(doc[known], place[known]), signed(mark)]),
                "doc": np.concatenate([doc[open_], doc[known], np.zeros(len(mark), np.int64)]),
                "place": np.concatenate([place[open_], place[known], np.full(len(mark), -1)]),
                "known": np.arange(len(open_) + len(known) + len(mark)) >= len(open_),
            })
            yield from out.to_batches(65536)
    return run


def _windows(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    period, _ = cover_for(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, prints, anchors = batch.column(0).to_numpy(False), batch.column(2).to_numpy(False), batch.column(3)
            keys, more, docs, places = [], [], [], []
            for begin, words, h, owner, pos in _batch_words(batch.column(1)):
                flat = anchors.slice(begin, len(words.count))
                hit = flat.flatten().to_numpy(False) & 0xFFFFFFFF
                base = words.first[:-1][np.repeat(np.arange(len(flat)), np.diff(flat.offsets.to_numpy()))]
                # A window that holds an anchor at p starts at p - period + 1 at the earliest.
                edge = np.zeros(len(h) + 1, np.int64)
                np.add.at(edge, base + np.maximum(hit - period + 1, 0), 1)
                np.add.at(edge, base + hit + 1, -1)
                w = window_hashes(h, window)
                n = len(w)
                at = np.flatnonzero((np.cumsum(edge[:n]) > 0) & (pos[:n] + window <= words.count[owner[:n]]))
                row = begin + owner[at]
                keys.append(w[at])
                more.append(window_hashes(h, window, 2)[at] >> np.uint64(32))
                docs.append(ids[row])
                places.append(_where(prints[row], pos[at]))
            if not keys:
                continue
            key, check = np.concatenate(keys), np.concatenate(more).astype(np.int64)
            doc, place = np.concatenate(docs), np.concatenate(places)
            least = _least_doc(mix(key ^ (check.astype(np.uint64) << np.uint64(32))), doc)
            # Settled windows go on as runs of consecutive starts; open ones as runs of equal windows (one word repeated).
            settled, open_ = np.flatnonzero(least < doc), np.flatnonzero(least == doc)
            if len(settled):
                d, p = doc[settled], place[settled]
                begins, lengths = _runs((p[1:] == p[:-1] + 1) & (d[1:] == d[:-1]))
                settled, settled_n = settled[begins], lengths
            else:
                settled_n = settled
            if len(open_):
                d, p, k, c = doc[open_], place[open_], key[open_], check[open_]
                begins, lengths = _runs((p[1:] == p[:-1] + 1) & (d[1:] == d[:-1]) & (k[1:] == k[:-1]) & (c[1:] == c[:-1]))
                open_, open_n = open_[begins], lengths
            else:
                open_n = open_
            out = pa.table({
                "key": np.concatenate([signed(key[open_]), _own_key(doc[settled], place[settled])]),
                "doc": np.concatenate([doc[open_], doc[settled]]),
                "place": np.concatenate([place[open_], place[settled]]),
                # The upper half: 32 more bits of the hash; the lower: OPEN for an open run, and the run's length.
                "extra": np.concatenate([(check[open_] << 32) | OPEN | open_n, settled_n]),
            })
            yield from out.to_batches(65536)
    return run


def _cut(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, spans, copies = batch.column(1), batch.column(2), batch.column(3).to_numpy(False)
            for begin, end in chunks(column):
                words = Words(column.slice(begin, end - begin), SPACE)
                part = spans.slice(begin, end - begin)
                if part.null_count:
                    part = part.fill_null(pa.scalar([], part.type))
                flat, size = part.flatten().to_numpy(False), np.diff(part.offsets.to_numpy())
                base = words.first[:-1][np.repeat(np.arange(len(part)), size)] + (flat >> 32)
                edge = np.zeros(len(words.start) + 1, np.int64)
                np.add.at(edge, base, 1)
                np.add.at(edge, base + (flat & 0xFFFFFFFF) + window - 1, -1)
                gone = (np.cumsum(edge[:-1]) > 0) | np.repeat(copies[begin:end] & (words.count >= window), words.count)
                total = np.concatenate(([0], np.cumsum(gone)))
                removed = total[words.first[1:]] - total[words.first[:-1]]
                stay = np.flatnonzero(~gone)
                length = words.end[stay] - words.start[stay] + 1
                text = np.append(words.data, np.uint8(0x20))[ranges(words.start[stay], length)]
                ends = np.cumsum(length)
                text[ends - 1] = 0x20
                left = words.count - removed
                last = np.cumsum(left)
                to = np.concatenate(([0], ends))[last]
                start = np.concatenate(([0], to[:-1]))
                joined = [text[a:b - 1 if b > a else b].tobytes() for a, b in zip(start, to, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, end - begin), pa.array(words.count, pa.int64()),
                     pa.array(removed, pa.int64()), pa.array(joined, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_text"])
    return run


def remove_repeated_passages(docs: DataFrame, window: int = 50, id_col: str = "doc_id",
                             text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_words``, ``n_removed``, ``kept_text`` (kept words joined by a space).

    A word goes if a window of ``window`` words around it also starts in a document with a smaller id; windows are
    judged on the input. Null text: no words. Null id: the row takes no part and is kept whole. Rows with the same id
    do not remove each other's words; each is judged by its own text. Other columns are not read. Texts are whole.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("print", F.crc32(F.col("text").cast("binary")).bitwiseAND(F.lit(0x7FFFFFFF)))
    # Both joins below are by these columns of the same rows, so their texts are shuffled once.
    base, row = rows.where("doc_id is not null"), ["doc_id", "print"]

    # A whole text that a smaller id also has: all its windows are known, it need not be searched.
    prints = base.select(*row, F.md5("text").alias("digest"))
    least = prints.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    copies = (prints.join(least.drop("most"), "digest").where("least < doc_id")
              .groupBy(*row).agg(F.lit(True).alias("copy")))
    anchors = base.join(copies, row, "left_anti").select("doc_id", "text", "print").mapInArrow(
        _anchors(window), "key long, doc long, place long, known boolean")
    same = Window.partitionBy("key")
    shared = (
        anchors.withColumn("hit", F.max("known").over(same)
                           | (F.min("doc").over(same) < F.max("doc").over(same)))
        .where("hit and place >= 0")
        .groupBy(F.col("doc").alias("doc_id"), F.shiftright("place", 32).alias("print"))
        .agg(F.collect_list("place").alias("anchors"))
    )
    windows = base.join(shared, row).select("doc_id", "text", "print", "anchors").mapInArrow(
        _windows(window), "key long, doc long, place long, extra long")
    settled = F.col("extra").bitwiseAND(F.lit(OPEN)) == 0
    equal = Window.partitionBy("key", F.shiftright("extra", 32))
    spans = (
        windows.withColumn("least", F.min("doc").over(equal))
        .where(settled | (F.col("least") < F.col("doc")))
        .select(F.col("doc").alias("doc_id"), F.shiftright("place", 32).alias("print"),
                (F.shiftleft(F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)), 32)
                 .bitwiseOR(F.col("extra").bitwiseAND(F.lit(OPEN - 1)))).alias("span"))
        .groupBy(*row).agg(F.collect_list("span").alias("spans"))
    )
    found = spans.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("spans", F.lit(None).cast("array<long>")))
    alone = rows.where("doc_id is null").select("doc_id", "text", F.lit(None).cast("array<long>").alias("spans"),
                                                F.lit(False).alias("copy"))
    judged = base.join(found, row, "left").select("doc_id", "text", "spans", F.coalesce("copy", F.lit(False)).alias("copy"))
    out = "doc_id long, n_words long, n_removed long, kept_text string"
    return judged.mapInArrow(_cut(window), out).union(alone.mapInArrow(_cut(window), out))
