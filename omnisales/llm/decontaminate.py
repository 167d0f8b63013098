"""Benchmark passages in training documents, found with an FM-index per training shard.

A shard is a batch of whole documents that one task holds. Its words become symbols: one for each
word of the benchmark, and a single break for any stretch that no occurrence can touch (words the
benchmark doesn't have, document ends, and benchmark words in runs shorter than the shortest
phrase). Over these the task builds a suffix array, the Burrows-Wheeler transform with wavelet-tree
ranks and a sample of suffix positions. All phrases are searched backwards at once; occurrences are
located and merged into the word spans to remove. Documents aren't shuffled. The benchmark is the
query set: it comes in blocks of bounded size, one pass over the shards each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .fm_index import FMIndex
from .scratch import tidied
from .words import Words, byte_class, chunks, ranges

ALNUM = byte_class("alnum")
BREAK = 1
#: Phrases searched in one pass: about 20 MB that each task reads.
BLOCK_PHRASES = 100_000
#: A shard's index has at most about so many symbols, or one document's.
SHARD_SYMBOLS = 4_000_000

FOUND = "text string, n_words long, spans array<struct<start:long,end:long>>, items array<long>"
NAMES = ["carried", "text", "n_words", "spans", "items"]


@dataclass
class Phrases:
    """Distinct phrases as symbols (from 2; -1 fills shorter ones on the left) and the items each belongs to."""

    vocabulary: np.ndarray
    symbols: np.ndarray
    length: np.ndarray
    items: np.ndarray
    item_at: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None], ids: list[int], window: int) -> Phrases:
        words = Words(pa.array(texts, pa.string()), ALNUM, lower=True)
        vocabulary, symbol = np.unique(words.hashes(), return_inverse=True)
        found: dict[tuple[int, ...], set[int]] = {}
        for d, item in enumerate(ids):
            own = tuple((symbol[words.first[d]:words.first[d + 1]] + BREAK + 1).tolist())
            for i in range(max(1, len(own) - window + 1) if own else 0):
                found.setdefault(own[i:i + window], set()).add(item)
        symbols = np.full((len(found), window), -1, np.int64)
        for i, phrase in enumerate(found):
            symbols[i, window - len(phrase):] = phrase
        of = [sorted(x) for x in found.values()]
        return cls(vocabulary, symbols, np.array([len(p) for p in found], np.int64),
                   np.array([x for o in of for x in o], np.int64), np.cumsum([0] + [len(o) for o in of]))


def _reduced(words: Words, vocabulary: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a chunk with breaks between runs of at least ``shortest`` benchmark words; each symbol's word."""
    h = words.hashes()
    # A table over 16 bits of the hash leaves few words for the search.
    may = np.zeros(1 << 16, bool)
    may[vocabulary >> np.uint64(48)] = True
    at = np.flatnonzero(may[h >> np.uint64(48)])
    place = np.minimum(np.searchsorted(vocabulary, h[at]), len(vocabulary) - 1)
    at, place = at[vocabulary[place] == h[at]], place[vocabulary[place] == h[at]]
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = words.owner()[at]
    begins = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1] + 1) | (text[1:] != text[:-1]))))
    length = np.diff(np.append(begins, len(at)))
    begins, length = begins[length >= shortest], length[length >= shortest]
    take = ranges(begins, length + 1)
    ends = np.cumsum(length + 1) - 1
    symbol, word = np.append(place, 0)[take] + BREAK + 1, np.append(at, 0)[take]
    symbol[ends], word[ends] = BREAK, -1
    return symbol, word


def _shards(column: pa.Array, phrases: Phrases) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Row, word counts, symbols, and words by their number in the shard, for runs of whole documents."""
    shortest = int(phrases.length.min())
    row, size, base, counts, symbols, places = 0, 0, 0, [], [], []
    for begin, end in chunks(column):
        words = Words(column.slice(begin, end - begin), ALNUM, lower=True)
        symbol, word = _reduced(words, phrases.vocabulary, shortest)
        counts.append(words.count)
        symbols.append(symbol)
        places.append(word + base)
        base, size = base + len(words.start), size + len(symbol)
        if size >= SHARD_SYMBOLS or end == len(column):
            yield row, np.concatenate(counts), np.concatenate(symbols), np.concatenate(places)
            row, size, base, counts, symbols, places = end, 0, 0, [], [], []


def _find(phrases_of: Callable[[], Phrases], first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = phrases_of()
        for batch in batches:
            for row, count, symbols, places in _shards(batch.column(1), phrases):
                part = batch.slice(row, len(count))
                base = np.concatenate(([0], np.cumsum(count)))
                edge = np.zeros(base[-1] + 1, np.int64)
                pairs = np.zeros((0, 2), np.int64)
                if len(symbols):
                    index = FMIndex(symbols)
                    low, high = index.search(phrases.symbols)
                    hits = high - low
                    phrase = np.repeat(np.arange(len(hits)), hits)
                    word = places[index.locate(ranges(low, hits))]
                    np.add.at(edge, word, 1)
                    np.add.at(edge, word + phrases.length[phrase], -1)
                    doc = np.searchsorted(base, word, side="right") - 1
                    pair = np.unique(np.stack([doc, phrase], axis=1), axis=0)
                    n = np.diff(phrases.item_at)[pair[:, 1]]
                    item = phrases.items[ranges(phrases.item_at[pair[:, 1]], n)]
                    pairs = np.stack([np.repeat(pair[:, 0], n), item], axis=1)
                if not first:
                    old = part.column(3)
                    of = np.repeat(np.arange(len(count)), np.diff(old.offsets.to_numpy()))
                    spans = old.flatten()
                    np.add.at(edge, base[of] + spans.field("start").to_numpy(False), 1)
                    np.add.at(edge, base[of] + spans.field("end").to_numpy(False), -1)
                    of = np.repeat(np.arange(len(count)), np.diff(part.column(4).offsets.to_numpy()))
                    pairs = np.concatenate([pairs, np.stack([of, part.column(4).flatten().to_numpy(False)], axis=1)])
                pairs = np.unique(pairs, axis=0)
                hit = np.cumsum(edge[:-1]) > 0
                before, after = np.zeros(len(hit), bool), np.zeros(len(hit), bool)
                before[1:], after[:-1] = hit[:-1], hit[1:]
                start_of = base[:-1][count > 0]
                before[start_of] = False
                after[start_of[1:] - 1] = False
                begin, end = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after) + 1
                doc = np.searchsorted(base, begin, side="right") - 1
                spans = pa.StructArray.from_arrays([pa.array(begin - base[doc]), pa.array(end - base[doc])], ["start", "end"])
                at = np.arange(len(count) + 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(count, pa.int64()),
                     pa.ListArray.from_arrays(np.searchsorted(doc, at).astype(np.int32), spans),
                     pa.ListArray.from_arrays(np.searchsorted(pairs[:, 0], at).astype(np.int32), pa.array(pairs[:, 1]))],
                    NAMES)
    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Without any phrase: word counts, no spans, no items."""
    for batch in batches:
        for begin, end in chunks(batch.column(1)):
            part = batch.slice(begin, end - begin)
            none = pa.array([[]] * len(part), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(Words(part.column(1), ALNUM).count, pa.int64()), none,
                 pa.array([[]] * len(part), pa.list_(pa.int64()))], NAMES)


def _blocks(benchmark: DataFrame, window: int) -> Iterator[Phrases]:
    texts, ids, size = [], [], 0
    for r in benchmark.toLocalIterator():
        texts.append(r["text"])
        ids.append(r["item_id"])
        size += 1 + len(r["text"]) // 2
        if size >= BLOCK_PHRASES:
            yield Phrases.of(texts, ids, window)
            texts, ids, size = [], [], 0
    if texts:
        yield Phrases.of(texts, ids, window)


def _search(docs: DataFrame, carried: Column, text: Column, benchmark: DataFrame, window: int) -> DataFrame:
    """``carried`` (any value of a row), ``text``, ``n_words``, ``spans``, ``items`` of every row, in one pass a block."""
    out = docs.select(carried.alias("carried"), text.alias("text"))
    schema = StructType([out.schema["carried"], *StructType.fromDDL(FOUND).fields])
    items = (benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
             .where("item_id is not null and text is not null"))
    first = True
    for phrases in _blocks(items, window):
        if not len(phrases.length):
            continue
        sent = docs.sparkSession.sparkContext.broadcast(phrases)
        out = out.mapInArrow(tidied(_find(lambda sent=sent: sent.value, first)), schema)
        first = False
    return out.mapInArrow(_count, schema) if first else out


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``): ``doc_id``, ``text``, ``n_words``, ``spans``, ``items``.

    Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. A phrase is ``window``
    consecutive words of a benchmark item (``item_id``, ``text``), or all words of a shorter item. ``spans`` are the
    word ranges of the document that occurrences cover, merged; ``items`` the sorted ids of items with occurring
    phrases. Null text has no words; benchmark rows with null id or text count for nothing; rows that share an id,
    on either side, are judged one by one (documents) or together (items). Other columns are not read.
    """
    return _search(docs, F.col("doc_id").cast("long"), F.col("text"), benchmark, window).withColumnRenamed("carried", "doc_id")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no phrase of the benchmark (see ``find_contamination``)."""
    found = _search(docs, F.struct(*(docs[c] for c in docs.columns)), docs["text"], benchmark, window)
    return found.where(F.size("spans") == 0).select("carried.*")
