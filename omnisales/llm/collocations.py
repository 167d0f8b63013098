"""Phrase collocations from depth-truncated suffix subtrees, partitioned vertically.

Every word begins a suffix of its piece of text; cut off at three words, the suffixes of all pieces form a tree whose
node counts are phrase counts. The tree is built in parts. Vertical partitioning: suffixes are divided by a hash of
their first word into buckets; the occurrences of each bucket are counted; a bucket over the memory budget is divided
again by the first two words, and one that is still over by all three (there, equal suffixes have become one leaf with
a count). Buckets are then put together to groups of about the budget. Each group's subtree is built by one task,
independently of the others: leaves sorted, equal beginnings are nodes, counts are sums over leaves. A word or
pair that is divided over groups gets its total as the sum of theirs.

Tasks send leaves with counts, as numbers into a short list of word hashes that each message carries along. Words are
told apart by 64-bit hashes of language and word; the text of a word travels beside them. Candidates, their parts and
their scores are joins of the counted nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import tidied, written
from .words import U64, Words, chunks, mix, signed

DEPTH = 3
#: Suffix occurrences of a group, and of a task before it sends what it has.
BUDGET, STORE = 1 << 19, 1 << 20
#: Buckets for each group's worth of occurrences, and the bounds on their number (as a power of two). A task counts at
#: most as many buckets as it has distinct words.
FINENESS, LEAST_BITS, MOST_BITS = 16, 16, 22
#: Bytes of text for each word at least, to choose the number of buckets by.
BYTES_A_WORD = 5
_SECOND, _THIRD = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
_KEPT = ~_BREAK
_KEPT[[0x20, 0x09]] = False

LEAVES = "level int, group long, lang string, vocabulary binary, words binary, width int, leaves binary, counts binary"
NODES = "depth int, lang string, a long, b long, c long, word string, n long"


def _salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class Suffixes:
    """The suffixes of one chunk: ``first``, ``second``, ``third`` word hashes (0: the piece ended), language codes."""

    def __init__(self, texts: pa.Array, langs: list[int], salts: np.ndarray):
        self.words = words = Words(texts, _KEPT, lower=True)
        owner = words.owner()
        self.lang = np.asarray(langs, np.int64)[owner]
        self.first = mix(words.hashes() ^ salts[self.lang])
        self.first[self.first == 0] = U64(1)
        breaks = np.concatenate(([0], np.cumsum(_BREAK[words.data])))
        n = len(self.first)
        self.joined = np.zeros(n, bool)  # the next word is in the same piece
        if n:
            self.joined[:-1] = (breaks[words.start[1:]] == breaks[words.end[:-1]]) & (owner[1:] == owner[:-1])

    def columns(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first, second, third = self.first, np.zeros_like(self.first), np.zeros_like(self.first)
        second[:-1] = np.where(self.joined[:-1], first[1:], U64(0))
        third[:-1] = np.where(self.joined[:-1], second[1:], U64(0))
        return first, second, third


def _chunk_suffixes(batches: Iterator[pa.RecordBatch], langs: dict[str, int]) -> Iterator[Suffixes]:
    """Suffixes of columns (text, lang), chunk by chunk; languages are numbered as they come."""
    for batch in batches:
        codes = [langs.setdefault(lang, len(langs)) for lang in batch.column(1).to_pylist()]
        salts = np.array([_salt(lang) for lang in langs], U64)
        for begin, end in chunks(batch.column(0)):
            yield Suffixes(batch.column(0).slice(begin, end - begin), codes[begin:end], salts)


def _bucket(level: int, first: np.ndarray, second: np.ndarray, third: np.ndarray, bits: int) -> np.ndarray:
    h = first
    if level > 1:
        h = mix(h + second * _SECOND)
    if level > 2:
        h = mix(h + third * _THIRD)
    return (h >> U64(64 - bits)).astype(np.int64)


class Partitioning:
    """By level, the group of each bucket; -1: the bucket is over the budget and divided at the next level."""

    def __init__(self, bits: int):
        self.bits, self.groups, self.n_groups = bits, [], 0

    def add(self, counts: np.ndarray, budget: int) -> bool:
        """Groups for a further level from the occurrences by bucket. True if buckets remain over the budget."""
        over = (counts > budget) & (len(self.groups) + 1 < DEPTH)
        before = np.concatenate(([0], np.cumsum(np.where(over, 0, counts))[:-1]))
        number = np.cumsum(np.concatenate(([False], before[1:] // budget != before[:-1] // budget)))
        self.groups.append(np.where(over, -1, self.n_groups + number))
        self.n_groups += int(number[-1]) + 1
        return bool(over.any())

    def of(self, *suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Group and level of each suffix; group -1 where a further level has to be counted first."""
        n = len(suffixes[0])
        group, level = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        open_ = np.arange(n)
        for k, groups in enumerate(self.groups, 1):
            got = groups[_bucket(k, *(s[open_] for s in suffixes), self.bits)]
            group[open_], level[open_] = got, k
            open_ = open_[got < 0]
        return group, level


def _histogram(known: Callable[[], Partitioning]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Occurrences by bucket of the level that comes next, of the suffixes that no level before has placed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = known()
        total = np.zeros(1 << parts.bits, np.int64)
        for s in _chunk_suffixes(batches, {}):
            columns = s.columns()
            open_ = parts.of(*columns)[0] < 0
            total += np.bincount(_bucket(len(parts.groups) + 1, *(c[open_] for c in columns), parts.bits), minlength=len(total))
        seen = np.flatnonzero(total)
        yield from pa.table({"bucket": seen, "n": total[seen]}).to_batches(65536)
    return run


class Store:
    """Suffixes of a task until they are sent: word numbers, and the text of each word."""

    def __init__(self, parts: Partitioning):
        self.parts, self.words, self.held, self.n = parts, {}, [], 0

    def add(self, s: Suffixes) -> None:
        uniq, at = np.unique(s.first, return_index=True)
        w = s.words
        for h, start, end in zip(uniq.tolist(), w.start[at].tolist(), w.end[at].tolist(), strict=True):
            if h not in self.words:
                self.words[h] = w.data[start:end].tobytes()
        self.held.append((s.first, s.joined, s.lang.astype(np.int32)))
        self.n += len(s.first)

    def flush(self, langs: list[str]) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        first, joined, lang = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held = []
        vocabulary, number = np.unique(first, return_inverse=True)
        vocabulary, number = np.concatenate((np.zeros(1, U64), vocabulary)), number.astype(np.int32) + 1  # 0: the piece ended
        second = np.zeros_like(number)
        second[:-1] = np.where(joined[:-1], number[1:], 0)
        third = np.zeros_like(number)
        third[:-1] = np.where(joined[:-1], second[1:], 0)
        width = max(len(vocabulary) - 1, 1).bit_length()
        if 3 * width > 63:
            raise ValueError("more words in a task's store than it can number")
        leaf = (number.astype(np.int64) << 2 * width) | (second.astype(np.int64) << width) | third
        order = np.argsort(leaf)
        leaf = leaf[order]
        new = np.flatnonzero(np.concatenate(([True], leaf[1:] != leaf[:-1])))
        count = np.diff(np.append(new, len(leaf)))
        some = order[new]  # one occurrence of each leaf, in the order of the leaves
        i, j, k, lang = number[some], second[some], third[some], lang[some]
        del first, number, second, third, leaf, order, new, some
        group, level = self.parts.of(vocabulary[i], vocabulary[j], vocabulary[k])
        by = np.lexsort((lang, group))
        cut = np.flatnonzero(np.concatenate(([True], (group[by][1:] != group[by][:-1]) | (lang[by][1:] != lang[by][:-1]))))
        place, rows = np.zeros(len(vocabulary), np.int64), []
        for a, b in zip(cut.tolist(), np.append(cut[1:], len(by)).tolist(), strict=True):
            own = by[a:b]
            mark = np.zeros(len(vocabulary), bool)
            for numbers in (i[own], j[own], k[own]):
                mark[numbers] = True
            mark[0] = True
            used = np.flatnonzero(mark)
            place[used] = np.arange(len(used))
            kind = np.uint16 if len(used) <= 1 << 16 else np.uint32
            heads = np.unique(i[own])
            text = b"\n".join(self.words[h] for h in vocabulary[heads].tolist())
            rows.append((int(level[own[0]]), int(group[own[0]]), langs[int(lang[own[0]])], vocabulary[used].tobytes(), text,
                         np.dtype(kind).itemsize, np.concatenate([place[x[own]] for x in (i, j, k)]).astype(kind).tobytes(),
                         _packed(count[own])))
        self.words, self.n = {}, 0
        types = [pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
        names = ["level", "group", "lang", "vocabulary", "words", "width", "leaves", "counts"]
        for a in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a:a + 64], strict=True), types, strict=True)], names)


def _packed(count: np.ndarray) -> bytes:
    """Counts in one byte each where they are small (the first byte tells their size)."""
    kind = np.uint8 if count.max() < 1 << 8 else np.int64
    return bytes([np.dtype(kind).itemsize]) + count.astype(kind).tobytes()


def _send(known: Callable[[], Partitioning]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, langs = Store(known()), {}
        for s in _chunk_suffixes(batches, langs):
            if store.n and store.n + len(s.first) > STORE:
                yield from store.flush(list(langs))
            store.add(s)
        yield from store.flush(list(langs))
    return run


def _unpacked(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, dict[int, tuple[str, str]]]:
    """Columns of word hashes, counts, and (language, word) of each first word."""
    columns: list[list[np.ndarray]] = [[], [], []]
    counts, heads = [], {}
    for lang, vocabulary, words, width, leaves, count in zip(
            *(table[c].to_pylist() for c in ("lang", "vocabulary", "words", "width", "leaves", "counts")), strict=True):
        vocabulary = np.frombuffer(vocabulary, U64)
        numbers = np.frombuffer(leaves, np.uint16 if width == 2 else np.uint32).reshape(3, -1)
        for held, column in zip(columns, numbers, strict=True):
            held.append(vocabulary[column])
        counts.append(np.frombuffer(count[1:], np.uint8 if count[0] == 1 else np.int64).astype(np.int64))
        own = vocabulary[np.unique(numbers[0])].tolist()  # numbers follow the order of the hashes
        heads.update(zip(own, ((lang, w.decode()) for w in words.split(b"\n")), strict=True))
    return [np.concatenate(c) for c in columns], np.concatenate(counts), heads


def _subtree(least: int) -> Callable[[pa.Table], pa.Table]:
    """Nodes of a group's subtree with counts. Those that lie whole in the group only from ``least`` on; those above the
    group's own level are parts and all go out. Depth 0: the occurrences by language."""
    def run(table: pa.Table) -> pa.Table:
        level = table["level"][0].as_py()
        (a, b, c), n, heads = _unpacked(table)
        order = np.lexsort((c, b, a))
        a, b, c, n = a[order], b[order], c[order], n[order]
        found = []
        changed = np.zeros(len(a), bool)
        changed[:1] = True
        for depth, column in enumerate((a, b, c), 1):
            changed[1:] |= column[1:] != column[:-1]
            starts = np.flatnonzero(changed)
            total = np.add.reduceat(n, starts)
            keep = (column[starts] != 0) & ((depth < level) | (total >= least))
            starts, total = starts[keep], total[keep]
            told = [heads[h] if depth == 1 else (None, None) for h in a[starts].tolist()]
            none = np.zeros(len(starts), U64)
            found.append(pa.table({
                "depth": pa.array(np.full(len(starts), depth), pa.int32()), "lang": pa.array([x for x, _ in told], pa.string()),
                "a": signed(a[starts]), "b": signed(b[starts] if depth > 1 else none), "c": signed(c[starts] if depth > 2 else none),
                "word": pa.array([x for _, x in told], pa.string()), "n": total}))
        totals: dict[str, int] = {}
        firsts, at = np.unique(a, return_index=True)
        for h, total in zip(firsts.tolist(), np.add.reduceat(n, at).tolist(), strict=True):
            totals[heads[h][0]] = totals.get(heads[h][0], 0) + total
        zero = pa.array([0] * len(totals), pa.int64())
        found.append(pa.table({"depth": pa.array([0] * len(totals), pa.int32()), "lang": pa.array(totals.keys(), pa.string()),
                               "a": zero, "b": zero, "c": zero, "word": pa.nulls(len(totals), pa.string()),
                               "n": pa.array(totals.values(), pa.int64())}))
        return pa.concat_tables(found)
    return run


def _partition(rows: DataFrame, budget: int) -> Partitioning:
    """Counts occurrences level by level until no bucket is over the budget. At most 2**MOST_BITS counts reach the driver."""
    spark = rows.sparkSession
    words = (rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0) // BYTES_A_WORD
    bits = min(max((FINENESS * words // budget).bit_length(), LEAST_BITS), MOST_BITS)
    budget = max(budget, 4 * words >> bits)
    parts, more = Partitioning(bits), True
    while more:
        sent = spark.sparkContext.broadcast(parts)
        counted = (rows.mapInArrow(tidied(lambda batches, sent=sent: _histogram(lambda: sent.value)(batches)), "bucket long, n long")
                   .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow())
        counts = np.zeros(1 << bits, np.int64)
        counts[counted["bucket"].to_numpy()] = counted["n"].to_numpy()
        more = parts.add(counts, budget)
    return parts


def phrase_nodes(rows: DataFrame, least: int, budget: int = BUDGET) -> DataFrame:
    """Counted phrases of ``rows`` (``text``, ``lang``; no nulls): ``depth`` 1 to 3, the words' hashes ``a``, ``b``, ``c``,
    ``n``, and ``lang`` and ``word`` at depth 1. Phrases of fewer than ``least`` occurrences are left out. Depth 0: words
    of each ``lang`` in all."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(_partition(rows, budget))
    leaves = rows.mapInArrow(tidied(lambda batches: _send(lambda: sent.value)(batches)), LEAVES)
    nodes = leaves.groupBy("group").applyInArrow(_subtree(least), NODES)
    whole = (nodes.groupBy("depth", "a", "b", "c", F.when(F.col("depth") == 0, F.col("lang")).alias("of"))
             .agg(F.sum("n").alias("n"), F.first("lang", ignorenulls=True).alias("lang"), F.first("word", ignorenulls=True).alias("word"))
             .where((F.col("depth") == 0) | (F.col("n") >= least)).drop("of"))
    return written(whole, "phrases")


def _exact_score(a: str, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exact: products of up to 38 digits."""
    wide = "decimal(19,0)"
    top = F.col(a).cast(wide) * F.col(a).cast(wide) * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", top, left.cast(wide) * right.cast(wide))


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, covered_percent: int = 50, budget: int = BUDGET,
                 text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The best phrases of two and three words in each language: ``lang``, ``rank`` (from 1), ``phrase``, ``a``, ``l``,
    ``r``, ``n``, ``score``.

    Texts are lower-cased (A-Z) and split to pieces at ``. , ; : ! ?`` and line breaks, pieces to words at spaces and
    tabs. ``a``: occurrences of the phrase, at least ``least``. The phrase is cut in two where
    floor(1000000*a*a/(l*r)) is lowest, the first such place; ``l`` and ``r`` are the occurrences of the parts, and that is
    its score. ``n``: words of the language. A phrase inside a longer counted one that has at least ``covered_percent``
    hundredths of its occurrences is left out. Order: score and ``a`` descending, phrase ascending by its bytes.

    Null text counts as empty, null language as ``und``. Repeated rows count each time, ids are not read, nor are other
    columns. No text or an empty table gives no rows. Pieces of any length are whole; memory of a task grows with the
    longest text.
    """
    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                       F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    nodes = phrase_nodes(rows, least, budget)
    one = nodes.where("depth = 1").select(F.col("a").alias("w"), F.col("n").alias("own"), "word", "lang")
    two = nodes.where("depth = 2").select("a", "b", "n")
    three = nodes.where("depth = 3").select("a", "b", "c", "n")

    def word(key: str, n: str, text: str, *more: Column) -> DataFrame:
        return one.select(F.col("w").alias(key), F.col("own").alias(n), F.col("word").alias(text), *more)

    inside = three.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("c").alias("b")))).alias("p"), "n")
    longer = inside.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.max("n").alias("longer"))
    pairs = (two.join(longer, ["a", "b"], "left")
             .where(F.coalesce(100 * F.col("longer") < covered_percent * F.col("n"), F.lit(True)))
             .join(word("a", "l", "x", "lang"), "a").join(word("b", "r", "y"), "b")
             .select("lang", F.concat_ws(" ", "x", "y").alias("phrase"), F.col("n").alias("f"), "l", "r")
             .withColumn("score", _exact_score("f", F.col("l"), F.col("r"))))
    triples = (three.join(two.withColumnRenamed("n", "ab"), ["a", "b"])
               .join(two.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("n").alias("bc")), ["b", "c"])
               .join(word("a", "na", "x", "lang"), "a").join(word("b", "nb", "y"), "b").join(word("c", "nc", "z"), "c")
               .withColumn("s1", _exact_score("n", F.col("na"), F.col("bc")))
               .withColumn("s2", _exact_score("n", F.col("ab"), F.col("nc")))
               .select("lang", F.concat_ws(" ", "x", "y", "z").alias("phrase"), F.col("n").alias("f"),
                       F.when(F.col("s2") < F.col("s1"), F.col("ab")).otherwise(F.col("na")).alias("l"),
                       F.when(F.col("s2") < F.col("s1"), F.col("nc")).otherwise(F.col("bc")).alias("r"),
                       F.least("s1", "s2").alias("score")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("f"), F.asc("phrase"))
    best = pairs.unionByName(triples).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = nodes.where("depth = 0").select("lang", F.col("n").alias("n"))
    return best.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"), "l", "r", "n", "score")
