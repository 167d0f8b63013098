"""Spelling variants: words one edit apart, found by composing automata.

The vocabulary is divided by initial states. A pair of words one edit apart has the same characters in front of the
first place where they differ, and the same behind it. So the place lies in the first or in the second half of the
shorter word: pairs with the place in the second half share the first half, the others share the last half. A partition
is all words of two neighbouring lengths with the same fixed part: what an acceptor reads on its way to one state. In
a partition the acceptor of the rests of its words is built, with the least number of states; composed with a
transducer of one edit and with itself again, it accepts just the pairs of rests one edit apart, which are enumerated.
The transducer makes its edit where the words first differ, so each pair is accepted once, in one partition.

A partition of more than ``BUDGET`` words is divided again: the part where the edit may lie is halved, and each half's
words share more. When one place is left, a partition has no more words than there are letters, twice.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import tidied, written
from .words import Words, chunks

LEAST_LETTERS, LEAST_TIMES = 5, 3
#: Fixed value: one run in so many loses a letter.
DAMAGED = 97
#: Words of a partition that is not divided any more; distinct words that a task counts before it sends them.
BUDGET, STORE = 20_000, 500_000
#: Bytes of a run up to which checksums are computed for all runs at once.
ALONG = 48

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True


def _in_run(raw: np.ndarray) -> np.ndarray:
    """Bytes of A-Z, a-z and U+00C0 to U+00FF (C3 and the byte behind it)."""
    inside = _LETTER[raw] | (raw == 0xC3)
    inside[1:] |= raw[:-1] == 0xC3
    return inside


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


_CRC = _crc_table()


def run_checksums(words: Words, which: np.ndarray, prefixes: list[bytes]) -> np.ndarray:
    """CRC-32 of each run behind its document's prefix."""
    start, size = words.start[which], (words.end - words.start)[which]
    seeds = np.array([zlib.crc32(p) for p in prefixes], np.uint32)
    owner = words.owner()[which]
    out = np.zeros(len(which), np.uint32)
    order = np.argsort(-size, kind="stable")
    long_ = order[size[order] > ALONG]
    for i in long_.tolist():
        out[i] = zlib.crc32(words.data[start[i]:start[i] + size[i]].tobytes(), int(seeds[owner[i]]))
    order = order[len(long_):]
    begin, left = start[order], size[order]
    crc = seeds[owner[order]] ^ np.uint32(0xFFFFFFFF)
    for k in range(int(left.max(initial=0))):
        n = int(np.searchsorted(-left, -k))  # runs of more than k bytes
        crc[:n] = _CRC[(crc[:n] ^ words.data[begin[:n] + k]) & np.uint32(0xFF)] ^ (crc[:n] >> np.uint32(8))
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def _count_words(least_letters: int, damaged: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for batch in batches:
            for begin, end in chunks(batch.column(1)):
                words = Words(batch.column(1).slice(begin, end - begin), _in_run, lower=True)
                wide = np.concatenate(([0], np.cumsum(words.data == 0xC3)))
                letters = words.end - words.start - (wide[words.end] - wide[words.start])
                which = np.flatnonzero(letters >= least_letters)
                if damaged:
                    ids = batch.column(0).slice(begin, end - begin).to_pylist()
                    crc = run_checksums(words, which, [f"{'' if i is None else i}:".encode() for i in ids])
                    hit = crc % np.uint32(damaged) == 0
                    for i, h in zip(which[hit].tolist(), crc[hit].tolist(), strict=True):
                        if letters[i] > least_letters:
                            word = words.data[words.start[i]:words.end[i]].tobytes().decode()
                            at = h % len(word)
                            word = (word[:at] + word[at + 1:]).encode()
                            counts[word] = counts.get(word, 0) + 1
                    which = which[~hit]
                _, first, n = np.unique(words.span_hashes(words.start[which], (words.end - words.start)[which]),
                                        return_index=True, return_counts=True)
                own = which[first]
                for a, b, times in zip(words.start[own].tolist(), words.end[own].tolist(), n.tolist(), strict=True):
                    word = words.data[a:b].tobytes()
                    counts[word] = counts.get(word, 0) + times
                if len(counts) > STORE:
                    yield from _counted(counts)
                    counts = {}
        yield from _counted(counts)
    return run


def _counted(counts: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    words, n = pa.array(counts.keys(), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())
    yield from pa.table({"word": words, "n": n}).to_batches(65536)


def vocabulary(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_times: int = LEAST_TIMES, damaged: int | None = DAMAGED,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word`` and ``n``: runs of A-Z, a-z and U+00C0 to U+00FF in all texts, lower-cased (A-Z), of at least
    ``least_letters`` code points and ``least_times`` occurrences. With ``damaged``, a run whose CRC-32 behind
    ``<id>:`` (null id: ``:``) is divisible by it has lost the code point at that number modulo its length."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return (rows.mapInArrow(tidied(_count_words(least_letters, damaged)), "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_times))


class Automaton:
    """States of minimal acceptors of finite languages: equal states of all of them are one. ``arcs[s]``: by character
    the next state; ``final[s]``."""

    def __init__(self):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.register: dict[tuple, int] = {}

    def _state(self, final: bool, arcs: list[tuple[str, int]]) -> int:
        key = (final, *arcs)
        state = self.register.get(key)
        if state is None:
            state = self.register[key] = len(self.arcs)
            self.arcs.append(dict(arcs))
            self.final.append(final)
        return state

    def accept(self, words: list[str]) -> int:
        """The initial state of the minimal acceptor of ``words``, which are sorted and distinct."""
        path: list[tuple[list[bool], list[tuple[str, int]]]] = [([False], [])]
        last = ""
        for word in words:
            same = 0
            for a, b in zip(last, word, strict=False):
                if a != b:
                    break
                same += 1
            self._close(path, last, same)
            path += [([False], []) for _ in range(len(word) - same)]
            path[-1][0][0] = True
            last = word
        self._close(path, last, 0)
        return self._state(path[0][0][0], path[0][1])

    def _close(self, path: list, word: str, to: int) -> None:
        while len(path) > to + 1:
            final, arcs = path.pop()
            path[-1][1].append((word[len(path) - 1], self._state(final[0], arcs)))

    def common(self, s: int, t: int, but: str | None = None) -> Iterator[str]:
        """Words that both states accept; ``but``: not starting with this character."""
        stack = [("", s, t)]
        while stack:
            word, s, t = stack.pop()
            if self.final[s] and self.final[t]:
                yield word
            one, other = self.arcs[s], self.arcs[t]
            if s == t:
                stack += [(word + c, x, x) for c, x in one.items() if word or c != but]
                continue
            if len(one) > len(other):
                one, other = other, one
            stack += [(word + c, x, other[c]) for c, x in one.items() if c in other and (word or c != but)]


def one_edit_pairs(short: list[str], long: list[str], places: int) -> Iterator[tuple[str, str]]:
    """Pairs of ``short`` words (all of one length) that differ by one replaced character, and pairs of a ``short`` and
    a ``long`` word (one longer) that differ by an inserted one, where the first difference is at one of the first
    ``places`` characters. The machine: acceptor, one-edit transducer, acceptor; a path with the edit made at the
    first difference. Both lists are sorted and distinct."""
    machine = Automaton()
    start = (machine.accept(short), machine.accept(long))
    stack = [("", *start)]
    while stack:
        prefix, s, t = stack.pop()
        if len(prefix) >= places:
            continue
        one, other = machine.arcs[s] if s is not None else {}, machine.arcs[t] if t is not None else {}
        heads = list(one.items())
        for k, (c, x) in enumerate(heads):  # replace c by d
            for d, y in heads[k + 1:]:
                for rest in machine.common(x, y):
                    yield prefix + c + rest, prefix + d + rest
        if s is not None:
            for d, y in other.items():  # insert d; the short word goes on otherwise
                for rest in machine.common(s, y, but=d):
                    yield prefix + rest, prefix + d + rest
        for c, x in heads:  # no edit yet
            stack.append((prefix + c, x, other.get(c)))


NEAR = "word string, n_near long, best long, form string"


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by partition: each word's near words in it, their number and the best."""
    for short, long, places in _partitions(batches):
        names = [{}, {}]
        for known, members in zip(names, (short, long), strict=True):
            known.update({rest: (word, n) for rest, word, n in members})
        found: dict[str, list] = {}
        for a, b in one_edit_pairs(sorted(names[0]), sorted(names[1]), places):
            x, y = names[0][a], names[len(b) > len(a)][b]
            for (word, _), (near, n) in ((x, y), (y, x)):
                have = found.get(word)
                if have is None:
                    found[word] = [1, n, near]
                else:
                    have[0] += 1
                    if n > have[1] or (n == have[1] and near < have[2]):
                        have[1:] = n, near
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.keys(), pa.string()), *(pa.array([f[k] for f in found.values()], t) for k, t in
                                                        enumerate((pa.int64(), pa.int64(), pa.string())))],
                ["word", "n_near", "best", "form"])


def _partitions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, int]]:
    """Short and long members (rest, word, n) of each partition that can hold a pair, and its number of places."""
    now, rows = None, []
    for batch in batches:
        shorts, xs, ys, words, ns, fixed = (batch.column(c).to_pylist() for c in ("m", "x", "y", "word", "n", "fixed"))
        for m, x, y, word, n, same in zip(shorts, xs, ys, words, ns, fixed, strict=True):
            if (key := (m, x, y, same)) != now:
                yield from _members(now, rows)
                now, rows = key, []
            rows.append((word, n))
    yield from _members(now, rows)


def _members(key: tuple | None, rows: list[tuple[str, int]]) -> Iterator[tuple[list, list, int]]:
    if len(rows) < 2:
        return
    m, x, y, _ = key
    behind = max(m - y, 0)
    short, long = [], []
    for word, n in rows:
        (short if len(word) == m else long).append((word[x:len(word) - behind], word, n))
    if short:
        yield short, long, y - x


def _fixed(rows: DataFrame) -> DataFrame:
    """Rows with what all words of their partition share: ``x`` characters in front, ``m - y`` behind."""
    behind = F.greatest(F.col("m") - F.col("y"), F.lit(0))
    word = F.col("word")
    tail = F.when(behind > 0, F.substring(word, F.char_length(word) - behind + 1, behind)).otherwise("")
    return rows.withColumn("fixed", F.concat(F.substring(word, F.lit(1), F.col("x")), F.lit("|"), tail))


def _halves(rows: DataFrame) -> DataFrame:
    """Each row of places [x, y) for the first difference twice: the first and the second half of the places."""
    z = F.floor((F.col("x") + F.col("y")) / 2).cast("int")
    both = F.array(F.struct(F.col("x").alias("x"), z.alias("y")), F.struct(z.alias("x"), F.col("y").alias("y")))
    return _fixed(rows.withColumn("half", F.explode(both)).select("m", "half.x", "half.y", "word", "n"))


def near_words(words: DataFrame, least_letters: int = LEAST_LETTERS, budget: int = BUDGET) -> DataFrame:
    """Per word of ``words`` (``word``, ``n``; distinct) with a near word: ``word``, ``n_near`` (how many differ from it by
    one inserted, deleted or replaced code point), ``best`` (the largest ``n`` of those) and ``form`` (that word; of
    several the smallest in code-point order)."""
    size = F.char_length("word")
    lengths = F.explode(F.filter(F.array(size, size - 1), lambda m: m >= least_letters)).alias("m")
    rows = _halves(words.select("word", "n", lengths).select("m", F.lit(0).alias("x"), (F.col("m") + 1).alias("y"), "word", "n"))
    key, done = ["m", "x", "y", "fixed"], None
    while True:
        rows = written(rows, "partitioned-words")
        hot = (rows.where("y - x > 1").groupBy(F.xxhash64(*key).alias("partition")).agg(F.count("*").alias("members"))
               .where(F.col("members") > budget).select("partition"))
        hot = written(hot, "large-partitions")
        own = rows.withColumn("partition", F.xxhash64(*key))
        kept = own.join(hot, "partition", "left_anti").drop("partition")
        done = kept if done is None else done.unionByName(kept)
        if hot.isEmpty():
            break
        rows = _halves(own.join(hot, "partition", "left_semi"))
    dealt = done.repartition(*key).sortWithinPartitions(*key)
    found = dealt.mapInArrow(tidied(_near), NEAR)
    first = F.min(F.struct((-F.col("best")).alias("less"), F.col("form").alias("form"))).alias("first")
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first)
            .select("word", "n_near", (-F.col("first.less")).alias("best"), F.col("first.form").alias("form")))


def _roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``: forms (``word``, ``form``; no cycles) followed to the last, in doubling steps."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = written(now.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                            F.col("further").isNotNull().alias("moved")), "roots")
        if now.where("moved").isEmpty():
            return now.drop("moved")
        now = now.drop("moved")


def spelling_variants(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_times: int = LEAST_TIMES,
                      damaged: int | None = DAMAGED, budget: int = BUDGET, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """One row per word of ``vocabulary``: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    ``n``: occurrences; ``n_near``: words that differ by exactly one inserted, deleted or replaced code point (0: none);
    ``form``: of those the one with the largest ``n`` (ties: smallest in code-point order) if that is at least twice
    the word's, else null; ``form_n``: its occurrences; ``root``: from the word, forms followed to the last.

    Null or empty text has no words; rows count one by one, also those that share an id; a null id is the empty string
    in the checksum. An empty table gives no rows. Words of any length are whole. Other columns are not read.
    """
    words = written(vocabulary(docs, least_letters, least_times, damaged, id_col, text_col), "vocabulary")
    near = near_words(words, least_letters, budget)
    own = written(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("best") >= 2 * F.col("n"), F.col("form")).alias("form"),
        F.when(F.col("best") >= 2 * F.col("n"), F.col("best")).alias("form_n")), "forms")
    roots = _roots(own.where("form is not null").select("word", "form"))
    return own.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
