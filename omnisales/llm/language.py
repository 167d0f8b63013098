"""Language identification by segmentation-marginalised unigrams.

The vocabulary is fixed and public: the pieces of a tokenizer file. Each language has a probability for
every piece. A word's probability in a language is the sum over all its segmentations into pieces, by
the forward algorithm; a text's is the product over its words. Probabilities are learned by a single
step of expectation-maximisation: the forward-backward algorithm under a common start distribution
(pieces by their rank in the vocabulary) gives expected piece counts of every word of the training
documents, and their sums by language are normalised. There is no second round. All words of all training documents count.

Words are runs of letters (A-Z lower-cased, all characters beyond ASCII), marked at their start, and
worked on as UTF-8 bytes; a byte that is no piece may stand alone at a fixed small probability. Sums that would
underflow are added in logs. Each distinct word of a chunk is worked on once. Words of any length are whole: a sum
needs the places within the longest piece only, so the forward table is a ring of that many.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sentencepieces import MARK, NORMAL, read_model
from .words import U64, Words, byte_class, chunks, mix, powers, ranges

VOCABULARY_PATH = "/opt/tokenizers/piece_bpe_32k.model"
LETTER = byte_class("letter")
#: Probability of a byte outside all pieces, and the count added to every piece of a language.
UNKNOWN, ADDED = 1e-7, 0.1
#: Distinct words that a task holds at a time, about; they are worked off or forgotten beyond it.
STORE = 300_000
#: Bytes of distinct words that are kept before they are worked off, and that are worked on together.
STORE_BYTES, BLOCK_BYTES, LEAST_BLOCK = 16 << 20, 1_600_000, 50_000
#: Sums below it are computed again in logs: above it, what underflows is no part of the result's digits.
LEAST_SUM = 1e-200
#: Languages that the model holds at most; more distinct values are an error, not a cut.
MOST_LANGUAGES = 2000
UND = "und"


class Vocabulary:
    """Pieces of letters with an optional marker (byte 0x20) in front, found by hash at every place of a buffer."""

    def __init__(self, data: bytes):
        pieces = []
        for piece, _, kind in read_model(data).pieces:
            body = piece.lstrip(MARK)
            if kind == NORMAL and len(piece) - len(body) <= 1:
                raw = (b" " if piece != body else b"") + body.encode().lower()  # A-Z, as in words
                if raw and all(LETTER[b] for b in raw.lstrip(b" ")):
                    pieces.append(raw)
        self.pieces = list(dict.fromkeys(pieces))
        rank = np.arange(len(self.pieces)) + 10.0
        self.start = (1 / rank) / (1 / rank).sum()
        self.longest = max(map(len, self.pieces), default=1)
        buffer = np.frombuffer(b"".join(self.pieces), np.uint8)
        size = np.array([len(p) for p in self.pieces], np.int64)
        at = np.concatenate(([0], np.cumsum(size)))
        h = np.zeros(len(size), U64)
        for n in range(1, self.longest + 1):
            own = np.flatnonzero(size == n)
            h[own] = self._hash(buffer, at[own], n)
        self.order = np.argsort(h, kind="stable")
        self.sorted = h[self.order]
        self.may = np.zeros(1 << 20, bool)
        self.may[self.sorted >> U64(44)] = True

    @staticmethod
    def _hash(buffer: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Hash of the ``n`` bytes at each place."""
        power, _ = powers(0x9E3779B97F4A7C15, n + 1)
        h = np.full(len(at), n, U64)
        for k in range(n):
            h += (buffer[at + k].astype(U64) + U64(1)) * power[k + 1]
        return mix(h)

    def edges(self, buffer: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """All pieces in all words: word, start and end in the word, piece (-1: a byte outside), by end and word."""
        word = np.repeat(np.arange(len(size)), size)
        at = ranges(first, size)
        left = first[word] + size[word] - at
        power, _ = powers(0x9E3779B97F4A7C15, self.longest + 1)
        h = np.zeros(len(at), U64)
        found = []
        for n in range(1, self.longest + 1):
            on = left >= n
            if not on.all():
                word, at, left, h = word[on], at[on], left[on], h[on]
            if not len(at):
                break
            h = h + (buffer[at + n - 1].astype(U64) + U64(1)) * power[n]
            key = mix(h + U64(n))
            hit = np.flatnonzero(self.may[key >> U64(44)])
            place = np.minimum(np.searchsorted(self.sorted, key[hit]), len(self.sorted) - 1)
            same = self.sorted[place] == key[hit]
            hit, place = hit[same], place[same]
            piece = self.order[place]
            start = at[hit] - first[word[hit]]
            found.append((word[hit], start, start + n, piece))
            if n == 1:  # every byte may stand alone
                none = np.ones(len(at), bool)
                none[hit] = False
                none = np.flatnonzero(none)
                start = at[none] - first[word[none]]
                found.append((word[none], start, start + 1, np.full(len(none), -1)))
        w, s, e, p = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.argsort(e * len(size) + w, kind="stable")
        return w[by], s[by], e[by], p[by]


@dataclass
class Numbers:
    """How probabilities are held: plainly, or as logs where they would underflow."""

    add: np.ufunc
    times: np.ufunc
    zero: float
    one: float


PLAIN, LOGS = Numbers(np.add, np.multiply, 0.0, 1.0), Numbers(np.logaddexp, np.add, -np.inf, 0.0)


def _forward(words: int, size: np.ndarray, edges: tuple[np.ndarray, ...], weight: np.ndarray,
             numbers: Numbers = PLAIN) -> np.ndarray:
    """alpha[word, place, model]: the summed probability of all segmentations of the word's first ``place`` bytes."""
    w, s, e, _ = edges
    width = int(size.max()) + 1
    alpha = np.full((words * width, weight.shape[1]), numbers.zero)
    alpha[np.arange(words) * width] = numbers.one
    to, source = w * width + e, w * width + s
    first = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
    cuts = np.searchsorted(e, np.arange(1, width + 1))
    group_cuts = np.searchsorted(first, cuts)
    for place in range(1, width):
        a, b = cuts[place - 1], cuts[place]
        starts = first[group_cuts[place - 1]:group_cuts[place]]
        if len(starts):
            alpha[to[starts]] = numbers.add.reduceat(numbers.times(alpha[source[a:b]], weight[a:b]), starts - a, axis=0)
    return alpha.reshape(words, width, -1)


def _totals(words: int, size: np.ndarray, edges: tuple[np.ndarray, ...], table: np.ndarray, numbers: Numbers = PLAIN) -> np.ndarray:
    """The summed probability of all segmentations of each word by model; ``table``: by piece (the last: a byte outside)
    and model. Of the forward table only the places that a piece can reach back to are held."""
    w, s, e, p = edges
    ring = int((e - s).max(initial=1)) + 1
    alpha = np.full((words * ring, table.shape[1]), numbers.zero)
    alpha[np.arange(words) * ring] = numbers.one
    out = np.full((words, table.shape[1]), numbers.one)
    last = int(size.max(initial=0))
    first = np.flatnonzero(np.concatenate(([True], (e[1:] != e[:-1]) | (w[1:] != w[:-1]))))[:len(e)]
    cuts = np.searchsorted(e, np.arange(1, last + 2))
    group_cuts = np.searchsorted(first, cuts)
    by_size = np.argsort(size, kind="stable")
    done = np.searchsorted(size[by_size], np.arange(last + 2))
    for place in range(1, last + 1):
        slot = place % ring
        alpha[slot::ring] = numbers.zero
        a, b = cuts[place - 1], cuts[place]
        starts = first[group_cuts[place - 1]:group_cuts[place]]
        if len(starts):
            terms = numbers.times(alpha[w[a:b] * ring + s[a:b] % ring], table[p[a:b]])
            alpha[w[starts] * ring + slot] = numbers.add.reduceat(terms, starts - a, axis=0)
        ended = by_size[done[place]:done[place + 1]]
        out[ended] = alpha[ended * ring + slot]
    return out


def _log_totals(words: int, size: np.ndarray, edges: tuple[np.ndarray, ...], table: np.ndarray) -> np.ndarray:
    """Logs of the words' probabilities by model. Words with a sum below ``LEAST_SUM`` are added in logs."""
    total = _totals(words, size, edges, table)
    low = np.flatnonzero((total < LEAST_SUM).any(axis=1))
    out = np.log(np.maximum(total, LEAST_SUM))
    if len(low):
        own, _ = _edges_of(words, edges, low)
        out[low] = _totals(len(low), size[low], own, np.log(table), LOGS)
    return out


def _edges_of(words: int, edges: tuple[np.ndarray, ...], some: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """The edges of some words, which are numbered anew in the same order, and their places among all edges."""
    number = np.full(words, -1)
    number[some] = np.arange(len(some))
    on = np.flatnonzero(number[edges[0]] >= 0)
    return (number[edges[0][on]], *(x[on] for x in edges[1:])), on


def _expected(words: int, size: np.ndarray, edges: tuple[np.ndarray, ...], weight: np.ndarray) -> np.ndarray:
    """Expected number of uses of each edge over all segmentations of its word, under one model."""
    total, used = _uses(words, size, edges, weight, PLAIN)
    used /= np.maximum(total, LEAST_SUM)[edges[0]]
    low = np.flatnonzero(total < LEAST_SUM)
    if len(low):
        own, on = _edges_of(words, edges, low)
        total, logs = _uses(len(low), size[low], own, np.log(weight[on]), LOGS)
        used[on] = np.exp(logs - total[own[0]])
    return used


def _uses(words: int, size: np.ndarray, edges: tuple[np.ndarray, ...], weight: np.ndarray, numbers: Numbers
          ) -> tuple[np.ndarray, np.ndarray]:
    """Each word's probability, and each edge's share of it (not divided)."""
    w, s, e, _ = edges
    alpha = _forward(words, size, edges, weight[:, None], numbers)[:, :, 0]
    width = alpha.shape[1]
    beta = np.full(words * width, numbers.zero)
    beta[np.arange(words) * width + size] = numbers.one
    by = np.argsort((width - s) * words + w, kind="stable")
    to, source, use = (w * width + s)[by], (w * width + e)[by], weight[by]
    first = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
    cuts = np.searchsorted((width - s)[by], np.arange(width + 2))
    group_cuts = np.searchsorted(first, cuts)
    for k in range(width + 1):
        a, b = cuts[k], cuts[k + 1]
        starts = first[group_cuts[k]:group_cuts[k + 1]]
        if len(starts):
            beta[to[starts]] = numbers.add.reduceat(numbers.times(beta[source[a:b]], use[a:b]), starts - a)
    used = numbers.times(numbers.times(alpha.ravel()[w * width + s], weight), beta[w * width + e])
    return alpha[np.arange(words), size], used


@dataclass
class Distinct:
    """Distinct marked words: hash, and bytes one after the other."""

    hash: np.ndarray
    buffer: np.ndarray
    at: np.ndarray

    def take(self, which: np.ndarray) -> Distinct:
        size = np.diff(self.at)[which]
        return Distinct(self.hash[which], self.buffer[ranges(self.at[which], size)], np.concatenate(([0], np.cumsum(size))))

    def blocks(self, models: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Words of like size with their numbers, bytes, first bytes and sizes; fewer where more models make wider tables.
        A word longer than a block is one by itself."""
        size = np.diff(self.at)
        by = np.argsort(size, kind="stable")
        limit = max(BLOCK_BYTES // max(models, 4), LEAST_BLOCK)
        upto = np.cumsum(size[by] + 1)
        a = 0
        while a < len(by):
            b = max(int(np.searchsorted(upto, (upto[a - 1] if a else 0) + limit, side="right")), a + 1)
            yield by[a:b], self.buffer, self.at[by[a:b]], size[by[a:b]]
            a = b


def _distinct(words: Words) -> tuple[Distinct, np.ndarray]:
    """The distinct words of a chunk, and for each word its number among them."""
    size = words.end - words.start
    keys, first, number = np.unique(words.span_hashes(words.start, size), return_index=True, return_inverse=True)
    src, n = words.start[first], size[first]
    at = np.concatenate(([0], np.cumsum(n + 1)))
    buffer = np.full(at[-1], 0x20, np.uint8)
    buffer[ranges(at[:-1] + 1, n)] = words.data[ranges(src, n)]
    return Distinct(keys, buffer, at), number


def _learn(data_of: Callable[[], bytes], languages: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Expected piece counts by language of the training documents (text, lang). Words are counted first, in stores."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(data_of())
        number = {lang: i for i, lang in enumerate(languages)}
        total = np.zeros((len(languages), len(vocabulary.pieces)))
        weight_of = np.append(vocabulary.start, UNKNOWN)
        held: list[tuple[Distinct, np.ndarray]] = []

        def empty() -> None:
            if not held:
                return
            size = np.concatenate([np.diff(d.at) for d, _ in held])
            every = Distinct(np.concatenate([d.hash for d, _ in held]), np.concatenate([d.buffer for d, _ in held]),
                             np.concatenate(([0], np.cumsum(size))))
            by = np.argsort(every.hash, kind="stable")
            key = every.hash[by]
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            times = np.add.reduceat(np.concatenate([t for _, t in held])[by], first, axis=0)
            store = every.take(by[first])
            held.clear()
            for own, buffer, at, size in store.blocks():
                edges = vocabulary.edges(buffer, at, size)
                used = _expected(len(size), size, edges, weight_of[edges[3]])
                inside = edges[3] >= 0
                w, p, used = edges[0][inside], edges[3][inside], used[inside]
                for i in np.flatnonzero(times[own].any(axis=0)):
                    total[i] += np.bincount(p, used * times[own][w, i], len(vocabulary.pieces))

        for batch in batches:
            lang = np.array([number[x] for x in batch.column(1).to_pylist()], np.int64)
            for begin, end in chunks(batch.column(0)):
                words = Words(batch.column(0).slice(begin, end - begin), LETTER, lower=True)
                if not len(words.start):
                    continue
                store, which = _distinct(words)
                told, n = lang[begin + words.owner()], len(store.hash)
                times = np.bincount(which * len(languages) + told, minlength=n * len(languages)).reshape(n, -1)
                held.append((store, times.astype(float)))
                if sum(len(d.hash) for d, _ in held) >= STORE or sum(len(d.buffer) for d, _ in held) >= STORE_BYTES:
                    empty()
        empty()
        for i in range(len(languages)):
            seen = np.flatnonzero(total[i] > 0)
            if len(seen):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(seen), i)), pa.array(seen), pa.array(total[i][seen])], ["lang", "piece", "n"])
    return run


def _predict(data_of: Callable[[], bytes], model_of: Callable[[], np.ndarray], languages: list[str]
             ) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, model = Vocabulary(data_of()), model_of()
        by_piece = np.concatenate([model, np.full((len(model), 1), UNKNOWN)], axis=1).T
        # Words already scored, by hash; a store that is full starts anew.
        known, known_logs = np.zeros(0, U64), np.zeros((0, len(languages)))
        for batch in batches:
            for begin, end in chunks(batch.column(1)):
                part = batch.slice(begin, end - begin)
                words = Words(part.column(1), LETTER, lower=True)
                rows, logs = len(words.count), np.zeros((len(words.count), len(languages)))
                if len(words.start) and len(languages):
                    store, which = _distinct(words)
                    place = np.minimum(np.searchsorted(known, store.hash), max(len(known) - 1, 0))
                    new = np.flatnonzero(known[place] != store.hash) if len(known) else np.arange(len(store.hash))
                    mine = np.zeros((len(store.hash), len(languages)))
                    fresh = store.take(new)
                    got = np.zeros((len(new), len(languages)))
                    for own, buffer, at, size in fresh.blocks(len(languages)):
                        edges = vocabulary.edges(buffer, at, size)
                        got[own] = _log_totals(len(size), size, edges, by_piece)
                    if len(known):
                        mine = known_logs[place]
                    mine[new] = got
                    if len(known) > STORE:
                        known, known_logs = store.hash, mine
                    else:
                        known = np.concatenate([known, fresh.hash])
                        by = np.argsort(known, kind="stable")
                        known, known_logs = known[by], np.concatenate([known_logs, got])[by]
                    doc = words.owner()
                    for i in range(len(languages)):
                        logs[:, i] = np.bincount(doc, mine[which, i], rows)
                letters = words.count > 0
                texts = part.column(1)
                foreign = [d for d in np.flatnonzero(letters).tolist() if not _has_letter(words, d)
                           and not any(c.isalpha() for c in texts[d].as_py())]
                letters[foreign] = False
                if len(languages):
                    best = logs.argmax(axis=1)
                    odds = np.exp(np.clip(logs - logs.max(axis=1, keepdims=True), -700, 0))
                    score = odds.max(axis=1) / odds.sum(axis=1)
                    told = [languages[b] if ok else UND for b, ok in zip(best, letters, strict=True)]
                else:
                    score, told = np.zeros(rows), [UND] * rows
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(told, pa.string()), pa.array(np.where(letters, score, 0.0))],
                    ["doc_id", "lang_pred", "score"])
    return run


def _has_letter(words: Words, doc: int) -> bool:
    """Whether a text has an ASCII letter; others are looked at by character."""
    a, b = words.first[doc], words.first[doc + 1]
    return bool((words.data[words.start[a:b]] < 0x80).any())


def is_held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify_language(docs: DataFrame, vocabulary_path: str = VOCABULARY_PATH, id_col: str = "doc_id",
                      text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``held_out``, ``lang_pred``, ``score`` (0 to 1).

    Learned from texts with a non-null language and a non-null id whose crc32 (as text) modulo 4 is not 2; language,
    source and id are no inputs of a prediction. ``lang_pred`` is a learned value, or ``und`` (score 0) where the text
    is null or has no letter, or nothing could be learned. Ties go to the first language in order. Repeated rows are
    learned from and predicted one by one. Texts and words of any length are whole; time and memory grow with the
    longest. Other columns are not read.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(Path(vocabulary_path).read_bytes())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.col(lang_col).cast("string").alias("lang"))
    train = rows.where(~is_held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull()
                       & F.col("text").isNotNull())
    languages = [r["lang"] for r in train.select("lang").distinct().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()]
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = (train.select("text", "lang").mapInArrow(_learn(lambda: sent.value, languages), "lang long, piece long, n double")
              .groupBy("lang", "piece").agg(F.sum("n").alias("n")))
    model = np.full((len(languages), len(Vocabulary(sent.value).pieces)), ADDED)
    for r in counts.toLocalIterator():
        model[r["lang"], r["piece"]] += r["n"]
    model /= model.sum(axis=1, keepdims=True)
    model = spark.sparkContext.broadcast(model)
    told = rows.select("doc_id", "text").mapInArrow(
        _predict(lambda: sent.value, lambda: model.value, languages), "doc_id long, lang_pred string, score double")
    return told.select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")
