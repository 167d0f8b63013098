"""Toxicity by weak supervision: lexicon and pattern voters, a label model, a linear classifier.

Terms are words and word beginnings of 5 to 8 bytes, lower-cased; beginnings stand for the forms of a
stem. Their document counts in toxic training documents and in all training documents give the learned
lexicon: all terms whose share among toxic documents stands out, those of one stem as one entry. Voters have
sources of their own: a fixed list of insults for each of four languages, learned words, learned beginnings of other
words, terms beside words that address somebody, a term said again, several terms, how dense they are, shouting
and symbols; the last votes for clean, where a long text has one term. That nothing was found is what the others'
silence says already. The label model estimates how
accurate and how correlated the voters are, with the label, where there is one, as a further voter. A linear classifier
on term and pattern features is trained on its posterior labels, each made without the row's own label, of rows that
have one and of rows that have none. It scores every document.

Documents cross the network once, as a handful of term numbers each. Texts are read three times: counts of
terms in all and in toxic training documents, in one pass and summed by task before they are sent; beginnings of the
terms that stand out, in the toxic ones; features of all documents. The
classifier has a column for each entry up to ``COLUMNS``; beyond, entries share columns (feature hashing).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import tidied, written
from .weak_labels import fit_linear, label_model, linear_score
from .words import U64, Words, byte_class, chunks, signed

LETTER = byte_class("letter")
PREFIXES = (5, 6, 7, 8)
#: Small public lists of insults, and words that address somebody, in English, French, German, Spanish.
INSULTS = (
    "idiot moron imbecile stupid dumb loser scum trash pathetic worthless disgusting vermin",
    "crétin débile ordure connard abruti minable",
    "dummkopf trottel abschaum widerlich versager",
    "imbécil estúpido basura asqueroso inútil escoria",
)
ADDRESS = "you your yours yourself tu toi vous votre ton ta du dich dir dein deine ihr euch tú ti usted ustedes vosotros".split()
#: The columns that all learned entries share in the classifier. How far from a term an address may stand, in words.
COLUMNS, NEAR = 512, 4
#: How much likelier a term has to be in a toxic document than in any, and by how many standard deviations.
LEAST_LIFT, LEAST_DEVIATIONS = 3.0, 5.0
#: Training documents that the classifier is fitted on at most, in the order of a hash of their ids.
SAMPLE = 20_000
THRESHOLD = 0.3
#: How often a label is right; it stays as given. Ridge penalty of single terms, against 1 for densities and patterns.
LABEL_ACCURACY, TERM_PENALTY = 0.999, 5.0
#: Ids of toxic training documents go to all tasks up to this number (8 MB); beyond it they are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Distinct terms that a task keeps before it sends their counts.
STORE = 400_000
NO_LABEL = 2


def is_training(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 != 2, F.lit(False))


def _terms(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word numbers and term hashes: whole words, then beginnings."""
    h = words.hashes()
    yield np.arange(len(h)), h
    for _, at, prefix in words.prefix_hashes(PREFIXES):
        yield at, prefix


def _batch_words(column: pa.Array) -> Iterator[tuple[int, Words]]:
    for begin, end in chunks(column):
        yield begin, Words(column.slice(begin, end - begin), LETTER, lower=True)


def _term_counts(words: Words, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms, the documents that have each, and the toxic ones among these."""
    owner, pairs = words.owner(), []
    for at, h in _terms(words):
        pairs.append((h, owner[at]))
    term, doc = (np.concatenate(x) for x in zip(*pairs, strict=True))
    by = np.lexsort((doc, term))
    term, doc = term[by], doc[by]
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
    return _summed(term[new], np.ones(int(new.sum()), np.int64), toxic[doc[new]])


def _summed(term: np.ndarray, n: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums by term; the terms are sorted."""
    if not len(term):
        return term, n, own
    first = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
    return term[first], np.add.reduceat(n, first), np.add.reduceat(own, first)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of columns (text, toxic): terms, the documents that have them and the toxic ones among these, summed over the
    task, or over as much of it as fills the store."""
    held, size = [], 0

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        by = np.argsort(columns[0], kind="stable")
        return _summed(*(c[by] for c in columns))

    def sent(term: np.ndarray, n: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield from pa.table({"term": signed(term), "n": n, "own": own}).to_batches(65536)

    for batch in batches:
        toxic = batch.column(1).to_numpy(False).astype(np.int64)
        for begin, words in _batch_words(batch.column(0)):
            held.append(_term_counts(words, toxic[begin:begin + len(words.count)]))
            size += len(held[-1][0])
            if size > 2 * STORE:
                held = [merged()]
                size = len(held[0][0])
                if size > STORE:
                    yield from sent(*held[0])
                    held, size = [], 0
    if held:
        yield from sent(*merged())


def _stems(known: Callable[[], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The beginnings of each known term that a task's texts have (0: it is shorter), once a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(known(), np.arange(len(known())))
        begins = np.zeros((len(lookup.terms), len(PREFIXES)), U64)
        seen = np.zeros(len(lookup.terms), bool)
        for batch in batches:
            for _, words in _batch_words(batch.column(0)):
                of_word = np.zeros((len(words.start), len(PREFIXES)), U64)
                for k, (_, at, prefix) in enumerate(words.prefix_hashes(PREFIXES, whole=True)):
                    of_word[at, k] = prefix
                # In the order of _terms: whole words, then beginnings, which have no longer ones.
                for k, (at, h) in enumerate(_terms(words)):
                    hit, term = lookup.find(h)
                    begins[term] = of_word[at[hit]] if not k else np.where(np.arange(len(PREFIXES)) < k, of_word[at[hit]], U64(0))
                    seen[term] = True
        own = np.flatnonzero(seen)
        yield from pa.table({"term": signed(known()[own]), **{f"b{k}": signed(begins[own, k]) for k in range(len(PREFIXES))}}).to_batches(65536)
    return run


class Lookup:
    """Entries of known terms by hash; a table over some bits of the hash keeps most words from the search."""

    def __init__(self, terms: np.ndarray, entries: np.ndarray):
        order = np.argsort(terms, kind="stable")
        self.terms, self.entries = terms[order], entries[order]
        self.may = np.zeros(1 << 22, bool)
        self.may[self.terms >> U64(42)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.may[h >> U64(42)])
        if not len(at):
            return at, at
        place = np.minimum(np.searchsorted(self.terms, h[at]), len(self.terms) - 1)
        same = self.terms[place] == h[at]
        return at[same], self.entries[place[same]]


def _known(words: Words, lookup: Lookup) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word number and entry of each known term, one for each occurrence, and whether the term is the whole word."""
    places, terms, whole = [], [], []
    for k, (at, h) in enumerate(_terms(words)):
        hit, number = lookup.find(h)
        places.append(at[hit])
        terms.append(number)
        whole.append(np.full(len(hit), k == 0))
    return np.concatenate(places), np.concatenate(terms), np.concatenate(whole)


@dataclass
class Lexicon:
    """Hashes of terms, and the entry (stem) of each, numbered from 0, the clearest first."""

    terms: np.ndarray
    entry: np.ndarray

    def __len__(self) -> int:
        return int(self.entry.max(initial=-1)) + 1


def _hashes(words: list[str]) -> np.ndarray:
    return Words(pa.array(words), LETTER, lower=True).hashes()


def _insult_hashes() -> np.ndarray:
    return _hashes(" ".join(INSULTS).split())


#: Voters: a fixed lexicon a language, learned words, learned beginnings of other words, terms beside an address, a
#: term said again, several terms, their density, shouting or symbols, one term in a long text.
INSULTS_END = np.cumsum([len(x.split()) for x in INSULTS])
VOTERS = len(INSULTS) + 8
NUMBERS = ["occurrences", "whole", "addressed", "most", "n_words", "loud", "symbols", "bytes"]
FEATURES = "doc_id long, terms array<int>, " + ", ".join(f"{c} long" for c in NUMBERS)


def _features(lexicon: Lexicon) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per document: distinct lexicon entries (numbers; fixed ones behind the learned), occurrences of entries, of whole
    learned words and of entries beside an address, of the most frequent entry; words, shouted words, symbols, bytes."""
    insults, address = _insult_hashes(), np.sort(_hashes(ADDRESS))
    entries = np.concatenate([lexicon.entry, len(lexicon) + np.arange(len(insults))])
    lookup_terms, n_entries = np.concatenate([lexicon.terms, insults]), len(lexicon) + len(insults)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(lookup_terms, entries)
        for batch in batches:
            for begin, words in _batch_words(batch.column(1)):
                rows, owner = len(words.count), words.owner()
                # A word counts once, for the clearest of its terms: forms of one stem are no independent evidence.
                at, term, whole = _known(words, lookup)
                best = np.unique(at * n_entries + term)
                is_whole = np.zeros(len(owner), bool)
                is_whole[at[whole & (term < len(lexicon))]] = True
                at, term = best // n_entries, best % n_entries
                first = np.ones(len(at), bool)
                first[1:] = at[1:] != at[:-1]
                at, term = at[first], term[first]
                doc = owner[at]
                pair, times = np.unique(doc * n_entries + term, return_counts=True)
                most = np.zeros(rows, np.int64)
                np.maximum.at(most, pair // n_entries, times)
                h = words.hashes()
                place = np.minimum(np.searchsorted(address, h), len(address) - 1)
                said = np.concatenate(([0], np.cumsum(address[place] == h)))
                lo, hi = np.maximum(at - NEAR, words.first[doc]), np.minimum(at + NEAR + 1, words.first[doc + 1])
                beside = said[hi] > said[lo]
                raw = Words(batch.column(1).slice(begin, rows), LETTER)
                upper = np.concatenate(([0], np.cumsum((raw.data >= 65) & (raw.data <= 90))))
                symbol = np.concatenate(([0], np.cumsum(np.isin(raw.data, np.frombuffer(b"#$%&*!|@~^<>", np.uint8)))))
                length = words.end - words.start
                loud = (upper[words.end] - upper[words.start] == length) & (length > 1)
                loud = np.concatenate(([0], np.cumsum(loud)))
                ends = np.searchsorted(pair // n_entries, np.arange(rows + 1)).astype(np.int32)
                numbers = [np.bincount(doc, minlength=rows), np.bincount(doc[is_whole[at]], minlength=rows),
                           np.bincount(doc[beside], minlength=rows), most, words.count,
                           loud[words.first[1:]] - loud[words.first[:-1]],
                           symbol[words.offsets[1:]] - symbol[words.offsets[:-1]], np.diff(words.offsets)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, rows),
                     pa.ListArray.from_arrays(ends, pa.array((pair % n_entries).astype(np.int32))),
                     *(pa.array(x.astype(np.int64)) for x in numbers)], ["doc_id", "terms", *NUMBERS])
    return run


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    got = {c: batch.column(c).to_numpy(False).astype(float) for c in NUMBERS}
    lists = batch.column("terms")
    got["flat"] = lists.flatten().to_numpy(False)
    got["row"] = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    return got


def _dense(batch: pa.RecordBatch, n_terms: int) -> np.ndarray:
    """Features of the classifier: the entries' columns, the fixed lexicons, and seven of the pattern."""
    c = _columns(batch)
    fixed = c["flat"] >= n_terms
    n_terms = min(n_terms, COLUMNS)
    x = np.zeros((batch.num_rows, n_terms + 8))
    x[c["row"], np.where(fixed, n_terms, c["flat"] % max(n_terms, 1))] = 1.0
    words = np.maximum(c["n_words"], 1)
    density = c["occurrences"] / words
    x[:, n_terms + 1] = np.log1p(c["occurrences"])
    x[:, n_terms + 2] = np.minimum(density * 50, 4)
    x[:, n_terms + 3] = c["loud"] / words
    x[:, n_terms + 4] = np.minimum(c["symbols"] / np.maximum(c["bytes"], 1) * 5, 2)
    x[:, n_terms + 5] = c["n_words"] == 0
    x[:, n_terms + 6] = c["addressed"] > 0
    x[:, n_terms + 7] = np.log1p(np.maximum(c["most"] - 1, 0))
    return x


def _vote(batch: pa.RecordBatch, n_terms: int) -> np.ndarray:
    """Votes of the lexicons and patterns: 1 toxic, 2 clean, 0 none."""
    c = _columns(batch)
    votes = np.zeros((batch.num_rows, VOTERS), np.int64)
    fixed = c["flat"] >= n_terms
    votes[c["row"][fixed], np.searchsorted(INSULTS_END, c["flat"][fixed] - n_terms, side="right")] = 1
    learned = np.zeros(batch.num_rows)
    np.add.at(learned, c["row"][~fixed], 1)
    words, k = np.maximum(c["n_words"], 1), len(INSULTS)
    distinct = np.bincount(c["row"], minlength=batch.num_rows)
    for j, said in enumerate((
            c["whole"] > 0, (learned > 0) & (c["whole"] == 0), c["addressed"] > 0, c["most"] > 1, distinct > 2,
            (c["occurrences"] > 0) & (c["occurrences"] >= 0.02 * words),
            (c["loud"] > 0.3 * words) | (c["symbols"] > 0.1 * c["bytes"]))):
        votes[:, k + j] = np.where(said, 1, 0)
    votes[:, k + 7] = np.where((c["occurrences"] == 1) & (words >= 100), 2, 0)
    return votes


def _patterns(n_terms: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of (votes, label) as one code, base 3; a voter says one thing or nothing, so there are few."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column("toxic").to_numpy(False)
            votes = np.concatenate([_vote(batch, n_terms), np.where(label == NO_LABEL, 0, np.where(label == 1, 1, 2))[:, None]], axis=1)
            code, n = np.unique(votes @ 3 ** np.arange(VOTERS + 1)[::-1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int64))], ["code", "n"])
    return run


def _score(beta: np.ndarray, n_terms: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.concatenate([linear_score(_dense(batch.slice(a, 4096), n_terms), beta)
                                    for a in range(0, batch.num_rows, 4096)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])
    return run


def _lexicon(train: DataFrame, toxic: DataFrame) -> Lexicon:
    """All terms that stand out in toxic training documents, by stem."""
    spark = train.sparkSession
    none = Lexicon(np.zeros(0, U64), np.zeros(0, np.int64))
    n_toxic = toxic.count()
    if not n_toxic:
        return none
    wanted = F.broadcast(toxic) if n_toxic <= BROADCAST_IDS else toxic
    flagged = train.join(wanted.withColumn("toxic", F.lit(1)), "doc_id", "left").select("text", F.coalesce("toxic", F.lit(0)).alias("toxic"))
    counted = (flagged.mapInArrow(tidied(_count_terms), "term long, n long, own long")
               .groupBy("term").agg(F.sum("n").alias("n"), F.sum("own").alias("own")))
    share = n_toxic / max(train.count(), 1)
    found = (counted.withColumn("expected", F.col("n") * share)
             .withColumn("deviations", (F.col("own") - F.col("expected")) / F.sqrt(F.col("expected") + 0.5))
             .where((F.col("own") >= LEAST_LIFT * F.col("expected")) & (F.col("deviations") >= LEAST_DEVIATIONS))
             .select("term", "deviations").toArrow())
    terms = found.column("term").to_numpy().view(U64)
    keep = np.flatnonzero(~np.isin(terms, _insult_hashes()))
    if not len(keep):
        return none
    order = keep[np.argsort(terms[keep])]
    terms, deviations = terms[order], found.column("deviations").to_numpy()[order]
    sent = spark.sparkContext.broadcast(terms)
    names = [f"b{k}" for k in range(len(PREFIXES))]
    begins = (train.join(wanted, "doc_id", "left_semi").select("text")
              .mapInArrow(tidied(lambda batches: _stems(lambda: sent.value)(batches)), f"term long, {', '.join(f'{b} long' for b in names)}")
              .groupBy("term").agg(*(F.max(b).alias(b) for b in names)).toArrow())
    at = np.searchsorted(terms, begins.column("term").to_numpy().view(U64))
    # The stem of a term: the shortest of its beginnings that stands out, or else the term itself.
    stem = terms.copy()
    for b in reversed(names):
        begin = begins.column(b).to_numpy().view(U64)
        stem[at] = np.where(np.isin(begin, terms), begin, stem[at])
    stems, at = np.unique(stem, return_inverse=True)
    clearest = np.full(len(stems), -np.inf)
    np.maximum.at(clearest, at, deviations)
    entry = np.empty(len(stems), np.int64)
    entry[np.lexsort((stems, -clearest))] = np.arange(len(stems))
    by = np.lexsort((terms, entry[at]))
    return Lexicon(terms[by], entry[at][by])


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 from 0.3 on).

    ``labels``: ``doc_id`` and ``toxic`` (0 or 1; other values and rows without an id count as no label; of several
    for one id the largest holds). Only documents whose crc32(id as text) modulo 4 is not 2 are learned from; null
    ids are never learned from. Null or empty text has no words and gets the score of a text without any feature.
    Without toxic training documents every score is 0. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    terms, beta, features = _fit(rows, labels)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    if beta is None:
        scored = features.select("doc_id", F.lit(0.0).alias("score"))
    else:
        sent = docs.sparkSession.sparkContext.broadcast(beta)
        n_terms = len(terms)
        scored = features.mapInArrow(lambda batches: _score(sent.value, n_terms)(batches), "doc_id long, score double")
    return scored.select("doc_id", held_out.alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` (``doc_id``, ``text`` and others), all columns, that ``score_toxicity`` predicts 0 for."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    terms, beta, _ = _fit(rows, labels)
    if beta is None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast((terms, beta))
    carried = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("carried"), docs["text"].alias("text"))
    return carried.mapInArrow(tidied(lambda batches: _keep(*sent.value)(batches)), carried.schema).select("carried.*")


def _fit(rows: DataFrame, labels: DataFrame) -> tuple[Lexicon, np.ndarray | None, DataFrame]:
    """The lexicon, the classifier's coefficients (None without toxic training documents), all rows' features."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .where("doc_id is not null and toxic in (0, 1)").where(is_training())
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    train = rows.where(is_training())
    present = train.select("doc_id").distinct().join(known.where("toxic = 1"), "doc_id").select("doc_id")
    terms = _lexicon(train, written(present, "toxic-ids"))
    features = written(rows.mapInArrow(tidied(_features(terms)), FEATURES), "toxicity-features")
    labelled = (features.where(is_training()).join(known, "doc_id", "left")
                .withColumn("toxic", F.coalesce("toxic", F.lit(NO_LABEL))))
    return terms, _classifier(labelled, len(terms)), features


def _keep(terms: Lexicon, beta: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for features in _features(terms)(iter([batch])):
                clean = linear_score(_dense(features, len(terms)), beta) < THRESHOLD
                part = pa.Table.from_batches([batch.slice(at, features.num_rows)]).filter(pa.array(clean))
                at += features.num_rows
                yield from part.to_batches()
    return run


def _classifier(labelled: DataFrame, n_terms: int) -> np.ndarray | None:
    """The label model is estimated with the given labels as one more voter, which anchors the others' accuracies. The
    classifier learns what the model says of rows with and without a label, their own label left out."""
    counts = (labelled.mapInArrow(_patterns(n_terms), "code long, n long").groupBy("code")
              .agg(F.sum("n").alias("n")).orderBy("code").toArrow())
    codes, n = counts.column("code").to_numpy(), counts.column("n").to_numpy().astype(float)
    votes = np.stack([codes // 3 ** (VOTERS - k) % 3 for k in range(VOTERS + 1)], axis=1)
    gold = votes[:, -1]
    if not n[gold == 1].sum():
        return None
    share = float(n[gold == 1].sum() / n[gold > 0].sum())
    model = label_model(votes, n, share=share, trusted={VOTERS: LABEL_ACCURACY})
    sample = (labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
              .select("terms", *NUMBERS).toArrow().combine_chunks())
    batch = sample.to_batches()[0]
    votes = np.concatenate([_vote(batch, n_terms), np.zeros((batch.num_rows, 1), np.int64)], axis=1)
    penalty = np.concatenate([np.full(min(n_terms, COLUMNS) + 1, TERM_PENALTY), np.ones(7)])
    return fit_linear(_dense(batch, n_terms), model.posterior(votes), np.ones(batch.num_rows), penalty)
