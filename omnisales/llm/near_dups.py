"""Near-duplicate documents by MinHash bands, with odd sketches as the filter before the exact test.

A document is its set of distinct word shingles. Of each set come 128 MinHash samples. Bands of 4
samples give 32 bucket keys: two sets with a Jaccard similarity of 0.75 miss each other in all
buckets with a probability of 5e-6. The same samples are folded into an odd sketch, a bitmap of 512
bits of which each sample flips one. Samples that two sets share flip the same bits and cancel, so
the population count of the XOR of two sketches tells how many differ, most precisely where few do.
Pairs beyond ``odd_limit`` (five standard deviations above what 0.75 gives) are dropped; the rest
are confirmed on the full sets.

Which pairs are looked at, in order that no group of n documents costs n*n:

* documents with equal sets are one class, and its smallest id stands for it;
* each bucket's members are tested against its smallest; that links nearly all groups of copies;
* only buckets whose members are still in different components afterwards are compared by sketch, in
  blocks of bounded size, and only across components. What passes connects documents into clusters;
  a block of a cluster gets the texts, and pairs that pass are compared there on their full sets. No
  pair is written down but links.

So each pair of different sets that share a bucket is either tested or known to be connected. What
remains quadratic is a large group of texts that are mutually just below the similarity: their
sketches alone can't tell that, and their blocks are many small tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import tidied, written
from .words import U64, Words, byte_class, chunks, mix, signed, window_hashes

SPACE = byte_class("space")
ROWS, BANDS, SKETCH_BITS = 4, 32, 512
SAMPLES = ROWS * BANDS
WORDS_OF_SKETCH = SKETCH_BITS // 64
_SEED = mix(np.arange(1, 2 * SAMPLES + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
FLIP, FACTOR = _SEED[:SAMPLES], _SEED[SAMPLES:] | U64(1)
SAME_SET = ["set_a", "set_b", "n_shingles"]
TEXT_SETS = "doc_id long, text string, set_a long, set_b long, n_shingles long"
#: Ids of candidates go to all tasks up to this number (8 MB); beyond it they are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Members of a bucket whose sketches are compared in one block, and documents of a cluster whose texts are.
BLOCK, TEXT_BLOCK = 2048, 512


def odd_limit(similarity: float, samples: int = SAMPLES, bits: int = SKETCH_BITS, deviations: float = 5.0) -> int:
    """Bits that may differ between two odd sketches of sets with at least ``similarity``, but for a chance of some 1e-6."""
    flips = 2 * samples * (1 - similarity)
    keep = (1 - 2 / bits) ** flips
    spread = 4 * samples * similarity * (1 - similarity) * keep**2
    own = bits / 4 * (1 - (1 - 4 / bits) ** flips) + bits**2 / 4 * ((1 - 4 / bits) ** flips - (1 - 2 / bits) ** (2 * flips))
    return math.ceil(bits / 2 * (1 - keep) + deviations * math.sqrt(spread + max(own, 0.0)))


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By chunk: its first row, the sorted distinct shingle hashes of its texts, and the offset of each text in them."""
    for begin, end in chunks(column, 1 << 20):
        words = Words(column.slice(begin, end - begin), SPACE, lower=True)
        h, count = words.hashes(), words.count
        number = np.where(count >= size, count - size + 1, np.minimum(count, 1))
        at = np.concatenate(([0], np.cumsum(number)))
        flat = np.empty(at[-1], U64)
        for n in range(1, size):
            short = np.flatnonzero(count == n)
            if len(short):
                flat[at[short]] = window_hashes(h, n)[words.first[short]]
        w = window_hashes(h, size)
        owner = words.owner()[:len(w)]
        ok = np.flatnonzero(np.arange(len(w)) + size <= words.first[1:][owner])
        flat[at[owner[ok]] + ok - words.first[owner[ok]]] = w[ok]
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            flat[a:b].sort()
        new = np.ones(len(flat), bool)
        new[1:] = flat[1:] != flat[:-1]
        new[at[:-1][number > 0]] = True
        total = np.concatenate(([0], np.cumsum(new)))
        yield begin, flat[new], total[at]


def _set_hashes(flat: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell each set (none is empty); equal bits are taken for equal sets."""
    return np.add.reduceat(mix(flat), first), np.add.reduceat(mix(flat ^ FLIP[0]), first)


def _signatures(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, flat, at in shingle_sets(batch.column(1), size):
                n, rows = np.diff(at), len(at) - 1
                full = np.flatnonzero(n)
                first = at[:-1][full]
                keys = np.zeros((len(full), BANDS), U64)
                parity = np.zeros(rows * SKETCH_BITS, np.int64)
                sums = np.zeros((2, rows), U64)
                if len(full):
                    buffer = np.empty_like(flat)
                    for j in range(SAMPLES):
                        np.bitwise_xor(flat, FLIP[j], out=buffer)
                        np.multiply(buffer, FACTOR[j], out=buffer)
                        sample = np.minimum.reduceat(buffer, first)
                        band = j // ROWS
                        keys[:, band] = mix((keys[:, band] if j % ROWS else U64(band + 1)) ^ mix(sample))
                        bit = (mix(sample ^ FACTOR[j]) >> U64(32)).astype(np.int64) % SKETCH_BITS
                        parity[full * SKETCH_BITS + bit] ^= 1
                    sums[:, full] = _set_hashes(flat, first)
                odd = np.packbits(parity.reshape(rows, SKETCH_BITS).astype(np.uint8), axis=1, bitorder="little").view(np.int64)
                ends = np.concatenate(([0], np.cumsum(np.where(n > 0, BANDS, 0)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, rows), pa.array(n, pa.int64()), pa.array(sums[0].view(np.int64)),
                     pa.array(sums[1].view(np.int64)), pa.ListArray.from_arrays(ends, pa.array(signed(keys).ravel())),
                     *(pa.array(np.ascontiguousarray(odd[:, i])) for i in range(WORDS_OF_SKETCH))],
                    ["doc_id", "n_shingles", "set_a", "set_b", "bands", *(f"odd{i}" for i in range(WORDS_OF_SKETCH))])
    return run


def _confirm(size: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of pairs with both texts, those with 100 * shared shingles >= percent * all their shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in chunks(batch.column(2)):
                part = batch.slice(begin, end - begin)
                sets = [[flat[a:b] for _, flat, at in shingle_sets(part.column(k), size)
                         for a, b in zip(at[:-1], at[1:], strict=True)] for k in (2, 3)]
                good = [len(a) > 0 and _similar(a, b, np.array([0]), np.array([len(b)]), percent)[0]
                        for a, b in zip(*sets, strict=True)]
                yield from pa.Table.from_batches([part.select([0, 1])]).filter(pa.array(good, pa.bool_())).to_batches()
    return run


def _similar(own: np.ndarray, others: np.ndarray, first: np.ndarray, count: np.ndarray, percent: int) -> np.ndarray:
    """One sorted set against several, which stand one after the other in ``others``; none is empty."""
    place = np.minimum(np.searchsorted(own, others), len(own) - 1)
    shared = np.add.reduceat((own[place] == others).astype(np.int64), first) if len(others) else np.zeros(len(first), np.int64)
    return (count > 0) & (100 * shared >= percent * (len(own) + count - shared))


def _groups(batches: Iterator[pa.RecordBatch], names: list[str], limit: int) -> Iterator[pa.Table]:
    """Tables of about ``limit`` bytes from sorted rows, cut only where a group ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        t = pa.Table.from_batches(held)
        if t.nbytes < limit:
            continue
        open_ = np.logical_and.reduce([t[c].to_numpy() == t[c][-1].as_py() for c in names])
        closed = t.num_rows - int(np.count_nonzero(open_))
        if closed:
            yield t.slice(0, closed).combine_chunks()
            held = t.slice(closed).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _across(t: pa.Table, limit: int, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of the same group (group, i, j) that are in different components, of like size and like sketch."""
    col = {c: t[c].to_numpy() for c in t.column_names if c != "text"}
    odd = np.stack([col[f"odd{i}"] for i in range(WORDS_OF_SKETCH)], axis=1).view(U64)
    rows, step, n = np.arange(t.num_rows), 0, t.num_rows
    while True:
        step += 1
        rows = rows[rows + step < n]
        rows = rows[np.logical_and.reduce([col[c][rows] == col[c][rows + step] for c in ("group", "i", "j")])]
        if not len(rows):
            return
        x, y = rows, rows + step
        small, large = np.minimum(col["n_shingles"][x], col["n_shingles"][y]), np.maximum(col["n_shingles"][x], col["n_shingles"][y])
        ok = (col["component"][x] != col["component"][y]) & (100 * small >= percent * large)
        ok &= (col["i"][x] == col["j"][x]) | (col["block"][x] != col["block"][y])
        x, y = x[ok], y[ok]
        near = np.bitwise_count(odd[x] ^ odd[y]).sum(axis=1) <= limit
        yield x[near], y[near]


def _candidate_forest(limit: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of all pairs that pass in a block, as many as connect the same documents: fewer rows than documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["group", "i", "j"], 4 << 20):
            ids, up = t["node"].to_numpy(), np.arange(t.num_rows)
            left, right = [], []

            def root(i: int, up: np.ndarray = up) -> int:
                while up[i] != i:
                    up[i] = up[up[i]]
                    i = int(up[i])
                return i

            for x, y in _across(t, limit, percent):
                new = up[x] != up[y]
                for a, b in zip(x[new].tolist(), y[new].tolist(), strict=True):
                    p, q = root(a), root(b)
                    if p != q:
                        up[max(p, q)] = min(p, q)
                        left.append(a)
                        right.append(b)
                while len(x) and (up[up] != up).any():
                    up[:] = up[up]
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(ids[left]), pa.array(ids[right])], ["a", "b"])
    return run


def _block_links(size: int, limit: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links in a block: pairs that pass the sketch test are compared on their full sets there; only links leave it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["group", "i", "j"], 8 << 20):
            ids, sets = t["node"].to_numpy(), []
            for _, flat, at in shingle_sets(t["text"].combine_chunks() if t["text"].num_chunks != 1 else t["text"].chunk(0), size):
                sets += [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            found = list(_across(t, limit, percent))
            if not found:
                continue
            x, y = (np.concatenate(side) for side in zip(*found, strict=True))
            by = np.argsort(x, kind="stable")
            x, y = x[by], y[by]
            for a, b in zip(starts := np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))[:len(x)],
                            np.append(starts[1:], len(x)), strict=True):
                for c in range(a, b, 4096):
                    others = [sets[k] for k in y[c:min(b, c + 4096)]]
                    count = np.array([len(o) for o in others])
                    first = np.concatenate(([0], np.cumsum(count)[:-1]))
                    good = _similar(sets[x[a]], np.concatenate(others), first, count, percent)
                    if good.any():
                        to = ids[y[c:min(b, c + 4096)][good]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(to), ids[x[a]])), pa.array(to)], ["a", "b"])
    return run


def _differing_bits() -> F.Column:
    total = F.lit(0)
    for i in range(WORDS_OF_SKETCH):
        total = total + F.bit_count(F.col(f"x.odd{i}").bitwiseXOR(F.col(f"y.odd{i}")))
    return total


def _like(pairs: DataFrame, sketches: DataFrame, limit: int, percent: int) -> DataFrame:
    """Pairs ``a``, ``b`` whose sizes and odd sketches allow the similarity."""
    joined = (pairs.join(sketches.alias("x"), F.col("a") == F.col("x.node"))
              .join(sketches.alias("y"), F.col("b") == F.col("y.node")))
    n, m = F.col("x.n_shingles"), F.col("y.n_shingles")
    return joined.where((100 * F.least(n, m) >= percent * F.greatest(n, m)) & (_differing_bits() <= limit)).select("a", "b")


def _text_sets(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (doc_id, text) with the hashes that tell their set; rows without a shingle go."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, flat, at in shingle_sets(batch.column(1), size):
                part, n = batch.slice(begin, len(at) - 1), np.diff(at)
                full = np.flatnonzero(n)
                if len(full):
                    part = part.take(pa.array(full))
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, *(pa.array(signed(x)) for x in _set_hashes(flat, at[:-1][full])), pa.array(n[full], pa.int64())],
                        ["doc_id", "text", *SAME_SET])
    return run


def _texts(base: DataFrame, reps: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """``node`` and ``text``, one row for each of ``nodes``. Other texts are not shuffled where the nodes are few.

    Ids can have several rows: each text is told by its id and its set, whatever else its id stands at."""
    wanted = written(reps.join(nodes.distinct(), "node").select("node", "doc_id", *SAME_SET), "candidates")
    only = wanted.select("doc_id").distinct()
    only = F.broadcast(only) if wanted.count() <= BROADCAST_IDS else only
    told = (base.join(only, "doc_id", "left_semi").mapInArrow(tidied(_text_sets(size)), TEXT_SETS)
            .dropDuplicates(["doc_id", *SAME_SET]))
    return told.join(wanted, ["doc_id", *SAME_SET]).select("node", "text")


def _confirmed(pairs: DataFrame, base: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs that hold on the full shingle sets."""
    texts = written(_texts(base, reps, pairs.select(F.explode(F.array("a", "b")).alias("node")), size), "candidate-texts")
    x = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    y = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(tidied(_confirm(size, percent)), "a long, b long").distinct()


def _dealt(rows: DataFrame, block: int) -> DataFrame:
    """Members of each ``group`` in blocks, and a copy for each pair of blocks (i, j): no pair of them is left out."""
    blocks = rows.groupBy("group").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    rows = rows.join(blocks, "group").withColumn("block", F.pmod(F.hash("node"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return (rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
            .drop("blocks", "other").repartition("group", "i", "j").sortWithinPartitions("group", "i", "j"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 75, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Documents are linked where 100 * |shared shingles| >= ``percent`` * |all shingles|; ``component_id`` is the
    smallest id reachable over links, the own one included, and ``kept`` marks its document. Equal sets are told by 128
    hash bits, shingles by 64. Text is lower-cased (A-Z) and split at white space; with fewer than ``shingle`` words all
    of them are the one shingle. Null or wordless text: no shingle, no link, kept. Null id: component null, kept. Rows
    with the same id count as one document, also those with other texts or none. Other columns are not read. Steps are
    written to the shared folder.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    odd = [f"odd{i}" for i in range(WORDS_OF_SKETCH)]
    limit = odd_limit(percent / 100)
    rows = written(base.mapInArrow(
        tidied(_signatures(shingle)), "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, "
        + ", ".join(f"{c} long" for c in odd)), "signatures")
    full = rows.where("doc_id is not null and n_shingles > 0")
    # A node is a class of equal sets, and its number means nothing; the smallest of its ids lends it the text.
    classes = written(full.groupBy(*SAME_SET).agg(F.min("doc_id").alias("class_id"))
                      .withColumn("node", F.monotonically_increasing_id()), "classes")
    reps = full.join(classes, SAME_SET).where("doc_id = class_id").dropDuplicates(SAME_SET)
    reps = written(reps.select("node", "doc_id", *SAME_SET, "bands", *odd), "representatives")
    sketches = reps.select("node", "n_shingles", *odd)

    members = reps.select("node", F.explode("bands").alias("key"))
    least = members.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
    buckets = written(members.join(least.drop("most"), "key"), "buckets")
    stars = buckets.where("node > least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    tested = written(_like(stars, sketches, limit, percent), "star-pairs")
    links = written(_confirmed(tested, base, reps, shingle, percent), "star-links")

    # An id whose rows are in several classes joins these.
    homes = written(full.select("doc_id", *SAME_SET).join(classes, SAME_SET).select("doc_id", "node").distinct(), "homes")
    twice = homes.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("most")).where("b < most")
    links = links.union(homes.join(twice, "doc_id").where("node > b").select(F.col("node").alias("a"), "b"))

    found = written(connected_components(links), "components")
    known = buckets.join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    mixed = known.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    open_ = (known.join(mixed.select("key"), "key").join(sketches, "node").withColumnRenamed("key", "group"))
    forest = _dealt(open_, BLOCK).mapInArrow(tidied(_candidate_forest(limit, percent)), "a long, b long")
    clusters = written(connected_components(forest).withColumnRenamed("component", "group"), "clusters")
    inside = (clusters.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")).join(sketches, "node"))
    inside = _texts(base, reps, clusters.select("node"), shingle).join(inside, "node")
    more = _dealt(inside, TEXT_BLOCK).mapInArrow(tidied(_block_links(shingle, limit, percent)), "a long, b long").distinct()
    roots = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
    final = written(connected_components(roots.union(more)), "all-components")
    placed = homes.join(final, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component"))
    smallest = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_id = placed.join(smallest, "component").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return (rows.select("doc_id", "n_shingles").join(of_id, "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` (``doc_id``, ``text`` and others), all columns, that ``near_duplicates`` keeps."""
    judged = near_duplicates(docs, shingle, percent)
    gone = written(judged.where("not kept").select("doc_id").distinct(), "copies")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    carried = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("carried"), docs["doc_id"].cast("long").alias("doc_id"))
    return carried.join(gone, "doc_id", "left_anti").select("carried.*")
