"""Best-fit packing of tokenised documents into sequences of one length.

Bounded-space online best-fit: a task holds a fixed number of open sequences. A bitset has bit ``f`` set where an
open one has ``f`` tokens free, so the fullest sequence that a piece fits into is one shift and the lowest set
bit. Where none fits and all places are taken, the fullest open sequence is closed and a new one opened. Pieces
arrive through a look-ahead of fixed size that hands them out by decreasing length, which leaves small pieces to
fill what the large ones left.

Texts are read and tokenised once and the ids never cross the network, but for the few that stand in sequences
that a task had not filled when it ended: those of ``FAN_IN`` tasks at a time are packed again together, then
those that remain open of ``FAN_IN`` such groups, until one group is left. What a group holds is bounded by
``FAN_IN`` times the open sequences, whatever the size of the corpus.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from itertools import repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import new_folder, tidied
from .words import U64, chunks, mix, ranges, text_bytes

TOKENIZER = "byte_bpe_50k.json"
CAPACITY, END_ID = 1024, 2
#: Open sequences of a task, pieces in its look-ahead, tasks whose unfilled sequences are packed again together.
OPEN, LOOK_AHEAD, FAN_IN = 512, 1000, 8
#: Units whose ids a worker remembers before it starts anew; bytes of text in one step; rows of an output batch; units
#: encoded as one text.
KEPT_UNITS, STEP_BYTES, ROWS_OUT, UNITS_A_TEXT = 1_200_000, 8 << 20, 4096, 512
PACKED = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"
LOTS = f"{PACKED}, lot long"
#: Bits of a sequence's number: its round, the task or group, and a running number.
TASK_BITS, OWN_BITS = 24, 35

#: ASCII classes that pre-tokenisation never joins but for a space or an apostrophe in front.
_LETTER, _DIGIT, _MARK, _LINE = 1, 2, 3, 4
_CLASS = np.zeros(256, np.int8)
_CLASS[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = _MARK
_CLASS[[c for c in range(128) if chr(c).isalpha()]] = _LETTER
_CLASS[ord("0"):ord("9") + 1] = _DIGIT
_CLASS[[0x09, 0x0A, 0x0D]] = _LINE
#: First bytes of characters that are no white space in any Unicode version; those of E1, E2, E3 and C2 may be.
_NO_SPACE = np.zeros(256, bool)
_NO_SPACE[0x21:0x7F] = True
_NO_SPACE[0xC3:0xF5] = True
_NO_SPACE[[0xE1, 0xE2, 0xE3]] = False


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where byte-level pre-tokenisation is sure to cut: before a space in front of a character that is none,
    and between ASCII letters, digits, marks and a single line end or tab of different kinds, but behind an apostrophe and
    before white space. Each text starts a unit."""
    n = len(data)
    begins = np.zeros(n + 1, bool)
    if n:
        kind = _CLASS[data]
        now, before = kind[1:], kind[:-1]
        solid = (kind > 0) & (kind < _LINE)
        known = solid[:-1] | (before == _LINE)
        known[1:] &= solid[1:-1] | solid[:-2]  # several line ends are not cut off: what follows decides how they are split
        known[:1] &= solid[:1]
        begins[1:n] = (now != before) & solid[1:] & known & (data[:-1] != ord("'"))
        begins[:n - 1] |= (data[:-1] == 0x20) & _NO_SPACE[data[1:]]
        last = offsets[1:][np.diff(offsets) > 0] - 1
        begins[last] &= data[last] != 0x20  # a space that ends a text is no start
        begins[offsets[:-1]] = True
    return np.flatnonzero(begins[:n])


class Encoder:
    """Token ids of whole texts. Where units are independent of each other, each distinct one is encoded once."""

    def __init__(self, definition: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        before, added = self.tokenizer.pre_tokenizer, self.tokenizer.get_added_tokens_decoder().values()
        self.by_unit = (type(before).__name__ == "ByteLevel" and not before.add_prefix_space and before.use_regex
                        and self.tokenizer.normalizer is None and all(t.special for t in added))
        feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.by_unit = self.by_unit and len(feed) == 1
        self.feed = np.array(feed[:1], np.uint32)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.ends, self.units = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), 0

    def _learn(self, new: list[str]) -> None:
        """Encode units not seen before: those without white space (but a space in front) joined by line feeds, whose
        token then only ends a unit; the others each by itself."""
        plain, others = [], []
        for unit in new:
            bare = unit[1:] if unit[0] == " " else unit
            (plain if bare.isprintable() and " " not in bare and bare else others).append(unit)
        blocks = ["\n".join(plain[a:a + UNITS_A_TEXT]) for a in range(0, len(plain), UNITS_A_TEXT)]
        got = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(blocks, add_special_tokens=False)]
        ids = np.concatenate([x for one in got for x in (one, self.feed)] or [self.feed[:0]])
        ends = np.flatnonzero(ids == self.feed[0])
        ids, count = np.delete(ids, ends), np.diff(ends, prepend=-1) - 1
        if len(count) != len(plain):
            raise ValueError("a unit holds the token of a line feed")
        self._keep(plain, ids, count)
        got = [e.ids for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)]
        count = np.fromiter(map(len, got), np.int64, len(got))
        self._keep(others, np.fromiter((i for one in got for i in one), np.uint32, int(count.sum())), count)

    def _keep(self, units: list[str], ids: np.ndarray, count: np.ndarray) -> None:
        first = self.units
        ends = self.ends[first] + np.cumsum(count)
        for name, need in (("flat", int(self.ends[first]) + len(ids)), ("ends", first + len(units) + 1)):
            have = getattr(self, name)
            if len(have) < need:
                more = np.zeros(2 * need, have.dtype)
                more[:len(have)] = have
                setattr(self, name, more)
        self.flat[self.ends[first]:self.ends[first] + len(ids)] = ids
        self.ends[first + 1:first + 1 + len(units)] = ends
        self.known.update(zip(units, range(first, first + len(units)), strict=True))
        self.units = first + len(units)

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, ``end_id`` behind each text's, and the offset of each text's (one more at the end)."""
        if self.by_unit:
            ids, at = self._by_unit(column)
        else:
            texts = [t or "" for t in column.to_pylist()]
            got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            at = np.concatenate(([0], np.cumsum([len(i) for i in got], dtype=np.int64)))
            ids = np.fromiter((i for one in got for i in one), np.uint32, int(at[-1]))
        return np.insert(ids, at[1:], end_id), at + np.arange(len(at))

    def _by_unit(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = text_bytes(column)
        start = unit_starts(data, offsets)
        units = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(np.append(start, len(data)).astype(np.int64)),
                                                 pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        distinct = units.dictionary.to_pylist()
        if len(self.known) > KEPT_UNITS:
            self._forget()
        number = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(number < 0)
        if len(new):
            unseen = [distinct[i] for i in new.tolist()]
            self._learn(unseen)
            number[new] = np.fromiter(map(self.known.__getitem__, unseen), np.int64, len(new))
        number = number[units.indices.to_numpy()]
        count = self.ends[number + 1] - self.ends[number]
        total = np.concatenate(([0], np.cumsum(count)))
        return self.flat[ranges(self.ends[number], count)], total[np.searchsorted(start, offsets)]


_ENCODERS: dict[int, Encoder] = {}


def encoder_of(definition: str) -> Encoder:
    """The worker's encoder, which later tasks go on with: most of their units are known by then."""
    key = hash(definition)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(definition)
    return _ENCODERS[key]


class Packer:
    """Open sequences of one task. Rows are (doc_id, piece, start, length, ids); closed sequences' rows go to ``out``."""

    def __init__(self, first_id: int, capacity: int = CAPACITY, limit: int = OPEN, look_ahead: int = LOOK_AHEAD):
        self.next_id, self.capacity, self.limit, self.look_ahead = first_id, capacity, limit, look_ahead
        self.free = 0  # bit f: an open sequence has f tokens free
        self.by_free: list[list[list[tuple]]] = [[] for _ in range(capacity + 1)]
        self.open = 0
        self.waiting: list[tuple] = []
        self.out: list[tuple] = []

    def add(self, row: tuple) -> None:
        if row[3] == self.capacity:
            self._close([row])
            return
        self.waiting.append(row)
        if len(self.waiting) >= self.look_ahead:
            self._place()

    def _place(self) -> None:
        for row in sorted(self.waiting, key=lambda r: -r[3]):
            length, fits = row[3], self.free >> row[3]
            if fits:
                room = length + (fits & -fits).bit_length() - 1
                members = self._take(room)
            else:
                if self.open == self.limit:
                    self._close(self._take((self.free & -self.free).bit_length() - 1))
                members, room = [], self.capacity
            members.append(row)
            if room == length:
                self._close(members)
            else:
                self.by_free[room - length].append(members)
                self.free |= 1 << (room - length)
                self.open += 1
        self.waiting = []

    def _take(self, room: int) -> list[tuple]:
        members = self.by_free[room].pop()
        if not self.by_free[room]:
            self.free ^= 1 << room
        self.open -= 1
        return members

    def _close(self, members: list[tuple]) -> None:
        at = 0
        for row in members:
            self.out.append((*row, self.next_id, at))
            at += row[3]
        self.next_id += 1

    def finish(self, close: bool) -> None:
        """Close what is open, or hand its rows out without a place."""
        self._place()
        for same in self.by_free:
            for members in same:
                if close:
                    self._close(members)
                else:
                    self.out += [(*row, None, None) for row in members]

    def batch(self, lot: int) -> pa.RecordBatch:
        rows, self.out = self.out, []
        columns = list(zip(*rows, strict=True)) if rows else [()] * 7
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        names = ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types, strict=True)),
                                           pa.array(np.full(len(rows), lot), pa.int64())], [*names, "lot"])


def _first_id(round_: int, lot: int) -> int:
    return (round_ << (TASK_BITS + OWN_BITS)) | (lot << OWN_BITS)


def _pieces(doc_ids: pa.Array, ids: np.ndarray, at: np.ndarray, capacity: int) -> Iterator[tuple]:
    """Rows of all texts; a text of more than ``capacity`` ids is cut so that only its first piece is shorter."""
    raw = ids.astype("<u4").tobytes()
    for doc_id, a, b in zip(doc_ids.to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
        begin, end, piece = a, a + ((b - a - 1) % capacity + 1), 0
        while begin < b:
            yield doc_id, piece, begin - a, end - begin, raw[4 * begin:4 * end]
            begin, end, piece = end, end + capacity, piece + 1


def _pack_texts(definition: Callable[[], str], capacity: int, end_id: int, sizes: tuple[int, int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot = TaskContext.get().partitionId()
        encoder, packer = encoder_of(definition()), Packer(_first_id(0, lot), capacity, *sizes)
        for batch in batches:
            for begin, end in chunks(batch.column(1), STEP_BYTES):
                part = batch.slice(begin, end - begin)
                for row in _pieces(part.column(0), *encoder.encode(part.column(1), end_id), capacity):
                    packer.add(row)
                    if len(packer.out) >= ROWS_OUT:
                        yield packer.batch(lot)
        packer.finish(close=False)
        yield packer.batch(lot)
    return run


def _pack_again(round_: int, capacity: int, sizes: tuple[int, int], last: bool) -> Callable[[pa.Table], pa.Table]:
    """Pieces of one group, in the order of a hash of their ids, so that no order of the corpus shows."""
    def run(table: pa.Table) -> pa.Table:
        lot = table["lot"][0].as_py()
        packer = Packer(_first_id(round_, lot), capacity, *sizes)
        table = table.combine_chunks()
        doc = mix(table["doc_id"].fill_null(0).to_numpy().view(U64))
        order = np.lexsort((table["start"].to_numpy(), table["piece"].to_numpy(), doc))
        for row in table.select(["doc_id", "piece", "start", "length", "ids"]).take(pa.array(order)).to_pylist():
            packer.add(tuple(row.values()))
        packer.finish(close=last)
        return pa.Table.from_batches([packer.batch(lot)])
    return run


def _written(df: DataFrame, name: str) -> DataFrame:
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
                   open_sequences: int = OPEN, look_ahead: int = LOOK_AHEAD, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id``, ``piece`` (from 0), ``start`` (the document's ids before it), ``length``, ``ids``
    (little-endian unsigned 32-bit numbers), ``sequence_id``, ``offset`` (place in the sequence, gapless from 0).

    A document is its token ids and ``end_id``. One of more than ``capacity`` ids is cut, the first piece may be shorter;
    all others stay whole. Null or empty text is ``end_id`` alone. Rows are packed one by one, also those that share an id
    (their pieces then share it, too) and those whose id is null. Strings of special tokens in a text are ordinary text.
    An empty table gives no rows. Other columns are not read. A very long text is one unit of work: memory grows with it.
    ``tokenizer``: path of a ``tokenizers`` JSON file; the driver reads it and sends its few megabytes to the tasks.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(Path(tokenizer or tokenizer_path()).read_text(encoding="utf-8"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sizes = (open_sequences, look_ahead)
    placed = _written(rows.mapInArrow(tidied(_pack_texts(lambda: sent.value, capacity, end_id, sizes)), LOTS), "packed")
    done = placed.where("sequence_id is not null")
    round_, last = 0, False
    while not last:
        left = placed.where("sequence_id is null").withColumn("lot", F.floor(F.col("lot") / FAN_IN).cast("long"))
        most = left.agg(F.max("lot").alias("most")).first()["most"]
        if most is None:
            break
        round_, last = round_ + 1, most == 0
        placed = _written(left.groupBy("lot").applyInArrow(_pack_again(round_, capacity, sizes, last), LOTS), "packed-again")
        done = done.union(placed.where("sequence_id is not null"))
    return done.drop("lot")


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence of ``pack_documents``: ``sequence_id``, ``length``, ``ids`` (as there), ``doc_ids`` in order."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids"))).alias("inside")
    return packed.groupBy("sequence_id").agg(inside).select(
        "sequence_id", F.aggregate("inside", F.lit(0).cast("long"), lambda n, x: n + x["length"]).alias("length"),
        F.aggregate("inside", F.lit(b""), lambda all_, x: F.concat(all_, x["ids"])).alias("ids"),
        F.transform("inside", lambda x: x["doc_id"]).alias("doc_ids"))
