"""SentencePiece encoding and decoding on the tokenizers library.

The model file is a protobuf message; its few fields are read here from the wire format: pieces with
scores and types, the model kind, byte fallback, and the normaliser's settings. From these a tokenizer
is rebuilt: normaliser, metaspace marker, unigram scores or the merges that a BPE model's scores imply,
byte fallback, and the matching decoder. Where no piece has the marker after another character, texts
are cut in front of markers: words are then independent, and a task encodes each distinct word once.
Batches are encoded by the library's own threads, as many as the task has CPUs. Every word's ids are
compared with those of the SentencePiece library.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .scratch import tidied
from .words import chunks, ranges, text_bytes

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


@dataclass
class PieceModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    mark_after_word: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze_spaces: bool = True
    escape_spaces: bool = True


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        key = varint()
        number, wire = key >> 3, key & 7
        if wire == 0:
            yield number, varint()
            continue
        size = varint() if wire == 2 else {1: 8, 5: 4}[wire]
        yield number, data[at:at + size]
        at += size


def read_model(data: bytes) -> PieceModel:
    model = PieceModel()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            model.pieces.append((piece, score, kind))
        elif number == 2:
            spec = dict(_fields(value))
            model.kind = spec.get(3, UNIGRAM)
            model.mark_after_word = bool(spec.get(24, 0))
            model.byte_fallback = bool(spec.get(35, 0))
            model.unk_id = spec.get(40, 0)
        elif number == 3:
            spec = dict(_fields(value))
            model.charsmap = spec.get(2, b"")
            model.dummy_prefix = bool(spec.get(3, 1))
            model.squeeze_spaces = bool(spec.get(4, 1))
            model.escape_spaces = bool(spec.get(5, 1))
    return model


def _merges(model: PieceModel, ids: dict[str, int]) -> list[tuple[str, str]]:
    """Every way to make a piece of two pieces, the highest score first; then by the ids of the parts."""
    found = []
    usable = {p for p, _, kind in model.pieces if kind in (NORMAL, USER)}
    for piece, score, kind in model.pieces:
        if kind == NORMAL:
            for cut in range(1, len(piece)):
                left, right = piece[:cut], piece[cut:]
                if left in usable and right in usable:
                    found.append((-score, ids[left], ids[right], left, right))
    return [(left, right) for *_, left, right in sorted(found)]


def words_are_independent(model: PieceModel) -> bool:
    """No piece goes on over a marker or has a line feed in it: texts can be cut in front of markers and around line feeds."""
    usable = [piece for piece, _, kind in model.pieces if kind in (NORMAL, USER)]
    return (model.escape_spaces and not model.mark_after_word and model.byte_fallback
            and not any(MARK in piece.lstrip(MARK) or "\n" in piece for piece in usable))


def build(model: PieceModel):
    """A ``tokenizers.Tokenizer`` for the model."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    ids = {piece: i for i, (piece, _, _) in enumerate(model.pieces)}
    unk = model.pieces[model.unk_id][0]
    if model.kind == UNIGRAM:
        tokenizer = Tokenizer(models.Unigram([(p, s) for p, s, _ in model.pieces], model.unk_id, model.byte_fallback))
    elif model.kind == BPE:
        tokenizer = Tokenizer(models.BPE(ids, _merges(model, ids), unk_token=unk, fuse_unk=True,
                                         byte_fallback=model.byte_fallback))
    else:
        raise ValueError(f"model kind {model.kind} is neither unigram nor BPE")
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze_spaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if model.escape_spaces else " "))
    if model.escape_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    if steps:
        tokenizer.normalizer = normalizers.Sequence(steps)
    if words_are_independent(model):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"\\n+|{MARK}+[^{MARK}\\n]*|[^{MARK}\\n]+"), "isolated")
    parts = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    if model.dummy_prefix:
        parts.append(decoders.Strip(" ", 1, 0))
    tokenizer.decoder = decoders.Sequence(parts)
    return tokenizer


#: Distinct words that a task keeps with their ids; beyond it the store starts anew.
KEPT_WORDS = 300_000
#: Words encoded as one text, so that a batch has work for several threads.
WORDS_A_TEXT = 2000


class Encoder:
    """Ids of whole texts, and whether SentencePiece itself gives the same ids."""

    def __init__(self, data: bytes, threads: int = 1):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        import sentencepiece

        self.threads, self.model = threads, read_model(data)
        self.tokenizer = build(self.model)
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        m = self.model
        #: Normalising is one replacement, and words are encoded independently of each other.
        self.by_word = not m.charsmap and not m.squeeze_spaces and m.dummy_prefix and words_are_independent(m)
        if self.by_word:
            self.tokenizer.normalizer = None  # words come normalised
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.same = np.zeros(0, bool)

    def _learn(self, new: list[str]) -> None:
        """Encode words not seen before, each checked against SentencePiece. A space stands for the marker."""
        feeds = [w for w in new if w[0] == "\n"]
        new = [w for w in new if w[0] != "\n"]
        blocks = [new[a:a + WORDS_A_TEXT] for a in range(0, len(new), WORDS_A_TEXT)]
        ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        # Joined by line feeds: every other word of such a text is one of ours.
        texts = ["\n".join(b).replace(" ", MARK) for b in blocks] + feeds
        for k, got in enumerate(self.tokenizer.encode_batch(texts, add_special_tokens=False)):
            own, word = np.array(got.ids, np.int32), np.array(got.word_ids, np.int64)
            if k < len(blocks):
                own, word = own[word % 2 == 0], word[word % 2 == 0] // 2
            ids.append(own)
            counts.append(np.bincount(word, minlength=len(blocks[k]) if k < len(blocks) else 1))
        new += feeds
        # After a line feed SentencePiece starts with the marker and the feed's own piece.
        expected = self.reference.encode(["\n" + w for w in new], num_threads=self.threads)
        flat, count = np.concatenate(ids), np.concatenate(counts)
        at = np.concatenate(([0], np.cumsum(count)))
        sizes = np.fromiter((len(e) - 2 for e in expected), np.int64, len(expected))
        if (sizes == count).all():
            theirs = np.fromiter((i for e in expected for i in e[2:]), np.int32, int(sizes.sum()))
            wrong = np.concatenate(([0], np.cumsum(flat != theirs)))
            same = wrong[at[1:]] == wrong[at[:-1]]
        else:
            same = np.array([flat[a:b].tolist() == e[2:] for a, b, e in zip(at[:-1], at[1:], expected, strict=True)])
        for w in new:
            self.known[w] = len(self.known)
        self.flat, self.at = np.concatenate([self.flat, flat]), np.concatenate([self.at, self.at[-1] + at[1:]])
        self.same = np.concatenate([self.same, same])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids one after the other, the offset of each text's, and by text whether SentencePiece agrees."""
        if not self.by_word:
            got = self.tokenizer.encode_batch(texts, add_special_tokens=False)
            ids = [e.ids for e in got]
            same = [a == b for a, b in zip(ids, self.reference.encode(texts, num_threads=self.threads), strict=True)]
            at = np.concatenate(([0], np.cumsum([len(i) for i in ids], dtype=np.int64)))
            return np.array([x for i in ids for x in i], np.int32), at, np.array(same, bool)
        # Normalised but for the marker, for which a space stands here; a marker in the text is the same thing.
        data, offsets = text_bytes(pa.array([" " + t.replace(MARK, " ") if t else "" for t in texts], pa.large_string()))
        kind = np.zeros(len(data) + 1, np.int8)
        kind[1:][data == 0x20] = 1
        kind[1:][data == 0x0A] = 2
        begins = (kind[1:] != kind[:-1]) & ((kind[1:] != 0) | (kind[:-1] == 2))
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        start = np.flatnonzero(begins)
        words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(np.append(start, len(data)).astype(np.int64)),
                                                 pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        if len(self.known) > KEPT_WORDS:
            self.forget()
        new = [w for w in distinct if w not in self.known]
        if new:
            self._learn(new)
        number = np.array([self.known[w] for w in distinct], np.int64)[words.indices.to_numpy()]
        count = self.at[number + 1] - self.at[number]
        ids = self.flat[ranges(self.at[number], count)]
        total = np.concatenate(([0], np.cumsum(count)))
        odd = np.concatenate(([0], np.cumsum(~self.same[number])))
        word_at = np.searchsorted(start, offsets)
        return ids, total[word_at], odd[word_at[1:]] == odd[word_at[:-1]]


class Decoder:
    """Texts of ids: the bytes of all pieces, one after the other; byte pieces are single bytes, control pieces nothing."""

    def __init__(self, data: bytes):
        model = read_model(data)
        parts = []
        for piece, _, kind in model.pieces:
            if kind == BYTE:
                parts.append(bytes([int(piece[1:-1], 16)]))
            elif kind == CONTROL:
                parts.append(b"")
            elif kind == UNKNOWN:
                parts.append(" ⁇ ".encode())
            else:
                parts.append(piece.replace(MARK, " ").encode() if model.escape_spaces else piece.encode())
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.at = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        self.prefix = model.dummy_prefix

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        count = self.at[ids + 1] - self.at[ids]
        data = self.bytes[ranges(self.at[ids], count)].tobytes()
        ends = np.concatenate(([0], np.cumsum(count)))[at]
        out = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            text = data[a:b].decode("utf-8", "replace")
            out.append(text[1:] if self.prefix and text.startswith(" ") else text)
        return out


def _cpus() -> int:
    context = TaskContext.get()
    return context.cpus() if context else 1


def _encode(data_of: Callable[[], bytes], decoded: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(data_of(), _cpus())
        decoder = Decoder(data_of()) if decoded else None
        for batch in batches:
            for begin, end in chunks(batch.column(1)):
                part = batch.slice(begin, end - begin)
                ids, at, same = encoder.encode([t or "" for t in part.column(1).to_pylist()])
                columns = [*part.columns, pa.ListArray.from_arrays(at.astype(np.int32), pa.array(ids)), pa.array(same)]
                if decoder:
                    columns.append(pa.array(decoder.decode(ids, at), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "ids", "parity", "decoded"][:len(columns)])
    return run


def _decode(data_of: Callable[[], bytes]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(data_of())
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                lists = part.column(at)
                ids = lists.flatten().to_numpy(False)
                offsets = lists.offsets.to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(decoder.decode(ids, offsets - offsets[0]), pa.string())],
                    [*batch.schema.names, "decoded"])
    return run


def _sent(spark, model_path: str) -> Callable[[], bytes]:
    sent = spark.sparkContext.broadcast(Path(model_path).read_bytes())
    return lambda: sent.value


ENCODED = "doc_id long, text string, ids array<int>, parity boolean"


def encode(docs: DataFrame, model_path: str = MODEL_PATH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text``, ``ids`` (array of int, no special pieces) and ``parity``: SentencePiece gives the same ids.

    Parity is checked for every word (where words are independent) or text. Null or empty text has no ids. Other
    columns are not read; rows are independent of each other. The driver reads the model file, half a megabyte.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidied(_encode(_sent(docs.sparkSession, model_path), False)), ENCODED)


def encode_and_decode(docs: DataFrame, model_path: str = MODEL_PATH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``decode(encode(docs))`` in one pass: the ids are decoded where they are made."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidied(_encode(_sent(docs.sparkSession, model_path), True)), f"{ENCODED}, decoded string")


def decode(encoded: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    """The columns of ``encoded`` and ``decoded``, the text of ``ids`` (none may be null); bytes that are no UTF-8 become U+FFFD."""
    return encoded.mapInArrow(tidied(_decode(_sent(encoded.sparkSession, model_path))),
                              StructType([*encoded.schema.fields, StructField("decoded", StringType())]))
