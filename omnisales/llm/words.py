"""Words of Arrow string columns as numpy arrays, without Python strings.

Word rules here name ASCII separators only, so they can be applied to UTF-8
bytes: every byte of a non-ASCII character is 0x80 or more. A window of words
is identified by a polynomial hash over the 64-bit hashes of its words, taken
from prefix sums (arithmetic modulo 2**64) and mixed at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Texts are worked on in groups of about so many bytes: it bounds the memory of one step, not a result.
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (xor-shift and multiply, twice)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base modulo 2**64 and their inverses; short tables are kept."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=U64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=U64))
        have = (both[0], both[1])
        if size <= 2 * CHUNK_BYTES:
            _POWERS[base] = have
    return have


BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(_ODD[0]))


def byte_class(kept: str) -> np.ndarray:
    """``space``: all but white space 20, 09-0D. ``alnum``: 0-9, a-z, A-Z and all beyond ASCII. ``letter``: without digits."""
    table = np.ones(256, dtype=bool)
    if kept == "space":
        table[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
        return table
    table[:128] = False
    table[ord("a"):ord("z") + 1] = True
    table[ord("A"):ord("Z") + 1] = True
    if kept == "alnum":
        table[ord("0"):ord("9") + 1] = True
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offset of each (one more at the end). Null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


class Words:
    """``start``/``end``: byte range of every word; ``first[d]``: index of the first word of text ``d``.

    ``kept``: a table of the bytes that words consist of, or a function from all bytes to those marked."""

    def __init__(self, column: pa.Array, kept: np.ndarray | Callable[[np.ndarray], np.ndarray], lower: bool = False):
        raw, self.offsets = text_bytes(column)
        self.data = LOWER[raw] if lower else raw
        inside = kept(raw) if callable(kept) else kept[raw]
        n = len(raw)
        cut = self.offsets[:-1]
        cut = cut[cut < n]
        before = np.zeros(n, dtype=bool)
        before[1:] = inside[:-1]
        before[cut] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros(n, dtype=bool)
        after[:-1] = inside[1:]
        after[cut[cut > 0] - 1] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def _sums(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.data)
        power, inverse = powers(_ODD[0], n + 1)
        sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(BYTE_VALUES[self.data] * power[:n], out=sums[1:])
        return sums, inverse

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return self.span_hashes(self.start, self.end - self.start)

    def span_hashes(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte range."""
        sums, inverse = self._sums()
        h = (sums[start + size] - sums[start]) * inverse[start]
        return mix(h ^ (size.astype(U64) * U64(_ODD[1])))

    def prefix_hashes(self, sizes: tuple[int, ...], whole: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """By size: the words that are longer than so many bytes (or as long, with ``whole``), and the hash of that prefix
        (never that of a word)."""
        sums, inverse = self._sums()
        for size in sizes:
            at = np.flatnonzero(self.end - self.start > size - whole)
            h = (sums[self.start[at] + size] - sums[self.start[at]]) * inverse[self.start[at]]
            yield size, at, mix(mix(h ^ U64(size * 0x9E3779B1)) + U64(size))


def window_hashes(h: np.ndarray, size: int, family: int = 1) -> np.ndarray:
    """Hash of ``h[i:i+size]`` for every ``i``; texts are not told apart."""
    n = len(h)
    if n < size:
        return np.zeros(0, dtype=U64)
    power, inverse = powers(_ODD[family], n + 1)
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum((h if family == 1 else mix(h ^ U64(_ODD[0]))) * power[:n], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * inverse[: n - size + 1] + U64(size))


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; a longer text has a range of its own."""
    if not len(column):
        return
    _, at = text_bytes(column)
    begin = 0
    while begin < len(column):
        end = int(np.searchsorted(at, at[begin] + limit, side="right")) - 1
        end = min(max(end, begin + 1), len(column))
        yield begin, end
        begin = end


def ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``begin[0], begin[0]+1, ...`` for ``length[0]`` numbers, then the same for the next."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    jump = np.repeat(begin - np.concatenate(([0], np.cumsum(length)[:-1])), length)
    return np.arange(total) + jump
