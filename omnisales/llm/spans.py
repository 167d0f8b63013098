"""Spans in texts: found by Python functions in Arrow batches, digested by SQL functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

Span = tuple[str, int, int]
SPANS = "array<struct<kind:string,start:long,end:long>>"
SPAN_LIST = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def span_array(found: list[list[Span]]) -> pa.Array:
    return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in one] for one in found], SPAN_LIST)


def in_order(spans: list[Span], kinds: list[str]) -> list[Span]:
    """By start, then by the kinds' order."""
    return sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2]))


class Taken:
    """Positions of a text that spans cover."""

    def __init__(self, length: int, spans: list[Span]):
        self.marks = bytearray(length)
        for _, a, b in spans:
            self.add(a, b)

    def add(self, a: int, b: int) -> None:
        self.marks[a:b] = b"\1" * (b - a)

    def clear(self, a: int, b: int) -> bool:
        return self.marks.find(1, a, b) < 0

    def free(self, a: int, b: int) -> Iterator[tuple[int, int]]:
        """The parts of a range that no span covers."""
        while (a := self.marks.find(0, a, b)) >= 0:
            to = self.marks.find(1, a, b)
            to = b if to < 0 else to
            yield a, to
            a = to


def of_kind(kind: str, spans: str = "spans") -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def joined(spans: Column | str) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def base_only(kinds: list[str], spans: str = "spans") -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def cut_out(text: str, spans: list[Span], mark: Callable[[str], str]) -> str:
    """The text with each group of overlapping spans replaced by the mark of its first kind."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], mark(kind)]
        at = max(at, end)
    return "".join([*out, text[at:]])


def texts_of(column: pa.Array) -> Iterator[str]:
    """Whole texts; null counts as empty."""
    for value in column:
        yield value.as_py() or ""
