"""The rows at given ranks of several orders at once, by counting instead of sorting.

Each order ("axis") is: NULLs first or last, a whole number ascending, then a unique id ascending. The first scan
counts the rows of all axes by the leading binary digits of the number. A wanted rank then lies in one bucket of its
axis. Buckets of few rows are fetched and ordered; larger ones are counted again by further digits of the number and,
where that is one value, by digits of the id, relative to the smallest and largest found in the bucket. Counts are
combined before the shuffle, and the driver reads a few thousand counts or rows for each rank.

Two scans settle a table of customers of any distribution up to some millions, three up to some billions.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

#: Leading digits told apart by one count, and rows of a bucket that are fetched at once.
DIGITS, FETCHED = 12, 4096
#: Bytes of a text id in one number, beside its remaining length.
CHUNK = 6


@dataclass(frozen=True)
class Axis:
    """SQL of ``nulls``: 0 for rows in front, 1 for rows behind; ``value``: a long, 0 for rows whose measure is NULL."""

    nulls: str
    value: str


@dataclass(frozen=True)
class _Bucket:
    """Rows of an axis with a number in ``low`` to ``high`` and an id that passes ``ids`` ((offset, least, most) each)."""

    axis: int
    nulls: int
    low: int
    high: int
    count: int
    least_id: object = None
    most_id: object = None
    ids: tuple[tuple[int, int, int], ...] = ()
    only_null_id: bool = False


@dataclass(frozen=True)
class Found:
    nulls: int
    value: int
    id: object


def rows_at_ranks(df: DataFrame, axes: Sequence[Axis], id_col: str,
                  wanted: Callable[[int], Sequence[int]]) -> tuple[int, list[dict[int, Found]]]:
    """The number of rows, and per axis the rows at the 1-based ranks that ``wanted`` gives for that number.

    ``id_col`` is unique and an integer or a text (ordered by its bytes), NULL first. ``df`` is scanned a few times and
    should be stored.
    """
    kind = df.schema[id_col].dataType
    if not isinstance(kind, (IntegralType, StringType)):
        raise TypeError(f"ids have to be integers or text, not {kind.simpleString()}")
    ids = _Ids(isinstance(kind, StringType))
    base = df.selectExpr(*[x for i, a in enumerate(axes) for x in (f"{a.nulls} as n{i}", f"{a.value} as v{i}")], f"`{id_col}` as id")
    total, buckets = _first_count(base, len(axes))
    pending: dict[tuple[int, int], tuple[_Bucket, int]] = {}
    for i in range(len(axes)):
        for rank in wanted(total):
            pending[i, rank] = _place(buckets[i], rank)
    found: list[dict[int, Found]] = [{} for _ in axes]
    while pending:
        distinct = list(dict.fromkeys(b for b, _ in pending.values()))
        small = [b for b in distinct if b.count <= FETCHED]
        rows = _fetch(base, ids, small) if small else {}
        for key, (bucket, rank) in list(pending.items()):
            if bucket in rows:
                found[key[0]][key[1]] = rows[bucket][rank - 1]
                del pending[key]
        large = [b for b in distinct if b.count > FETCHED]
        finer = _count_again(base, ids, large) if large else {}
        for key, (bucket, rank) in pending.items():
            pending[key] = _place(finer[bucket], rank)
    return total, found


@dataclass(frozen=True)
class _Ids:
    """Numbers that keep the order of ids."""

    text: bool

    def number(self, offset: int) -> str:
        """Of an integer itself; of a text its ``CHUNK`` bytes from ``offset`` on, then how many bytes are left."""
        if not self.text:
            return "cast(id as decimal(20,0))"
        digits = f"rpad(hex(substring(cast(id as binary), {offset + 1}, {CHUNK})), {2 * CHUNK}, '0')"
        left = f"least(greatest(octet_length(id) - {offset}, 0), {CHUNK + 1})"
        return f"cast(cast(conv({digits}, 16, 10) as long) * {CHUNK + 2} + {left} as decimal(20,0))"

    def number_of(self, value: object, offset: int) -> int:
        if not self.text:
            return int(value)
        raw = value.encode()[offset:]
        return int.from_bytes(raw[:CHUNK].ljust(CHUNK, b"\0"), "big") * (CHUNK + 2) + min(len(raw), CHUNK + 1)

    def sort_key(self, value: object) -> tuple:
        return (value is not None, value.encode() if self.text and value is not None else value or 0)


def _first_count(base: DataFrame, axes: int) -> tuple[int, list[list[_Bucket]]]:
    """Of each axis, its buckets in order: by NULL, sign and leading digits of the number."""
    parts = [f"named_struct('axis', {i}, 'nulls', n{i}, 'sign', cast(signum(v{i}) as int), "
             f"'shift', greatest(length(bin(abs(v{i}))) - {DIGITS}, 0), "
             f"'top', shiftright(abs(v{i}), greatest(length(bin(abs(v{i}))) - {DIGITS}, 0)))" for i in range(axes)]
    rows = _counted(base.selectExpr(f"explode(array({', '.join(parts)})) as p", "id"))
    found: list[list[_Bucket]] = [[] for _ in range(axes)]
    for r in rows:
        p = r["p"]
        near, far = p["top"] << p["shift"], ((p["top"] + 1) << p["shift"]) - 1
        low, high = (near, far) if p["sign"] >= 0 else (-far, -near)
        found[p["axis"]].append(_Bucket(p["axis"], p["nulls"], low, high, r["n"], r["least"], r["most"]))
    for one in found:
        one.sort(key=lambda b: (b.nulls, b.low))
    return sum(b.count for b in found[0]) if found else 0, found


def _counted(rows: DataFrame) -> list[Row]:
    return rows.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.max("id").alias("most")).collect()


def _place(buckets: Sequence[_Bucket], rank: int) -> tuple[_Bucket, int]:
    """The bucket that holds a rank, and the rank inside it."""
    for b in buckets:
        if rank <= b.count:
            return b, rank
        rank -= b.count
    raise ValueError("a rank beyond the rows, or the rows changed between scans")


def _inside(b: _Bucket, ids: _Ids) -> str:
    tests = [f"n{b.axis} = {b.nulls}", f"v{b.axis} between {b.low}L and {b.high}L"]
    if b.only_null_id:
        tests.append("id is null")
    tests += [f"id is not null and {ids.number(offset)} between {least}BD and {most}BD" for offset, least, most in b.ids]
    return " and ".join(tests)


def _chosen(base: DataFrame, cases: list[tuple[str, str]]) -> DataFrame:
    """For each row, the structs ``p`` of the cases (test, struct) that hold for it."""
    each = ", ".join(f"if({test}, {value}, null)" for test, value in cases)
    return base.selectExpr(f"explode(filter(array({each}), x -> x is not null)) as p", "id")


def _fetch(base: DataFrame, ids: _Ids, buckets: list[_Bucket]) -> dict[_Bucket, list[Found]]:
    """The rows of small buckets, in order."""
    rows = _chosen(base, [(_inside(b, ids), f"named_struct('k', {k}, 'v', v{b.axis})") for k, b in enumerate(buckets)]).collect()
    found: dict[_Bucket, list[Found]] = {b: [] for b in buckets}
    for r in rows:
        b = buckets[r["p"]["k"]]
        found[b].append(Found(b.nulls, r["p"]["v"], r["id"]))
    for b, members in found.items():
        if len(members) != b.count:
            raise RuntimeError("the rows changed between scans")
        members.sort(key=lambda f: (f.value, ids.sort_key(f.id)))
    return found


def _count_again(base: DataFrame, ids: _Ids, buckets: list[_Bucket]) -> dict[_Bucket, list[_Bucket]]:
    """Each large bucket as smaller ones, in order: by further digits of its numbers or, where that is one, of its ids."""
    cases, steps = [], []
    for k, b in enumerate(buckets):
        if b.low < b.high:
            offset, least = 0, b.low
            shift = max((b.high - b.low).bit_length() - DIGITS, 0)
            digit = f"cast(v{b.axis} as decimal(20,0))"
        else:
            offset = len(os.path.commonprefix([b.least_id.encode(), b.most_id.encode()])) if ids.text else 0
            least, most = ids.number_of(b.least_id, offset), ids.number_of(b.most_id, offset)
            shift = max((most - least).bit_length() - DIGITS, 0)
            digit = ids.number(offset)
        digit = f"({digit} - {least}BD) div {1 << shift}BD"
        if b.low == b.high:
            digit = f"if(id is null, -1L, {digit})"
        steps.append((shift, offset, least))
        cases.append((_inside(b, ids), f"named_struct('k', {k}, 'digit', {digit})"))
    rows = _counted(_chosen(base, cases))
    finer: dict[_Bucket, list[_Bucket]] = {b: [] for b in buckets}
    for r in sorted(rows, key=lambda r: r["p"]["digit"]):
        b, (shift, offset, least) = buckets[r["p"]["k"]], steps[r["p"]["k"]]
        digit = r["p"]["digit"]
        first, last = least + (digit << shift), least + ((digit + 1) << shift) - 1
        part = replace(b, count=r["n"], least_id=r["least"], most_id=r["most"])
        if b.low < b.high:
            part = replace(part, low=first, high=min(last, b.high))
        elif digit < 0:
            part = replace(part, only_null_id=True)
        else:
            part = replace(part, ids=(*b.ids, (offset, first, last)))
        finer[b].append(part)
    return finer


def tile_number(axis: Axis, id_col: str, ends: Sequence[tuple[Found, int]]) -> Column:
    """1 + how many tiles end before a row: of ``ends`` (the last row of a tile, how many tiles end there)."""
    parts = ["1L"]
    for end, times in ends:
        if end.id is None:
            later = f"`{id_col}` is not null"
        else:
            at = f"cast(X'{end.id.encode().hex()}' as string)" if isinstance(end.id, str) else f"{end.id}L"
            later = f"coalesce(`{id_col}` > {at}, false)"
        tied = f"{axis.nulls} = {end.nulls} and ({axis.value} > {end.value}L or {axis.value} = {end.value}L and {later})"
        parts.append(f"if({axis.nulls} > {end.nulls} or {tied}, {times}L, 0L)")
    return F.expr(" + ".join(parts))
