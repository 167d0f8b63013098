"""Ranks, top-k, order statistics and exact NTILE.

Two kinds of input are ranked:

* aggregated rows of a dimension whose domain does not grow with the facts
  (platform, campaign, warehouse, city, weekday, day ...): a plain
  ``Window.orderBy`` in one task;
* rows whose number grows with the data (customers, products): ``positions``
  and ``rows_at`` below. One range shuffle sorts them; a row's number is its
  place in its partition plus the sizes of the partitions before it, which
  are observed in the same pass. No task holds more than one range, and there
  is one plan for every size.

NTILE needs no rank of every row: the rows that end the tiles are enough
(``selection.rows_at_ranks``), and for exact numbers the values there come
from counting (``ntile_maxima``) without any sort.

Every order passed in must end with a unique key, so ranks and tiles are
deterministic (the reference's ROW_NUMBER / NTILE have no tie-break).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Observation, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType

from ..session import shuffle_partitions, stored_copy

# monotonically_increasing_id: the partition in the upper bits, the place in it in the lower 33.
PLACE_BITS = 33


def rank_rows(df: DataFrame, order: Sequence[Column], name: str = "Ranking", bounded: bool = True) -> DataFrame:
    """ROW_NUMBER over aggregated rows.

    ``bounded``: the rows are groups of a dimension with a bounded domain, so
    one task orders them. Otherwise (e.g. products of a catalogue that grows)
    they are numbered by ``positions``.
    """
    if bounded:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
    return positions(df, order, name)


def top_k(df: DataFrame, order: Sequence[Column], k: int, name: str = "Ranking") -> DataFrame:
    """The first ``k`` rows in ``order``, numbered 1..k (TakeOrderedAndProject, then a k-row window)."""
    return rank_rows(df.orderBy(*order).limit(k), order, name)


@dataclass(frozen=True)
class OrderedCopy:
    """Rows in a total order, written; what was observed while they were: the size of each partition, and ``metrics``."""

    rows: DataFrame
    sizes: list[tuple[int, int]]
    metrics: dict

    def first_positions(self) -> list[tuple[int, int, int]]:
        """Number, first position and size of each partition."""
        found, at = [], 1
        for p, n in sorted(self.sizes):
            found.append((p, at, n))
            at += n
        return found

    @property
    def total(self) -> int:
        return sum(n for _, n in self.sizes)


def ordered_copy(df: DataFrame, order: Sequence[Column], *metrics: Column) -> OrderedCopy:
    """``df`` range-partitioned, sorted and written with ``_mid``, the row's partition and place in it.

    Sampled bounds split hot values because the order ends with a unique key.
    Partition sizes (a histogram with a bin for each partition, so exact) and
    the aggregates ``metrics`` are observed in the pass that writes: no job
    counts afterwards.
    """
    partitions = shuffle_partitions(df.sparkSession)
    ranged = df.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    ranged = ranged.withColumn("_mid", F.monotonically_increasing_id())
    seen = Observation(f"ordered-{uuid.uuid4().hex}")
    sizes = F.histogram_numeric(F.shiftright("_mid", PLACE_BITS), F.lit(max(partitions, 2))).alias("_sizes")
    rows = stored_copy(ranged.observe(seen, sizes, *metrics), "ordered")
    got = dict(seen.get)
    return OrderedCopy(rows, [(int(b["x"]), int(b["y"])) for b in got.pop("_sizes") or []], got)


def positions(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """1-based position of every row in a total ``order``."""
    return numbered(ordered_copy(df, order), name)


def numbered(copy: OrderedCopy, name: str) -> DataFrame:
    """The rows of an ``ordered_copy`` with their positions."""
    before = [0] * (max((p for p, _ in copy.sizes), default=0) + 1)
    for p, at, _ in copy.first_positions():
        before[p] = at
    place = F.col("_mid").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    # One number per partition, as one literal.
    first = F.split(F.lit(",".join(map(str, before))), ",")
    start = F.element_at(first, (F.shiftright("_mid", PLACE_BITS) + 1).cast("int")).cast("long")
    return copy.rows.withColumn(name, start + place).drop("_mid")


def rows_at(df: DataFrame, order: Sequence[Column], wanted: Callable[[int], Sequence[int]]) -> tuple[int, dict[int, Row]]:
    """The number of rows, and the rows at the 1-based positions of a total ``order`` that ``wanted`` gives for it."""
    copy = ordered_copy(df, order)
    mids = {}
    for w in wanted(copy.total):
        for p, at, n in copy.first_positions():
            if at <= w < at + n:
                mids[(p << PLACE_BITS) + w - at] = w
    if not mids:
        return copy.total, {}
    rows = copy.rows.filter(F.col("_mid").isin(*mids)).collect()
    return copy.total, {mids[r["_mid"]]: r for r in rows}


def tile_ends(total: int, tiles: int) -> list[int]:
    """Last position of each NTILE bucket; the first ``total % tiles`` buckets hold one more row."""
    size, extra = divmod(total, tiles)
    return [k * size + min(k, extra) for k in range(1, tiles + 1)]


def ntile_maxima(values: DataFrame, column: str, tiles: int) -> list:
    """``MAX(v)`` of each NTILE(tiles) bucket over ascending ``v`` (None for an empty bucket).

    That is the value at the bucket's last position. Exact numbers that fit
    64 bits on their grid (integers, DECIMAL up to 18 digits) are found by
    a sketch and an exact count; other types by a distributed sort (``rows_at``). Returns plain
    Python values; NULLs are left out.
    """
    kind = values.schema[column].dataType
    values = values.select(column).filter(F.col(column).isNotNull())
    if isinstance(kind, IntegralType) or isinstance(kind, DecimalType) and kind.precision <= 18:
        scale = kind.scale if isinstance(kind, DecimalType) else 0
        found = _select_tile_ends(values, column, tiles, scale)
        unit = Decimal(1).scaleb(-scale)
        return [None if v is None else Decimal(v) * unit if isinstance(kind, DecimalType) else v for v in found]
    total, rows = rows_at(values, [F.col(column).asc()], lambda n: tile_ends(n, tiles))
    ends = tile_ends(total, tiles)
    return [rows[e][column] if e and (not k or e > ends[k - 1]) else None for k, e in enumerate(ends)]


# Of the quantile sketch: ranks are right within one part in so many. Binary digits that one exact count tells apart.
SKETCH_PARTS, ROUND_BITS = 10_000, 12


@dataclass(frozen=True)
class _Interval:
    """Values that hold a wanted position, ends included."""

    low: int
    high: int


def _select_tile_ends(values: DataFrame, column: str, tiles: int, scale: int) -> list[int | None]:
    """Exact values at the tile ends of a column on an integer grid, in two scans.

    The first scan merges a quantile sketch, which brackets every limit, and
    counts the rows. The second counts rows below, between and, by value, inside
    the brackets, so the value at each position is known exactly. What the sketch
    says decides the work, never the result: where a bracket has more than
    2**ROUND_BITS values, it is counted by its leading digits first and once
    more inside; a position outside its bracket is looked for where the counts
    put it. Nothing is sorted, and the driver reads bucket counts only.
    """
    unit = f"cast({column} * {10 ** scale} as long)" if scale else f"cast({column} as long)"
    base = values.selectExpr(f"{unit} as u")
    around = [min(max(k / tiles + d / SKETCH_PARTS, 0.0), 1.0) for k in range(1, tiles) for d in (-2, 2)]
    first = base.agg(F.count(F.lit(1)).alias("n"), F.min("u").alias("low"), F.max("u").alias("high"),
                     F.percentile_approx("u", around or [0.5], SKETCH_PARTS).alias("around")).first()
    total = first["n"]
    ends = tile_ends(total, tiles)
    if not total:
        return [None] * tiles
    at: dict[int, int] = {total: first["high"]}
    open_: dict[int, _Interval] = {}
    for k, e in enumerate(ends[:-1]):
        if 0 < e < total:
            open_[e] = _Interval(first["around"][2 * k], first["around"][2 * k + 1])
    whole = _Interval(first["low"], first["high"])
    while open_:
        for e, found in _count_intervals(base, open_, whole).items():
            if found.low == found.high:
                at[e] = found.low
                del open_[e]
            else:
                open_[e] = found
    return [at[e] if e and (not k or e > ends[k - 1]) else None for k, e in enumerate(ends)]


def _count_intervals(base: DataFrame, wanted: dict[int, _Interval], whole: _Interval) -> dict[int, _Interval]:
    """One scan: for each wanted position a smaller interval that holds it, a single value where the count tells."""
    cuts = sorted({whole.low, whole.high + 1} | {x for i in wanted.values() for x in (i.low, i.high + 1)})
    regions = [_Interval(a, b - 1) for a, b in zip(cuts, cuts[1:])]
    inside = [any(i.low <= r.low and r.high <= i.high for i in wanted.values()) for r in regions]
    shifts = [max((r.high - r.low).bit_length() - ROUND_BITS, 0) if x else 64 for r, x in zip(regions, inside)]
    region = " + ".join(f"if(u >= {c}L, 1, 0)" for c in cuts[1:-1]) or "0"
    digit = " ".join(f"when {k} then shiftright(u - {r.low}L, {s})" for k, (r, s) in enumerate(zip(regions, shifts)) if s < 64)
    rows = (base.selectExpr("u", f"{region} as region").selectExpr("region", f"case region {digit} else 0L end as digit")
            .groupBy("region", "digit").agg(F.count(F.lit(1)).alias("n")).collect())
    found, before = {}, 0
    todo = sorted(wanted)
    for r in sorted(rows, key=lambda r: (r["region"], r["digit"])):
        of, shift = regions[r["region"]], shifts[r["region"]]
        part = of if shift == 64 else _Interval(of.low + (r["digit"] << shift), min(of.low + ((r["digit"] + 1) << shift) - 1, of.high))
        while todo and todo[0] <= before + r["n"]:
            found[todo.pop(0)] = part
        before += r["n"]
    if todo:
        raise RuntimeError("input changed between scans: position not found")
    return found
