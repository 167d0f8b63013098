"""Months of activity as bitmaps.

The months in which a key was active become bits of a few longs, set by ``bit_or`` while rows are aggregated (combined
before the shuffle: a key of any number of rows sends one row a task). "Active k months later" is then a shift and
an AND, for all months at once; nothing is exploded and no list is built.

A word covers ``SPAN`` months from a January on. Its bits above are the first months of the next word's, so that a
shift of up to ``MOST_AHEAD`` months never leaves the word. The number of words follows the calendar, not the data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN, MOST_AHEAD = 48, 15
_OWN = (1 << SPAN) - 1


@dataclass(frozen=True)
class Bitmaps:
    """``rows``: one row per key with the words ``bits0``, ``bits1``, ...; ``start``: month index of the first bit."""

    rows: DataFrame
    start: int
    words: int

    def calendar_months(self, after: int = 0) -> Column:
        """Months of the year, of all years together, in which the key was active and ``after`` months later again: 12
        bits, January lowest."""
        years = [f"shiftright({self._own(word, after)}, {shift})" for word in range(self.words) for shift in range(0, SPAN, 12)]
        return F.expr(f"({' | '.join(years)}) & {0xFFF}L")

    def first_month(self) -> Column:
        """Month index of the first active month; NULL if there is none."""
        found = [f"if({self._own(word)} = 0, null, bit_count({self._lowest(word)} - 1) + {self.start + SPAN * word})"
                 for word in range(self.words)]
        return F.expr(f"coalesce({', '.join([*found, 'null'])})")

    def active_after_first(self, after: int) -> Column:
        """Whether the key was active ``after`` months after its first active month."""
        cases = [f"when {self._own(word)} <> 0 then (shiftright(bits{word}, {after}) & {self._lowest(word)}) <> 0"
                 for word in range(self.words)]
        return F.expr(f"case {' '.join(cases)} else false end")

    def _own(self, word: int, after: int = 0) -> str:
        """The word's own months in which the key was active, and ``after`` months later again."""
        again = f" & shiftright(bits{word}, {after})" if after else ""
        return f"(bits{word}{again} & {_OWN}L)"

    def _lowest(self, word: int) -> str:
        return f"({self._own(word)} & -{self._own(word)})"


def month_bitmaps(df: DataFrame, key: str, date: str, *others: Column) -> Bitmaps:
    """One row per ``key`` (NULL is a key, too) with its months of ``date`` and the aggregates ``others``; rows without a
    date set no bit. The calendar's first and last year come from one scan of the date column."""
    ends = df.agg(F.min(F.year(date)).alias("low"), F.max(F.year(date)).alias("high")).first()
    low, high = (ends["low"], ends["high"]) if ends["low"] is not None else (0, 0)
    start, words = 12 * low + 1, (12 * (high - low + 1) + SPAN - 1) // SPAN
    month = f"(year({date}) * 12 + month({date}) - {start})"

    def bits(word: int) -> Column:
        at = f"({month} - {SPAN * word})"
        return F.expr(f"bit_or(if({at} >= 0 and {at} < {SPAN + MOST_AHEAD}, shiftleft(1L, {at}), 0L))").alias(f"bits{word}")

    return Bitmaps(df.groupBy(key).agg(*[bits(w) for w in range(words)], *others), start, words)
