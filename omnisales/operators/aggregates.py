"""Shares of a total, status panels and moving averages over aggregated rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import percent
from ..functions.text import pct_text
from ..functions.ordering import asc, desc, field_position
from ..operators.ranking import numbered, ordered_copy

# Delivery statuses of the panels, in panel order.
PANEL_STATUSES = ("Cancelled", "Returned", "Delivered")


def share_text(df: DataFrame, measure: str, digits: int, name: str = "Ratio") -> DataFrame:
    """``CONCAT(ROUND(m / SUM(m) OVER () * 100, digits), '%')`` on aggregated rows.

    The frame is one row per group of a bounded dimension, so the empty
    window (one task) carries only a handful of rows after the aggregate.
    """
    total = F.sum(measure).over(Window.partitionBy())
    return df.withColumn(name, pct_text(percent(F.col(measure), total, digits)))


def status_panel(sales: DataFrame, entity: str, measures: dict[str, Column], rank_measure: str,
                 ratio_measure: str | None = None, ratio_digits: int = 0,
                 statuses: Sequence[str] = PANEL_STATUSES, bounded: bool = True) -> DataFrame:
    """Per-status ranked lists of ``entity`` zipped side by side on their rank.

    The reference scans the view once per status and inner-joins three ranked
    lists on ROW_NUMBER. Here one aggregate over (entity, status) feeds the
    ranks and shares of all statuses, and a single group-by on the rank lays
    the lists side by side: one struct column per status holding ``entity``,
    the ``measures`` and ``Ratio``. Rows exist only for ranks present in every
    list, as with the inner joins. The rank order is ``rank_measure`` DESC,
    then the entity.

    With ``bounded`` (entities of a bounded dimension: warehouses, cities) the
    ranks and shares come from one window partitioned by status. Otherwise
    the (entity, status) groups are written once, ordered by (status, measure,
    entity); ranks are positions in that order minus each status's offset, and
    shares come from per-status totals, both observed in the pass that writes.
    """
    grouped = (sales.filter(F.col("delivery_status").isin(*statuses))
               .groupBy(entity, "delivery_status")
               .agg(*[agg.alias(name) for name, agg in measures.items()]))
    order = [desc(rank_measure), asc(entity)]
    if not bounded:
        status_no = field_position(F.col("delivery_status"), list(statuses))
        each = [F.count_if(F.col("delivery_status") == st).alias(f"n{i}") for i, st in enumerate(statuses)]
        if ratio_measure:
            each += [F.sum(F.when(F.col("delivery_status") == st, F.col(ratio_measure))).alias(f"t{i}") for i, st in enumerate(statuses)]
        copy = ordered_copy(grouped.withColumn("_s", status_no), [F.col("_s").asc()] + order, *each)
        offset, start = F.lit(0), 0
        for i, st in enumerate(statuses):
            offset = F.when(F.col("delivery_status") == st, F.lit(start)).otherwise(offset)
            start += copy.metrics[f"n{i}"] or 0
        ranked = numbered(copy, "_pos").withColumn("rn", F.col("_pos") - offset).drop("_s", "_pos")
        if ratio_measure:
            total = F.lit(None).cast("decimal(38,0)")
            for i, st in enumerate(statuses):
                if copy.metrics[f"t{i}"] is not None:
                    total = F.when(F.col("delivery_status") == st, F.lit(copy.metrics[f"t{i}"])).otherwise(total)
            ranked = ranked.withColumn("Ratio", pct_text(percent(F.col(ratio_measure), total, ratio_digits)))
    else:
        by_status = Window.partitionBy("delivery_status")
        ranked = grouped.withColumn("rn", F.row_number().over(by_status.orderBy(*order)))
        if ratio_measure:
            total = F.sum(ratio_measure).over(by_status)
            ranked = ranked.withColumn("Ratio", pct_text(percent(F.col(ratio_measure), total, ratio_digits)))
    fields = [entity] + list(measures) + (["Ratio"] if ratio_measure else [])
    packed = ranked.select("rn", F.struct("delivery_status", *fields).alias("v"))
    # one entry per status and rank: collect_list keeps a hash-based aggregate of <= len(statuses) items
    wide = packed.groupBy("rn").agg(F.collect_list("v").alias("vs"))
    def of_status(status: str):
        return lambda v: v["delivery_status"] == status

    picked = [F.filter("vs", of_status(s)) for s in statuses]
    keep = F.lit(True)
    for p in picked:
        keep = keep & (F.size(p) > 0)
    return wide.filter(keep).select("rn", *[F.element_at(p, 1).dropFields("delivery_status").alias(s)
                                             for p, s in zip(picked, statuses)])


def moving_average(daily: DataFrame, order: str, value: str, rows: int, name: str) -> Column:
    """AVG over the current and ``rows - 1`` preceding rows (rows, not calendar days)."""
    frame = Window.orderBy(order).rowsBetween(-(rows - 1), Window.currentRow)
    return F.avg(value).over(frame).alias(name)
