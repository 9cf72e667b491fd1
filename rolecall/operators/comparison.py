"""Shares, growth and ratios over small aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def share_of_total(groups: DataFrame, count: str, share: str) -> DataFrame:
    """Adds each row's percentage of the total of ``count``.

    The rows must be a fixed few, such as bands: the total runs over all of them.
    """
    total = F.sum(count).over(Window.partitionBy())
    return groups.withColumn(share, 100 * F.col(count).cast("double") / total)


def period_growth(
    cells: DataFrame, key: str, period: str, count: str, before: Column | None = None
) -> DataFrame:
    """Adds the previous period's count of the same key and the growth over it.

    With ``before``, the period that must come before each, both are null where the
    key has no row for it; without, the previous row counts.
    """
    order = Window.partitionBy(key).orderBy(period)
    previous = F.lag(count).over(order)
    if before is not None:
        previous = F.when(F.lag(period).over(order) == before, previous)
    return cells.withColumn("previous", previous).withColumn(
        "growth", F.col(count).cast("double") / F.nullif(F.col("previous"), F.lit(0)) - 1
    )


def on_calendar(
    cells: DataFrame, keys: list[str], period: str, months: int, counts: list[str]
) -> DataFrame:
    """``cells`` with a row for every period of each key, from its first to its last.

    Periods are ``months`` apart; missing ones have 0 in ``counts`` and null elsewhere.
    Each key's span comes from its own cells, and the spine is as long as the calendar,
    so neither grows with the rows behind the cells; a period that holds nothing anywhere
    is there too.
    """
    span = cells.groupBy(*keys).agg(F.min(period).alias("_first"), F.max(period).alias("_last"))
    step = F.make_ym_interval(F.lit(0), F.lit(months))
    named = span.filter(F.col("_first").isNotNull())
    spine = named.select(*keys, F.explode(F.sequence("_first", "_last", step)).alias(period))
    return spine.join(cells, [*keys, period], "left").fillna(0, counts).select(*cells.columns)


def ratio_to_base(
    groups: DataFrame, key: str, base: str, measure: str, ratio: str
) -> DataFrame:
    """Adds ``measure`` as a multiple of the base group's; null without that group."""
    base_measure = F.max(F.when(F.col(key) == base, F.col(measure)))
    # The rows are a fixed few, and finished: one scan serves both sides.
    base_measure = base_measure.over(Window.partitionBy())
    return groups.withColumn(ratio, F.col(measure) / base_measure)
