"""Histograms and box statistics as exact aggregates over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rolecall.operators.percentiles import percentile_profile
from rolecall.operators.ranking import few_in_order
from rolecall.operators.sampling import repeatable_sample

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def histogram(
    rows: DataFrame, value: str, low: float, high: float, width: float
) -> DataFrame:
    """(bin, bin_from, bin_to, count) over the values from low to high inclusive.

    Bin 0 starts at ``low``; bins without a value are left out.
    """
    number = F.floor((F.col(value) - F.lit(low)) / F.lit(width)).cast("long")
    counted = rows.filter(F.col(value).between(low, high)).groupBy(number.alias("bin"))
    start = F.lit(float(low)) + F.col("bin") * F.lit(float(width))
    bins = counted.agg(F.count(F.lit(1)).alias("count")).select(
        "bin",
        start.alias("bin_from"),
        (start + F.lit(float(width))).alias("bin_to"),
        "count",
    )
    return few_in_order(bins, "bin")


# The round widths in each power of ten.
ROUND = (1, 2, 5)


def round_histogram(
    rows: DataFrame, value: str, low: float, high: float, most: int, finest: float
) -> DataFrame:
    """(bin, bin_from, bin_to, count) in at most ``most`` bins of one round width.

    The width is the smallest of 1, 2 or 5 times a power of ten, counted in ``finest``
    (itself a power of ten), whose bins from the least to the greatest value between
    ``low`` and ``high`` number at most ``most``. Bins begin at whole multiples of the
    width; those between without a value are left out.

    Values are counted at the finest width, with partial counts before the one shuffle;
    that is at most (high - low) / finest rows. They then tell the range, so the width, and
    are merged in the task that received them.
    """
    cells = int((high - low) / finest) + 2
    if not 0 < cells <= 1_000_000 or most < 2:
        raise ValueError("finest must be under the range and over a millionth of it, most over 1")
    cell = F.floor(F.col(value) / F.lit(float(finest))).cast("long").alias("_cell")
    counted = rows.filter(F.col(value).between(low, high)).groupBy(cell)
    counted = counted.agg(F.count(F.lit(1)).alias("_n")).coalesce(1)
    widths = [factor * 10**power for power in range(len(str(cells)) + 1) for factor in ROUND]
    everything = Window.partitionBy()
    first, last = F.min("_cell").over(everything), F.max("_cell").over(everything)

    def fits(width: Column) -> Column:
        return F.floor(F.col("_last") / width) - F.floor(F.col("_first") / width) < most

    listed = F.array(*[F.lit(width).cast("long") for width in widths])
    ranged = counted.select("_cell", "_n", first.alias("_first"), last.alias("_last"))
    chosen = ranged.withColumn("_width", F.array_min(F.filter(listed, fits)))
    number = F.floor(F.col("_cell") / F.col("_width")).cast("long")
    merged = chosen.groupBy(number.alias("bin"), "_width").agg(F.sum("_n").alias("count"))
    width = F.col("_width") * F.lit(float(finest))
    return merged.select(
        "bin",
        (F.col("bin") * width).alias("bin_from"),
        ((F.col("bin") + 1) * width).alias("bin_to"),
        "count",
    ).orderBy("bin")


def quartiles(counts: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, mean, q1, median, q3) from counted values."""
    return percentile_profile(counts, [key], value, QUARTILES)


def fences(reach: float = 1.5) -> tuple[Column, Column]:
    """So many interquartile ranges below and above the box."""
    spread = F.col("q3") - F.col("q1")
    return F.col("q1") - reach * spread, F.col("q3") + reach * spread


def box_stats(counts: DataFrame, boxes: DataFrame, key: str, value: str) -> DataFrame:
    """Adds whiskers and outlier counts to ``boxes``, a bounded set of quartile rows.

    Whiskers are the outermost values within 1.5 interquartile ranges of the box.
    ``boxes`` must have been cut by a limit, which bounds the broadcast.
    """
    lower, upper = fences()
    inside = F.col(value).between(lower, upper)
    fenced = counts.join(F.broadcast(boxes.withColumnRenamed("n", "_rows")), key)
    return fenced.groupBy(key, "_rows", "q1", "median", "q3").agg(
        F.min(value).alias("minimum"),
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.max(value).alias("maximum"),
        F.sum(F.when(inside, F.lit(0)).otherwise(F.col("n"))).alias("outliers"),
    ).withColumnRenamed("_rows", "count")


def outlier_rows(
    rows: DataFrame,
    boxes: DataFrame,
    key: str,
    value: str,
    order: list[str],
    n: int,
    reach: float = 1.5,
) -> DataFrame:
    """Rows outside the fences of their group's box: at most n of each group.

    Which n is settled by the hash of ``order``, so that it is the same on every run.
    ``boxes`` (key, q1, q3) must have been cut by a limit: it is broadcast, and what is
    left of the rows is counted and cut group by group without gathering any group.
    """
    lower, upper = fences(reach)
    box = boxes.select(F.col(key).alias("_group"), lower.alias("_low"), upper.alias("_high"))
    outside = (F.col(value) < F.col("_low")) | (F.col(value) > F.col("_high"))
    held = rows.join(F.broadcast(box), (F.col(key) == F.col("_group")) & outside)
    return repeatable_sample(held.select(*rows.columns), order, n, by=[key])
