"""Salary benchmarks: industry by seniority, boxes, employment types, best-paid roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rolecall.functions.derive import row_count, whole_mean
from rolecall.functions.text import cell_text
from rolecall.model import LEVELS
from rolecall.operators.distribution import box_stats, outlier_rows, quartiles
from rolecall.operators.filters import USUAL_SALARIES, PostingFilter
from rolecall.operators.percentiles import percentile_profile, value_counts
from rolecall.operators.ranking import (
    few_in_order,
    in_large_groups,
    keep_groups,
    ties,
    top_groups,
    top_k,
)
from rolecall.operators.sampling import repeatable_sample


def salary_cells(
    postings: DataFrame, more_than: int = 50, k: int = 12
) -> DataFrame:
    """Mean salary per industry and level, for cells of more than 50 postings.

    Keeps the k industries with most postings in such cells.
    """
    cells = _cells(postings, more_than)
    top = top_groups(cells, "industry", "count", k)
    return keep_groups(cells, top, "industry")


def _cells(postings: DataFrame, more_than: int) -> DataFrame:
    rows = postings.filter(
        F.col("primary_category").isNotNull()
        & F.col("positionLevels").isNotNull()
        & F.col("average_salary").between(500, 30000)
    )
    cells = rows.groupBy(
        F.col("primary_category").alias("industry"),
        F.col("positionLevels").alias("seniority"),
    ).agg(
        whole_mean(F.col("average_salary")).alias("avg_salary"), row_count().alias("count")
    )
    # Every cell has a mean. Asking for it keeps the mean in all readers of the cells, so
    # that these share one scan and one shuffle.
    return cells.filter((F.col("count") > more_than) & F.col("avg_salary").isNotNull())


def salary_matrix(
    postings: DataFrame,
    levels: list[str] = LEVELS,
    more_than: int = 50,
    k: int = 12,
) -> DataFrame:
    """``salary_cells`` with a column per level, in order of seniority.

    Levels outside the list are dropped. Every listed level gives a column, so that the
    schema does not depend on the data; ``present_levels`` tells which hold a cell.
    """
    wide = salary_cells(postings, more_than, k).groupBy("industry")
    matrix = wide.pivot("seniority", levels).agg(F.first("avg_salary"))
    return few_in_order(matrix, "industry")


def salary_matrix_text(
    postings: DataFrame,
    levels: list[str] = LEVELS,
    more_than: int = 50,
    k: int = 12,
) -> DataFrame:
    """``salary_matrix`` as text for display; a cell without a mean is empty."""
    matrix = salary_matrix(postings, levels, more_than, k)
    shown = [cell_text(F.col(f"`{level}`")).alias(level) for level in levels]
    return matrix.select("industry", *shown)


def present_levels(
    postings: DataFrame, levels: list[str] = LEVELS, more_than: int = 50
) -> DataFrame:
    """The listed levels that hold a cell, in order of seniority: (level, ordinal)."""
    ordinal = F.array_position(F.lit(levels), F.col("seniority"))
    found = _cells(postings, more_than).select("seniority").distinct()
    listed = found.select(F.col("seniority").alias("level"), ordinal.alias("ordinal"))
    return few_in_order(listed.filter(F.col("ordinal") > 0), "ordinal")


def large_industry_salaries(
    postings: DataFrame,
    more_than: int = 500,
    low: float = 500,
    high: float = 20000,
) -> DataFrame:
    """Raw (industry, average_salary) of industries with more than 500 postings."""
    rows = _named_between(postings, low, high)
    return in_large_groups(rows, "industry", more_than)


def salary_samples(
    postings: DataFrame, keys: list[str], n: int = 100, low: float = 500, high: float = 20000
) -> DataFrame:
    """At most n raw salaries of every industry, in a fixed pseudo-random choice."""
    rows = _named_between(postings, low, high, keys)
    return repeatable_sample(rows, keys, n, by=["industry"])


def _named_between(
    postings: DataFrame, low: float, high: float, keys: list[str] | None = None
) -> DataFrame:
    rows = postings.filter(
        F.col("primary_category").isNotNull()
        & F.col("average_salary").between(low, high)
    )
    industry = F.col("primary_category").alias("industry")
    return rows.select(*(keys or []), industry, "average_salary")


def salary_box(
    postings: DataFrame,
    more_than: int = 500,
    k: int = 10,
    low: float = 500,
    high: float = 20000,
) -> DataFrame:
    """Box statistics of the k industries with the highest median, over all rows.

    One scan: group sizes, quartiles and whiskers all come from the counted values.
    """
    rows = _named_between(postings, low, high)
    counts = value_counts(rows, ["industry"], "average_salary")
    top = _top_boxes(counts, more_than, k)
    stats = box_stats(counts, top, "industry", "average_salary")
    return few_in_order(stats, F.desc("median"), *ties("industry"))


def _top_boxes(counts: DataFrame, more_than: int, k: int) -> DataFrame:
    boxes = quartiles(counts, "industry", "average_salary")
    boxes = boxes.filter(F.col("n") > more_than)
    return top_k(boxes, "median", k, "industry").drop("mean")


def salary_outliers(
    postings: DataFrame,
    keys: list[str],
    n: int = 50,
    more_than: int = 500,
    k: int = 10,
    low: float = 500,
    high: float = 20000,
    reach: float = 1.5,
) -> DataFrame:
    """The points beside the boxes of ``salary_box``: at most n of each industry.

    (industry, average_salary) and the columns ``keys``, by whose hash the n are chosen.
    ``reach`` is how many interquartile ranges from the box a point must be.
    """
    counts = value_counts(_named_between(postings, low, high), ["industry"], "average_salary")
    top = _top_boxes(counts, more_than, k)
    rows = _named_between(postings, low, high, keys)
    return outlier_rows(rows, top, "industry", "average_salary", keys, n, reach)


def salary_by_employment(postings: DataFrame) -> DataFrame:
    """Mean and median salary per employment type, best paid first."""
    rows = postings.filter(
        F.col("employmentTypes").isNotNull()
        & F.col("average_salary").between(500, 30000)
    )
    counts = value_counts(rows, ["employmentTypes"], "average_salary")
    profile = percentile_profile(
        counts, ["employmentTypes"], "average_salary", {"median": 0.5}
    )
    return profile.select(
        F.col("employmentTypes").alias("type"),
        F.round("mean", 0).alias("avg_sal"),
        F.round("median", 0).alias("median_sal"),
        F.col("n").alias("count"),
    ).orderBy(F.desc("avg_sal"), *ties("type"))


def top_paying_roles(
    postings: DataFrame,
    chosen: PostingFilter = USUAL_SALARIES,
    at_least: int = 5,
    k: int = 20,
) -> DataFrame:
    """The k best-paid (title, industry) pairs with at least 5 postings."""
    rows = chosen.apply(postings).filter(F.col("average_salary") > 0)
    grouped = rows.groupBy(
        "title", F.col("primary_category").alias("industry")
    ).agg(
        whole_mean(F.col("average_salary")).alias("avg_salary"),
        row_count().alias("postings"),
    )
    frequent = grouped.filter(F.col("postings") >= at_least)
    return top_k(frequent, "avg_salary", k, "title", "industry")
