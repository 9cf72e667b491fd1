"""Keyword search over roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rolecall.functions.derive import row_count, whole_mean
from rolecall.functions.text import (
    matches_keyword,
    money_range_text,
    money_text,
    one_decimal_text,
)
from rolecall.operators.distribution import histogram, round_histogram
from rolecall.operators.filters import USUAL_SALARIES, PostingFilter
from rolecall.operators.ranking import ties

_KEYS = ["title", "industry", "seniority", "type"]

# The three orders on offer, with the column that each sorts by.
ORDERS = {
    "Salary (High→Low)": F.desc_nulls_last,
    "Salary (Low→High)": F.asc_nulls_last,
    "Postings (Most)": F.desc_nulls_last,
}
BEST_PAID, WORST_PAID, MOST_POSTED = ORDERS


def _matching(
    postings: DataFrame, chosen: PostingFilter, keyword: str, wildcards: bool
) -> DataFrame:
    rows = chosen.apply(postings)
    if not keyword:
        return rows
    return rows.filter(matches_keyword(F.col("title"), keyword, wildcards))


def role_groups(
    postings: DataFrame,
    chosen: PostingFilter = USUAL_SALARIES,
    keyword: str = "",
    at_least: int = 3,
    wildcards: bool = False,
) -> DataFrame:
    """All matching (title, industry, level, type) groups of at least 3 postings."""
    rows = _matching(postings, chosen, keyword, wildcards)
    grouped = rows.groupBy(
        "title",
        F.col("primary_category").alias("industry"),
        F.col("positionLevels").alias("seniority"),
        F.col("employmentTypes").alias("type"),
    ).agg(
        whole_mean(F.col("average_salary")).alias("avg_salary"),
        F.round(F.min("salary_minimum"), 0).alias("min_sal"),
        F.round(F.max("salary_maximum"), 0).alias("max_sal"),
        row_count().alias("cnt"),
        F.avg("metadata_totalNumberJobApplication").alias("avg_apps"),
    )
    return grouped.filter(F.col("cnt") >= at_least)


def role_search(
    postings: DataFrame,
    chosen: PostingFilter = USUAL_SALARIES,
    keyword: str = "",
    order: str = BEST_PAID,
    limit: int = 200,
    at_least: int = 3,
    wildcards: bool = False,
) -> DataFrame:
    """The first ``limit`` role groups in one of three orders, ties by their keys."""
    measure = "cnt" if order == MOST_POSTED else "avg_salary"
    groups = role_groups(postings, chosen, keyword, at_least, wildcards)
    return groups.orderBy(ORDERS[order](measure), *ties(*_KEYS)).limit(limit)


def role_table(roles: DataFrame) -> DataFrame:
    """Role groups as text for display, under their display names."""
    return roles.select(
        F.col("title").alias("Title"),
        F.col("industry").alias("Industry"),
        F.col("seniority").alias("Seniority"),
        F.col("type").alias("Type"),
        money_text(F.col("avg_salary")).alias("Avg Salary"),
        money_range_text(F.col("min_sal"), F.col("max_sal")).alias("Range"),
        F.col("cnt").alias("Postings"),
        one_decimal_text(F.col("avg_apps")).alias("Avg Apps"),
    )


def role_count(
    postings: DataFrame,
    chosen: PostingFilter = USUAL_SALARIES,
    keyword: str = "",
    limit: int = 200,
    at_least: int = 3,
    wildcards: bool = False,
) -> DataFrame:
    """One row: how many groups match, and how many of them ``role_search`` shows."""
    groups = role_groups(postings, chosen, keyword, at_least, wildcards)
    found = groups.agg(row_count().alias("found"))
    return found.select("found", F.least("found", F.lit(limit).cast("long")).alias("shown"))


def search_histogram(
    postings: DataFrame,
    chosen: PostingFilter = USUAL_SALARIES,
    keyword: str = "",
    low: float = 500,
    high: float = 25000,
    width: float = 500,
    wildcards: bool = False,
) -> DataFrame:
    """Salaries of all matching postings, also those in groups below 3 postings."""
    rows = _matching(postings, chosen, keyword, wildcards)
    return histogram(rows, "average_salary", low, high, width)


def search_round_histogram(
    postings: DataFrame,
    chosen: PostingFilter = USUAL_SALARIES,
    keyword: str = "",
    low: float = 500,
    high: float = 25000,
    most: int = 50,
    finest: float = 1,
    wildcards: bool = False,
) -> DataFrame:
    """As ``search_histogram``, in at most ``most`` bins of a round width."""
    rows = _matching(postings, chosen, keyword, wildcards)
    return round_histogram(rows, "average_salary", low, high, most, finest)
