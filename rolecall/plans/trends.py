"""Time series and tiers. These reports take no filter."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from rolecall.functions.derive import (
    application_tier,
    at_midnight,
    month_of,
    quarter_of,
    repost_tier,
    row_count,
    whole_mean,
)
from rolecall.operators.comparison import on_calendar, period_growth
from rolecall.operators.filters import PostingFilter
from rolecall.operators.ranking import few_in_order, keep_groups, ties, top_groups

_POSTED = "metadata_originalPostingDate"

# Fixed value: both series leave out the months before this day.
SERIES_START = date(2023, 1, 1)


def _month_start_from(day: date) -> date:
    """The first month start on or after ``day``."""
    if day.day == 1:
        return day
    return date(day.year + day.month // 12, day.month % 12 + 1, 1)


def _posted(postings: DataFrame, start: date, end: date | None = None) -> Column:
    """Posted from ``start`` to before ``end``.

    If the table is split into folders by month, the folder is tested too, so that
    others are not read.
    """
    posted = F.col(_POSTED) >= F.lit(start)
    if end is not None:
        posted &= F.col(_POSTED) < F.lit(end)
    if "posting_month" in postings.columns:
        posted &= F.col("posting_month") >= F.lit(start.replace(day=1))
        if end is not None:
            posted &= F.col("posting_month") <= F.lit(end)
    return posted


def monthly_trend(postings: DataFrame, since: date = SERIES_START) -> DataFrame:
    """Postings, mean salary and companies per month, from the first month >= since.

    The cut is made on the rows, where the scan can use it, and equals a cut on months.
    """
    months = _monthly(postings, since).withColumn("month", at_midnight(F.col("month")))
    return few_in_order(months, "month")


def _monthly(postings: DataFrame, since: date) -> DataFrame:
    rows = postings.filter(
        _posted(postings, _month_start_from(since)) & (F.col("average_salary") > 0)
    )
    return rows.groupBy(month_of(F.col(_POSTED)).alias("month")).agg(
        row_count().alias("postings"),
        whole_mean(F.col("average_salary")).alias("avg_salary"),
        F.count_distinct("postedCompany_name").alias("companies"),
    )


def monthly_calendar(
    postings: DataFrame, since: date = SERIES_START, chosen: PostingFilter | None = None
) -> DataFrame:
    """As ``monthly_trend``, with every month from the first posting to the last.

    A month without postings has counts of 0 and no mean. ``chosen`` narrows the postings.
    """
    cells = _monthly(chosen.apply(postings) if chosen else postings, since)
    months = on_calendar(cells, [], "month", 1, ["postings", "companies"])
    return few_in_order(months.withColumn("month", at_midnight(F.col("month"))), "month")


def quarterly_calendar(
    postings: DataFrame,
    since: date = SERIES_START,
    k: int | None = None,
    chosen: PostingFilter | None = None,
) -> DataFrame:
    """Quarter-over-quarter growth per industry on a complete calendar.

    Every industry has a row for each quarter from its first to its last posting, empty
    ones with 0 postings; growth after an empty quarter is null, into one it is -1.
    """
    cells = _quarterly(chosen.apply(postings) if chosen else postings, since)
    if k is not None:
        cells = keep_groups(cells, top_groups(cells, "industry", "postings", k), "industry")
    cells = on_calendar(cells, ["industry"], "quarter", 3, ["postings"])
    grown = period_growth(cells, "industry", "quarter", "postings")
    return grown.withColumn("quarter", at_midnight(F.col("quarter")))


def _quarterly(postings: DataFrame, since: date) -> DataFrame:
    rows = postings.filter(
        _posted(postings, since) & F.col("primary_category").isNotNull()
    )
    return rows.groupBy(
        F.col("primary_category").alias("industry"),
        quarter_of(F.col(_POSTED)).alias("quarter"),
    ).agg(row_count().alias("postings"))


def quarterly_trend(
    postings: DataFrame, since: date = SERIES_START, k: int = 6
) -> DataFrame:
    """Postings per quarter of the k largest industries; salaries play no part."""
    cells = _quarterly(postings, since)
    top = top_groups(cells, "industry", "postings", k)
    kept = keep_groups(cells, top, "industry")
    kept = kept.withColumn("quarter", at_midnight(F.col("quarter")))
    # Not one task: it would also merge the counts of the industries left out.
    return kept.orderBy("industry", "quarter")


def quarterly_growth(
    postings: DataFrame, since: date = SERIES_START, k: int | None = None
) -> DataFrame:
    """Quarter-over-quarter growth per industry; null after a quarter without postings.

    ``k`` keeps the k largest industries. The window holds one row per quarter.
    """
    cells = _quarterly(postings, since)
    if k is not None:
        cells = keep_groups(cells, top_groups(cells, "industry", "postings", k), "industry")
    before = F.add_months("quarter", -3)
    grown = period_growth(cells, "industry", "quarter", "postings", before)
    return grown.withColumn("quarter", at_midnight(F.col("quarter")))


def market_multiple(postings: DataFrame, earlier: date, later: date) -> DataFrame:
    """One row: postings in the quarters of two days, and the later over the earlier."""
    quarter = quarter_of(F.col(_POSTED))

    def within(day: date) -> Column:
        month = (day.month - 1) // 3 * 3 + 1
        start = date(day.year, month, 1)
        end = date(day.year + (month + 3) // 13, (month + 2) % 12 + 1, 1)
        return _posted(postings, start, end)

    counted = postings.filter(within(earlier) | within(later)).agg(
        F.count_if(quarter == quarter_of(F.lit(earlier))).alias("earlier_postings"),
        F.count_if(quarter == quarter_of(F.lit(later))).alias("later_postings"),
    )
    base = F.nullif(F.col("earlier_postings").cast("double"), F.lit(0.0))
    return counted.withColumn("multiple", F.col("later_postings") / base)


def _tiers(rows: DataFrame, tier: Column, name: str, order: Column) -> DataFrame:
    grouped = rows.groupBy(tier.alias(name)).agg(
        row_count().alias("count"),
        whole_mean(F.col("average_salary")).alias("avg_sal"),
        F.min(order).alias("_lowest"),
    )
    return few_in_order(grouped, *ties("_lowest", name)).drop("_lowest")


def repost_tiers(postings: DataFrame) -> DataFrame:
    """Postings and mean salary by how often a posting was repeated."""
    reposts = F.col("metadata_repostCount")
    rows = postings.filter(F.col("average_salary") > 0)
    return _tiers(rows, repost_tier(reposts), "category", reposts)


def application_tiers(postings: DataFrame) -> DataFrame:
    """Postings and mean salary by number of applications, fewest first."""
    applications = F.col("metadata_totalNumberJobApplication")
    rows = postings.filter(applications.isNotNull() & (F.col("average_salary") > 0))
    return _tiers(rows, application_tier(applications), "tier", applications)
