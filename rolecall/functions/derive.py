"""Columns derived from a posting's own fields."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rolecall.model import CATEGORY_LIST_TYPE

# Fixed value: finds the first named category in the JSON text.
CATEGORY_PATTERN = '"category":"([^"]+)"'


def primary_category(categories: Column) -> Column:
    """First named category; '' when the text names none, null for null text."""
    return F.regexp_extract(categories, CATEGORY_PATTERN, 1)


def category_list(categories: Column) -> Column:
    """All categories as an array of (id, category), parsed as true JSON.

    Text that is not well formed gives its first named category, without an id.
    """
    first = primary_category(categories)
    only = F.struct(F.lit(None).cast("int").alias("id"), first.alias("category"))
    parsed = F.from_json(categories, CATEGORY_LIST_TYPE)
    return F.coalesce(parsed, F.when(first != "", F.array(only)))


# The labels and bounds of the three tier columns below.


def salary_band(salary: Column) -> Column:
    return (
        F.when(salary < 3000, "Low (<S$3K)")
        .when(salary <= 6000, "Mid (S$3K–6K)")
        .when(salary <= 10000, "High (S$6K–10K)")
        .otherwise("Premium (>S$10K)")
    )


def repost_tier(reposts: Column) -> Column:
    """A null count falls into the last tier."""
    return (
        F.when(reposts == 0, "First Post")
        .when(reposts <= 2, "Reposted 1-2x")
        .when(reposts <= 5, "Reposted 3-5x")
        .otherwise("Reposted 6x+")
    )


def application_tier(applications: Column) -> Column:
    """A null count falls into the last tier."""
    return (
        F.when(applications < 5, "<5 apps")
        .when(applications < 20, "5-19 apps")
        .when(applications < 50, "20-49 apps")
        .otherwise("50+ apps")
    )


def month_of(day: Column) -> Column:
    """First day of the month, as a date."""
    return F.trunc(day, "month")


def quarter_of(day: Column) -> Column:
    """First day of the quarter, as a date."""
    return F.trunc(day, "quarter")


def at_midnight(day: Column) -> Column:
    """A date as a timestamp that does not depend on the session's time zone."""
    return day.cast("timestamp_ntz")


def row_count() -> Column:
    return F.count(F.lit(1))


def whole_mean(value: Column) -> Column:
    """Mean rounded to a whole number, halves away from zero."""
    return F.round(F.avg(value), 0)
