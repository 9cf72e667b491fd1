"""One industry in depth. These reports see all salaries above 0, without filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rolecall.functions.derive import row_count, whole_mean
from rolecall.operators.distribution import histogram, round_histogram
from rolecall.operators.percentiles import percentile_profile, value_counts
from rolecall.operators.ranking import top_k
from rolecall.operators.sampling import repeatable_sample


def _paid(postings: DataFrame, industry: str) -> DataFrame:
    chosen = F.col("primary_category") == industry
    return postings.filter(chosen & (F.col("average_salary") > 0))


def industry_kpis(postings: DataFrame, industry: str) -> DataFrame:
    """One row: postings, mean, median and highest salary, companies."""
    rows = _paid(postings, industry)
    counts = value_counts(rows, [], "average_salary")
    median = percentile_profile(counts, [], "average_salary", {"p50": 0.5})
    stats = rows.agg(
        row_count().alias("total"),
        whole_mean(F.col("average_salary")).alias("avg_sal"),
        F.max("average_salary").alias("max_sal"),
        F.count_distinct("postedCompany_name").alias("companies"),
    )
    return stats.select(
        "total",
        "avg_sal",
        F.round(median.select("p50").scalar(), 0).alias("median_sal"),
        "max_sal",
        "companies",
    )


def top_roles(postings: DataFrame, industry: str, k: int = 10) -> DataFrame:
    """The k titles with most postings: (title, count, avg_sal)."""
    grouped = _paid(postings, industry).groupBy("title").agg(
        row_count().alias("count"), whole_mean(F.col("average_salary")).alias("avg_sal")
    )
    return top_k(grouped, "count", k, "title")


def top_companies(postings: DataFrame, industry: str, k: int = 15) -> DataFrame:
    """The k companies with most postings; unnamed ones form one group."""
    company = F.col("postedCompany_name").alias("company")
    grouped = _paid(postings, industry).groupBy(company).agg(
        row_count().alias("postings"), whole_mean(F.col("average_salary")).alias("avg_salary")
    )
    return top_k(grouped, "postings", k, "company")


def salary_histogram(
    postings: DataFrame,
    industry: str,
    low: float = 500,
    high: float = 30000,
    width: float = 500,
) -> DataFrame:
    """Salaries of the industry in bins of fixed width, over all postings."""
    rows = postings.filter(F.col("primary_category") == industry)
    return histogram(rows, "average_salary", low, high, width)


def salary_round_histogram(
    postings: DataFrame,
    industry: str,
    low: float = 500,
    high: float = 30000,
    most: int = 40,
    finest: float = 1,
) -> DataFrame:
    """Salaries of the industry in at most ``most`` bins of a round width."""
    rows = postings.filter(F.col("primary_category") == industry)
    return round_histogram(rows, "average_salary", low, high, most, finest)


def salary_sample(
    postings: DataFrame,
    industry: str,
    keys: list[str],
    n: int = 5000,
    low: float = 500,
    high: float = 30000,
) -> DataFrame:
    """At most n raw salaries of the industry, in a fixed pseudo-random order."""
    rows = postings.filter(
        (F.col("primary_category") == industry)
        & F.col("average_salary").between(low, high)
    ).select(*keys, "average_salary")
    return repeatable_sample(rows, keys, n)
