"""Distinct counts that can be merged: kept per month and industry, rolled up for any choice."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from rolecall.functions.derive import month_of, row_count

# 2 to this power registers: a standard error of 0.8 % (1.04 / sqrt(2 ** 14)).
PRECISION = 14
_KEYS = ["month", "industry"]


def _keyed(postings: DataFrame) -> DataFrame:
    return postings.filter(F.col("average_salary") > 0).select(
        month_of(F.col("metadata_originalPostingDate")).alias("month"),
        F.col("primary_category").alias("industry"),
        F.col("postedCompany_name").alias("company"),
        "title",
        "average_salary",
    )


def monthly_sketches(postings: DataFrame, precision: int = PRECISION) -> DataFrame:
    """(month, industry, postings, salaries, companies, titles): the last two are sketches.

    One row for each month and industry, whatever the number of postings: sketches are
    built in the tasks that read the rows, and only they are shuffled. Null names do
    not count; rows of no month or industry have rows of their own.
    """
    return _keyed(postings).groupBy(*_KEYS).agg(
        row_count().alias("postings"),
        F.sum("average_salary").alias("salaries"),
        F.hll_sketch_agg("company", F.lit(precision)).alias("companies"),
        F.hll_sketch_agg("title", F.lit(precision)).alias("titles"),
    )


def monthly_names(postings: DataFrame) -> DataFrame:
    """(month, industry, company), distinct: the exact counterpart of the sketches."""
    return _keyed(postings).select(*_KEYS, "company").distinct()


def _chosen(
    kept: DataFrame,
    since: date | None,
    until: date | None,
    industries: tuple[str, ...],
) -> DataFrame:
    if since is not None:
        kept = kept.filter(F.col("month") >= F.lit(since))
    if until is not None:
        kept = kept.filter(F.col("month") < F.lit(until))
    if industries:
        kept = kept.filter(F.col("industry").isin(*industries))
    return kept


def rolled_up(
    sketches: DataFrame,
    by: list[str],
    since: date | None = None,
    until: date | None = None,
    industries: tuple[str, ...] = (),
) -> DataFrame:
    """(by, postings, avg_salary, companies, titles) of a choice of months and industries.

    Reads no postings: counts, sums and sketches of the chosen rows are merged. ``by``
    is any of month and industry, or nothing for a total. Distinct counts are estimates.
    """
    chosen = _chosen(sketches, since, until, industries)
    return chosen.groupBy(*by).agg(
        F.sum("postings").alias("postings"),
        F.round(F.sum("salaries") / F.sum("postings"), 0).alias("avg_salary"),
        F.hll_sketch_estimate(F.hll_union_agg("companies")).alias("companies"),
        F.hll_sketch_estimate(F.hll_union_agg("titles")).alias("titles"),
    )


def exact_companies(
    names: DataFrame,
    by: list[str],
    since: date | None = None,
    until: date | None = None,
    industries: tuple[str, ...] = (),
) -> DataFrame:
    """(by, companies) of the same choice, exact, from ``monthly_names``."""
    chosen = _chosen(names, since, until, industries)
    return chosen.groupBy(*by).agg(F.count_distinct("company").alias("companies"))


def sketch_errors(sketches: DataFrame, names: DataFrame, by: list[str]) -> DataFrame:
    """(by, companies, estimate, error): each group's relative error, as a check."""
    exact = exact_companies(names, by)
    estimates = rolled_up(sketches, by).select(*by, F.col("companies").alias("estimate"))
    same = F.lit(True)
    for key in by:
        same = same & exact[key].eqNullSafe(estimates[key])
    both = exact.join(estimates, same).select(exact["*"], "estimate")
    apart = F.abs(F.col("estimate") - F.col("companies")).cast("double")
    base = F.nullif(F.col("companies").cast("double"), F.lit(0.0))
    return both.withColumn("error", F.coalesce(apart / base, F.lit(0.0)))
