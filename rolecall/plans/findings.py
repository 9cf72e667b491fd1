"""The market findings that the overview states in words, as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rolecall.functions.derive import row_count, whole_mean
from rolecall.model import LEVELS
from rolecall.operators.comparison import ratio_to_base
from rolecall.operators.filters import USUAL_SALARIES, PostingFilter
from rolecall.operators.ranking import ties, top_k, with_dense_rank
from rolecall.plans.overview import seniority_profile


def seniority_ratio(
    postings: DataFrame, base: str = LEVELS[0], chosen: PostingFilter = USUAL_SALARIES
) -> DataFrame:
    """Each level's mean salary as a multiple of the base level's."""
    profile = seniority_profile(postings, chosen)
    return ratio_to_base(profile, "level", base, "avg_salary", "ratio")


def industry_rank(postings: DataFrame) -> DataFrame:
    """Industries by volume and by mean salary, with both dense ranks."""
    rows = postings.filter(
        F.col("primary_category").isNotNull() & (F.col("average_salary") > 0)
    )
    grouped = rows.groupBy(F.col("primary_category").alias("industry")).agg(
        row_count().alias("postings"), whole_mean(F.col("average_salary")).alias("avg_salary")
    )
    # Every industry has a mean. Asking for it keeps both measures in all readers, so that
    # these share one scan and one shuffle.
    grouped = grouped.filter((F.col("postings") > 0) & F.col("avg_salary").isNotNull())
    ranked = with_dense_rank(grouped, "postings", "volume_rank")
    ranked = with_dense_rank(ranked, "avg_salary", "salary_rank")
    both = F.col("volume_rank") + F.col("salary_rank")
    return ranked.orderBy(both, *ties("industry")).select(
        "industry", "postings", "avg_salary", "volume_rank", "salary_rank"
    )


def top_companies_overall(
    postings: DataFrame, chosen: PostingFilter = USUAL_SALARIES, k: int = 5
) -> DataFrame:
    """The k named companies with most postings in the salary range of ``chosen``."""
    rows = chosen.apply(postings).filter(F.col("postedCompany_name").isNotNull())
    grouped = rows.groupBy(F.col("postedCompany_name").alias("company"))
    return top_k(grouped.agg(row_count().alias("postings")), "postings", k, "company")


def load_profile(postings: DataFrame) -> DataFrame:
    """One row on the loaded table: rows, null salaries, rejected cells, date range."""
    posted = F.col("metadata_originalPostingDate")
    return postings.agg(
        row_count().alias("rows"),
        F.count_if(F.col("average_salary").isNull()).alias("null_salaries"),
        F.coalesce(F.sum("rejected_cells"), F.lit(0).cast("long")).alias("rejected_cells"),
        F.min(posted).alias("first_posted"),
        F.max(posted).alias("last_posted"),
    )
