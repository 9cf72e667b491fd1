"""Market overview: totals, industries, bands, seniority and employment types."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rolecall.functions.derive import category_list, row_count, salary_band, whole_mean
from rolecall.operators.comparison import share_of_total
from rolecall.operators.filters import USUAL_SALARIES, PostingFilter
from rolecall.operators.ranking import few_in_order, ties, top_k


def industry_facets(postings: DataFrame, k: int = 20) -> DataFrame:
    """The k industries with most postings, over the whole table: (cat, cnt)."""
    named = postings.filter(F.col("primary_category").isNotNull())
    counted = named.groupBy(F.col("primary_category").alias("cat"))
    return top_k(counted.agg(row_count().alias("cnt")), "cnt", k, "cat")


def market_kpis(
    postings: DataFrame, chosen: PostingFilter = USUAL_SALARIES, approximate: bool = False
) -> DataFrame:
    """One row: postings, companies, mean salary and industries.

    The distinct counts shuffle distinct names only, whatever their share of the rows.
    ``approximate`` uses sketches, which shuffle nothing but themselves.
    """
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return chosen.apply(postings).agg(
        row_count().alias("total"),
        distinct("postedCompany_name").alias("companies"),
        whole_mean(F.col("average_salary")).alias("avg_sal"),
        distinct("primary_category").alias("industries"),
    )


def top_industries(
    postings: DataFrame, chosen: PostingFilter = USUAL_SALARIES, k: int = 12
) -> DataFrame:
    """The k industries with most postings: (industry, postings, avg_salary)."""
    rows = chosen.apply(postings).filter(F.col("primary_category").isNotNull())
    grouped = rows.groupBy(F.col("primary_category").alias("industry")).agg(
        row_count().alias("postings"), whole_mean(F.col("average_salary")).alias("avg_salary")
    )
    return top_k(grouped, "postings", k, "industry")


def salary_bands(
    postings: DataFrame, chosen: PostingFilter = USUAL_SALARIES
) -> DataFrame:
    """Postings per salary band, lowest band first: (band, count)."""
    return few_in_order(_bands(postings, chosen), "_lowest").drop("_lowest")


def salary_band_shares(
    postings: DataFrame, chosen: PostingFilter = USUAL_SALARIES
) -> DataFrame:
    """As ``salary_bands``, with each band's percentage of all postings."""
    shares = share_of_total(_bands(postings, chosen), "count", "share_pct")
    return few_in_order(shares, "_lowest").drop("_lowest")


def _bands(postings: DataFrame, chosen: PostingFilter) -> DataFrame:
    band = salary_band(F.col("average_salary")).alias("band")
    return chosen.apply(postings).groupBy(band).agg(
        row_count().alias("count"), F.min("average_salary").alias("_lowest")
    )


def seniority_profile(
    postings: DataFrame, chosen: PostingFilter = USUAL_SALARIES
) -> DataFrame:
    """Postings and mean salary per level, worst paid first."""
    rows = chosen.apply(postings).filter(F.col("positionLevels").isNotNull())
    grouped = rows.groupBy(F.col("positionLevels").alias("level")).agg(
        row_count().alias("count"), whole_mean(F.col("average_salary")).alias("avg_salary")
    )
    return grouped.orderBy(*ties("avg_salary", "level"))


def employment_mix(
    postings: DataFrame, chosen: PostingFilter = USUAL_SALARIES
) -> DataFrame:
    """Postings per employment type, most first: (type, count)."""
    rows = chosen.apply(postings).filter(F.col("employmentTypes").isNotNull())
    grouped = rows.groupBy(F.col("employmentTypes").alias("type"))
    counted = grouped.agg(row_count().alias("count"))
    return counted.orderBy(F.desc("count"), *ties("type"))


def overview_tiles(
    postings: DataFrame, chosen: PostingFilter = USUAL_SALARIES
) -> DataFrame:
    """All four breakdowns from one scan: (tile, label, postings, avg_salary).

    Rows are aggregated once by all four keys; grouping sets then run over that small
    cube, so that no raw row is expanded.
    """
    rows = chosen.apply(postings)
    keys = ["industry", "band", "level", "type"]
    cube = rows.groupBy(
        F.col("primary_category").alias("industry"),
        salary_band(F.col("average_salary")).alias("band"),
        F.col("positionLevels").alias("level"),
        F.col("employmentTypes").alias("type"),
    ).agg(row_count().alias("_n"), F.sum("average_salary").alias("_s"))
    tiles = cube.groupingSets([[key] for key in keys], *keys).agg(
        *[F.grouping(key).alias(f"_{key}") for key in keys],
        F.sum("_n").alias("postings"),
        F.round(F.sum("_s") / F.sum("_n"), 0).alias("avg_salary"),
    )
    tile, label = F.lit(None).cast("string"), F.lit(None).cast("string")
    for key in keys:
        used = F.col(f"_{key}") == 0
        tile = F.when(used, key).otherwise(tile)
        label = F.when(used, F.col(key)).otherwise(label)
    named = tiles.select(
        tile.alias("tile"), label.alias("label"), "postings", "avg_salary"
    )
    return named.filter(F.col("label").isNotNull())


def category_counts(postings: DataFrame) -> DataFrame:
    """Postings and mean salary per category, a posting counting in each of its own.

    The other reports count a posting under its first category only. Empty names do not
    count, as in those. Postings with the same text are counted together first, so that
    each text is parsed once.
    """

    stored = "category_list" in postings.columns
    key = "category_list" if stored else "categories"
    alike = postings.groupBy(key).agg(
        row_count().alias("_n"),
        F.sum("average_salary").alias("_s"),
        F.count("average_salary").alias("_paid"),
    )
    lists = F.col(key) if stored else category_list(F.col(key))
    names = F.filter(F.array_distinct(lists["category"]), lambda name: name != "")
    each = alike.select("_n", "_s", "_paid", F.explode(names).alias("industry"))
    return each.groupBy("industry").agg(
        F.sum("_n").alias("postings"),
        F.round(F.sum("_s") / F.sum("_paid"), 0).alias("avg_salary"),
    )
