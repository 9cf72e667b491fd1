
from __future__ import annotations

from collections.abc import Callable
from datetime import date
from importlib import import_module
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession, functions as F

from rolecall.functions.derive import at_midnight
from rolecall.operators.filters import PostingFilter
from rolecall.operators.ranking import axis_order
from rolecall.plans import findings, industry, overview, salary, search, sketches, trends
from rolecall.plans.adhoc import ask
from rolecall.sources import detect, ingest, quarantine, titles
from rolecall.sources.ingest import clean
from rolecall.sources.shared import derived_once, label_of, shared_folder
from rolecall.sources.star import as_delivered, star_postings, write_as_csv

# The parameters that suit the test tables.
CUT = date(1997, 1, 1)
INDUSTRY = "Brand#4"
KEYWORD = "red w"
WILDCARDS = "r_d%small"
LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
# Few postings are paid so well that months and quarters are left empty.
BEST_PAID = PostingFilter(salary_from=31500, salary_to=None)
SAMPLE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _optional(name: str) -> ModuleType | None:
    """A module of the training-data operators, or None where it can't be imported."""
    try:
        return import_module(name)
    except ImportError:
        return None


_LLM = _optional("rolecall.llm.queries")
_PIPELINE = _optional("corpus_pipeline")


def _all_choices() -> PostingFilter:
    return PostingFilter(
        salary_from=2000,
        salary_to=12000,
        industries=("Brand#4", "Brand#7", "Brand#11"),
        employment_types=("BUILDING", "MACHINERY", "AUTOMOBILE"),
        levels=("1-URGENT", "2-HIGH", "5-LOW"),
        extra=F.col("metadata_repostCount") <= 4,
    )


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean postings table over the test tables: see ``derived_once``."""
    return derived_once(spark, sf_dir, lambda: star_postings(spark, sf_dir))


def entry(spark: SparkSession) -> DataFrame:
    return overview.top_industries(postings(spark, "/root/testdata/sf0.001"))


def _load_profile(table: DataFrame) -> DataFrame:
    profile = findings.load_profile(table)
    return profile.withColumns(
        {name: at_midnight(F.col(name)) for name in ("first_posted", "last_posted")}
    )


def _ingest_clean(table: DataFrame) -> DataFrame:
    posted = "metadata_originalPostingDate"
    cleaned = clean(as_delivered(table))
    return cleaned.withColumn(posted, at_midnight(F.col(posted)))


def _by_industry(cleaned: DataFrame) -> DataFrame:
    """A load profile of each industry."""
    return cleaned.groupBy(F.col("primary_category").alias("industry")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("average_salary").isNull()).alias("null_salaries"),
        F.sum("rejected_cells").alias("rejected_cells"),
        F.sum("salary_maximum").alias("salaries"),
    )


def _folder(table: DataFrame, name: str) -> str:
    """A shared folder for what a query writes, one for each table."""
    label = label_of(",".join(sorted(table.inputFiles())))
    return f"{shared_folder(table.sparkSession)}/{name}-{label}"


def _ingest_csv(table: DataFrame) -> DataFrame:
    """From text files to the clean table, through files on both sides."""
    spark, path = table.sparkSession, _folder(table, "csv")
    # As text, the rows take seven times the space of the table they come from.
    write_as_csv(as_delivered(table), f"{path}/raw", compression="gzip")
    ingest.write_csv_by_month(spark, f"{path}/raw/*/*.txt.gz", f"{path}/clean")
    return _by_industry(ingest.open_postings(spark, f"{path}/clean"))


def _ingest_csv_types(table: DataFrame) -> DataFrame:
    spark, path = table.sparkSession, _folder(table, "csv-types")
    write_as_csv(as_delivered(table), path)
    typed, types = detect.read_csv_detected(spark, f"{path}/*/*.txt")
    found = spark.createDataFrame(typed.dtypes, "column string, given string")
    return types.join(found, "column").drop("odd_place")


def _ingest_quarantine(table: DataFrame) -> DataFrame:
    """Both outcomes, row for row."""
    raw, path = as_delivered(table), _folder(table, "quarantine")
    kept, held = quarantine.split_postings(raw, path)
    same = ["title", "categories", F.col("postedCompany_name").alias("company")]
    return kept.select(
        F.lit("clean").alias("side"),
        *same,
        F.col("average_salary").cast("string").alias("salary"),
        F.lit("").alias("reasons"),
    ).unionByName(
        held.select(
            F.lit("quarantine").alias("side"),
            *same,
            F.col("average_salary").alias("salary"),
            F.array_join("reasons", ",").alias("reasons"),
        )
    )


def _ingest_reasons(table: DataFrame) -> DataFrame:
    path = _folder(table, "reasons")
    return quarantine.reason_counts(quarantine.split_postings(as_delivered(table), path)[1])


def _ingest_months(table: DataFrame) -> DataFrame:
    """A wrong delivery, a second one, and the first corrected, and once more."""
    spark, path = table.sparkSession, _folder(table, "months")
    paid = F.coalesce(F.col("average_salary") > 0, F.lit(False))
    early = F.col("metadata_originalPostingDate") < F.lit(date(1996, 1, 1))
    cleaned = table.select(*ingest.CLEAN_SCHEMA.names)
    for rows, load in (
        (cleaned.filter(~paid | early), "paid"),
        (cleaned.filter(~paid), "unpaid"),
        (cleaned.filter(paid), "paid"),
        (cleaned.filter(paid), "paid"),
    ):
        ingest.load_month_files(rows, path, load)
    held = ingest.open_months(spark, path)
    return held.groupBy(at_midnight(F.col("posting_month")).alias("month"), "load").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("average_salary").alias("salaries")
    )


def _title_index(table: DataFrame) -> str:
    """The title index over a table, written once per application."""
    path = _folder(table, "titles")
    if path not in _indexed:
        titles.write_title_index(table, path)
        _indexed.add(path)
    return path


_indexed: set[str] = set()


def _search_by_title(table: DataFrame) -> DataFrame:
    found = titles.postings_with(table.sparkSession, _title_index(table), KEYWORD)
    return search.role_search(found, keyword=KEYWORD)


def _matching_titles(table: DataFrame) -> DataFrame:
    found = titles.matching_titles(table.sparkSession, _title_index(table), WILDCARDS, True)
    return found.select("title")


def _sketched_companies(table: DataFrame) -> DataFrame:
    """Exact counts, and whether the merged sketches come within 2 % of them."""
    kept = sketches.monthly_sketches(table)
    errors = sketches.sketch_errors(kept, sketches.monthly_names(table), ["industry"])
    return errors.select("industry", "companies", (F.col("error") <= 0.02).alias("near"))


def _ingest_categories(table: DataFrame) -> DataFrame:
    """Categories of texts of which some are cut short."""
    torn = F.expr("substring(categories, 1, length(categories) - 1)")
    cut = F.when(F.col("l_partkey") % 7 == 0, torn).otherwise(F.col("categories"))
    raw = as_delivered(table.withColumn("categories", cut))
    return overview.category_counts(clean(raw, with_category_list=True))


def _titles_by_type(table: DataFrame) -> DataFrame:
    return ask(
        table,
        """
        SELECT employmentTypes AS type, COUNT(*) AS postings,
               COUNT(DISTINCT title) AS titles
        FROM {postings}
        WHERE average_salary > :floor AND positionLevels = :level
        GROUP BY employmentTypes
        """,
        floor=3000.0,
        level="2-HIGH",
    )


_REPORTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    # overview
    "facet_industries": overview.industry_facets,
    "kpi_overview": overview.market_kpis,
    "kpi_overview_filtered": lambda t: overview.market_kpis(t, _all_choices()),
    "top_industries": overview.top_industries,
    "top_industries_axis": lambda t: axis_order(
        overview.top_industries(t), "industry", "postings"
    ),
    "salary_bands": overview.salary_bands,
    "salary_band_share": overview.salary_band_shares,
    "seniority_profile": overview.seniority_profile,
    "employment_mix": overview.employment_mix,
    "overview_tiles": overview.overview_tiles,
    "category_counts": overview.category_counts,
    # industry
    "industry_kpi": lambda t: industry.industry_kpis(t, INDUSTRY),
    "industry_top_roles": lambda t: industry.top_roles(t, INDUSTRY),
    "industry_top_roles_axis": lambda t: axis_order(
        industry.top_roles(t, INDUSTRY), "title", "count"
    ),
    "industry_salary_hist": lambda t: industry.salary_histogram(t, INDUSTRY),
    "industry_top_companies": lambda t: industry.top_companies(t, INDUSTRY),
    "industry_salary_sample": lambda t: industry.salary_sample(
        t, INDUSTRY, SAMPLE_KEYS, n=1000
    ),
    "industry_salary_bins": lambda t: industry.salary_round_histogram(t, INDUSTRY),
    # salary
    "salary_heatmap": salary.salary_cells,
    "salary_heatmap_pivot": lambda t: salary.salary_matrix(t, LEVELS),
    "salary_heatmap_text": lambda t: salary.salary_matrix_text(t, LEVELS, more_than=65),
    "salary_heatmap_levels": lambda t: salary.present_levels(t, LEVELS),
    "salary_box": salary.salary_box,
    "salary_outliers": lambda t: salary.salary_outliers(t, SAMPLE_KEYS, reach=0.4),
    "salary_samples": lambda t: salary.salary_samples(t, SAMPLE_KEYS),
    "large_industry_salaries": salary.large_industry_salaries,
    "salary_by_employment": salary.salary_by_employment,
    "top_paying_roles": salary.top_paying_roles,
    "top_paying_roles_axis": lambda t: axis_order(
        salary.top_paying_roles(t), "title", "avg_salary"
    ),
    # trends
    "monthly_trend": lambda t: trends.monthly_trend(t, CUT),
    "quarterly_industry_trend": lambda t: trends.quarterly_trend(t, CUT),
    "quarterly_growth": lambda t: trends.quarterly_growth(t, CUT),
    "monthly_calendar": lambda t: trends.monthly_calendar(t, CUT, BEST_PAID),
    "quarterly_calendar": lambda t: trends.quarterly_calendar(t, CUT, chosen=BEST_PAID),
    "sketched_companies": _sketched_companies,
    "companies_since": lambda t: sketches.exact_companies(
        sketches.monthly_names(t), ["industry"], since=CUT
    ),
    "sketched_postings": lambda t: sketches.rolled_up(
        sketches.monthly_sketches(t), ["month"], since=CUT
    ).select(at_midnight(F.col("month")).alias("month"), "postings", "avg_salary"),
    "market_multiple": lambda t: trends.market_multiple(t, CUT, date(1997, 7, 1)),
    "repost_tiers": trends.repost_tiers,
    "application_tiers": trends.application_tiers,
    # search
    "role_search": lambda t: search.role_search(t, keyword=KEYWORD),
    "role_search_low": lambda t: search.role_search(
        t, keyword=KEYWORD, order=search.WORST_PAID
    ),
    "role_search_most": lambda t: search.role_search(
        t, keyword=KEYWORD, order=search.MOST_POSTED
    ),
    "role_search_all": search.role_search,
    "role_search_filtered": lambda t: search.role_search(
        t, _all_choices(), "red", at_least=1
    ),
    "role_search_by_title": _search_by_title,
    "matching_titles": _matching_titles,
    "role_search_wildcards": lambda t: search.role_search(
        t, keyword=WILDCARDS, wildcards=True
    ),
    "role_search_table": lambda t: search.role_table(
        search.role_search(t, keyword=KEYWORD)
    ),
    "role_search_count": search.role_count,
    "search_salary_hist": lambda t: search.search_histogram(t, keyword=KEYWORD),
    "search_salary_bins": lambda t: search.search_round_histogram(t, keyword=KEYWORD),
    # findings
    "seniority_ratio": lambda t: findings.seniority_ratio(t, LEVELS[-1]),
    "industry_rank": findings.industry_rank,
    "top_companies": findings.top_companies_overall,
    "load_profile": _load_profile,
    "adhoc_sql": _titles_by_type,
    # ingest
    "ingest_clean": _ingest_clean,
    "ingest_profile": lambda t: _load_profile(clean(as_delivered(t))),
    "ingest_categories": _ingest_categories,
    "ingest_types": lambda t: detect.detect_types(as_delivered(t), F.col("title")),
    "ingest_csv": _ingest_csv,
    "ingest_csv_types": _ingest_csv_types,
    "ingest_quarantine": _ingest_quarantine,
    "ingest_reasons": _ingest_reasons,
    "ingest_months": _ingest_months,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:

    def over(report: Callable[[DataFrame], DataFrame]):
        return lambda spark, sf_dir: report(postings(spark, sf_dir))

    found = {name: over(report) for name, report in _REPORTS.items()}
    if _LLM:
        found |= _LLM.QUERIES
    if _PIPELINE:
        found["pipeline"] = _PIPELINE.run
    return found


# The table as DuckDB sees it, written apart from the library on purpose. It stands before every oracle text.
_POSTINGS_SQL = """
WITH postings AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey,
    p.p_name || ' ' || lower(p.p_type) AS title,
    CASE WHEN l.l_partkey % 53 = 0 THEN NULL
         WHEN l.l_partkey % 59 = 0 THEN '[]'
         WHEN l.l_partkey % 3 = 0 THEN
           '[{"id":' || CAST(p.p_size AS VARCHAR) || ',"category":"' || p.p_brand
           || '"},{"id":0,"category":"' || p.p_type || '"}]'
         ELSE '[{"id":' || CAST(p.p_size AS VARCHAR) || ',"category":"' || p.p_brand
           || '"}]' END AS categories,
    CASE WHEN l.l_suppkey % 37 = 0 THEN NULL ELSE s.s_name END AS company,
    CASE WHEN l.l_orderkey % 71 = 0 THEN NULL ELSE o.o_orderpriority END AS level,
    CASE WHEN l.l_orderkey % 67 = 0 THEN NULL ELSE c.c_mktsegment END AS type,
    CASE WHEN l.l_orderkey % 263 = 0 THEN NULL WHEN l.l_orderkey % 61 = 0 THEN 0.0
         ELSE floor(l.l_extendedprice / 3) END::DOUBLE AS low,
    CASE WHEN l.l_orderkey % 263 = 0 THEN NULL WHEN l.l_orderkey % 61 = 0 THEN 0.0
         ELSE floor(l.l_extendedprice / 3) + 100 * l.l_linenumber END::DOUBLE AS high,
    CASE WHEN l.l_orderkey % 263 = 0 THEN NULL WHEN l.l_orderkey % 61 = 0 THEN 0.0
         ELSE floor(l.l_extendedprice / 3) + 50 * l.l_linenumber END::DOUBLE AS pay,
    CASE WHEN l.l_orderkey % 251 = 0 THEN NULL
         ELSE CAST(o.o_orderdate AS DATE) END AS posted,
    CASE WHEN l.l_orderkey % 257 = 0 THEN NULL
         ELSE CAST(l.l_linenumber - 1 AS INT) END AS reposts,
    CASE WHEN l.l_partkey % 89 = 0 THEN NULL
         ELSE CAST(l.l_quantity AS INT) END AS apps
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN customer c ON o.o_custkey = c.c_custkey
), named AS (
  SELECT *, regexp_extract(categories, '"category":"([^"]+)"', 1) AS industry
  FROM postings
), paid AS (
  SELECT * FROM named WHERE pay >= 1 AND pay <= 30000
), picked AS (
  SELECT * FROM named
  WHERE pay >= 2000 AND pay <= 12000
    AND industry IN ('Brand#4', 'Brand#7', 'Brand#11')
    AND type IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE')
    AND level IN ('1-URGENT', '2-HIGH', '5-LOW')
    AND reposts <= 4
), sector AS (
  SELECT * FROM named WHERE industry = 'Brand#4' AND pay > 0
)
"""

_KPIS_SQL = """
SELECT COUNT(*) AS total, COUNT(DISTINCT company) AS companies,
       round(AVG(pay), 0) AS avg_sal, COUNT(DISTINCT industry) AS industries
FROM {rows}
"""

_CELLS_SQL = """
, cells AS (
  SELECT industry, level AS seniority, round(AVG(pay), 0) AS avg_salary,
         COUNT(*) AS "count"
  FROM named
  WHERE industry IS NOT NULL AND level IS NOT NULL AND pay >= 500 AND pay <= 30000
  GROUP BY 1, 2 HAVING COUNT(*) > 50
), leaders AS (
  SELECT industry FROM cells GROUP BY industry
  ORDER BY SUM("count") DESC, industry LIMIT 12
)
"""

# The labels and bounds of the bands here and of the tiers below.
_BANDS_SQL = """
, banded AS (
  SELECT CASE WHEN pay < 3000 THEN 'Low (<S$3K)'
              WHEN pay <= 6000 THEN 'Mid (S$3K–6K)'
              WHEN pay <= 10000 THEN 'High (S$6K–10K)'
              ELSE 'Premium (>S$10K)' END AS band, *
  FROM paid
)
"""

_QUARTERS_SQL = """
, quarters AS (
  SELECT industry, CAST(date_trunc('quarter', posted) AS TIMESTAMP) AS quarter,
         COUNT(*) AS postings
  FROM named WHERE posted >= DATE '1997-01-01' AND industry IS NOT NULL
  GROUP BY 1, 2
)
"""

_DELIVERED_SQL = """
, delivered AS (
  SELECT *,
    CASE WHEN l_orderkey % 17 = 0 THEN 'n/a' ELSE CAST(low AS VARCHAR) END AS low_text,
    CASE WHEN l_orderkey % 19 = 0 THEN 'NaN' WHEN l_orderkey % 23 = 0 THEN 'Infinity'
         WHEN l_orderkey % 29 = 0 THEN ' ' || CAST(pay AS VARCHAR)
         ELSE CAST(pay AS VARCHAR) END AS pay_text,
    CASE WHEN l_orderkey % 43 = 0 THEN 'soon' ELSE CAST(posted AS VARCHAR) END
      AS posted_text,
    CASE WHEN l_partkey % 29 = 0 THEN '2.7' ELSE CAST(reposts AS VARCHAR) END
      AS reposts_text,
    CASE WHEN l_partkey % 31 = 0 THEN CAST(apps AS VARCHAR) || '.0'
         ELSE CAST(apps AS VARCHAR) END AS apps_text
  FROM named
), numbers AS (
  SELECT *, TRY_CAST(low_text AS DOUBLE) AS low_value,
    TRY_CAST(pay_text AS DOUBLE) AS pay_number,
    TRY_CAST(posted_text AS DATE) AS posted_value,
    TRY_CAST(reposts_text AS DOUBLE) AS reposts_number,
    TRY_CAST(apps_text AS DOUBLE) AS apps_number
  FROM delivered
), typed AS (
  SELECT *, CASE WHEN isfinite(pay_number) THEN pay_number END AS pay_value,
    CASE WHEN reposts_number = floor(reposts_number)
         THEN CAST(reposts_number AS INTEGER) END AS reposts_value,
    CASE WHEN apps_number = floor(apps_number)
         THEN CAST(apps_number AS INTEGER) END AS apps_value
  FROM numbers
), counted AS (
  SELECT *, CAST(
    CAST(low_text IS NOT NULL AND low_value IS NULL AS INT)
    + CAST(pay_text IS NOT NULL AND pay_value IS NULL AS INT)
    + CAST(posted_text IS NOT NULL AND posted_value IS NULL AS INT)
    + CAST(reposts_text IS NOT NULL AND reposts_value IS NULL AS INT)
    + CAST(apps_text IS NOT NULL AND apps_value IS NULL AS INT)
    + CAST(l_suppkey % 41 = 0 AS INT) AS INTEGER) AS rejected
  FROM typed
)
"""

# The columns whose cell was rejected, in the table's order.
_REASONS_SQL = """
, reasoned AS (
  SELECT *, concat_ws(',',
    CASE WHEN low_text IS NOT NULL AND low_value IS NULL THEN 'salary_minimum' END,
    CASE WHEN pay_text IS NOT NULL AND pay_value IS NULL THEN 'average_salary' END,
    CASE WHEN posted_text IS NOT NULL AND posted_value IS NULL
         THEN 'metadata_originalPostingDate' END,
    CASE WHEN reposts_text IS NOT NULL AND reposts_value IS NULL
         THEN 'metadata_repostCount' END,
    CASE WHEN apps_text IS NOT NULL AND apps_value IS NULL
         THEN 'metadata_totalNumberJobApplication' END,
    CASE WHEN l_suppkey % 41 = 0 THEN 'malformed_row' END,
    CASE WHEN pay_text IS NULL THEN 'no average_salary' END) AS reasons
  FROM counted
)
"""

_LARGE_SQL = """
, ranged AS (
  SELECT industry, pay FROM named
  WHERE industry IS NOT NULL AND pay >= 500 AND pay <= 20000
), large AS (
  SELECT industry FROM ranged GROUP BY industry HAVING COUNT(*) > 500
)
"""

_BOXES_SQL = """
, boxes AS (
  SELECT industry, COUNT(*) AS n, quantile_cont(pay, 0.25) AS q1,
         median(pay) AS median, quantile_cont(pay, 0.75) AS q3
  FROM ranged WHERE industry IN (SELECT industry FROM large)
  GROUP BY industry ORDER BY median DESC, industry LIMIT 10
)
"""

_CALENDAR_SQL = """
, best AS (
  SELECT *, CAST(date_trunc('month', posted) AS DATE) AS month,
         CAST(date_trunc('quarter', posted) AS DATE) AS quarter
  FROM named WHERE posted >= DATE '1997-01-01' AND pay >= 31500
)
"""

_TOP_PAYING_SQL = """
, best AS (
  SELECT title, industry, round(AVG(pay), 0) AS avg_salary, COUNT(*) AS postings
  FROM paid GROUP BY title, industry HAVING COUNT(*) >= 5
  ORDER BY avg_salary DESC, title NULLS LAST, industry NULLS LAST LIMIT 20
)
"""


def _roles_sql(
    order: str = "avg_salary DESC NULLS LAST",
    rows: str = "paid",
    where: str = "contains(lower(title), 'red w')",
    at_least: int = 3,
    limit: str = "LIMIT 200",
) -> str:
    return f"""
    , roles AS (
      SELECT title, industry, level AS seniority, type,
             round(AVG(pay), 0) AS avg_salary, round(MIN(low), 0) AS min_sal,
             round(MAX(high), 0) AS max_sal, COUNT(*) AS cnt, AVG(apps) AS avg_apps
      FROM {rows} WHERE {where}
      GROUP BY title, industry, level, type HAVING COUNT(*) >= {at_least}
      ORDER BY {order}, title NULLS LAST, industry NULLS LAST,
               seniority NULLS LAST, type NULLS LAST {limit}
    )
    """


def _hist_sql(rows: str, low: int, high: int) -> str:
    number = f"CAST(floor((pay - {low}) / 500) AS BIGINT)"
    return f"""
    SELECT {number} AS bin, CAST({low} + 500 * {number} AS DOUBLE) AS bin_from,
           CAST({low} + 500 * {number} + 500 AS DOUBLE) AS bin_to, COUNT(*) AS "count"
    FROM {rows} AND pay >= {low} AND pay <= {high} GROUP BY 1, 2, 3
    """


def _bins_sql(rows: str, low: int, high: int, most: int) -> str:
    """Bins of the smallest round width that gives at most so many."""
    return f"""
    , inside AS (
      SELECT CAST(floor(pay) AS BIGINT) AS cell FROM {rows} AND pay >= {low} AND pay <= {high}
    ), bounds AS (
      SELECT MIN(cell) AS least, MAX(cell) AS greatest FROM inside
    ), widths AS (
      SELECT CAST(f * power(10, p) AS BIGINT) AS width
      FROM (SELECT unnest([1, 2, 5]) AS f), (SELECT unnest(range(0, 7)) AS p)
    ), best AS (
      SELECT MIN(width) AS width FROM widths, bounds
      WHERE greatest // width - least // width + 1 <= {most}
    )
    SELECT cell // width AS bin, CAST(cell // width * width AS DOUBLE) AS bin_from,
           CAST((cell // width + 1) * width AS DOUBLE) AS bin_to, COUNT(*) AS "count"
    FROM inside, best GROUP BY 1, 2, 3
    """


# What counts as a whole and as any number.
_WHOLE = "regexp_matches(cell, '^[+-]?[0-9]{1,18}$')"
_NUMBER = "regexp_matches(cell, '^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$')"
_FITS = {
    "bigint": _WHOLE,
    "boolean": "lower(cell) IN ('true', 'false')",
    "date:MM/dd/yyyy": "try_strptime(cell, '%m/%d/%Y') IS NOT NULL",
    "date:dd/MM/yyyy": "try_strptime(cell, '%d/%m/%Y') IS NOT NULL",
    "date:yyyy-MM-dd": "try_strptime(cell, '%Y-%m-%d') IS NOT NULL",
    "double": _NUMBER,
    "int": f"coalesce({_WHOLE} AND TRY_CAST(cell AS INT) IS NOT NULL, FALSE)",
}
_NARROWEST = [
    "boolean", "int", "bigint", "double",
    "date:yyyy-MM-dd", "date:dd/MM/yyyy", "date:MM/dd/yyyy",
]
_DELIVERED_CELLS = {
    "title": "title",
    "categories": "categories",
    "postedCompany_name": "company",
    "positionLevels": "level",
    "employmentTypes": "type",
    "salary_minimum": "low_text",
    "salary_maximum": "CAST(high AS VARCHAR)",
    "average_salary": "pay_text",
    "metadata_originalPostingDate": "posted_text",
    "metadata_repostCount": "reposts_text",
    "metadata_totalNumberJobApplication": "apps_text",
}


def _types_sql(more: str) -> str:
    """Each column's type; the fits are listed by name, which settles ties."""
    cells = " UNION ALL ".join(
        f"SELECT '{name}' AS \"column\", nullif(trim({text}), '') AS cell, title FROM delivered"
        for name, text in _DELIVERED_CELLS.items()
    )
    fits = ", ".join(
        f"{{'misfits': COUNT(*) FILTER (WHERE cell IS NOT NULL AND NOT {test}), 'kind': '{kind}', "
        f"'odd_cell': MIN(cell) FILTER (WHERE NOT {test}), "
        f"'odd_place': arg_min(title, {{'c': cell, 't': title}}) FILTER (WHERE NOT {test})}}"
        for kind, test in _FITS.items()
    )
    listed = ", ".join(f"'{kind}'" for kind in _NARROWEST)
    return f"""
    , cells AS ({cells}), told AS (
      SELECT "column", COUNT(cell) AS cells, COUNT(*) - COUNT(cell) AS empty,
             [{fits}] AS fits FROM cells GROUP BY "column"
    ), judged AS (
      SELECT *, coalesce(list_filter([{listed}], lambda k: cells > 0 AND len(list_filter(
               fits, lambda f: f.kind = k AND f.misfits = 0)) > 0)[1], 'string') AS kind,
             list_sort(list_filter(fits, lambda f: f.misfits > 0 AND f.misfits < cells))[1]
               AS near
      FROM told
    )
    SELECT "column", CASE WHEN kind LIKE 'date:%' THEN 'date' ELSE kind END AS type,
           CASE WHEN kind LIKE 'date:%' THEN substr(kind, 6) END AS date_format,
           cells, empty, near.kind AS nearest, near.misfits AS misfits,
           near.odd_cell AS odd_cell{more}
    FROM judged
    """


def _tier_sql(name: str, cases: str, where: str) -> str:
    return f"""
    SELECT CASE {cases} END AS {name}, COUNT(*) AS "count",
           round(AVG(pay), 0) AS avg_sal
    FROM named WHERE {where} GROUP BY 1
    """


def _tile_sql(name: str, key: str) -> str:
    return f"""
    SELECT '{name}' AS tile, {key} AS label, COUNT(*) AS postings,
           round(AVG(pay), 0) AS avg_salary
    FROM banded WHERE {key} IS NOT NULL GROUP BY {key}
    """


_ORACLES: dict[str, str] = {
    "facet_industries": """
        SELECT industry AS cat, COUNT(*) AS cnt FROM named
        WHERE categories IS NOT NULL GROUP BY 1 ORDER BY cnt DESC, cat LIMIT 20""",
    "kpi_overview": _KPIS_SQL.format(rows="paid"),
    "kpi_overview_filtered": _KPIS_SQL.format(rows="picked"),
    "top_industries": """
        SELECT industry, COUNT(*) AS postings, round(AVG(pay), 0) AS avg_salary
        FROM paid WHERE industry IS NOT NULL GROUP BY industry
        ORDER BY postings DESC, industry LIMIT 12""",
    "top_industries_axis": """
        SELECT industry, CAST(SUM(postings) AS BIGINT) AS total FROM (
          SELECT industry, COUNT(*) AS postings FROM paid WHERE industry IS NOT NULL
          GROUP BY industry ORDER BY postings DESC, industry LIMIT 12)
        GROUP BY industry""",
    "salary_bands": _BANDS_SQL
    + 'SELECT band, COUNT(*) AS "count" FROM banded GROUP BY band',
    "salary_band_share": _BANDS_SQL
    + """
        SELECT band, COUNT(*) AS "count",
               100 * CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT(*) FROM paid) AS share_pct
        FROM banded GROUP BY band""",
    "seniority_profile": """
        SELECT level, COUNT(*) AS "count", round(AVG(pay), 0) AS avg_salary
        FROM paid WHERE level IS NOT NULL GROUP BY level""",
    "employment_mix": """
        SELECT type, COUNT(*) AS "count" FROM paid WHERE type IS NOT NULL GROUP BY type""",
    "overview_tiles": _BANDS_SQL
    + " UNION ALL ".join(
        _tile_sql(name, name) for name in ("industry", "band", "level", "type")
    ),
    "category_counts": """
        SELECT category AS industry, COUNT(*) AS postings,
               round(AVG(pay), 0) AS avg_salary
        FROM (
          SELECT pay, unnest(list_distinct(
            regexp_extract_all(categories, '"category":"([^"]+)"', 1))) AS category
          FROM named)
        GROUP BY category""",
    "industry_kpi": """
        SELECT COUNT(*) AS total, round(AVG(pay), 0) AS avg_sal,
               round(median(pay), 0) AS median_sal, MAX(pay) AS max_sal,
               COUNT(DISTINCT company) AS companies
        FROM sector""",
    "industry_top_roles": """
        SELECT title, COUNT(*) AS "count", round(AVG(pay), 0) AS avg_sal
        FROM sector GROUP BY title
        ORDER BY "count" DESC, title NULLS LAST LIMIT 10""",
    "industry_top_roles_axis": """
        SELECT title, CAST(SUM(n) AS BIGINT) AS total FROM (
          SELECT title, COUNT(*) AS n FROM sector GROUP BY title
          ORDER BY n DESC, title NULLS LAST LIMIT 10)
        GROUP BY title""",
    "industry_salary_hist": _hist_sql("named WHERE industry = 'Brand#4'", 500, 30000),
    "industry_top_companies": """
        SELECT company, COUNT(*) AS postings, round(AVG(pay), 0) AS avg_salary
        FROM sector GROUP BY company
        ORDER BY postings DESC, company NULLS LAST LIMIT 15""",
    "industry_salary_sample": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, pay AS average_salary
        FROM sector WHERE pay >= 500 AND pay <= 30000
        ORDER BY md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)),
                 l_orderkey, l_linenumber, l_partkey, l_suppkey, pay
        LIMIT 1000""",
    "industry_salary_bins": _bins_sql("named WHERE industry = 'Brand#4'", 500, 30000, 40),
    "salary_heatmap": _CELLS_SQL
    + "SELECT * FROM cells WHERE industry IN (SELECT industry FROM leaders)",
    "salary_heatmap_pivot": _CELLS_SQL
    + "SELECT industry, "
    + ", ".join(
        f"MAX(avg_salary) FILTER (WHERE seniority = '{level}') AS \"{level}\""
        for level in LEVELS
    )
    + " FROM cells WHERE industry IN (SELECT industry FROM leaders) GROUP BY industry",
    "salary_heatmap_text": _CELLS_SQL.replace("> 50", "> 65")
    + "SELECT industry, "
    + ", ".join(
        "coalesce('S$' || format('{:,}', CAST(trunc(MAX(avg_salary) FILTER "
        f"(WHERE seniority = '{level}')) AS BIGINT)), '') AS \"{level}\""
        for level in LEVELS
    )
    + " FROM cells WHERE industry IN (SELECT industry FROM leaders) GROUP BY industry",
    "salary_heatmap_levels": _CELLS_SQL
    + "SELECT DISTINCT seniority AS level, CAST(list_position(["
    + ", ".join(f"'{level}'" for level in LEVELS)
    + "], seniority) AS BIGINT) AS ordinal FROM cells",
    "salary_box": _LARGE_SQL
    + _BOXES_SQL
    + """
        SELECT industry, n AS "count", q1, median, q3, MIN(pay) AS minimum,
               MIN(pay) FILTER (WHERE pay >= q1 - 1.5 * (q3 - q1)) AS whisker_low,
               MAX(pay) FILTER (WHERE pay <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
               MAX(pay) AS maximum,
               COUNT(*) FILTER (WHERE pay < q1 - 1.5 * (q3 - q1)
                                   OR pay > q3 + 1.5 * (q3 - q1)) AS outliers
        FROM ranged JOIN boxes USING (industry)
        GROUP BY industry, n, q1, median, q3""",
    "salary_outliers": _LARGE_SQL
    + _BOXES_SQL
    + """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, industry,
               pay AS average_salary
        FROM named JOIN boxes USING (industry)
        WHERE pay >= 500 AND pay <= 20000
          AND (pay < q1 - 0.4 * (q3 - q1) OR pay > q3 + 0.4 * (q3 - q1))
        QUALIFY ROW_NUMBER() OVER (PARTITION BY industry ORDER BY md5(
          concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)),
          l_orderkey, l_linenumber, l_partkey, l_suppkey, pay) <= 50""",
    "salary_samples": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, industry,
               pay AS average_salary
        FROM named WHERE industry IS NOT NULL AND pay >= 500 AND pay <= 20000
        QUALIFY ROW_NUMBER() OVER (PARTITION BY industry ORDER BY md5(
          concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)),
          l_orderkey, l_linenumber, l_partkey, l_suppkey, pay) <= 100""",
    "large_industry_salaries": _LARGE_SQL
    + """
        SELECT industry, pay AS average_salary FROM ranged
        WHERE industry IN (SELECT industry FROM large)""",
    "salary_by_employment": """
        SELECT type, round(AVG(pay), 0) AS avg_sal, round(median(pay), 0) AS median_sal,
               COUNT(*) AS "count"
        FROM named WHERE type IS NOT NULL AND pay >= 500 AND pay <= 30000
        GROUP BY type""",
    "top_paying_roles": _TOP_PAYING_SQL + "SELECT * FROM best",
    "top_paying_roles_axis": _TOP_PAYING_SQL
    + "SELECT title, SUM(avg_salary) AS total FROM best GROUP BY title",
    "monthly_trend": """
        SELECT CAST(date_trunc('month', posted) AS TIMESTAMP) AS month,
               COUNT(*) AS postings, round(AVG(pay), 0) AS avg_salary,
               COUNT(DISTINCT company) AS companies
        FROM named WHERE posted IS NOT NULL AND pay > 0
        GROUP BY 1 HAVING month >= TIMESTAMP '1997-01-01'""",
    "quarterly_industry_trend": _QUARTERS_SQL
    + """
        SELECT * FROM quarters WHERE industry IN (
          SELECT industry FROM quarters GROUP BY industry
          ORDER BY SUM(postings) DESC, industry LIMIT 6)""",
    "quarterly_growth": _QUARTERS_SQL
    + """
        SELECT q.*, p.postings AS previous,
               CAST(q.postings AS DOUBLE) / p.postings - 1 AS growth
        FROM quarters q LEFT JOIN quarters p
          ON p.industry = q.industry AND p.quarter = q.quarter - INTERVAL 3 MONTH""",
    "monthly_calendar": _CALENDAR_SQL
    + """
        , spine AS (
          SELECT unnest(generate_series((SELECT MIN(month) FROM best),
                 (SELECT MAX(month) FROM best), INTERVAL 1 MONTH)) AS month
        )
        SELECT CAST(s.month AS TIMESTAMP) AS month, COUNT(b.month) AS postings,
               round(AVG(pay), 0) AS avg_salary, COUNT(DISTINCT company) AS companies
        FROM spine s LEFT JOIN best b ON CAST(s.month AS DATE) = b.month GROUP BY 1""",
    "quarterly_calendar": _CALENDAR_SQL
    + """
        , spine AS (
          SELECT industry, unnest(generate_series(MIN(quarter), MAX(quarter),
                 INTERVAL 3 MONTH)) AS quarter
          FROM best WHERE industry IS NOT NULL GROUP BY industry
        ), filled AS (
          SELECT s.industry, CAST(s.quarter AS TIMESTAMP) AS quarter,
                 COUNT(b.quarter) AS postings
          FROM spine s LEFT JOIN best b
            ON s.industry = b.industry AND CAST(s.quarter AS DATE) = b.quarter
          GROUP BY 1, 2
        )
        SELECT *, lag(postings) OVER w AS previous,
               CAST(postings AS DOUBLE) / nullif(lag(postings) OVER w, 0) - 1 AS growth
        FROM filled WINDOW w AS (PARTITION BY industry ORDER BY quarter)""",
    "sketched_companies": """
        SELECT industry, COUNT(DISTINCT company) AS companies, TRUE AS near
        FROM named WHERE pay > 0 GROUP BY industry""",
    "companies_since": """
        SELECT industry, COUNT(DISTINCT company) AS companies
        FROM named WHERE pay > 0 AND posted >= DATE '1997-01-01' GROUP BY industry""",
    "sketched_postings": """
        SELECT CAST(date_trunc('month', posted) AS TIMESTAMP) AS month,
               COUNT(*) AS postings, round(AVG(pay), 0) AS avg_salary
        FROM named WHERE pay > 0 AND posted >= DATE '1997-01-01' GROUP BY 1""",
    "market_multiple": """
        SELECT COUNT(*) FILTER (WHERE posted < DATE '1997-04-01') AS earlier_postings,
               COUNT(*) FILTER (WHERE posted >= DATE '1997-07-01') AS later_postings,
               CAST(COUNT(*) FILTER (WHERE posted >= DATE '1997-07-01') AS DOUBLE)
                 / COUNT(*) FILTER (WHERE posted < DATE '1997-04-01') AS multiple
        FROM named WHERE posted >= DATE '1997-01-01' AND posted < DATE '1997-10-01'""",
    "repost_tiers": _tier_sql(
        "category",
        """WHEN reposts = 0 THEN 'First Post' WHEN reposts <= 2 THEN 'Reposted 1-2x'
           WHEN reposts <= 5 THEN 'Reposted 3-5x' ELSE 'Reposted 6x+'""",
        "pay > 0",
    ),
    "application_tiers": _tier_sql(
        "tier",
        """WHEN apps < 5 THEN '<5 apps' WHEN apps < 20 THEN '5-19 apps'
           WHEN apps < 50 THEN '20-49 apps' ELSE '50+ apps'""",
        "apps IS NOT NULL AND pay > 0",
    ),
    "role_search": _roles_sql() + "SELECT * FROM roles",
    "role_search_by_title": _roles_sql() + "SELECT * FROM roles",
    "matching_titles": """
        SELECT DISTINCT title FROM named WHERE lower(title) LIKE '%r_d%small%'""",
    "role_search_low": _roles_sql("avg_salary ASC NULLS LAST") + "SELECT * FROM roles",
    "role_search_most": _roles_sql("cnt DESC") + "SELECT * FROM roles",
    "role_search_all": _roles_sql(where="TRUE") + "SELECT * FROM roles",
    "role_search_filtered": _roles_sql(
        rows="picked", where="contains(lower(title), 'red')", at_least=1
    )
    + "SELECT * FROM roles",
    "role_search_wildcards": _roles_sql(where="lower(title) LIKE '%r_d%small%'")
    + "SELECT * FROM roles",
    "role_search_table": _roles_sql()
    + """
        SELECT title AS "Title", industry AS "Industry", seniority AS "Seniority",
               type AS "Type",
               coalesce('S$' || format('{:,}', CAST(trunc(avg_salary) AS BIGINT)), '-')
                 AS "Avg Salary",
               coalesce('S$' || format('{:,}', CAST(trunc(min_sal) AS BIGINT)) || '–'
                 || format('{:,}', CAST(trunc(max_sal) AS BIGINT)), '-') AS "Range",
               cnt AS "Postings", coalesce(format('{:.1f}', avg_apps), '-') AS "Avg Apps"
        FROM roles""",
    "role_search_count": _roles_sql(where="TRUE", limit="")
    + """
        SELECT COUNT(*) AS found, CAST(least(COUNT(*), 200) AS BIGINT) AS shown
        FROM roles""",
    "search_salary_hist": _hist_sql(
        "paid WHERE contains(lower(title), 'red w')", 500, 25000
    ),
    "search_salary_bins": _bins_sql(
        "paid WHERE contains(lower(title), 'red w')", 500, 25000, 50
    ),
    "seniority_ratio": """
        , profile AS (
          SELECT level, COUNT(*) AS "count", round(AVG(pay), 0) AS avg_salary
          FROM paid WHERE level IS NOT NULL GROUP BY level)
        SELECT level, "count", avg_salary, avg_salary / (
          SELECT avg_salary FROM profile WHERE level = '5-LOW') AS ratio
        FROM profile""",
    "industry_rank": """
        , totals AS (
          SELECT industry, COUNT(*) AS postings, round(AVG(pay), 0) AS avg_salary
          FROM named WHERE industry IS NOT NULL AND pay > 0 GROUP BY industry)
        SELECT *, CAST(dense_rank() OVER (ORDER BY postings DESC) AS BIGINT) AS volume_rank,
               CAST(dense_rank() OVER (ORDER BY avg_salary DESC) AS BIGINT) AS salary_rank
        FROM totals""",
    "top_companies": """
        SELECT company, COUNT(*) AS postings FROM paid WHERE company IS NOT NULL
        GROUP BY company ORDER BY postings DESC, company LIMIT 5""",
    "load_profile": """
        SELECT COUNT(*) AS "rows", COUNT(*) FILTER (WHERE pay IS NULL) AS null_salaries,
               CAST(0 AS BIGINT) AS rejected_cells,
               CAST(MIN(posted) AS TIMESTAMP) AS first_posted,
               CAST(MAX(posted) AS TIMESTAMP) AS last_posted
        FROM named""",
    "adhoc_sql": """
        SELECT type, COUNT(*) AS postings, COUNT(DISTINCT title) AS titles
        FROM named WHERE pay > 3000 AND level = '2-HIGH' GROUP BY type""",
    "ingest_clean": _DELIVERED_SQL
    + """
        SELECT title, categories, company AS "postedCompany_name",
               level AS "positionLevels", type AS "employmentTypes",
               low_value AS salary_minimum, high AS salary_maximum,
               pay_value AS average_salary,
               CAST(posted_value AS TIMESTAMP) AS "metadata_originalPostingDate",
               reposts_value AS "metadata_repostCount",
               apps_value AS "metadata_totalNumberJobApplication",
               industry AS primary_category, rejected AS rejected_cells
        FROM counted""",
    "ingest_profile": _DELIVERED_SQL
    + """
        SELECT COUNT(*) AS "rows", COUNT(*) - COUNT(pay_value) AS null_salaries,
               CAST(SUM(rejected) AS BIGINT) AS rejected_cells,
               CAST(MIN(posted_value) AS TIMESTAMP) AS first_posted,
               CAST(MAX(posted_value) AS TIMESTAMP) AS last_posted
        FROM counted""",
    "ingest_categories": _DELIVERED_SQL
    + """
        SELECT category AS industry, COUNT(*) AS postings,
               round(AVG(pay_value), 0) AS avg_salary
        FROM (
          SELECT pay_value, unnest(list_distinct(
            CASE WHEN l_partkey % 7 = 0 THEN [industry]
                 ELSE regexp_extract_all(categories, '"category":"([^"]+)"', 1)
            END)) AS category
          FROM counted)
        WHERE category <> '' GROUP BY category""",
    "ingest_types": _DELIVERED_SQL + _types_sql(", near.odd_place AS odd_place"),
    "ingest_csv": _DELIVERED_SQL
    + """
        SELECT industry, COUNT(*) AS "rows", COUNT(*) - COUNT(pay_value) AS null_salaries,
               CAST(SUM(rejected) AS BIGINT) AS rejected_cells, SUM(high) AS salaries
        FROM counted GROUP BY industry""",
    "ingest_csv_types": _DELIVERED_SQL
    + _types_sql(", CASE WHEN kind LIKE 'date:%' THEN 'date' ELSE kind END AS given"),
    "ingest_quarantine": _DELIVERED_SQL
    + _REASONS_SQL
    + """
        SELECT CASE WHEN reasons = '' THEN 'clean' ELSE 'quarantine' END AS side,
               title, categories, company, reasons,
               CASE WHEN reasons = '' THEN CAST(pay_value AS VARCHAR) ELSE pay_text END
                 AS salary
        FROM reasoned""",
    "ingest_reasons": _DELIVERED_SQL
    + _REASONS_SQL
    + """
        SELECT reason, COUNT(*) AS "rows", CAST(0 AS BIGINT) AS files, MIN(title) AS example
        FROM (SELECT title, unnest(string_split(reasons, ',')) AS reason
              FROM reasoned WHERE reasons <> '')
        GROUP BY reason""",
    "ingest_months": """
        SELECT CAST(date_trunc('month', posted) AS TIMESTAMP) AS month,
               CASE WHEN pay > 0 THEN 'paid' ELSE 'unpaid' END AS load,
               COUNT(*) AS "rows", SUM(pay) AS salaries
        FROM named GROUP BY 1, 2""",
}


def oracle_sql() -> dict[str, str]:
    """
    DuckDB on the same parquet tables.
    """
    found = {name: _POSTINGS_SQL + text for name, text in _ORACLES.items()}
    if _LLM:
        found |= _LLM.ORACLES
    if _PIPELINE and _PIPELINE.ORACLE_SQL:
        found["pipeline"] = _PIPELINE.ORACLE_SQL
    return found


def reports() -> list[str]:
    """The queries over the postings table, without the optional ones."""
    return list(_REPORTS)
