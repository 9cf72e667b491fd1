"""Command-line jobs, to be given to spark-submit with the package as a zip file.

    spark-submit --py-files rolecall.zip rolecall/jobs.py ingest --csv raw/ --out clean/
    spark-submit --py-files rolecall.zip rolecall/jobs.py \\
        report top_industries --table clean/ --out report/
"""

from __future__ import annotations

import argparse
import inspect
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from rolecall.operators.filters import PostingFilter
from rolecall.plans import findings, industry, overview, salary, search, trends
from rolecall.sources.detect import detect_types
from rolecall.sources.ingest import (
    clean,
    load_month_files,
    open_postings,
    read_csv,
    write_postings,
)
from rolecall.sources.quarantine import split_postings

REPORTS = {
    report.__name__: report
    for report in (
        overview.industry_facets, overview.market_kpis, overview.top_industries,
        overview.salary_bands, overview.salary_band_shares, overview.seniority_profile,
        overview.employment_mix, overview.overview_tiles, overview.category_counts,
        industry.industry_kpis, industry.top_roles, industry.top_companies,
        industry.salary_histogram, industry.salary_round_histogram, industry.salary_sample,
        salary.salary_cells, salary.salary_matrix, salary.salary_matrix_text,
        salary.present_levels, salary.large_industry_salaries, salary.salary_box,
        salary.salary_outliers, salary.salary_samples,
        salary.salary_by_employment, salary.top_paying_roles,
        trends.monthly_trend, trends.monthly_calendar, trends.quarterly_trend,
        trends.quarterly_growth, trends.quarterly_calendar,
        trends.market_multiple, trends.repost_tiers, trends.application_tiers,
        search.role_search, search.role_count, search.search_histogram,
        search.search_round_histogram,
        findings.seniority_ratio, findings.industry_rank,
        findings.top_companies_overall, findings.load_profile,
    )
}

# The result of a report, shown as text.
ROLE_TABLE = search.role_table.__name__


def _ingest(spark: SparkSession, options: argparse.Namespace) -> None:
    if options.csv:
        source = options.quarantine is not None
        raw = read_csv(spark, options.csv, not options.single_line, with_source=source)
    else:
        raw = spark.read.parquet(options.parquet)
    if options.quarantine:
        kept, _ = split_postings(raw, options.quarantine, date_format=options.date_format)
        write_postings(kept, options.out, options.by_month)
        return
    table = clean(raw, options.date_format, options.category_list)
    if options.load:
        load_month_files(table, options.out, options.load)
    else:
        write_postings(table, options.out, options.by_month)


def _types(spark: SparkSession, options: argparse.Namespace) -> None:
    raw = read_csv(spark, options.csv, not options.single_line, with_source=True)
    detect_types(raw).write.mode("overwrite").parquet(options.out)


def run_report(table: DataFrame, options: argparse.Namespace) -> DataFrame:
    """The named report; options that it does not take, or lacks, are an error.

    ``role_table`` shows the result of ``role_search``, whose options it takes.
    """
    if options.name == ROLE_TABLE:
        options = argparse.Namespace(**{**vars(options), "name": search.role_search.__name__})
        return search.role_table(run_report(table, options))
    report = REPORTS[options.name]
    takes = inspect.signature(report).parameters
    choices = {
        "salary_from": options.salary_from,
        "salary_to": options.salary_to,
        "industries": tuple(options.industries),
        "employment_types": tuple(options.types),
        "levels": tuple(options.levels),
    }
    choices = {k: v for k, v in choices.items() if v not in (None, ())}
    given = {
        "chosen": PostingFilter(**choices) if choices else None,
        "industry": options.industry,
        "keyword": options.keyword,
        "order": options.order,
        "since": options.since,
        "earlier": options.earlier,
        "later": options.later,
        "k": options.k,
        "n": options.n,
        "limit": options.limit,
        "at_least": options.at_least,
        "more_than": options.more_than,
        "most": options.most,
        "base": options.base,
        "keys": options.keys or None,
        "wildcards": options.wildcards or None,
    }
    given = {k: v for k, v in given.items() if v is not None}
    if unused := [k for k in given if k not in takes]:
        names = [", ".join(choices) if k == "chosen" else k for k in unused]
        raise ValueError(f"{options.name} takes no {', '.join(names)}")
    needed = [k for k, v in takes.items() if v.default is v.empty and k not in given]
    if missing := needed[1:]:  # the first is the table
        raise ValueError(f"{options.name} needs {', '.join(missing)}")
    return report(table, **given)


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)

    load = jobs.add_parser("ingest")
    source = load.add_mutually_exclusive_group(required=True)
    source.add_argument("--csv")
    source.add_argument("--parquet")
    load.add_argument("--out", required=True)
    load.add_argument("--single-line", action="store_true")
    load.add_argument("--date-format")
    load.add_argument("--category-list", action="store_true")
    load.add_argument("--by-month", action="store_true")
    aside = load.add_mutually_exclusive_group()
    aside.add_argument("--quarantine", help="folder for the rows that are not clean")
    aside.add_argument("--load", help="name of this delivery, to add it month by month")

    types = jobs.add_parser("types")
    types.add_argument("--csv", required=True)
    types.add_argument("--out", required=True)
    types.add_argument("--single-line", action="store_true")

    report = jobs.add_parser("report")
    report.add_argument("name", choices=sorted([*REPORTS, ROLE_TABLE]))
    report.add_argument("--table", required=True)
    report.add_argument("--out", required=True)
    report.add_argument("--category-list", action="store_true")
    report.add_argument("--salary-from", type=float)
    report.add_argument("--salary-to", type=float)
    report.add_argument("--industries", nargs="*", default=[])
    report.add_argument("--types", nargs="*", default=[])
    report.add_argument("--levels", nargs="*", default=[])
    report.add_argument("--industry")
    report.add_argument("--keyword")
    report.add_argument("--order", choices=list(search.ORDERS))
    report.add_argument("--wildcards", action="store_true")
    report.add_argument("--base", help="the level that others are compared to")
    report.add_argument("--keys", nargs="*", default=[], help="columns that tell rows apart")
    for name in ("--k", "--n", "--limit", "--at-least", "--more-than", "--most"):
        report.add_argument(name, type=int)
    for name in ("--since", "--earlier", "--later"):
        report.add_argument(name, type=date.fromisoformat)
    return parser


def main(arguments: list[str] | None = None) -> None:
    options = _parser().parse_args(arguments)
    spark = SparkSession.builder.appName(f"rolecall {options.job}").getOrCreate()
    if options.job == "ingest":
        _ingest(spark, options)
    elif options.job == "types":
        _types(spark, options)
    else:
        table = open_postings(spark, options.table, options.category_list)
        run_report(table, options).write.mode("overwrite").parquet(options.out)


if __name__ == "__main__":
    main()
