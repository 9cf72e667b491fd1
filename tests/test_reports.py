"""Reports on small literal tables, over no rows, and their properties."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from frames import named, postings, rows
from rolecall.model import LEVELS
from rolecall.operators.filters import PostingFilter
from rolecall.plans import findings, industry, overview, salary, search, trends
from rolecall.plans.adhoc import ask


# -- which postings a report sees


def test_unfiltered_reports_see_salaries_above_the_slider(spark):
    table = postings(spark, {"average_salary": 40000.0}, {})
    assert rows(overview.market_kpis(table))[0][0] == 1
    assert rows(industry.industry_kpis(table, "Admin"))[0] == (
        2, 22000.0, 22000.0, 40000.0, 1,
    )
    assert rows(trends.monthly_trend(table))[0][1] == 2
    assert rows(trends.repost_tiers(table)) == [("First Post", 2, 22000.0)]


def test_first_category_counts(spark):
    both = '[{"id":1,"category":"A"},{"id":2,"category":"B"}]'
    table = postings(
        spark, {"categories": both}, {"categories": "[]"}, {"categories": None}
    )
    assert rows(overview.industry_facets(table)) == [("", 1), ("A", 1)]
    # '' counts as an industry, null does not.
    assert rows(overview.market_kpis(table)) == [(3, 1, 4000.0, 2)]
    assert sorted(rows(overview.category_counts(table))) == [
        ("A", 1, 4000.0), ("B", 1, 4000.0),
    ]


def test_category_without_salaries(spark):
    table = postings(spark, {"average_salary": None}, {"categories": named("B")})
    assert sorted(rows(overview.category_counts(table)), key=str) == [
        ("Admin", 1, None), ("B", 1, 4000.0),
    ]


def test_approximate_kpis(spark, table):
    exact, near = rows(overview.market_kpis(table))[0], rows(
        overview.market_kpis(table, approximate=True)
    )[0]
    assert (exact[0], exact[2]) == (near[0], near[2])
    assert near[1] == pytest.approx(exact[1], rel=0.2)


def test_bands_are_in_their_own_order(spark):
    table = postings(
        spark, *[{"average_salary": v} for v in (20000.0, 5000.0, 100.0, 7000.0, 100.0)]
    )
    assert [name for name, _ in rows(overview.salary_bands(table))] == [
        "Low (<S$3K)", "Mid (S$3K–6K)", "High (S$6K–10K)", "Premium (>S$10K)",
    ]
    shares = rows(overview.salary_band_shares(table))
    assert shares[0] == ("Low (<S$3K)", 2, 40.0)


def test_band_counts_sum_to_total(spark, table):
    total = rows(overview.market_kpis(table))[0][0]
    assert sum(n for _, n in rows(overview.salary_bands(table))) == total


def test_tiles_equal_the_single_reports(spark, table):
    tiles = overview.overview_tiles(table).collect()

    def tile(name):
        return {(r.label, r.postings, r.avg_salary) for r in tiles if r.tile == name}

    every = rows(overview.top_industries(table, k=1000))
    assert tile("industry") == set(every)
    assert tile("level") == set(rows(overview.seniority_profile(table)))
    bands = {(label, n) for label, n, _ in tile("band")}
    assert bands == set(rows(overview.salary_bands(table)))
    types = {(label, n) for label, n, _ in tile("type")}
    assert types == set(rows(overview.employment_mix(table)))


def test_null_companies_form_a_group(spark):
    table = postings(spark, {"postedCompany_name": None}, {"postedCompany_name": None}, {})
    assert rows(industry.top_companies(table, "Admin")) == [
        (None, 2, 4000.0), ("Acme", 1, 4000.0),
    ]
    assert rows(findings.top_companies_overall(table)) == [("Acme", 1)]


# -- salary


def cells(spark, *groups):
    every = []
    for name, level, count, amount in groups:
        every += [
            {"categories": named(name), "positionLevels": level, "average_salary": amount}
        ] * count
    return postings(spark, *every)


def test_heatmap_threshold_comes_before_the_top_groups(spark):
    table = cells(
        spark,
        ("A", LEVELS[0], 4, 1000.0),
        ("A", LEVELS[2], 3, 3000.0),
        ("B", LEVELS[2], 5, 2000.0),
        # 6 rows in all, but 3 in the surviving cell
        ("C", LEVELS[2], 3, 9000.0), ("C", LEVELS[3], 2, 1.0), ("C", "Other", 3, 700.0),
    )
    long = salary.salary_cells(table, more_than=2, k=2)
    assert sorted(rows(long)) == [
        ("A", LEVELS[0], 1000.0, 4), ("A", LEVELS[2], 3000.0, 3),
        ("C", LEVELS[2], 9000.0, 3), ("C", "Other", 700.0, 3),
    ]
    matrix = salary.salary_matrix(table, more_than=2, k=2)
    assert matrix.columns == ["industry", *LEVELS]
    assert [(r.industry, r[LEVELS[0]], r[LEVELS[2]], r[LEVELS[3]]) for r in matrix.collect()] == [
        ("A", 1000.0, 3000.0, None), ("C", None, 9000.0, None),
    ]
    assert rows(salary.present_levels(table, more_than=2)) == [
        (LEVELS[0], 1), (LEVELS[2], 3),
    ]


def test_heatmap_cells_are_group_counts(spark, table):
    whole = table.filter(
        F.col("average_salary").between(500, 30000)
    ).groupBy("primary_category", "positionLevels").count()
    counts = {(r[0], r[1]): r[2] for r in whole.collect()}
    found = salary.salary_cells(table, more_than=10).collect()
    assert found
    assert all(counts[r.industry, r.seniority] == r["count"] for r in found)


def test_box_leaves_out_small_groups_and_breaks_ties_by_name(spark):
    table = cells(
        spark, ("B", "x", 3, 900.0), ("A", "x", 3, 900.0), ("C", "x", 2, 9000.0),
        ("D", "x", 3, 800.0), ("E", "x", 3, 30000.0),
    )
    got = rows(salary.salary_box(table, more_than=2, k=2).select("industry", "count", "median"))
    assert got == [("A", 3, 900.0), ("B", 3, 900.0)]


def test_best_paid_roles_need_five_postings(spark):
    table = postings(
        spark,
        *[{"title": "Rare", "average_salary": 9000.0}] * 4,
        *[{"title": "Common", "average_salary": 5000.0, "categories": None}] * 5,
    )
    assert rows(salary.top_paying_roles(table)) == [("Common", None, 5000.0, 5)]


# -- trends


def test_month_cut_is_on_months(spark):
    table = postings(
        spark,
        *[
            {"metadata_originalPostingDate": day}
            for day in (date(2022, 12, 31), date(2023, 1, 1), date(2023, 1, 31), None)
        ],
    )
    assert rows(trends.monthly_trend(table)) == [(datetime(2023, 1, 1), 2, 4000.0, 1)]
    late = trends.monthly_trend(table, since=date(2023, 1, 2))
    assert rows(late) == []
    december = trends.monthly_trend(table, since=date(2022, 12, 1))
    assert [row[0] for row in rows(december)] == [
        datetime(2022, 12, 1), datetime(2023, 1, 1),
    ]
    assert rows(trends.monthly_trend(table, since=date(2022, 12, 2))) == [
        (datetime(2023, 1, 1), 2, 4000.0, 1)
    ]


def test_quarters_ignore_salary(spark):
    table = postings(spark, {"average_salary": None}, {"average_salary": 0.0})
    assert rows(trends.quarterly_trend(table)) == [("Admin", datetime(2023, 1, 1), 2)]


def test_quarterly_growth_of_largest_industries(spark):
    days = [date(2023, 1, 1), date(2023, 4, 1), date(2023, 4, 2)]
    table = postings(
        spark,
        *[{"metadata_originalPostingDate": day} for day in days],
        {"categories": named("Small")},
    )
    got = trends.quarterly_growth(table, k=1).orderBy("quarter")
    assert [(r.postings, r.previous, r.growth) for r in got.collect()] == [
        (1, None, None), (2, 1, 1.0),
    ]


def test_market_multiple(spark):
    days = [date(2022, 12, 31), date(2023, 1, 1), date(2023, 10, 1), date(2023, 12, 31)]
    table = postings(spark, *[{"metadata_originalPostingDate": day} for day in days])
    got = trends.market_multiple(table, date(2023, 2, 1), date(2023, 11, 30))
    assert rows(got) == [(1, 2, 2.0)]
    nothing = trends.market_multiple(table, date(2020, 1, 1), date(2023, 11, 30))
    assert rows(nothing) == [(0, 2, None)]


def test_tiers_catch_nulls_as_documented(spark):
    table = postings(
        spark,
        {"metadata_repostCount": None}, {"metadata_repostCount": 6},
        {"metadata_repostCount": 1}, {"metadata_repostCount": 0},
        {"metadata_totalNumberJobApplication": None, "metadata_repostCount": 3},
    )
    assert [row[:2] for row in rows(trends.repost_tiers(table))] == [
        ("First Post", 1), ("Reposted 1-2x", 1), ("Reposted 3-5x", 1), ("Reposted 6x+", 2),
    ]
    assert rows(trends.application_tiers(table)) == [("5-19 apps", 4, 4000.0)]


# -- search


def roles(spark):
    return postings(
        spark,
        *[{"title": "Data Engineer", "average_salary": 7000.0}] * 3,
        *[{"title": "Data Analyst", "average_salary": 5000.0}] * 4,
        *[{"title": "DATA Clerk", "positionLevels": None, "average_salary": 6000.0}] * 3,
        *[{"title": "Data Scientist"}] * 2,
        *[{"title": None}] * 3,
    )


def test_search_orders_and_threshold(spark):
    table = roles(spark)

    def titles(**options):
        return [row[0] for row in rows(search.role_search(table, **options))]

    assert titles(keyword="data") == ["Data Engineer", "DATA Clerk", "Data Analyst"]
    assert titles(keyword="data", order=search.WORST_PAID) == [
        "Data Analyst", "DATA Clerk", "Data Engineer",
    ]
    assert titles(keyword="data", order=search.MOST_POSTED) == [
        "Data Analyst", "DATA Clerk", "Data Engineer",
    ]
    assert titles() == ["Data Engineer", "DATA Clerk", "Data Analyst", None]
    assert titles(keyword="d%eng", wildcards=True) == ["Data Engineer"]
    assert titles(keyword="d%eng") == []
    assert rows(search.role_count(table, keyword="data", limit=2)) == [(3, 2)]


def test_search_histogram_takes_small_groups_too(spark):
    bins = search.search_histogram(roles(spark), keyword="data")
    assert bins.agg(F.sum("count")).first()[0] == 12


def test_role_table(spark):
    table = postings(
        spark,
        {"salary_minimum": None, "metadata_totalNumberJobApplication": None},
        {"title": "B", "average_salary": 12345.0},
    )
    shown = search.role_table(search.role_search(table, at_least=1))
    assert shown.columns == [
        "Title", "Industry", "Seniority", "Type", "Avg Salary", "Range", "Postings",
        "Avg Apps",
    ]
    assert rows(shown) == [
        ("B", "Admin", "Executive", "Permanent", "S$12,345", "S$3,000–5,000", 1, "10.0"),
        ("Clerk", "Admin", "Executive", "Permanent", "S$4,000", "-", 1, "-"),
    ]


def test_filter_and_keyword_combine(spark):
    chosen = PostingFilter(salary_from=5500, levels=("Executive",))
    got = rows(search.role_search(roles(spark), chosen, "data"))
    assert [row[0] for row in got] == ["Data Engineer"]


# -- findings and ad-hoc text


def test_seniority_ratio(spark):
    table = cells(spark, ("A", LEVELS[0], 1, 2000.0), ("A", LEVELS[-1], 1, 8400.0))
    got = rows(findings.seniority_ratio(table).select("level", "ratio"))
    assert got == [(LEVELS[0], 1.0), (LEVELS[-1], 4.2)]


def test_load_profile(spark):
    table = postings(spark, {"average_salary": None}, {"metadata_originalPostingDate": None})
    assert rows(findings.load_profile(table)) == [
        (2, 1, 0, date(2023, 2, 3), date(2023, 2, 3))
    ]


def test_ad_hoc_parameters_are_values(spark):
    table = postings(spark, {"title": "x' OR 1=1 --"}, {})
    got = ask(
        table,
        "SELECT COUNT(*) AS n FROM {postings} WHERE title = :title",
        title="x' OR 1=1 --",
    )
    assert rows(got) == [(1,)]


# -- nothing to report


def test_reports_over_no_rows(spark):
    none = postings(spark, {}).filter("false")
    assert rows(overview.market_kpis(none)) == [(0, 0, None, 0)]
    assert rows(industry.industry_kpis(none, "Admin")) == [(0, None, None, None, 0)]
    assert rows(findings.load_profile(none)) == [(0, 0, 0, None, None)]
    assert rows(trends.market_multiple(none, date(2023, 1, 1), date(2023, 7, 1))) == [
        (0, 0, None)
    ]
    assert rows(search.role_count(none)) == [(0, 0)]
    for report in (
        overview.top_industries, overview.salary_bands, overview.salary_band_shares,
        overview.overview_tiles, overview.category_counts, salary.salary_cells,
        salary.salary_matrix, salary.salary_box, salary.salary_by_employment,
        salary.top_paying_roles, trends.monthly_trend, trends.quarterly_trend,
        trends.quarterly_growth, trends.repost_tiers, trends.application_tiers,
        search.role_search, search.search_histogram, findings.industry_rank,
        findings.seniority_ratio,
    ):
        assert rows(report(none)) == [], report.__name__
