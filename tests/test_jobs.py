"""The command-line jobs, from a CSV file to a written report."""

import pytest

from frames import rows
from rolecall import jobs
from rolecall.model import POSTING_SCHEMA
from test_ingest import csv_file  # noqa: F401


@pytest.fixture
def clean_table(spark, csv_file, tmp_path):  # noqa: F811
    out = str(tmp_path / "clean")
    jobs.main(["ingest", "--csv", csv_file, "--out", out, "--date-format", "yyyy-MM-dd"])
    return out


def report(spark, clean_table, tmp_path, *arguments):
    out = str(tmp_path / "report")
    jobs.main(["report", *arguments, "--table", clean_table, "--out", out])
    return rows(spark.read.parquet(out))


def test_plain_report(spark, clean_table, tmp_path):
    assert report(spark, clean_table, tmp_path, "top_industries") == [
        ("", 1, 2000.0), ("Food", 1, 2001.0),
    ]


def test_filtered_report(spark, clean_table, tmp_path):
    got = report(
        spark, clean_table, tmp_path, "market_kpis", "--levels", "Manager", "Executive",
        "--industries", "Food", "--salary-from", "2000",
    )
    assert got == [(1, 1, 2001.0, 1)]


def test_report_of_one_industry(spark, clean_table, tmp_path):
    got = report(spark, clean_table, tmp_path, "industry_kpis", "--industry", "Food")
    assert got == [(1, 2001.0, 2001.0, 2000.5, 1)]


def test_dates(spark, clean_table, tmp_path):
    got = report(spark, clean_table, tmp_path, "monthly_trend", "--since", "2023-02-01")
    assert got == []


def test_stored_categories_keep_malformed_text(spark, tmp_path):
    raw, table = str(tmp_path / "raw"), str(tmp_path / "table")
    texts = [
        '[{"id":1,"category":"Food"},{"id":2,"category":"Retail"}]',
        '[{"id":1,"category":"Food"},{"id":2,"cat',
        '[{"id":1,"category":""},{"id":2,"category":"Retail"}]',
        "[]",
        None,
    ]
    delivered = spark.createDataFrame([(text,) for text in texts], "categories string")
    for field in POSTING_SCHEMA.fields:
        if field.name != "categories":
            delivered = delivered.selectExpr("*", f"'1000' AS {field.name}")
    delivered.write.parquet(raw)
    jobs.main(["ingest", "--parquet", raw, "--out", table, "--category-list"])
    want = [("Food", 2, 1000.0), ("Retail", 2, 1000.0)]
    for stored in ([], ["--category-list"]):
        assert sorted(report(spark, table, tmp_path, "category_counts", *stored)) == want


@pytest.mark.parametrize(
    "arguments, says",
    [
        (["repost_tiers", "--levels", "Manager"], "levels"),
        (["industry_facets", "--salary-from", "9000"], "salary_from"),
        (["industry_kpis"], "needs industry"),
        (["market_multiple", "--earlier", "2023-01-01"], "needs later"),
    ],
)
def test_options_that_do_not_fit_are_refused(spark, clean_table, tmp_path, arguments, says):
    with pytest.raises(ValueError, match=says):
        report(spark, clean_table, tmp_path, *arguments)


def test_search_options(spark, clean_table, tmp_path):
    got = report(
        spark, clean_table, tmp_path, "role_table", "--keyword", "c_ok", "--wildcards",
        "--at-least", "1", "--limit", "5",
    )
    assert got == [('Cook, "Chef"', "Food", "Executive", "Permanent", "S$2,001",
                    "S$1,000–S$3,000".replace("–S$", "–"), 1, "5.0")]
    assert report(spark, clean_table, tmp_path, "role_search", "--keyword", "cook") == []
    top = report(spark, clean_table, tmp_path, "top_industries", "--k", "1")
    assert top == [("", 1, 2000.0)]
    ratio = report(spark, clean_table, tmp_path, "seniority_ratio", "--base", "Manager")
    assert [r[0] for r in ratio] == ["Manager", "Executive"]
    sample = report(
        spark, clean_table, tmp_path, "salary_sample", "--industry", "Food", "--keys", "title"
    )
    assert sample == [('Cook, "Chef"', 2000.5)]
    bins = report(
        spark, clean_table, tmp_path, "salary_round_histogram", "--industry", "Food", "--most", "9"
    )
    assert bins == [(2000, 2000.0, 2001.0, 1)]


def test_types_job(spark, csv_file, tmp_path):  # noqa: F811
    out = str(tmp_path / "types")
    jobs.main(["types", "--csv", csv_file, "--out", out])
    found = {r["column"]: r["type"] for r in spark.read.parquet(out).collect()}
    assert found["extra"] == "int" and found["salary_maximum"] == "int"
    assert found["average_salary"] == "double" and found["salary_minimum"] == "string"


def test_ingest_with_quarantine_and_by_delivery(spark, csv_file, tmp_path):  # noqa: F811
    out, aside, months = (str(tmp_path / name) for name in ("out", "aside", "months"))
    jobs.main(["ingest", "--csv", csv_file, "--out", out, "--quarantine", aside])
    assert [r.title for r in spark.read.parquet(out).collect()] == ['Cook, "Chef"']
    held = spark.read.parquet(aside).filter("quarantined = 'true'")
    assert sorted(len(r.reasons) for r in held.collect()) == [1, 3]
    for _ in range(2):
        jobs.main(["ingest", "--csv", csv_file, "--out", months, "--load", "file1"])
    assert spark.read.parquet(months).count() == 3


def test_every_report_takes_its_table_first():
    import inspect

    for name, function in jobs.REPORTS.items():
        assert next(iter(inspect.signature(function).parameters)) == "postings", name
