"""Edges of the column functions."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from rolecall.functions import derive, text


def values(spark, kind, items, function):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    done = frame.select("i", function(F.col("v")).alias("r")).orderBy("i")
    return [row.r for row in done.collect()]


CATEGORIES = {
    None: None,
    "": "",
    "[]": "",
    '[{"id":1,"category":"A / B"}]': "A / B",
    '[{"id":1,"category":"A"},{"id":2,"category":"B"}]': "A",
    '[{"id":1,"category":""},{"id":2,"category":"B"}]': "B",
    '[{"id":1,"category": "A"}]': "",
    '[{"id":1,"category":"A\\"B"}]': "A\\",
    '[{"id":1,"category":"A \\u0026 B"}]': "A \\u0026 B",
}


def test_primary_category(spark):
    got = values(spark, "string", list(CATEGORIES), derive.primary_category)
    assert got == list(CATEGORIES.values())


def test_category_list_reads_true_json(spark):
    texts = ['[{"id":1,"category":"A \\u0026 B"},{"id":2,"category":""}]', None, "[]"]
    got = values(spark, "string", texts, derive.category_list)
    assert [None if v is None else [tuple(item) for item in v] for v in got] == [
        [(1, "A & B"), (2, "")],
        None,
        [],
    ]


def test_salary_band_edges(spark):
    salaries = [1, 2999.99, 3000, 6000, 6000.01, 10000, 10000.01]
    got = values(spark, "double", [float(v) for v in salaries], derive.salary_band)
    low, mid, high, premium = (
        "Low (<S$3K)", "Mid (S$3K–6K)", "High (S$6K–10K)", "Premium (>S$10K)",
    )
    assert got == [low, low, mid, mid, high, high, premium]


def test_repost_tier_edges(spark):
    got = values(spark, "int", [0, 1, 2, 3, 5, 6, None], derive.repost_tier)
    assert got == [
        "First Post", "Reposted 1-2x", "Reposted 1-2x", "Reposted 3-5x",
        "Reposted 3-5x", "Reposted 6x+", "Reposted 6x+",
    ]


def test_application_tier_edges(spark):
    got = values(spark, "int", [0, 4, 5, 19, 20, 49, 50, None], derive.application_tier)
    assert got == [
        "<5 apps", "<5 apps", "5-19 apps", "5-19 apps", "20-49 apps", "20-49 apps",
        "50+ apps", "50+ apps",
    ]


def test_month_and_quarter(spark):
    days = [date(2023, 12, 31), date(2024, 1, 1), date(2024, 6, 30), None]
    assert values(spark, "date", days, derive.month_of) == [
        date(2023, 12, 1), date(2024, 1, 1), date(2024, 6, 1), None,
    ]
    assert values(spark, "date", days, derive.quarter_of) == [
        date(2023, 10, 1), date(2024, 1, 1), date(2024, 4, 1), None,
    ]
    assert values(spark, "date", days[:1], derive.at_midnight) == [datetime(2023, 12, 31)]


def test_whole_mean_rounds_halves_away_from_zero(spark):
    frame = spark.createDataFrame([(2.0,), (3.0,)], "v double")
    assert frame.agg(derive.whole_mean(F.col("v"))).first()[0] == 3.0


@pytest.mark.parametrize(
    ("title", "keyword", "found"),
    [
        ("Data ENGINEER", "engineer", True),
        ("data engineer", "ENGI", True),
        ("Clerk", "engineer", False),
        ("50% off", "%", True),
        ("50 off", "%", False),
        ("a_b", "_", True),
        ("ab", "_", False),
        ("C\\C++", "\\", True),
        ("it's", "'", True),
        ("İstanbul guide", "istanbul", True),
        ("ΟΔΟΣ", "οδοσ", True),
        (None, "a", None),
    ],
)
def test_keyword(spark, title, keyword, found):
    assert values(
        spark, "string", [title], lambda c: text.matches_keyword(c, keyword)
    ) == [found]


@pytest.mark.parametrize(
    ("title", "keyword", "found"),
    [
        ("red big widget", "red%widget", True),
        ("Red", "r_d", True),
        ("rd", "r_d", False),
        ("a\\b", "\\", True),
        ("ab", "\\", False),
        ("a\\xb", "a\\_b", True),
    ],
)
def test_keyword_with_wildcards(spark, title, keyword, found):
    assert values(
        spark, "string", [title], lambda c: text.matches_keyword(c, keyword, True)
    ) == [found]


def test_money_text(spark):
    got = values(spark, "double", [1234567.9, 0.0, 999.0, None], text.money_text)
    assert got == ["S$1,234,567", "S$0", "S$999", "-"]


def test_money_range_text(spark):
    frame = spark.createDataFrame(
        [(1000.0, 2500.0), (None, 2500.0)], "low double, high double"
    )
    got = frame.select(text.money_range_text(F.col("low"), F.col("high"))).collect()
    assert [row[0] for row in got] == ["S$1,000–2,500", "-"]


def test_one_decimal_text(spark):
    numbers = [1.25, 0.35, 2.0, 1234.56, 0.04, None]
    expected = ["-" if v is None else f"{v:.1f}" for v in numbers]
    assert values(spark, "double", numbers, text.one_decimal_text) == expected
