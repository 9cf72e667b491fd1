"""Operators against brute force, ties, and properties."""

import random
from collections import Counter
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from frames import named, postings, rows
from rolecall.model import LEVELS
from rolecall.operators import comparison, distribution, ranking, sampling
from rolecall.operators.filters import PostingFilter
from rolecall.operators.percentiles import value_counts


def frame(spark, schema, *items):
    return spark.createDataFrame(list(items), schema)


# -- filter


SALARIES = [
    None, 0.0, 0.5, 1.0, 499.0, 500.0, 30000.0, 30000.01, float("nan"), -5.0,
]


@pytest.mark.parametrize(
    ("chosen", "passing"),
    [
        (PostingFilter(), [1.0, 499.0, 500.0, 30000.0]),
        (PostingFilter(salary_from=500), [500.0, 30000.0]),
        (PostingFilter(salary_to=499), [1.0, 499.0]),
    ],
)
def test_salary_range(spark, chosen, passing):
    table = postings(spark, *[{"average_salary": v} for v in SALARIES])
    kept = chosen.apply(table).select("average_salary")
    assert sorted(row[0] for row in rows(kept)) == passing


def test_choices_combine(spark):
    table = postings(
        spark,
        {"title": "a"},
        {"title": "b", "categories": named("IT")},
        {"title": "c", "employmentTypes": "Contract"},
        {"title": "d", "positionLevels": None},
        {"title": "e", "categories": None},
    )
    chosen = PostingFilter(
        industries=("Admin", "Law"),
        employment_types=("Permanent",),
        levels=("Executive", "Manager"),
    )
    assert rows(chosen.apply(table).select("title")) == [("a",)]
    extra = PostingFilter(extra=F.col("title") > "c")
    assert sorted(rows(extra.apply(table).select("title"))) == [("d",), ("e",)]


def test_quotes_in_choices_are_plain_text(spark):
    table = postings(spark, {"positionLevels": "It's"}, {})
    assert PostingFilter(levels=("It's",)).apply(table).count() == 1


# -- ranking


def test_top_k_ties_go_to_smaller_keys_and_nulls_last(spark):
    counts = frame(
        spark, "k string, n long", ("c", 2), (None, 2), ("b", 2), ("a", 2), ("z", 9)
    )
    got = [row[0] for row in rows(ranking.top_k(counts, "n", 4, "k"))]
    assert got == ["z", "a", "b", "c"]
    assert rows(ranking.top_k(counts, "n", 5, "k"))[-1] == (None, 2)


def test_top_k_prefix(spark, table):
    counted = table.groupBy("title").agg(F.count("*").alias("n"))
    long = rows(ranking.top_k(counted, "n", 40, "title"))
    assert rows(ranking.top_k(counted, "n", 15, "title")) == long[:15]


def test_top_groups_sums_and_keep_groups(spark):
    cells = frame(
        spark, "k string, n long", ("a", 5), ("a", 1), ("b", 6), ("c", 6), ("d", 1)
    )
    top = ranking.top_groups(cells, "k", "n", 2)
    assert rows(top) == [("a",), ("b",)]
    assert sorted(rows(ranking.keep_groups(cells, top, "k"))) == [
        ("a", 1), ("a", 5), ("b", 6),
    ]


def test_in_large_groups_keeps_whole_groups(spark):
    items = [("hot", i) for i in range(700)] + [(f"k{i % 50}", i) for i in range(400)]
    table = spark.createDataFrame(items, "k string, v int").repartition(7)
    got = Counter(row.k for row in ranking.in_large_groups(table, "k", 8).collect())
    assert got == {"hot": 700}
    assert ranking.in_large_groups(table, "k", 7).count() == 1100
    assert ranking.in_large_groups(table, "k", 700).count() == 0


def test_dense_rank_equals_window(spark):
    table = frame(
        spark, "k string, n double", *[(c, n) for c, n in zip("abcdef", [3.0, 1.0, 3.0, None, 2.0, 1.0])]
    )
    got = dict(rows(ranking.with_dense_rank(table, "n", "r").select("k", "r")))
    assert got == {"a": 1, "c": 1, "e": 2, "b": 3, "f": 3, "d": 4}


def test_axis_order(spark):
    table = frame(spark, "k string, n long", ("b", 1), ("a", 1), ("c", 9), ("c", 1))
    assert rows(ranking.axis_order(table, "k", "n")) == [("a", 1), ("b", 1), ("c", 10)]


# -- sampling


def test_sample_does_not_depend_on_layout(spark, table):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    narrow = table.select(*keys, "average_salary")
    once = rows(sampling.repeatable_sample(narrow, keys, 50))
    again = rows(sampling.repeatable_sample(narrow.repartition(13), keys, 50))
    assert once == again and len(once) == 50
    longer = rows(sampling.repeatable_sample(narrow, keys, 80))
    assert longer[:50] == once


def test_sample_with_many_copies(spark):
    items = [(0, "copy")] * 400 + [(i, "x") for i in range(300)]
    table = spark.createDataFrame(items, "k int, v string").repartition(5)
    every = rows(table.orderBy(sampling.hash_order("k", "v"), "k", "v"))
    for n in (1, 150, 450, 700, 900):
        assert rows(sampling.repeatable_sample(table, ["k", "v"], n)) == every[:n]


def test_sample_takes_all_when_short(spark):
    table = frame(spark, "k int, v string", (1, "a"), (2, None))
    assert sorted(rows(sampling.repeatable_sample(table, ["k", "v"], 10))) == [
        (1, "a"), (2, None),
    ]


# -- histogram and box


def test_histogram_edges(spark):
    salaries = [None, 499.0, 500.0, 999.99, 1000.0, 30000.0, 30000.01, float("nan")]
    table = frame(spark, "v double", *[(v,) for v in salaries])
    assert rows(distribution.histogram(table, "v", 500, 30000, 500)) == [
        (0, 500.0, 1000.0, 2),
        (1, 1000.0, 1500.0, 1),
        (59, 30000.0, 30500.0, 1),
    ]


@pytest.mark.parametrize("width", [137, 500, 1000])
def test_histogram_counts_every_row_in_range(spark, table, width):
    total = table.filter(F.col("average_salary").between(500, 25000)).count()
    bins = distribution.histogram(table, "average_salary", 500, 25000, width)
    assert bins.agg(F.sum("count")).first()[0] == total


@pytest.mark.parametrize("seed", [1, 2])
def test_box_against_brute_force(spark, seed):
    draw = random.Random(seed)
    groups = {
        "even": [float(draw.randint(500, 20000)) for _ in range(240)],
        "heavy": [4000.0] * 150 + [float(draw.randint(1, 30000)) for _ in range(90)],
        "one": [77.0],
        "outliers": [float(100 + i) for i in range(40)] + [9999.0, 1.0],
    }
    pairs = [(key, value) for key, held in groups.items() for value in held]
    draw.shuffle(pairs)
    table = spark.createDataFrame(pairs, "k string, v double").repartition(6)
    counts = value_counts(table, ["k"], "v")
    boxes = distribution.quartiles(counts, "k", "v").drop("mean").limit(10)
    got = {row.k: row for row in distribution.box_stats(counts, boxes, "k", "v").collect()}
    assert got.keys() == groups.keys()
    for key, held in groups.items():
        q1, middle, q3 = np.quantile(held, [0.25, 0.5, 0.75])
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        inside = [v for v in held if low <= v <= high]
        row = got[key]
        assert (row.q1, row.median, row.q3) == pytest.approx((q1, middle, q3))
        assert (row.minimum, row.maximum) == (min(held), max(held))
        assert (row.whisker_low, row.whisker_high) == (min(inside), max(inside))
        assert (row["count"], row.outliers) == (len(held), len(held) - len(inside))


# -- shares, growth, ratios


def test_shares_sum_to_100(spark):
    table = frame(spark, "k string, n long", ("a", 1), ("b", 2), ("c", 4))
    shares = rows(comparison.share_of_total(table, "n", "share").select("share"))
    assert sum(share for (share,) in shares) == pytest.approx(100)


def test_growth_starts_null_in_each_group(spark):
    table = frame(
        spark, "k string, q date, n long",
        ("a", date(2023, 4, 1), 30), ("a", date(2023, 1, 1), 20), ("b", date(2023, 4, 1), 5),
    )
    got = comparison.period_growth(table, "k", "q", "n").orderBy("k", "q")
    assert rows(got.select("k", "previous", "growth")) == [
        ("a", None, None), ("a", 20, 0.5), ("b", None, None),
    ]


def test_growth_after_a_gap_is_null(spark):
    rows = [("a", 1, 10), ("a", 2, 20), ("a", 4, 40)]
    table = spark.createDataFrame(rows, "k string, q int, n long")
    before = F.col("q") - 1
    got = comparison.period_growth(table, "k", "q", "n", before).orderBy("q").collect()
    assert [(r.previous, r.growth) for r in got] == [(None, None), (10, 1.0), (None, None)]


def test_ratio_to_base(spark):
    table = frame(spark, "k string, v double", ("low", 2.0), ("high", 8.0), ("none", None))
    got = comparison.ratio_to_base(table, "k", "low", "v", "r").select("k", "r")
    assert dict(rows(got)) == {"low": 1.0, "high": 4.0, "none": None}
    missing = comparison.ratio_to_base(table, "k", "absent", "v", "r").select("r")
    assert rows(missing) == [(None,)] * 3


def test_levels_are_in_order_of_seniority():
    assert LEVELS[0] == "Fresh/entry level" and LEVELS[-1] == "Senior Management"
    assert len(set(LEVELS)) == 9
