"""Histograms of round widths, samples by group, outliers, calendars and sketches."""

import hashlib
import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from frames import named, postings, rows
from rolecall.operators import distribution, sampling
from rolecall.operators.comparison import on_calendar
from rolecall.operators.percentiles import percentile_profile, value_counts
from rolecall.plans import salary, sketches, trends


def _brute_bins(values, low, high, most, finest=1.0):
    inside = [v for v in values if v is not None and low <= v <= high]
    if not inside:
        return []
    width = next(
        f * 10**p for p in range(12) for f in (1, 2, 5)
        if max(inside) // finest // (f * 10**p) - min(inside) // finest // (f * 10**p) < most
    )
    counts = {}
    for v in inside:
        number = int(v // finest // width)
        counts[number] = counts.get(number, 0) + 1
    return [(b, b * width * finest, (b + 1) * width * finest, n) for b, n in sorted(counts.items())]


@pytest.mark.parametrize("seed", range(6))
def test_round_histogram(spark, seed):
    draw = random.Random(seed)
    low, high = draw.choice([(0, 50000), (500, 30000), (-1000, 1000)])
    centre, spread = draw.uniform(low, high), draw.choice([0, 3, 100, 5000])
    values = [draw.gauss(centre, spread) for _ in range(300)] + [None, low, high][: draw.randint(0, 3)]
    frame = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double").repartition(3)
    most = draw.choice([2, 10, 40, 50])
    found = distribution.round_histogram(frame, "v", low, high, most, 1)
    got = rows(found)
    assert got == _brute_bins(values, low, high, most)
    assert not got or got[-1][0] - got[0][0] < most


def test_round_histogram_of_nothing_and_of_bad_choices(spark):
    frame = spark.createDataFrame([], "v double")
    assert rows(distribution.round_histogram(frame, "v", 0, 10, 5, 1)) == []
    with pytest.raises(ValueError):
        distribution.round_histogram(frame, "v", 0, 1e9, 5, 0.001)


def _brute_sample(pairs, n):
    """(group, key) pairs: the n keys of least md5 in each group."""
    groups = {}
    for group, key in pairs:
        digest = hashlib.md5(str(key).encode()).hexdigest()
        groups.setdefault(group, []).append((digest, key))
    return sorted(((g, k) for g, held in groups.items() for _, k in sorted(held)[:n]), key=str)


def test_sample_by_group(spark):
    pairs = [("big", k) for k in range(3000)] + [("small", k) for k in range(5)] + [(None, 7), (None, 8)]
    frame = spark.createDataFrame(pairs, "g string, k int")
    for layout in (frame.repartition(7), frame.coalesce(1)):
        got = sampling.repeatable_sample(layout, ["k"], 20, by=["g"])
        assert got.columns == ["g", "k"]
        assert sorted(rows(got), key=str) == _brute_sample(pairs, 20)
    whole = rows(sampling.repeatable_sample(frame, ["k"], 20))
    assert sorted(r[1] for r in whole) == sorted(
        k for _, _, k in sorted((hashlib.md5(str(k).encode()).hexdigest(), str(g), k) for g, k in pairs)[:20]
    )


@pytest.mark.parametrize("size", [1000, 100_000, 1_000_000])
def test_few_rows_are_sorted_whatever_the_size(spark, size):
    hashed = spark.range(size).withColumn("h", F.md5(F.col("id").cast("string")))
    near = sampling.near_smallest(hashed, "h", 100, [])
    assert 100 <= near.count() <= 110
    by = sampling.near_smallest(hashed.withColumn("g", F.col("id") % 3 > 0), "h", 50, ["g"])
    assert all(50 <= n <= 60 for _, n in rows(by.groupBy("g").count()))


def test_outliers_are_those_of_the_box(spark):
    draw = random.Random(1)
    made = [{"categories": named(g), "average_salary": v, "title": f"{g}{k}"}
            for g, centre in (("a", 3000.0), ("b", 9000.0), ("few", 5000.0))
            for k, v in enumerate([draw.gauss(centre, 100) for _ in range(600 if g != "few" else 9)]
                                  + [centre + 2000.0] * 30 + [centre - 2000.0] * 3)]
    table = postings(spark, *made)
    box = {r.industry: r for r in salary.salary_box(table, more_than=500).collect()}
    found = salary.salary_outliers(table, ["title"], n=20, more_than=500).collect()
    assert box.keys() == {"a", "b"} == {r.industry for r in found}
    for group, held in box.items():
        reach = 1.5 * (held.q3 - held.q1)
        outside = [r for r in made if r["categories"] == named(group)
                   and not held.q1 - reach <= r["average_salary"] <= held.q3 + reach]
        assert len(outside) == held.outliers
        want = sorted(outside, key=lambda r: hashlib.md5(r["title"].encode()).hexdigest())[:20]
        got = {(r.title, r.average_salary) for r in found if r.industry == group}
        assert got == {(r["title"], r["average_salary"]) for r in want}


def test_a_month_without_postings_has_a_row(spark):
    days = [date(2023, 1, 5), date(2023, 1, 9), date(2023, 4, 1), None]
    table = postings(spark, *[{"metadata_originalPostingDate": d} for d in days])
    got = rows(trends.monthly_calendar(table).selectExpr("month(month)", "postings", "avg_salary", "companies"))
    assert got == [(1, 2, 4000.0, 1), (2, 0, None, 0), (3, 0, None, 0), (4, 1, 4000.0, 1)]
    assert rows(trends.monthly_calendar(table, date(2024, 1, 1))) == []


def test_growth_over_an_empty_quarter(spark):
    made = [("a", date(2023, 1, 5)), ("a", date(2023, 8, 5)), ("a", date(2023, 8, 6)),
            ("b", date(2023, 5, 1)), ("b", date(2023, 7, 1))]
    table = postings(spark, *[{"categories": named(g), "metadata_originalPostingDate": d} for g, d in made])
    found = trends.quarterly_calendar(table).selectExpr("industry", "quarter(quarter)", "postings", "previous", "growth")
    assert sorted(rows(found)) == [
        ("a", 1, 1, None, None), ("a", 2, 0, 1, -1.0), ("a", 3, 2, 0, None),
        ("b", 2, 1, None, None), ("b", 3, 1, 1, 0.0),
    ]


def test_calendar_of_nothing(spark):
    cells = spark.createDataFrame([(None, date(2023, 1, 1), 3)], "k string, p date, n long")
    assert rows(on_calendar(cells.limit(0), ["k"], "p", 1, ["n"])) == []


def _many(spark, companies):
    pairs = [(m, g, c) for c in range(companies) for m in (1, 2) for g in ("a", "b") if (c + m) % (3 if g == "a" else 7)]
    frame = spark.createDataFrame(pairs, "m int, industry string, c int")
    return frame.selectExpr(
        "make_date(2023, m, 5) metadata_originalPostingDate", "industry primary_category",
        "if(c = 3, null, cast(c as string)) postedCompany_name", "concat('t', c % 50) title",
        "1000D average_salary",
    )


def test_merged_sketches_are_near_the_exact_counts(spark):
    table = _many(spark, 4000)
    kept, names = sketches.monthly_sketches(table), sketches.monthly_names(table)
    assert kept.count() == 4
    for by in (["industry"], ["month"], ["month", "industry"]):
        errors = sketches.sketch_errors(kept, names, by)
        assert all(r.companies > 2000 and r.error <= 0.02 for r in errors.collect())
    total = sketches.rolled_up(kept, [], since=date(2023, 2, 1), industries=("b",)).first()
    exact = sketches.exact_companies(names, [], since=date(2023, 2, 1), industries=("b",)).first()
    direct = table.filter("month(metadata_originalPostingDate) = 2 AND primary_category = 'b'")
    assert exact.companies == direct.select("postedCompany_name").distinct().count() - 1
    assert abs(total.companies / exact.companies - 1) < 0.02
    assert (total.postings, total.avg_salary, total.titles) == (direct.count(), 1000.0, 50)


def test_sketches_read_no_postings_again(spark, tmp_path):
    table = _many(spark, 50)
    table.write.parquet(str(tmp_path / "postings"))
    sketches.monthly_sketches(spark.read.parquet(str(tmp_path / "postings"))).write.parquet(str(tmp_path / "kept"))
    rolled = sketches.rolled_up(spark.read.parquet(str(tmp_path / "kept")), ["industry"])
    assert all("/kept" in f for f in rolled.inputFiles())
    assert {r.industry: r.companies for r in rolled.collect()} == {"a": 49, "b": 49}


def test_crowded_values_are_spread_over_buckets(spark):
    """200,000 different values within half a percent of each other."""
    count = 200_000
    frame = spark.range(count).selectExpr("'a' k", f"5000 + id * 25D / {count} v")
    counts = value_counts(frame, ["k"], "v")
    row = percentile_profile(counts, ["k"], "v", {"p10": 0.1, "p50": 0.5, "p99": 0.99}).first()
    values = 5000 + np.arange(count) * 25.0 / count
    for label, share in (("p10", 0.1), ("p50", 0.5), ("p99", 0.99)):
        assert abs(row[label] - np.quantile(values, share)) < 1e-9
