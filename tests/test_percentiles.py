"""Exact percentiles against brute force."""

import math
import random

import numpy as np
import pytest

from rolecall.operators.percentiles import _bucket, percentile_profile, value_counts
from pyspark.sql import functions as F

WANTED = {"p0": 0.0, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p100": 1.0}


def profile(spark, pairs):
    frame = spark.createDataFrame(pairs, "k string, v double").repartition(5)
    counts = value_counts(frame, ["k"], "v")
    rows = percentile_profile(counts, ["k"], "v", WANTED).collect()
    return {row.k: row for row in rows}


def check(spark, pairs):
    got = profile(spark, pairs)
    groups = {}
    for key, value in pairs:
        if value is not None:
            groups.setdefault(key, []).append(value)
    assert got.keys() == groups.keys()
    for key, held in groups.items():
        row = got[key]
        assert row.n == len(held)
        assert math.isclose(row.mean, float(np.mean(held)), rel_tol=1e-12, abs_tol=1e-9)
        for label, share in WANTED.items():
            expected = float(np.quantile(held, share))
            assert math.isclose(row[label], expected, rel_tol=1e-12, abs_tol=1e-12), (
                key, label, row[label], expected,
            )


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_groups(spark, seed):
    draw = random.Random(seed)
    makers = {
        "whole": lambda: float(draw.randint(500, 30000)),
        "few": lambda: float(draw.choice([1000, 2000, 2000, 2000, 9000])),
        "fractions": lambda: draw.lognormvariate(8, 2),
        "signs": lambda: draw.choice([-1, 0, 1]) * draw.lognormvariate(0, 3),
        "tiny": lambda: draw.random() * 1e-300,
        None: lambda: float(draw.randint(1, 50)),
    }
    pairs = [
        (key, make()) for key, make in makers.items() for _ in range(draw.randint(1, 300))
    ]
    pairs += [("whole", None), ("only null", None)]
    check(spark, pairs)


def test_one_value_holds_a_third_of_all_rows(spark):
    draw = random.Random(4)
    pairs = [("a", 4000.0)] * 1000
    pairs += [("a", float(draw.randint(1, 20000))) for _ in range(1500)]
    pairs += [(f"k{i}", float(i)) for i in range(500)]
    check(spark, pairs)


@pytest.mark.parametrize("count", [1, 2, 3, 4, 5])
def test_odd_and_even_counts(spark, count):
    check(spark, [("a", float(value * value)) for value in range(count)])


def test_no_keys(spark):
    frame = spark.createDataFrame([(float(v),) for v in (5, 1, 4, 2)], "v double")
    counts = value_counts(frame, [], "v")
    row = percentile_profile(counts, [], "v", {"p50": 0.5}).first()
    assert (row.n, row.mean, row.p50) == (4, 3.0, 3.0)


def test_no_rows(spark):
    frame = spark.createDataFrame([], "k string, v double")
    alone = value_counts(frame, [], "v")
    assert percentile_profile(alone, [], "v", {"p50": 0.5}).collect() == [(0, None, None)]
    grouped = value_counts(frame, ["k"], "v")
    assert percentile_profile(grouped, ["k"], "v", {"p50": 0.5}).collect() == []


def test_two_keys(spark):
    pairs = [("a", None, 1.0), ("a", None, 3.0), ("a", 1, 7.0), (None, 1, 9.0)]
    frame = spark.createDataFrame(pairs, "k string, j int, v double")
    counts = value_counts(frame, ["k", "j"], "v")
    rows = percentile_profile(counts, ["k", "j"], "v", {"p50": 0.5}).collect()
    assert {(r.k, r.j): (r.n, r.p50) for r in rows} == {
        ("a", None): (2, 2.0), ("a", 1): (1, 7.0), (None, 1): (1, 9.0),
    }


def test_equals_the_built_in_percentile(spark, table):
    shares = [0.25, 0.5, 0.75]
    built_in = table.groupBy("employmentTypes").agg(
        F.percentile("average_salary", shares).alias("p")
    )
    counts = value_counts(table, ["employmentTypes"], "average_salary")
    wanted = {"q1": 0.25, "q2": 0.5, "q3": 0.75}
    ours = percentile_profile(counts, ["employmentTypes"], "average_salary", wanted)
    assert {r.employmentTypes: [r.q1, r.q2, r.q3] for r in ours.collect()} == {
        r.employmentTypes: r.p for r in built_in.collect()
    }


def test_buckets_never_fall(spark):
    draw = random.Random(5)
    numbers = [draw.choice([-1, 1]) * draw.lognormvariate(0, 40) for _ in range(3000)]
    numbers += [0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, math.inf, -math.inf]
    numbers += [base * (1 + i * 2.0**-52) for base in (1.0, 2.0, 4096.0) for i in range(3)]
    frame = spark.createDataFrame([(v,) for v in numbers], "v double")
    rows = frame.select("v", F.expr(_bucket("v")).alias("b")).collect()
    ordered = sorted(rows, key=lambda row: row.v)
    assert all(a.b <= b.b for a, b in zip(ordered, ordered[1:]))
