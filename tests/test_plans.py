"""What the plans must and must not hold."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from rolecall.operators.ranking import in_large_groups
from frames import postings
from rolecall.functions.text import matches_keyword
from rolecall.plans import findings, industry, overview, salary, trends
from rolecall.sources import titles
from rolecall.sources.star import star_postings


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def final_plan(frame) -> str:
    """The plan that adaptive execution ended with."""
    frame.collect()
    return plan(frame).split("Initial Plan")[0]


def shuffles(text: str) -> int:
    return len(re.findall(r"(?<!Reused)(?<!Broadcast)Exchange (?:hash|range|Single)", text))


# Sketches are objects of a fixed size, one for each group.
SKETCHES = {"sketched_companies", "sketched_postings"}
# These number the few rows near the cut (tests/test_shapes.py counts them).
SAMPLES = {"salary_samples", "salary_outliers"}


@pytest.mark.parametrize("name", contract.reports())
def test_no_python_and_no_pairwise_join(spark, small, name):
    text = plan(contract.queries()[name](spark, small))
    unwanted = {"Python", "CartesianProduct", "BroadcastNestedLoopJoin", "ObjectHashAggregate"}
    if name in SKETCHES:
        unwanted.remove("ObjectHashAggregate")
    assert not [word for word in unwanted if word in text]


@pytest.mark.parametrize("name", sorted(set(contract.reports()) - SAMPLES))
def test_windows_never_see_raw_rows(spark, small, name):
    """Between a scan and a window there is always an aggregation."""
    lines = plan(contract.queries()[name](spark, small)).splitlines()
    open_windows = []
    for line in lines:
        depth = re.search(r"[A-Z*]", line)
        if not depth:
            continue
        at = depth.start()
        open_windows = [(d, kind) for d, kind in open_windows if d < at]
        if re.search(r"\bWindow \[", line):
            open_windows.append((at, "window"))
        elif "HashAggregate" in line and open_windows:
            open_windows = []
        elif "FileScan" in line:
            assert not open_windows, line


def test_one_shuffle_for_a_simple_report(table):
    assert shuffles(plan(overview.top_industries(table))) == 1
    assert shuffles(plan(trends.repost_tiers(table))) == 1
    assert shuffles(plan(industry.salary_histogram(table, "Brand#4"))) == 1


def test_filters_and_columns_reach_the_scan(table):
    text = plan(industry.top_roles(table, "Brand#4"))
    pushed = re.search(r"PushedFilters: \[(.*?)\]", text).group(1)
    assert "EqualTo(primary_category,Brand#4)" in pushed
    assert "GreaterThan(average_salary,0.0)" in pushed
    read = re.search(r"ReadSchema: struct<(.*?)>", text).group(1)
    names = {column.split(":")[0] for column in read.split(",")}
    assert names == {"title", "average_salary", "primary_category"}


def test_date_cut_reaches_the_scan(table):
    text = plan(trends.monthly_trend(table, contract.CUT))
    pushed = re.search(r"PushedFilters: \[(.*?)\]", text).group(1)
    assert "GreaterThanOrEqual(metadata_originalPostingDate,1997-01-01)" in pushed


@pytest.mark.parametrize(
    "report",
    [salary.salary_by_employment, lambda table: salary.salary_box(table, more_than=50)],
)
def test_percentiles_scan_once(table, report):
    text = final_plan(report(table))
    assert text.count("FileScan") == 1
    assert "ReusedExchange" in text


def test_cells_are_shuffled_once(table):
    assert final_plan(salary.salary_cells(table, more_than=5)).count("FileScan") == 1
    assert final_plan(trends.quarterly_trend(table, contract.CUT)).count("FileScan") == 1


def test_tiles_expand_the_cube_only(table):
    text = plan(overview.overview_tiles(table))
    assert text.count("FileScan") == 1
    # Read from the top: the expansion lies above a finished aggregation.
    assert text.index("Expand") < text.rindex("HashAggregate")
    between = text[text.index("Expand") : text.index("FileScan")]
    assert between.count("HashAggregate") == 2


def test_broadcasts_are_bounded_by_a_limit(spark, small, table):
    """Every broadcast asked for by the code itself sits on a limit."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        for name in contract.reports():
            text = plan(contract.queries()[name](spark, small))
            for part in text.split("BroadcastExchange")[1:]:
                limited = re.match(r".*\n.*(?:TakeOrdered|Limit)", part)
                assert limited or "TakeOrderedAndProject" in "".join(part.splitlines()[:3]), name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_lines_are_shuffled_before_they_get_text_and_amounts(spark, small):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(star_postings(spark, small))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Read from the top: the last join is that with the parts.
    joins = re.findall(r"(?:Join|HashJoin) \[(\w+)#", text)
    assert joins == ["l_partkey", "l_suppkey", "l_orderkey", "o_custkey"]
    below = text[text.index("Exchange") :]
    assert "salary_minimum" not in below and "salary_maximum" not in below


def test_hot_key_is_split_at_run_time(spark, small):
    """One part holds most order lines; the join still gets several tasks for it."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "40KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        rows = spark.range(0, 40000, 1, 8).select(
            F.when(F.col("id") % 3 > 0, F.lit("hot"))
            .otherwise(F.col("id").cast("string")).alias("k"),
            F.md5(F.col("id").cast("string")).alias("v"),
        )
        kept = in_large_groups(rows, "k", 1, splits=1)
        assert "skew=true" in final_plan(kept)
        assert kept.count() == rows.filter("k = 'hot'").count()
        assert star_postings(spark, small).count() == contract.postings(spark, small).count()
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_keyword_ids_reach_the_scan(spark, small, table, tmp_path):
    path = str(tmp_path / "index")
    titles.write_title_index(table, path)
    found = titles.postings_with(spark, path, "red")
    pushed = re.search(r"PushedFilters: \[(.*?)\]", found._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))).group(1)
    assert "In(title_id, [" in pushed
    want = table.filter(F.lower("title").contains("red"))
    assert found.count() == want.count() > 0
    # More ids than the list takes are joined, with the same rows.
    joined = titles.postings_with(spark, path, "red", most=1)
    assert "Join" in plan(joined) and joined.exceptAll(found).isEmpty()
    assert joined.count() == found.count()


def test_titles_of_all_keywords(spark, tmp_path):
    names = ["Red Wine", "RED WAX", "ed w", "re", "", "50% off_x", "İstanbul", None, "red  w"]
    table = postings(spark, *[{"title": name} for name in names for _ in range(2)])
    path = str(tmp_path / "index")
    titles.write_title_index(table, path)
    for keyword in ("red w", "RED", "re", "", "%", "ist", "zzz", "d w"):
        want = table.filter(matches_keyword(F.col("title"), keyword))
        got = titles.postings_with(spark, path, keyword)
        assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str), keyword
    assert titles.postings_with(spark, path, "r_d%x", wildcards=True).count() == 2


def test_industry_ranks_scan_once(table):
    assert final_plan(findings.industry_rank(table)).count("FileScan") == 1
