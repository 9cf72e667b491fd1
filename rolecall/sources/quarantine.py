"""Rows that don't make a clean posting, kept beside the clean table with their reasons."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from rolecall.functions.derive import primary_category
from rolecall.model import CLEAN_SCHEMA
from rolecall.sources.ingest import SOURCE_FILE, typed_cells

# What stands before a required column's name in the reasons.
MISSING = "no "


def judged(
    raw: DataFrame, required: tuple[str, ...] = ("average_salary",), date_format: str | None = None
) -> DataFrame:
    """The clean columns, with ``reasons`` and, where there are any, the ``raw_row``.

    Reasons are the names of columns whose cell was rejected, ``malformed_row``, and
    ``no <column>`` for a required column that is empty; the raw row is all columns as
    they came.
    """
    typed, rejected = typed_cells(raw, date_format)
    reasons = [F.when(flag, F.lit(name)) for name, flag in rejected.items()]
    reasons += [F.when(F.col(f"`{name}`").isNull(), F.lit(MISSING + name)) for name in required]
    told = F.array_compact(F.array(*reasons))
    as_came = F.struct(*[F.col(f"`{name}`") for name in raw.columns])
    return raw.select(
        *typed,
        primary_category(F.col("categories")).alias("primary_category"),
        F.lit(0).alias("rejected_cells"),
        told.alias("reasons"),
        F.when(F.size(told) > 0, as_came).alias("raw_row"),
    )


@contextmanager
def _both_folders_open(spark: SparkSession) -> Iterator[None]:
    """Lets a task write to both folders at once, so that it need not sort its rows first.

    Spark sorts as soon as a task has as many writers as this number, hence one more than two.
    """
    writers = "spark.sql.maxConcurrentOutputFileWriters"
    usual = spark.conf.get(writers, None)
    spark.conf.set(writers, "3")
    try:
        yield
    finally:
        spark.conf.set(writers, usual) if usual else spark.conf.unset(writers)


def split_postings(
    raw: DataFrame,
    path: str,
    required: tuple[str, ...] = ("average_salary",),
    date_format: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(clean, quarantine): every row of ``raw`` is in exactly one of them.

    The raw rows are read once: they are judged, and written to ``path`` in two folders
    by the outcome, from which both tables are then read. The quarantine holds the
    row's columns as they came, with ``reasons``; rows that ``read_csv`` delivers
    with their source keep the file, and surplus cells in the row's text.
    """
    spark = raw.sparkSession
    rows = judged(raw, required, date_format)
    rows = rows.withColumn("quarantined", F.size("reasons") > 0)
    with _both_folders_open(spark):
        rows.write.mode("overwrite").partitionBy("quarantined").parquet(path)
    stored = spark.read.schema(rows.schema).parquet(path)
    clean = stored.filter(~F.col("quarantined")).select(*CLEAN_SCHEMA.names)
    return clean, stored.filter("quarantined").select("raw_row.*", "reasons")


def reason_counts(quarantine: DataFrame) -> DataFrame:
    """(reason, rows, files, example): how often each reason applies, and one row's place.

    The example is the least title it applies to; files are counted where rows have them.
    """
    file = F.col(SOURCE_FILE) if SOURCE_FILE in quarantine.columns else F.lit(None)
    each = quarantine.select(
        F.explode("reasons").alias("reason"), file.alias("_file"), F.col("title").alias("_title")
    )
    return each.groupBy("reason").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("_file").alias("files"),
        F.min("_title").alias("example"),
    )


