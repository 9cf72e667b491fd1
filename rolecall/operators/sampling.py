"""Repeatable samples, for callers that want raw points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# The start of a hash that rows are first counted by: its leading zeros, the first other
# hex digit and two more. However many rows there are, the starts near the cut are
# finer than 1 / 256 of what lies below them; in all there are fewer than 4,096 for each
# number of zeros, of which there are at most log16(rows).
_START = "^0*.{0,3}"


def hash_order(*columns: str) -> Column:
    """A fixed pseudo-random order: the md5 of the columns' text."""
    parts = [F.coalesce(F.col(name).cast("string"), F.lit("")) for name in columns]
    return F.md5(F.concat_ws("|", *parts))


def repeatable_sample(
    rows: DataFrame, keys: list[str], n: int, by: list[str] | None = None, splits: int = 64
) -> DataFrame:
    """n rows in hash order of ``keys``; the same rows on every run and layout.

    With ``by``, n rows of each group; a null is a group like others.

    A plain sort with a limit would pass n rows of every task through one. So the rows
    are first counted by the start of their hash, and only those up to the start at
    which the count reaches n are sorted: about n rows (of each group) at any size.
    """
    by = by or []
    hashed = rows.withColumn("_hash", hash_order(*keys))
    near = near_smallest(hashed, "_hash", n, by, splits)
    every = [F.col(name).asc_nulls_last() for name in rows.columns]
    if not by:
        return near.orderBy("_hash", *every).limit(n).drop("_hash")
    order = Window.partitionBy(*by).orderBy("_hash", *every)
    place = F.row_number().over(order)
    return near.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place", "_hash")


def near_smallest(
    hashed: DataFrame, hash_column: str, n: int, by: list[str], splits: int = 64
) -> DataFrame:
    """The rows up to the start of hash at which each group's count reaches n.

    These hold the group's n smallest hashes, and few others. Rows of a group of any
    size stay spread: the cuts are repeated for ``splits`` parts, and rows meet them
    by group and by the task that read them.
    """
    start = F.regexp_extract(hash_column, _START, 0)
    counts = hashed.groupBy(*by, start.alias("_start")).agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy(*by).orderBy("_start")
    before = F.sum("_n").over(running.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    within = counts.withColumn("_before", before).filter(F.col("_before") < n)
    if not by:
        last = within.agg(F.max("_start")).scalar()
        return hashed.filter(start <= last)
    names = [f"_by{i}" for i in range(len(by))]
    cuts = within.groupBy(*[F.col(key).alias(name) for key, name in zip(by, names)]).agg(
        F.max("_start").alias("_last")
    )
    cuts = cuts.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    task = F.pmod(F.spark_partition_id(), F.lit(splits)).alias("_split")
    same = F.col("_split") == F.col("_part")
    for key, name in zip(by, names):
        same = same & F.col(key).eqNullSafe(F.col(name))
    near = hashed.select("*", task).join(cuts, same & (start <= F.col("_last")))
    return near.select(*hashed.columns)
