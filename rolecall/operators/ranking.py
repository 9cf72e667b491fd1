"""Top-k, top groups and ranks, with repeatable ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def ties(*keys: str) -> list[Column]:
    """Sort columns that settle equal measures: the keys ascending, nulls last."""
    return [F.col(key).asc_nulls_last() for key in keys]


def few_in_order(rows: DataFrame, *order: str | Column) -> DataFrame:
    """Sorts rows of a fixed small number in one task.

    Saves the sampling job and the range shuffle of a general sort. Only for results
    whose size does not grow with the data, such as bands or a top-k list.
    """
    return rows.coalesce(1).orderBy(*order)


def top_k(rows: DataFrame, measure: str, k: int, *keys: str) -> DataFrame:
    """The k rows with the largest measure; ties go to the smaller keys."""
    return rows.orderBy(F.col(measure).desc_nulls_last(), *ties(*keys)).limit(k)


def top_groups(cells: DataFrame, key: str, measure: str, n: int) -> DataFrame:
    """Keys of the n groups whose measure sums highest: at most n rows, one column."""
    sums = cells.groupBy(key).agg(F.sum(measure).alias("_sum"))
    return top_k(sums, "_sum", n, key).select(key)


def keep_groups(rows: DataFrame, top: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ``top``, a list of distinct keys that was cut by a limit.

    The limit is what bounds the broadcast. The keys being distinct, an inner join
    equals a semi-join; Spark would push the latter below the aggregation that made
    ``rows`` and so scan the table a second time.
    """
    return rows.join(F.broadcast(top), key)


def axis_order(rows: DataFrame, key: str, measure: str) -> DataFrame:
    """The keys of a bounded report by rising total of a measure: (key, total)."""
    totals = rows.groupBy(key).agg(F.sum(measure).alias("total"))
    return few_in_order(totals, *ties("total", key))


def in_large_groups(
    rows: DataFrame, key: str, more_than: int, splits: int = 64
) -> DataFrame:
    """Rows of the groups that have more than ``more_than`` rows.

    Counts first and joins the surviving keys back, so that no group is ever
    gathered in one task; a window over the raw rows would do that. The number of
    surviving keys is not bounded, so how to join is left to the planner. If it has to
    shuffle the rows, a hot group is spread over ``splits`` parts by the task that read
    each row: that, unlike a random number, is the same when a lost task runs again.
    """
    large = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_size"))
    large = large.filter(F.col("_size") > more_than).select(
        key, F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("_split")
    )
    split = F.pmod(F.spark_partition_id(), F.lit(splits)).alias("_split")
    return rows.select("*", split).join(large, [key, "_split"], "left_semi").drop("_split")


def with_dense_rank(rows: DataFrame, measure: str, rank: str) -> DataFrame:
    """Adds the dense rank by falling measure over all rows.

    Only the distinct measures meet in one window: for counts over N postings these
    are fewer than sqrt(2N) values however many groups there are.
    """
    values = rows.select(F.col(measure).alias("_value")).distinct()
    order = Window.orderBy(F.col("_value").desc_nulls_last())
    ranks = values.withColumn(rank, F.dense_rank().over(order).cast("long"))
    return rows.join(ranks, F.col(measure).eqNullSafe(F.col("_value"))).drop("_value")
