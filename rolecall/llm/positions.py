"""Positions of rows in a total order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from rolecall.llm.scratch import written

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the place in a partition there


def numbered(rows: DataFrame, order: list[str], into: str, total: str) -> DataFrame:
    """``rows`` with their place (from 0) in ``order`` and the number of all rows.

    Rows are range-partitioned and sorted, numbered inside their partition, and
    written: the bounds are drawn from a sample, so they must be drawn once only. Each
    partition's first place is then the sum of the counts before it. ``order`` should
    name enough columns that rows which tie are equal.
    """
    at, part = f"{into}__at", f"{into}__part"
    table = written(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn(at, F.monotonically_increasing_id()),
        "numbered",
    )
    parts = (
        table.groupBy(F.shiftright(at, _LOCAL_BITS).alias(part))
        .agg(F.count("*").alias("n"))
        .select(
            part,
            (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias(into),
            F.sum("n").over(Window.partitionBy()).alias(total),
        )
    )
    # One row for each partition of the order, however many rows there are.
    local = F.col(at).bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    return (
        table.withColumn(part, F.shiftright(at, _LOCAL_BITS))
        .join(F.broadcast(parts), part)
        .withColumn(into, F.col(into) + local)
        .drop(at, part)
    )
