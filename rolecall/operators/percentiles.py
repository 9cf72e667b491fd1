"""Exact percentiles without gathering a group in one task.

The built-in exact percentile keeps a whole group's values in one task's memory. Here
the values are first counted (partial counts run before the shuffle, so a value held
by a third of all rows costs one row per task), then each group's ranks are found by
bucket, and only the buckets that hold a wanted rank are put in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Buckets per doubling of the value: each is about 0.14 % wide. Values from 500 to
# 30,000 have about 3,000 buckets, the most rows that a group's running sum sees for
# them; and if they are amounts in cents, a bucket holds at most some 4,000 different
# ones, the most that a task puts in order for one wanted rank.
_PER_DOUBLING = 512
_OFFSET = 1100 * _PER_DOUBLING
# Infinity saturates to this bucket; NaN, which sorts above it, joins it.
_LAST = 2**63 - 1


def value_counts(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n): how often each non-null value occurs in each group."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value)
    return counted.agg(F.count(F.lit(1)).alias("n"))


def _bucket(value: str) -> str:
    """SQL for a bucket number that never falls when the value rises."""
    steps = f"floor(log2(abs({value})) * {_PER_DOUBLING} + {_OFFSET})"
    return (
        f"CASE WHEN isnan({value}) THEN {_LAST}L WHEN {value} > 0 THEN {steps} "
        f"WHEN {value} < 0 THEN -{steps} ELSE 0L END"
    )


def percentile_profile(
    counts: DataFrame, keys: list[str], value: str, wanted: dict[str, float]
) -> DataFrame:
    """(keys, n, mean, one column per wanted percentile) from ``value_counts``.

    Percentiles interpolate linearly between neighbours, as ``percentile`` does. With
    no keys the result is one row, all null but ``n`` over no input.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    group = f"PARTITION BY {', '.join(names)}" if names else ""
    bucket = ", ".join([*names, "_b"])
    shares = [f"{float(share)!r}D" for share in wanted.values()]
    # Each percentile lies between the values at two ranks, counted from 0.
    ranks = [
        f"{side}((_total - 1) * {share})" for share in shares for side in ("floor", "ceil")
    ]

    placed = counts.selectExpr(
        *[f"`{key}` AS {name}" for key, name in zip(keys, names)],
        f"`{value}` AS _v",
        "n",
        f"{_bucket(f'`{value}`')} AS _b",
    )
    sums = placed.groupBy(*names, "_b").agg(
        F.expr("sum(n) AS _bn"), F.expr("sum(_v * n) AS _bs")
    )
    buckets = sums.selectExpr(
        *[f"{name} AS _j{name}" for name in [*names, "_b"]],
        "_bn",
        f"sum(_bn) OVER ({group} ORDER BY _b ROWS UNBOUNDED PRECEDING) - _bn AS _before",
        f"sum(_bn) OVER ({group}) AS _total",
        f"sum(_bs) OVER ({group}) / sum(_bn) OVER ({group}) AS _mean",
    )
    held = [f"({rank} >= _before AND {rank} < _before + _bn)" for rank in ranks]
    targets = buckets.filter(" OR ".join(held))
    # Null-safe throughout: plain equality would add a null test to one of the two
    # readers of ``counts`` and so keep them from sharing one shuffle.
    same = " AND ".join(f"{name} <=> _j{name}" for name in [*names, "_b"])
    near = placed.join(targets, F.expr(same))
    # By group, so that the window and the last aggregation need no further shuffle;
    # only values in the wanted buckets are left.
    near = near.repartition(*names) if names else near.repartition(1)
    upto = (
        f"_before + sum(n) OVER (PARTITION BY {bucket} ORDER BY _v "
        "ROWS UNBOUNDED PRECEDING) AS _upto"
    )
    ranked = near.selectExpr("*", upto).groupBy(*names).agg(
        F.expr("max(_total) AS _n"),
        F.expr("max(_mean) AS mean"),
        *[
            F.expr(f"min(CASE WHEN _upto > {rank} THEN _v END) AS _at{i}")
            for i, rank in enumerate(ranks)
        ],
    )

    def interpolated(i: int, share: str, label: str) -> str:
        low, high, rank = f"_at{2 * i}", f"_at{2 * i + 1}", f"((_n - 1) * {share})"
        return (
            f"CASE WHEN {low} = {high} THEN {low} ELSE (ceil({rank}) - {rank}) * {low} "
            f"+ ({rank} - floor({rank})) * {high} END AS `{label}`"
        )

    return ranked.selectExpr(
        *[f"{name} AS `{key}`" for key, name in zip(keys, names)],
        "coalesce(_n, 0L) AS n",
        "mean",
        *[
            interpolated(i, share, label)
            for i, (share, label) in enumerate(zip(shares, wanted))
        ],
    )
