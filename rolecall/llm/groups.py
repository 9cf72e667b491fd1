"""Joins of rows to a table of their groups, where one group may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

_SHARE = 1000


def join_groups(
    rows: DataFrame, key: str, groups: DataFrame, group: str, size: str, how: str = "inner"
) -> DataFrame:
    """``rows`` joined to ``groups`` by ``key = group``; ``how`` is inner or left.

    ``groups`` has one row for each value of ``group``, with the number of its rows in
    ``size``; names of columns must differ. Groups of more than a thousandth of all
    rows, of which there are fewer than a thousand, are broadcast, so that their rows
    stay where they are. All others are small beside a task's share, and are
    joined by a shuffle. ``rows`` is read twice: it should be a written table.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    is_large = F.col(size) > total // _SHARE
    # Fewer than _SHARE disjoint groups can each hold over 1 / _SHARE of the rows.
    large = F.broadcast(groups.where(is_large))
    small = groups.where(~is_large)
    same = F.col(key) == F.col(group)
    near = rows.where(F.col(key).isNotNull()).join(large, same, "left_anti")
    found = rows.join(large, same).unionByName(near.join(small, same, how))
    if how == "left":
        # Rows without a key would all meet in one task of the shuffle.
        nameless = rows.where(F.col(key).isNull())
        found = found.unionByName(nameless, allowMissingColumns=True)
    return found
