"""Joins of rows with a table of counted groups, where one group may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group is hot from this many rows on, or from so many that at most MOST_HOT groups can have as many.
HOT_ROWS, MOST_HOT = 10_000, 200_000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], n: str = "n", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of ``rows`` with ``groups`` (one row per key, with its count ``n``; a written table). Hot groups are broadcast,
    so their rows stay where they are; their number has a bound: the sum of all counts through the least count of a hot
    group, MOST_HOT at most. All other groups are joined by shuffle and are small by definition."""
    total = groups.agg(F.sum(n)).first()[0] or 0
    least = max(hot_rows, -(-total // MOST_HOT))
    hot = groups.filter(F.col(n) >= least)
    if hot.isEmpty():
        return rows.join(groups, keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(rest.join(groups.filter(F.col(n) < least), keys))


def parts(n, size: int = 4096):
    """Into how many parts a group of ``n`` rows is dealt."""
    return F.ceil(n / size).cast("int")
