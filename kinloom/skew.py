"""Joins with groups that may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_size(rows: int) -> int:
    """From how many rows on a key is hot: at most 20,000 of `rows` keys can be."""
    return max(10_000, rows // 20_000)


def join_groups(rows: DataFrame, groups: DataFrame, key: str | list[str], hot: int, n: str = "n") -> DataFrame:
    """rows with the one row that `groups` has a key; column `n` there counts the key's rows.

    Keys of `hot` rows or more, a bounded number, are broadcast, so that no task
    gets all rows of one; the others are shuffled. `rows` is read twice: it
    should be a written table.
    """
    keys = [key] if isinstance(key, str) else key
    large = groups.where(F.col(n) >= hot)
    cold = rows.join(F.broadcast(large.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(large), keys).unionByName(cold.join(groups.where(F.col(n) < hot), keys))
