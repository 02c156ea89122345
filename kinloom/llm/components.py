"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_table, hot_size, join_groups, settle


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _with_least(rows: DataFrame, least: DataFrame, hot: int | None) -> DataFrame:
    return rows.join(least, "u") if hot is None else join_groups(rows, least, "u", hot)


def large_star(edges: DataFrame, hot: int | None = None) -> DataFrame:
    """Each node links its larger neighbours to the least of its neighbourhood."""
    both = _both(edges)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return _with_least(both, least, hot).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def small_star(edges: DataFrame, hot: int | None = None) -> DataFrame:
    """Each node links itself and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    linked = _with_least(down, least, hot).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return linked.where("u != v").distinct()


def _mark(edges: DataFrame):
    """Number of edges and a sum of their hashes: stars are reached when a step changes neither."""
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, most: int = 60, hot: int | None = None) -> DataFrame:
    """(node, component) of every node with an edge; component is its least node. `edges` has longs u, v.

    Hubs of `hot` edges or more (by default what hot_size() says) are joined by
    broadcast, so no task gets all edges of one. Null ends and u = v are no
    edges; repeated edges count once; without edges the result is empty.
    """
    now = settle(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = _mark(now)
    for _ in range(most):
        # A node has at most as many edges as there are.
        limit = hot or hot_size(seen[0])
        limit = limit if seen[0] >= limit else None
        stars = settle(small_star(large_star(now, limit), limit), "stars")
        drop_table(now)
        now, mark = stars, _mark(stars)
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = mark
    raise RuntimeError("components did not settle")
