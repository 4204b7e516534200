"""Connected components by alternating large and small stars, one written table a round."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from placegrid.llm.common import forget
from placegrid.session import materialize

#: Links that a task reads or writes, about; a table of few links is not spread over many files.
ROWS = 200_000


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("low"))


def _signature(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def roots(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for every node of ``edges`` (u, v) but the roots themselves.

    Rounds go on until nothing changes; their number grows with the logarithm of the longest path.
    """
    stars = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _signature(stars)
    while True:
        tasks = max(1, -(-2 * before[0] // ROWS))
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _lowest(both).select("u", F.least("u", "low").alias("low"))
        large = both.join(low, "u").where("v > u AND v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = materialize(large.unionByName(low.where("u <> low").select("u", F.col("low").alias("v"))).coalesce(tasks).distinct().coalesce(tasks))
        low = _lowest(large)
        small = large.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        passed, stars = stars, materialize(small.unionByName(low.select("u", F.col("low").alias("v"))).coalesce(tasks).distinct().coalesce(tasks))
        for table in (passed, large):
            forget(table)
        now = _signature(stars)
        if now == before:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
