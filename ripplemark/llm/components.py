"""Connected components by alternating large and small stars.

Each round rewires every node to the least node it knows of (large star: larger
neighbours; small star: smaller ones) until the links are stars around the least node
of each component.  Links stay in tables; only a row count and a checksum a round come
to the driver.  A node with very many links is combined before the shuffle for its
minimum, and the join that hands the minimum out is one that AQE can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.plans.shared import drop_table, write_table


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large(edges: DataFrame) -> DataFrame:
    both = _both(edges)
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, component (the least node reachable) for every node of ``edges`` (u, v)."""
    edges = write_table(edges.select("u", "v").where("u <> v").distinct(), name)
    sign = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
    seen, now = None, sign(edges)
    while now != seen and now[0]:
        before, edges = edges, write_table(_small(_large(edges)), name)
        drop_table(before)
        seen, now = now, sign(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
