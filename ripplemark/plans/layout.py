"""Radial layout of a walk, and rows and documents for reports."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplemark.functions.nodes import command_label, is_entry_point

MOST_NODES = 300
RING = 120.0


def radial(hops: DataFrame, most: int = MOST_NODES) -> DataFrame:
    """node, depth, kind, x, y: the nodes of least depth, each ring evenly spaced from the top on, rounded to 2 places.

    Only the first ``most`` nodes by (depth, node) are laid out, a feature of the picture;
    :func:`hidden` counts the rest.
    """
    shown = hops.groupBy("node").agg(F.min("depth").alias("depth")).orderBy("depth", "node").limit(most)
    ring = Window.partitionBy("depth")
    angle = 2 * math.pi * (F.row_number().over(ring.orderBy("node")) - 1) / F.count(F.lit(1)).over(ring) - math.pi / 2
    place = shown.withColumn("angle", angle)
    kind = F.when(is_entry_point(F.col("node")), "entry").when(F.col("node").contains("::"), "member").otherwise("class")
    return place.select("node", "depth", kind.alias("kind"), (F.round(RING * F.col("depth") * F.cos("angle"), 2) + 0.0).alias("x"), (F.round(RING * F.col("depth") * F.sin("angle"), 2) + 0.0).alias("y"))


def hidden(hops: DataFrame, most: int = MOST_NODES) -> DataFrame:
    return hops.agg(F.greatest(F.countDistinct("node") - most, F.lit(0)).cast("long").alias("hidden"))


def entry_point_rows(points: DataFrame, meta: DataFrame, references: DataFrame, chains: DataFrame) -> DataFrame:
    """One row an entry point: label, file, exposure, how many tests name it, and its chain as text, by label."""
    tests = references.groupBy("node").agg(F.countDistinct("file").alias("tests"))
    chain = chains.groupBy(F.col("target").alias("node")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "node"))), lambda x: x["node"]), " > ").alias("chain"))
    rows = points.select("node").distinct().join(meta.select("node", "file", "exposure"), "node", "left").join(tests, "node", "left").join(chain, "node", "left")
    return rows.select(command_label(F.col("node")).alias("label"), "file", "exposure", F.coalesce("tests", F.lit(0)).cast("long").alias("tests"), "chain").orderBy("label")


def documents(rows: DataFrame, columns: list[str]) -> DataFrame:
    """json: one document a row, with the named fields alone; null fields are left out."""
    return rows.select(F.to_json(F.struct(*columns)).alias("json"))
