"""Which resources may lack a field that their model gained."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.functions.nodes import base_name
from ripplemark.operators import walk
from ripplemark.operators.graph import nodes

#: Where resources are looked for by name.
RESOURCE_FOLDERS = ("app/Http/Resources/", "app/Transformers/")


def parity_candidates(models: DataFrame, edges: DataFrame, meta: DataFrame, classes: DataFrame) -> DataFrame:
    """model, resource, path: the resources that callers of a model, at most two hops up, return; else those named after it.

    All models share one walk.  A resource without a known file can't be read and is no
    candidate; ``classes`` (cls, path) are searched by name for models that have none.
    """
    seeds = nodes(edges).select(F.substring_index("node", "::", 1).alias("model"), "node").join(models.select("model").distinct(), "model")
    callers = walk.walk(edges, seeds.select(F.col("model").alias("origin"), "node"), walk.UP, max_depth=2).hops.select(F.col("origin").alias("model"), F.col("node").alias("source"))
    shown = callers.join(edges.where("type = 'resource'").select("source", F.col("target").alias("resource")), "source").select("model", "resource").distinct()
    known = shown.join(meta.where("file is not null").groupBy(F.col("node").alias("resource")).agg(F.min("file").alias("path")), "resource").select("model", "resource", "path")
    rest = models.select("model").distinct().join(known.select("model").distinct(), "model", "left_anti").withColumn("short", base_name(F.col("model")))
    there = F.lit(False)
    for folder in RESOURCE_FOLDERS:
        there = there | F.col("path").startswith(folder)
    # A class is found by any part of its name, or by its base name without its suffix.
    parts = F.split("cls", r"[.\\]")
    named = classes.where(there).select("cls", "path", F.explode(F.array_distinct(F.concat(parts, F.array(F.regexp_replace(base_name(F.col("cls")), "(Resource|Collection)$", ""))))).alias("short"))
    by_name = rest.join(named, "short").select("model", F.col("cls").alias("resource"), "path").distinct()
    return known.unionByName(by_name)
