"""The whole of change detection: seeds, reach, hazards, tests, a level with its cause."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.functions.nodes import class_of
from ripplemark.functions.vocabulary import ASSOCIATION
from ripplemark.operators import risk, walk
from ripplemark.operators.graph import nodes


def detect_changes(edges: DataFrame, changes: DataFrame, hazards: DataFrame, points: DataFrame, references: DataFrame, checkable: DataFrame) -> DataFrame:
    """One row a diff: id, level, cause, points, hazards, files, unresolved.

    ``changes`` (id, file, node; null node: unplaced) are the seeds, ``hazards`` (id, position,
    lane, tier, member) the findings, ``points`` (node, exposure, public_write, contradicted)
    what is known of entry points, ``references`` (node, file) and ``checkable`` (node) the
    test index.  All diffs share one walk; entry points are those reached by calls.
    """
    known = nodes(edges)
    seeds = changes.where("node is not null").select(F.col("id").alias("origin"), "node").join(known, "node", "left_semi")
    up = walk.walks(edges, {"seeds": (seeds, ASSOCIATION), "members": (risk.member_seeds(hazards.select("member").distinct(), known), ())}, walk.UP)
    ids = changes.select("id").distinct().withColumn("origin", F.col("id").cast("string"))
    reached = walk.entry_points(up["seeds"]).join(ids, "origin").select("id", "node")
    above = risk.hazard_entry_points(hazards, edges, known, walk.entry_points(up["members"]))
    graded = hazards.join(risk.reach_classes(hazards.select("member"), above, points), "member", "left")
    # A diff that reaches no entry point is verified by its classes.
    alone = changes.where("node is not null").join(reached.select("id").distinct(), "id", "left_anti").select("id", class_of(F.col("node")).alias("node")).distinct()
    surfaces = reached.unionByName(alone)
    state = risk.verification_state(surfaces.select("node").distinct(), references, checkable)
    seeded = changes.groupBy("id").agg(F.max(F.col("node").isNotNull().cast("int")).cast("boolean").alias("seeded"), F.countDistinct("file").alias("files"), F.sum(F.col("node").isNull().cast("long")).alias("unresolved"))
    levels = risk.ladder(seeded, graded, surfaces.join(state, "node"))
    counts = reached.groupBy("id").agg(F.count(F.lit(1)).alias("points"))
    findings = hazards.groupBy("id").agg(F.count(F.lit(1)).alias("hazards"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return levels.join(seeded, "id").join(counts, "id", "left").join(findings, "id", "left").select("id", "level", "cause", zero("points"), zero("hazards"), F.col("files").cast("long").alias("files"), "unresolved")
