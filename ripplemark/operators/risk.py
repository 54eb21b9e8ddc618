"""Reach classes, the decision ladder, verification and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemark.functions.nodes import class_of
from ripplemark.operators import walk

# Exposures that count as gated, and levels in order.
GATED = ("authed", "admin", "internal")
LEVELS = ("LOW", "MEDIUM", "HIGH")


def contradicted_entry_points(edges: DataFrame, points: DataFrame, auth_classes: DataFrame) -> DataFrame:
    """node of the entry points whose public write is contradicted: they reach a policy, or pass a middleware that is (or extends) an auth class.

    A point reaches a policy if one of the nodes that authorise lies at most MAX_DEPTH hops below it,
    itself included: one walk up from those nodes, as one origin, answers all points.
    """
    guards = walk.one_origin(edges.where("type = 'authorizes'").select(F.col("source").alias("node")))
    up = walk.walk(edges, guards, walk.UP, gated=False)
    policy = up.hops.select("node").unionByName(up.seeds.select("node"))
    middleware = edges.where("type = 'route-to-middleware'").select(F.col("source").alias("node"), F.col("target").alias("cls")).join(auth_classes, "cls", "left_semi").select("node")
    return policy.unionByName(middleware).distinct().join(points, "node", "left_semi")


def hazard_entry_points(hazards: DataFrame, edges: DataFrame, graph_nodes: DataFrame, direct: DataFrame | None = None) -> DataFrame:
    """member, point: the entry points above each hazard's member, or, if none, above its class and the class's members.

    One walk answers all members at once (``direct``: origin, node, where the caller has it
    already), one more the classes of the rest.
    """
    members = hazards.select("member").distinct()
    if direct is None:
        direct = walk.entry_points(walk.walk(edges, member_seeds(members, graph_nodes), walk.UP))
    direct = direct.select(F.col("origin").alias("member"), F.col("node").alias("point"))
    rest = members.join(direct, "member", "left_anti").withColumn("cls", class_of(F.col("member")))
    # A class whose only node is the member itself was walked from already.
    nodes_of = graph_nodes.select(class_of(F.col("node")).alias("origin"), "node").join(rest.select(F.col("cls").alias("origin")).distinct(), "origin", "left_semi")
    others = nodes_of.join(rest.select(F.col("cls").alias("origin"), F.col("member").alias("node")), ["origin", "node"], "left_anti").select("origin").distinct()
    above = walk.entry_points(walk.walk(edges, nodes_of.join(others, "origin", "left_semi"), walk.UP))
    return direct.unionByName(rest.join(above.select(F.col("origin").alias("cls"), F.col("node").alias("point")), "cls").select("member", "point"))


def member_seeds(members: DataFrame, graph_nodes: DataFrame) -> DataFrame:
    """origin, node: the members that are nodes, each an origin of its own."""
    known = members.join(graph_nodes.select(F.col("node").alias("member")), "member", "left_semi")
    return known.select(F.col("member").alias("origin"), F.col("member").alias("node"))


def reach_classes(members: DataFrame, above: DataFrame, points: DataFrame) -> DataFrame:
    """member, reach from (member, point) and points (node, exposure, public_write, contradicted)."""
    facts = above.join(points.withColumnRenamed("node", "point"), "point", "left")
    write = F.coalesce(F.col("public_write"), F.lit(False)) & ~F.coalesce(F.col("contradicted"), F.lit(False))
    gated = F.coalesce(F.col("exposure").isin(*GATED), F.lit(False)) | F.coalesce(F.col("contradicted"), F.lit(False))
    known = facts.groupBy("member").agg(F.max(write.cast("int")).alias("w"), F.min(gated.cast("int")).alias("g"))
    reach = F.when(F.col("w").isNull(), "no-known-path").when(F.col("w") == 1, "public-write").when(F.col("g") == 1, "gated").otherwise("no-guard-found")
    return members.select("member").distinct().join(known, "member", "left").select("member", reach.alias("reach"))


def cell(tier: Column, reach: Column) -> Column:
    """The level (0, 1, 2) of a hazard's tier and reach."""
    return F.when(tier >= 3, 2).when(tier == 2, F.when(reach == "public-write", 2).otherwise(1)).otherwise(F.when(reach == "no-known-path", 0).otherwise(1))


def level_name(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LEVELS]), level + 1)


def verification_set(reached: DataFrame, files: DataFrame, anchors: DataFrame) -> DataFrame:
    """node: reached entry points (file, node), and for each file (file) without one its class (file, cls)."""
    alone = files.join(reached.select("file").distinct(), "file", "left_anti").join(anchors, "file").select(F.col("cls").alias("node"))
    return reached.select("node").unionByName(alone).distinct()


def verification_state(surfaces: DataFrame, references: DataFrame, checkable: DataFrame) -> DataFrame:
    """node, referenced: true if a runnable test (node, file) names it, null if it can't be checked (not in node), else false."""
    seen = references.where(F.col("file").endswith("Test.php")).select("node").distinct().withColumn("yes", F.lit(True))
    can = checkable.select("node").distinct().withColumn("can", F.lit(True))
    state = F.when(F.col("yes"), True).when(F.col("can"), False)
    return surfaces.join(seen, "node", "left").join(can, "node", "left").select("node", state.alias("referenced"))


def ladder(diffs: DataFrame, hazards: DataFrame, surfaces: DataFrame) -> DataFrame:
    """id, level, cause for each diff (id, seeded).

    ``hazards``: id, position, lane, tier, member, reach; ``surfaces``: id, referenced (true,
    false or null: not checked).  Steps: hazards decide by their worst cell, and the first
    that reaches it is the cause; nothing seeded is low; nothing placed, nothing checked, or
    something unreferenced is medium; everything referenced is low.
    """
    h = hazards.withColumn("cell", cell(F.col("tier"), F.col("reach")))
    worst = h.groupBy("id").agg(F.min(F.struct((-F.col("cell")).alias("c"), "position", "lane", "tier", "member", "reach")).alias("w"))
    s = surfaces.groupBy("id").agg(
        F.count(F.lit(1)).alias("total"), F.sum(F.col("referenced").isNull().cast("int")).alias("unknown"), F.sum((F.col("referenced") == F.lit(False)).cast("int")).alias("bare")
    )
    d = diffs.select("id", "seeded").join(worst, "id", "left").join(s, "id", "left")
    bare, unknown = F.coalesce("bare", F.lit(0)), F.coalesce("unknown", F.lit(0))
    level = F.when(F.col("w").isNotNull(), -F.col("w.c")).when(~F.col("seeded"), 0).when(F.col("total").isNull(), 1).when(unknown == F.col("total"), 1).when((bare == 0) & (unknown == 0), 0).otherwise(1)
    hazard_cause = F.concat_ws(" ", F.lit("tier"), F.col("w.tier"), F.col("w.lane"), F.lit("hazard in"), F.col("w.member"), F.concat(F.lit("("), F.col("w.reach"), F.lit(")")))
    rest = F.concat_ws(" ", bare.cast("string"), F.lit("of"), F.col("total"), F.lit("reached surfaces have no test"), F.when(unknown > 0, F.concat(F.lit("and "), unknown.cast("string"), F.lit(" could not be checked"))))
    cause = F.when(F.col("w").isNotNull(), hazard_cause).when(~F.col("seeded"), "nothing in this diff seeds a walk").when(F.col("total").isNull(), "what this change reaches could not be placed").when(unknown == F.col("total"), "test references were not checked").when((bare == 0) & (unknown == 0), "every reached surface is referenced by a test").otherwise(rest)
    return d.select("id", level_name(level).alias("level"), cause.alias("cause"))


def gate(levels: DataFrame, hazards: DataFrame, unresolved: DataFrame, *, fail_on: str | None = "HIGH", fail_tier: int | None = None, fail_unresolved: bool = False) -> DataFrame:
    """id, failed: any of the conditions asked for; a diff without files (files = 0) never fails."""
    rank = lambda c: F.array_position(F.array(*[F.lit(x) for x in LEVELS]), c)
    tiers = hazards.groupBy("id").agg(F.max("tier").alias("tier"))
    open_ = unresolved.groupBy("id").agg(F.count(F.lit(1)).alias("open"))
    out = levels.join(tiers, "id", "left").join(open_, "id", "left")
    bad = F.lit(False)
    if fail_on:
        bad = bad | (rank(F.col("level")) >= rank(F.lit(fail_on)))
    if fail_tier:
        bad = bad | F.coalesce(F.col("tier") >= fail_tier, F.lit(False))
    if fail_unresolved:
        bad = bad | F.col("open").isNotNull()
    return out.select("id", (bad & (F.col("files") > 0)).alias("failed"))


def coverage(files: DataFrame) -> DataFrame:
    """file, coverage: ``analyzed`` if it seeded a walk or only added or reformatted, else ``unresolved``."""
    return files.select("file", F.when((F.col("seeds") > 0) | F.col("additive"), "analyzed").otherwise("unresolved").alias("coverage"))


def risk_inputs(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """file, points: how many entry points lie above each file's seeds (file, node); one walk answers all files."""
    found = walk.entry_points(walk.walk(edges, seeds.select(F.col("file").alias("origin"), "node"), walk.UP))
    counts = found.groupBy(F.col("origin").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    return seeds.select("file").distinct().join(counts, "file", "left").select("file", F.coalesce("n", F.lit(0)).cast("long").alias("points"))


def self_listed(changes: DataFrame, inputs: DataFrame, points: DataFrame) -> DataFrame:
    """node: the entry points (node), and the classes of changed files (file, fqcn, entry_class, additive) that are entry points by their place and have none above."""
    own = changes.where("entry_class and not additive").join(inputs.where("points = 0").select("file"), "file", "left_semi").select(F.col("fqcn").alias("node"))
    return points.select("node").unionByName(own).distinct()


def with_frontend(points: DataFrame, seeds: DataFrame) -> DataFrame:
    """node: the entry points, and the routes that changed frontend files (file, node) name."""
    return points.select("node").unionByName(seeds.select("node")).distinct()


def job_flips(coverage: DataFrame, changes: DataFrame, inputs: DataFrame, uncertain: bool) -> DataFrame:
    """file, coverage: a changed job that no entry point reaches is ``unresolved``, where some dispatch or file couldn't be followed (``uncertain``)."""
    if not uncertain:
        return coverage.select("file", "coverage")
    jobs = changes.where(~F.col("additive") & F.col("fqcn").rlike(r"[.\\]Jobs[.\\]")).select("file").join(inputs.where("points = 0").select("file"), "file", "left_semi").withColumn("job", F.lit(True))
    flip = F.col("job").isNotNull() & (F.col("coverage") == "analyzed")
    return coverage.join(jobs, "file", "left").select("file", F.when(flip, "unresolved").otherwise(F.col("coverage")).alias("coverage"))
