"""Notes beside the risk: coverage of roots, group sizes, feature flags, pages, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemark.operators.resolve import ancestors


def root_coverage(classes: DataFrame, graph_nodes: DataFrame, roots: DataFrame, least: int = 5) -> DataFrame:
    """dir, classes: directories of at least ``least`` classes (cls, dir), none in the graph, that no configured root (dir) covers."""
    seen = graph_nodes.select(F.substring_index("node", "::", 1).alias("cls")).distinct().withColumn("there", F.lit(1))
    sizes = classes.join(seen, "cls", "left").groupBy("dir").agg(F.count(F.lit(1)).alias("classes"), F.sum(F.coalesce("there", F.lit(0))).alias("hit"))
    return sizes.where((F.col("classes") >= least) & (F.col("hit") == 0)).join(roots, "dir", "left_anti").select("dir", "classes")


def group_sizes(members: DataFrame, routes: DataFrame) -> DataFrame:
    """grp, middleware, routes: distinct middleware of each group with those of nested groups (grp, member), and its routes (route, grp)."""
    inner = members.select(F.col("grp").alias("cls"), F.col("member").alias("parent"))
    nested = ancestors(inner).select(F.col("cls").alias("grp"), F.col("ancestor").alias("member"))
    groups = members.select(F.col("grp").alias("member")).distinct()
    n = nested.join(groups, "member", "left_anti").groupBy("grp").agg(F.countDistinct("member").alias("middleware"))
    r = routes.groupBy("grp").agg(F.countDistinct("route").alias("routes"))
    return members.select("grp").distinct().join(n, "grp", "left").join(r, "grp", "left").select("grp", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("middleware", "routes")])


def feature_flags(calls: DataFrame, ranges: DataFrame) -> DataFrame:
    """file, flags: feature checks (file, line, flag) on changed lines (file, start, end)."""
    hit = calls.join(ranges, "file").where(F.col("line").between(F.col("start"), F.col("end")))
    return hit.groupBy("file").agg(F.array_join(F.sort_array(F.collect_set("flag")), ",").alias("flags"))


def page_files(pages: DataFrame, files: DataFrame, extensions: tuple[str, ...] = ("vue", "tsx", "jsx", "ts", "js", "svelte")) -> DataFrame:
    """page, path: the first existing file of each page; null if there is none."""
    tries = pages.select("page", F.posexplode(F.array(*[F.lit(x) for x in extensions])).alias("n", "ext"))
    found = tries.withColumn("path", F.concat(F.lit("resources/js/Pages/"), "page", F.lit("."), "ext")).join(files, "path", "left_semi")
    best = found.groupBy("page").agg(F.min_by("path", "n").alias("path"))
    return pages.select("page").distinct().join(best, "page", "left").select("page", "path")


def route_gates(middleware: Column) -> Column:
    """The abilities and roles among a route's raw middleware, in order, once each."""
    of = lambda m: F.transform(F.split(F.regexp_replace(m, "^(can|role|permission|ability):", ""), r"[,|]"), lambda x: F.trim(x))
    return F.array_distinct(F.flatten(F.transform(F.filter(middleware, lambda m: m.rlike("^(can|role|permission|ability):")), of)))


def eager_loads(calls: DataFrame, relations: DataFrame) -> DataFrame:
    """cls, path: eager-load strings whose first segment no relation of the class has."""
    first = F.substring_index(F.substring_index("path", ":", 1), ".", 1)
    return calls.withColumn("method", first).join(relations.select(F.col("owner").alias("cls"), "method"), ["cls", "method"], "left_anti").select("cls", "path").distinct()
