"""Which tests a change warrants, and whether that can be vouched for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.functions.scan import match_templates


def entry_point_references(points: DataFrame, references: DataFrame, names: DataFrame) -> DataFrame:
    """node, file: the tests that name each entry point (node).

    Routes ``route::VERB::/uri`` match by URI template or by name (names: node, name);
    commands by the first word of their signature.
    """
    routes = points.where(F.col("node").startswith("route::")).select("node", F.regexp_replace("node", "^route::[A-Z|]+::", "").alias("template"))
    uris = references.where("kind = 'uri'")
    met = match_templates(uris.select(F.col("key").alias("uri")), routes).join(uris.select(F.col("key").alias("uri"), "file"), "uri")
    by_uri = routes.join(met, "template").select("node", "file")
    by_name = names.join(references.where("kind = 'route'").select(F.col("key").alias("name"), "file"), "name").join(points, "node", "left_semi").select("node", "file")
    commands = points.where(F.col("node").startswith("command::")).select("node", F.regexp_extract("node", r"^command::(\S+)", 1).alias("key"))
    by_command = commands.join(references.where("kind = 'artisan'").select("key", "file"), "key").select("node", "file")
    return by_uri.unionByName(by_name).unionByName(by_command).distinct()


def reference_state(nodes: DataFrame, references: DataFrame, checkable: DataFrame) -> DataFrame:
    """node, referenced: true, false, or null where the index can't tell (not in ``checkable``)."""
    yes = references.select("node").distinct().withColumn("yes", F.lit(True))
    can = checkable.select("node").distinct().withColumn("can", F.lit(True))
    return nodes.select("node").distinct().join(yes, "node", "left").join(can, "node", "left").select("node", F.when(F.col("yes"), True).when(F.col("can"), False).alias("referenced"))


def weakly_tested(references: DataFrame, weak: DataFrame) -> DataFrame:
    """node, weak: whether every file that names the node asserts nothing beyond success (weak: file, weak)."""
    return references.join(weak, "file").groupBy("node").agg(F.min(F.col("weak").cast("int")).cast("boolean").alias("weak"))


def affected_tests(changed_tests: DataFrame, by_entry_point: DataFrame, by_class: DataFrame) -> DataFrame:
    """file: runnable tests that changed, that name a reached entry point, or that import a changed class."""
    parts = [changed_tests.select("file"), by_entry_point.select("file"), by_class.select("file")]
    return reduce(DataFrame.unionByName, parts).where(F.col("file").endswith("Test.php")).distinct()


def determinability(unresolved: DataFrame, low_confidence: DataFrame, unparseable: bool, blocked: DataFrame, states: DataFrame, support_only: DataFrame) -> DataFrame:
    """reason, subject: why a selection can't be vouched for; none means that it can."""
    tag = lambda df, column, reason: df.select(F.lit(reason).alias("reason"), F.col(column).alias("subject"))
    rows = [
        tag(unresolved, "file", "unresolved file"), tag(low_confidence, "file", "low confidence"), tag(blocked, "node", "unresolved dispatch"),
        tag(states.where("referenced is null"), "node", "entry point not checkable"), tag(support_only, "node", "named by support files alone"),
    ]
    out = reduce(DataFrame.unionByName, rows).distinct()
    if unparseable:
        out = out.unionByName(out.sparkSession.sql("select 'unparseable files' as reason, '' as subject"))
    return out


def support_only(references: DataFrame) -> DataFrame:
    """node: named by some files, none of which is a runnable test."""
    return references.groupBy("node").agg(F.max(F.col("file").endswith("Test.php").cast("int")).alias("r")).where("r = 0").select("node")


# Nodes of these kinds are never dispatched.
NOT_DISPATCHED = ("route::", "view::", "command::", "schedule::", "middleware::", "model::", "controller::", "action::")


def dispatch_blocked(changed: DataFrame, callers: DataFrame, targets: DataFrame) -> DataFrame:
    """id, blocked: whether a dispatch that couldn't be followed may hide callers of a change.

    That is so if a class that may be dispatched is changed (id, fqcn) or calls the change from
    above (id, node).  ``targets`` (name, target) says which classes may be; one that isn't
    in it may.
    """
    plain = F.lit(True)
    for prefix in NOT_DISPATCHED:
        plain = plain & ~F.col("node").startswith(prefix)
    own = changed.where("fqcn <> ''").select("id", F.col("fqcn").alias("name")).unionByName(callers.where(plain).select("id", F.substring_index("node", "::", 1).alias("name"))).distinct()
    may = own.join(targets, "name", "left").groupBy("id").agg(F.max(F.coalesce("target", F.lit(True)).cast("int")).alias("may"))
    return changed.select("id").distinct().join(may, "id", "left").select("id", (F.coalesce("may", F.lit(0)) == 1).alias("blocked"))


def capped(rows: DataFrame, key: str, value: str, most: int = 15) -> DataFrame:
    """key, shown, more: at most ``most`` values in order, and how many are left out."""
    all_ = rows.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias("all"))
    return all_.select(key, F.array_join(F.slice("all", 1, most), ", ").alias("shown"), F.greatest(F.size("all") - most, F.lit(0)).cast("long").alias("more"))
