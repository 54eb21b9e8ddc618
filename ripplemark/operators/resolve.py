"""Resolution of names across files: closures, nearest declarations, rewrites, merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplemark.functions.nodes import base_name, class_of, is_member
from ripplemark.operators.graph import nodes
from ripplemark.plans.shared import parts, write_table


def ancestors(parents: DataFrame) -> DataFrame:
    """cls, ancestor, depth (the least) from (cls, parent); cycles end where they close."""
    step = parents.select(F.col("cls").alias("ancestor"), F.col("parent").alias("next")).distinct()
    now = write_table(parents.select("cls", F.col("parent").alias("ancestor")).where("cls <> ancestor").distinct(), "ancestors")
    found, depth = [now.withColumn("depth", F.lit(1))], 1
    while not now.isEmpty():  # a cycle finds nothing new
        seen = reduce(DataFrame.unionByName, found).select("cls", "ancestor")
        now = now.join(step, "ancestor").select("cls", F.col("next").alias("ancestor")).where("cls <> ancestor").distinct()
        now = write_table(now.join(seen, ["cls", "ancestor"], "left_anti"), "ancestors")
        depth += 1
        found.append(now.withColumn("depth", F.lit(depth)))
    return reduce(DataFrame.unionByName, found)


def override_edges(closure: DataFrame, methods: DataFrame) -> DataFrame:
    """source (ancestor's method), target (overriding method): methods are (cls, method, visibility, static, kind)."""
    can = methods.where((F.col("visibility") != "private") & ~F.col("static") & (F.col("method") != "__construct") & (F.col("kind") != "trait")).select("cls", "method").distinct()
    upper = can.withColumnRenamed("cls", "ancestor")
    return closure.join(can, "cls").join(upper, ["ancestor", "method"]).select(F.concat_ws("::", "ancestor", "method").alias("source"), F.concat_ws("::", "cls", "method").alias("target"), F.lit("override").alias("type")).distinct()


def nearest_declaring(wanted: DataFrame, closure: DataFrame, declared: DataFrame) -> DataFrame:
    """cls, member, owner, depth: who declares each wanted (cls, member); depth 0 is the class itself."""
    own = wanted.join(declared, ["cls", "member"], "left_semi").select("cls", "member", F.col("cls").alias("owner"), F.lit(0).alias("depth"))
    above = wanted.join(closure, "cls").join(declared.select(F.col("cls").alias("ancestor"), "member"), ["ancestor", "member"]).select("cls", "member", F.col("ancestor").alias("owner"), "depth")
    return own.unionByName(above).groupBy("cls", "member").agg(F.min(F.struct("depth", "owner")).alias("n")).select("cls", "member", "n.owner", "n.depth")


def inherited_edges(edges: DataFrame, closure: DataFrame, declared: DataFrame) -> DataFrame:
    """Edges from referenced members that a class only inherits to the nearest declaration."""
    referenced = nodes(edges).where(is_member(F.col("node"))).select(class_of(F.col("node")).alias("cls"), F.regexp_replace("node", "^.*?::", "").alias("member"))
    found = nearest_declaring(referenced, closure, declared).where("depth > 0")
    return found.select(F.concat_ws("::", "cls", "member").alias("source"), F.concat_ws("::", "owner", "member").alias("target"), F.lit("inherits").alias("type"))


def declares_edges(edges: DataFrame) -> DataFrame:
    """From each member node to its class."""
    return nodes(edges).where(is_member(F.col("node"))).select(F.col("node").alias("source"), class_of(F.col("node")).alias("target"), F.lit("declares").alias("type"))


def member_declaration(edges: DataFrame, methods: DataFrame) -> DataFrame:
    """From each class node of the graph to the methods that it declares."""
    classes = nodes(edges).where(~F.col("node").contains("::")).withColumnRenamed("node", "cls")
    return methods.join(classes, "cls", "left_semi").select(F.col("cls").alias("source"), F.concat_ws("::", "cls", "method").alias("target"), F.lit("declares").alias("type")).distinct()


def unique_bindings(bindings: DataFrame) -> DataFrame:
    """key, concrete of the container keys that are bound to one class alone."""
    return bindings.groupBy("key").agg(F.min("concrete").alias("concrete"), F.max("concrete").alias("most")).where("concrete = most").drop("most")


def facade_edges(calls: DataFrame, accessors: DataFrame, bindings: DataFrame, methods: DataFrame) -> DataFrame:
    """From a facade's static call to the concrete method: ``calls`` (facade, method), ``accessors`` (facade, accessor: a class or a key)."""
    concrete = accessors.join(unique_bindings(bindings).withColumnRenamed("key", "accessor"), "accessor", "left").select("facade", F.coalesce("concrete", F.when(F.col("accessor").contains("."), F.col("accessor"))).alias("cls"))
    known = calls.join(concrete.where("cls is not null"), "facade").join(methods.select("cls", "method"), ["cls", "method"], "left_semi")
    return known.select(F.concat_ws("::", "facade", "method").alias("source"), F.concat_ws("::", "cls", "method").alias("target"), F.lit("facade-resolves-to").alias("type")).distinct()


def with_trait_relations(relations: DataFrame, uses: DataFrame) -> DataFrame:
    """Relations (owner, method, related, to_many) with those of used traits; a class's own come first."""
    copied = relations.withColumnRenamed("owner", "trait").join(uses, "trait").select(F.col("cls").alias("owner"), "method", "related", "to_many", F.lit(1).alias("rank"))
    both = relations.select("owner", "method", "related", "to_many", F.lit(0).alias("rank")).unionByName(copied)
    return both.groupBy("owner", "method").agg(F.min(F.struct("rank", "related", "to_many")).alias("r")).select("owner", "method", "r.related", "r.to_many")


def relation_lookup(wanted: DataFrame, relations: DataFrame, closure: DataFrame) -> DataFrame:
    """cls, method, owner, related, to_many: through the parents, nearest first."""
    near = nearest_declaring(wanted.withColumnRenamed("method", "member"), closure, relations.select(F.col("owner").alias("cls"), F.col("method").alias("member")))
    return near.withColumnRenamed("member", "method").join(relations, ["owner", "method"]).select("cls", "method", "owner", "related", "to_many")


def relation_edges(relations: DataFrame) -> DataFrame:
    return relations.select(F.concat_ws("::", "owner", "method").alias("source"), F.col("related").alias("target"), F.lit("relation-to-model").alias("type")).distinct()


def relation_chains(chains: DataFrame, relations: DataFrame, closure: DataFrame, stop_at_many: bool = False) -> DataFrame:
    """id, pos, source, target of dotted chains (id, root, path), hop by hop; an unknown hop draws nothing and ends its path.

    With ``stop_at_many``, as for the traversal of relations in a body, a to-many hop is the
    last.  After the first segment, columns (``comments:id,body``) aren't part of the name.
    """
    parts = chains.select("id", F.col("root").alias("cls"), F.split("path", r"\.").alias("path"))
    found: list[DataFrame] = []
    while True:  # to the end of the longest path that resolves
        pos = len(found)
        segment = F.get("path", F.lit(pos))
        now = parts.where(F.size("path") > pos).withColumn("method", F.substring_index(segment, ":", 1) if pos else segment)
        hop = now.join(relation_lookup(now.select("cls", "method").distinct(), relations, closure), ["cls", "method"])
        hop = write_table(hop, "relation-chains")
        if hop.isEmpty():
            break
        found.append(hop.select("id", F.lit(pos).alias("pos"), F.concat_ws("::", "owner", "method").alias("source"), F.col("related").alias("target")))
        parts = (hop.where(~F.col("to_many")) if stop_at_many else hop).select("id", F.col("related").alias("cls"), "path")
    return reduce(DataFrame.unionByName, found) if found else chains.select("id", F.lit(0).alias("pos"), F.col("root").alias("source"), F.col("path").alias("target")).limit(0)


def instance_call_keep(edges: DataFrame, closure: DataFrame, declared: DataFrame) -> DataFrame:
    """Edges without the instance calls whose method no class, ancestor or trait declares."""
    calls = edges.where(F.col("type") == "instance-call").withColumn("cls", class_of(F.col("target"))).withColumn("member", F.regexp_replace("target", "^.*?::", ""))
    kept = nearest_declaring(calls.select("cls", "member").distinct(), closure, declared)
    return edges.where(F.col("type") != "instance-call").unionByName(calls.join(kept, ["cls", "member"], "left_semi").select(*edges.columns))


def short_id_rewrite(edges: DataFrame, classes: DataFrame, methods: DataFrame, prefix: str = "controller::") -> DataFrame:
    """Targets such as ``controller::Name@method`` become the one class of that base name that has the method."""
    short = F.split(F.substr(F.col("target"), F.lit(len(prefix) + 1)), "@")
    asked = edges.where(F.col("target").startswith(prefix)).select("target", short[0].alias("name"), short[1].alias("method")).distinct()
    known = classes.select("cls", base_name(F.col("cls")).alias("name")).join(methods.select("cls", "method"), "cls")
    answer = asked.join(known, ["name", "method"]).groupBy("target").agg(F.min("cls").alias("cls"), F.max("cls").alias("most"), F.first("method").alias("method")).where("cls = most")
    answer = answer.select("target", F.concat_ws("::", "cls", "method").alias("full"))
    return edges.join(answer, "target", "left").select("source", F.coalesce("full", "target").alias("target"), "type")


def alias_rewrite(edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """``middleware::alias[:parameters]`` becomes the alias's class; of several, the least precedence wins."""
    name = F.regexp_extract("target", "^middleware::([^:]+)", 1)
    best = aliases.groupBy("alias").agg(F.min_by("cls", "precedence").alias("cls"))
    return edges.withColumn("alias", F.when(F.col("target").startswith("middleware::"), name)).join(best, "alias", "left").select("source", F.coalesce("cls", "target").alias("target"), "type")


def canonical_ids(edges: DataFrame, upstream: DataFrame) -> DataFrame:
    """Ends that the upstream node table (id, fqcn, method) knows by a namespaced class become ``class[::method]``."""
    full = F.when(F.col("fqcn").contains("."), F.concat_ws("::", "fqcn", "method"))
    known = upstream.select("id", full.alias("full"))
    out = edges
    for end in ("source", "target"):
        out = out.join(known.withColumnRenamed("id", end), end, "left").withColumn(end, F.coalesce("full", end)).drop("full")
    return out.select("source", "target", "type")


def merge_metadata(meta: DataFrame, key: str, ordinal: str, columns: list[str]) -> DataFrame:
    """One row a key; of each column the first value that isn't null, by the ordinal, then by the value."""
    return meta.groupBy(key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(ordinal, c))).alias(c) for c in columns])


def fallback_files(meta: DataFrame, files: DataFrame, root: str = "App.") -> DataFrame:
    """node, file: a class without a file gets the path that its name gives, if there is such a file."""
    guess = F.concat(F.lit("app/"), F.replace(F.substr(class_of(F.col("node")), F.lit(len(root) + 1)), F.lit("."), F.lit("/")), F.lit(".php"))
    guess = F.when(F.col("file").isNull() & F.col("node").startswith(root), guess)
    return meta.withColumn("guess", guess).join(files.select(F.col("path").alias("guess"), F.lit(True).alias("there")), "guess", "left").select("node", F.coalesce("file", F.when(F.col("there"), F.col("guess"))).alias("file"))


def second_hop(edges: DataFrame, scope: str = "methods") -> DataFrame:
    """node: call targets whose bodies no walk covers yet; with ``class`` the classes of all call targets, too; with ``none`` nothing."""
    calls = edges.where(F.col("type").isin("static-call", "facade-resolves-to")).select(F.col("target").alias("node")).distinct()
    walked = edges.where(~F.col("type").isin("declares", "override", "inherits", "implements", "uses-trait")).select(F.col("source").alias("node")).distinct()
    out = calls.join(walked, "node", "left_anti")
    if scope == "none":
        return out.limit(0)
    return out if scope == "methods" else out.unionByName(calls.where(F.col("node").contains("::")).select(class_of(F.col("node")).alias("node"))).distinct()


def config_registry_edges(reads: DataFrame, entries: DataFrame) -> DataFrame:
    """Reads (reader, file, key_path; null: not enumerable) of config entries (file, key_path, cls).

    A literal path gives the classes at it, and none if it is absent; a path that can't be
    enumerated gives every class of the file, as a fan-out.  Both sides are made distinct before
    they meet: equal reads of a key times equal entries at it would grow with the square of the tables.
    """
    literal = reads.where("key_path is not null").select("reader", "file", "key_path").distinct().join(entries.select("file", "key_path", "cls").distinct(), ["file", "key_path"]).select("reader", "cls", F.lit("config-registry").alias("type"))
    fanout = reads.where("key_path is null").select("reader", "file").distinct().join(entries.select("file", "cls").distinct(), "file").select("reader", "cls", F.lit("config-registry-fanout").alias("type"))
    both = literal.unionByName(fanout).select(F.col("reader").alias("source"), F.col("cls").alias("target"), "type")
    # Few rows are equal before they are dealt by reader: combining them there would only fill memory.
    return both.repartition(parts(reads, entries, mb=0.5), "source").distinct()


def typed_references(names: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Edges of names (source, name) by the longest matching of a few (prefix, type) rows."""
    hit = names.join(F.broadcast(prefixes), F.col("name").startswith(F.col("prefix")))  # a fixed table of prefixes
    return hit.groupBy("source", "name").agg(F.max_by("type", F.length("prefix")).alias("type")).select("source", F.col("name").alias("target"), "type")


def label_collapse(labels: DataFrame) -> DataFrame:
    """Labels without the short ones that have exactly one full name behind them."""
    rows = labels.distinct().withColumn("base", base_name(F.col("label"))).withColumn("short", ~F.col("label").contains("."))
    full = F.sum((~F.col("short")).cast("long")).over(Window.partitionBy("base"))
    return rows.withColumn("full", full).where(~(F.col("short") & (F.col("full") == 1))).select("label")


def schedule_references(schedules: DataFrame, edges: DataFrame, commands: DataFrame) -> DataFrame:
    """schedule, referenced: over the commands that each runs; null if none is known, or one isn't and none is referenced."""
    runs = edges.where(F.col("target").startswith("command::")).select(F.col("source").alias("schedule"), F.col("target").alias("command"))
    state = schedules.join(runs, "schedule", "left").join(commands, "command", "left")
    return state.groupBy("schedule").agg(three_valued_any(F.col("referenced")).alias("referenced"))


def three_valued_any(value: Column) -> Column:
    """True if any is, else null if any is null, else false."""
    return F.when(F.max(value.cast("int")) == 1, True).when(F.sum(value.isNull().cast("int")) > 0, F.lit(None).cast("boolean")).otherwise(False)
