"""Edges from facts of source files (:mod:`ripplemark.sources.php`), as joins and filters."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplemark.functions.scan import all_matches, view_node
from ripplemark.operators.resolve import ancestors, second_hop

# Calls that put a job on a queue, and namespace parts with the edge type that a reference to them is.
DISPATCH_FUNCTIONS = ("dispatch", "dispatch_sync")
DISPATCH_STATICS = ("dispatch", "dispatchSync", "dispatchNow", "dispatchIf", "dispatchUnless", "dispatchAfterResponse")
BUS_SINGLE, BUS_GROUP = ("dispatch", "dispatchSync", "dispatchNow"), ("chain", "batch")
REFERENCE_TYPES = (("\\Resources\\", "resource"), ("\\Transformers\\", "resource"), ("\\Rules\\", "validates-with"), ("\\Handlers\\", "references"), ("\\Actions\\", "references"))


def _in(facts: DataFrame, *kinds: str) -> DataFrame:
    return facts.where(F.col("fact").isin(*kinds))


def _edge(df: DataFrame, source: Column, target: Column, kind) -> DataFrame:
    return df.select(source.alias("source"), target.alias("target"), (F.lit(kind) if isinstance(kind, str) else kind).alias("type")).where("source is not null and target is not null").distinct()


def member(cls="cls", method="method") -> Column:
    return F.when(F.col(method).isNotNull(), F.concat_ws("::", cls, method)).otherwise(F.col(cls))


def app(name: str, root: str) -> Column:
    return F.col(name).startswith(root + "\\")


def interface_edges(facts: DataFrame, root: str = "App") -> DataFrame:
    return _edge(_in(facts, "implements").where(app("name", root)), F.col("cls"), F.col("name"), "implements")


def trait_edges(facts: DataFrame, root: str = "App") -> DataFrame:
    return _edge(_in(facts, "trait").where(app("name", root)), F.col("cls"), F.col("name"), "uses-trait")


def constructor_edges(facts: DataFrame, root: str = "App") -> DataFrame:
    """``new C`` of a class that the files declare."""
    known = _in(facts, "class").select(F.col("cls").alias("name")).distinct()
    return _edge(_in(facts, "new").where(app("name", root)).join(known, "name", "left_semi"), member(), F.concat(F.col("name"), F.lit("::__construct")), "constructs")


def static_call_edges(facts: DataFrame, models: DataFrame | None = None, root: str = "App") -> DataFrame:
    """Static calls on declared classes; those on ``models`` (cls), and in anonymous classes through self, are left out."""
    known = _in(facts, "class").select(F.col("cls").alias("name")).distinct()
    calls = _in(facts, "static").where(app("name", root)).where(~(F.col("nested") & (F.col("name") == F.col("cls")))).join(known, "name", "left_semi")
    if models is not None:
        calls = calls.join(models.select(F.col("cls").alias("name")), "name", "left_anti")
    return _edge(calls, member(), F.concat_ws("::", "name", "arg"), "static-call")


def instance_call_edges(facts: DataFrame) -> DataFrame:
    """Calls on ``$this`` outside anonymous classes."""
    return _edge(_in(facts, "this").where(~F.col("nested")), member(), F.concat_ws("::", "cls", "name"), "instance-call")


def constant_edges(facts: DataFrame, root: str = "App") -> DataFrame:
    return _edge(_in(facts, "fetch").where(app("name", root) & (F.col("arg") != "class")), member(), F.concat_ws("::", "name", "arg"), "references-constant")


def policy_edges(facts: DataFrame, root: str = "App") -> DataFrame:
    """From methods to the project's policies that they make, call, name or take as a parameter."""
    named = _in(facts, "new", "static", "fetch").select("cls", "method", "name").unionByName(_in(facts, "type").where("method is not null and extra is null").select("cls", "method", F.col("arg").alias("name")))
    return _edge(named.where(F.col("name").startswith(f"{root}\\Policies\\")), member(), F.col("name"), "authorizes")


def policy_view_edges(templates: DataFrame, root: str = "App") -> DataFrame:
    """From templates (path, source) to the project's policies that stand in them by their full names."""
    spaces = f"{root}\\Policies\\"
    views = templates.where(F.col("path").rlike(r"^resources/views/.+\.blade\.php$"))
    found = views.withColumn("policy", F.explode(F.array_distinct(all_matches(F.col("source"), re.escape(spaces) + r"([\w\\]+)"))))
    return _edge(found, view_node(F.col("path")), F.concat(F.lit(spaces), "policy"), "authorizes")


def reference_edges(facts: DataFrame) -> DataFrame:
    """Names in a few namespaces, typed by the namespace."""
    kind = reduce(lambda rest, pair: F.when(F.col("name").contains(pair[0]), pair[1]).otherwise(rest), reversed(REFERENCE_TYPES), F.lit(None).cast("string"))
    named = _in(facts, "new", "static", "fetch").withColumn("kind", kind).where("kind is not null and name <> cls")
    return _edge(named, member(), F.col("name"), F.col("kind"))


def view_edges(facts: DataFrame, views: DataFrame) -> DataFrame:
    """Literal views of ``view()`` and ``View::make()`` that exist (views: name)."""
    named = _in(facts, "call").where("name = 'view'").unionByName(_in(facts, "static").where(F.col("name").endswith("View") & (F.col("arg") == "make")))
    named = named.select("cls", "method", F.col("extra").alias("view")).join(views.select(F.col("name").alias("view")), "view", "left_semi")
    return _edge(named, member(), F.concat(F.lit("view::blade__"), F.lower("view")), "action-to-view")


def dispatch_targets(facts: DataFrame) -> DataFrame:
    """name, target: whether a declared class can be dispatched; classes that aren't declared count as targets (a left join gives null).

    What a class is or has by its parents, interfaces and traits counts as its own; the namespace of jobs doesn't descend.
    """
    classes = _in(facts, "class").select("cls").distinct()
    above = ancestors(parents(facts).unionByName(_in(facts, "trait").select("cls", F.col("name").alias("parent")))).select("cls", "ancestor")
    called = _in(facts, "method").where(F.col("name").isin("handle", "__invoke")).select("cls").distinct()
    signs = above.where(F.col("ancestor").rlike("(ShouldQueue|Dispatchable)$")).select("cls").unionByName(above.join(called.withColumnRenamed("cls", "ancestor"), "ancestor", "left_semi").select("cls"))
    signs = signs.unionByName(called).unionByName(classes.where(F.col("cls").contains("\\Jobs\\"))).distinct().withColumn("yes", F.lit(True))
    return classes.join(signs, "cls", "left").select(F.col("cls").alias("name"), F.coalesce("yes", F.lit(False)).alias("target"))


def dispatches(facts: DataFrame, helpers: tuple[str, ...] = ()) -> DataFrame:
    """path, line, pos, cls, method, how (class, single, group), extra of each dispatch site."""
    names = DISPATCH_FUNCTIONS + helpers
    calls = _in(facts, "call").where(F.col("name").isin(*names)).withColumn("how", F.lit("single"))
    own = _in(facts, "this").where(F.col("name") == "dispatch").where(F.col("extra").isNull() | F.col("extra").rlike("^(new|class|var|map):|^array$|^closure$")).withColumn("how", F.lit("single"))
    bus = _in(facts, "static").where(F.col("name").rlike(r"(^|\\)Bus$"))
    single, group = bus.where(F.col("arg").isin(*BUS_SINGLE)).withColumn("how", F.lit("single")), bus.where(F.col("arg").isin(*BUS_GROUP)).withColumn("how", F.lit("group"))
    direct = _in(facts, "static").where(F.col("arg").isin(*DISPATCH_STATICS) & ~F.col("name").rlike(r"(^|\\)Bus$")).withColumn("how", F.lit("class")).withColumn("extra", F.concat(F.lit("new:"), "name"))
    return reduce(DataFrame.unionByName, [calls, own, single, group, direct]).select("path", "line", "pos", "cls", "method", "how", "extra")


def local_jobs(facts: DataFrame, sites: DataFrame) -> DataFrame:
    """The sites that dispatch a variable, with the class (name) that its only write, before the site, makes: an object for one job, a mapped collection for a group."""
    n = F.count(F.lit(1)).over(Window.partitionBy("path", "cls", "method", "name"))
    once = _in(facts, "write").withColumn("n", n).where("n = 1 and arg is not null and not nested").select("path", "cls", "method", F.col("name").alias("var"), F.col("arg").alias("made"), F.col("pos").alias("written"), F.coalesce(F.col("extra") == "map", F.lit(False)).alias("each"))
    asked = sites.where(F.col("extra").startswith("var:")).withColumn("var", F.substr(F.col("extra"), F.lit(5)))
    return asked.join(once, ["path", "cls", "method", "var"]).where((F.col("written") < F.col("pos")) & (F.col("each") == (F.col("how") == "group"))).select(*sites.columns, F.col("made").alias("name"))


def dispatch_edges(facts: DataFrame, helpers: tuple[str, ...] = ()) -> DataFrame:
    """To the ``handle`` of each dispatched class, and of each class that a dispatching method makes and that is a target."""
    sites = dispatches(facts, helpers)
    named = sites.where(F.col("extra").startswith("new:") | (F.col("extra").startswith("map:") & (F.col("how") == "group"))).select("cls", "method", F.substr(F.col("extra"), F.lit(5)).alias("name"))
    made = _in(facts, "new").where("name is not null").select("cls", "method", "name").join(sites.select("cls", "method").distinct(), ["cls", "method"], "left_semi")
    both = named.unionByName(local_jobs(facts, sites).select("cls", "method", "name")).unionByName(made).where("name <> cls").distinct().join(dispatch_targets(facts), "name", "left").where(F.coalesce("target", F.lit(True)))
    return _edge(both, member(), F.concat(F.col("name"), F.lit("::handle")), "action-to-job")


def unresolved_dispatches(facts: DataFrame, helpers: tuple[str, ...] = ()) -> DataFrame:
    """file, line, dispatcher of the sites whose job can't be named; a variable written once before, by ``new``, is named."""
    sites = dispatches(facts, helpers).where("how <> 'class'")
    known = local_jobs(facts, sites).select("path", "pos")
    open_ = sites.where(F.col("extra").isNull() | F.col("extra").startswith("var:")).join(known, ["path", "pos"], "left_anti")
    return open_.select(F.col("path").alias("file"), "line", member().alias("dispatcher")).distinct()


def mapped_jobs(facts: DataFrame) -> DataFrame:
    """path, line, cls, method, name: the jobs of groups that are a collection mapped item by item, written in place or once before."""
    sites = dispatches(facts).where("how = 'group'")
    here = sites.where(F.col("extra").startswith("map:")).withColumn("name", F.substr("extra", F.lit(5)))
    both = here.unionByName(local_jobs(facts, sites))
    known = both.join(dispatch_targets(facts), "name", "left").where(F.coalesce("target", F.lit(True)))
    return known.select("path", "line", "cls", "method", "name").distinct()


def typed_calls(facts: DataFrame, root: str = "App") -> DataFrame:
    """Calls on variables and properties that are declared as one class: by parameter, property or tag; within a method its own declarations count, the nearest before the call."""
    types = _in(facts, "type").where(app("arg", root)).select("path", "cls", F.col("method").alias("of"), "name", F.col("arg").alias("known"), F.col("pos").alias("said"))
    calls = _in(facts, "on").where(~F.col("nested")).select("path", "cls", "method", "name", F.col("arg").alias("called"), "pos")
    met = calls.join(types, ["path", "cls", "name"]).where((F.col("of").isNull() & F.col("name").startswith("this.")) | ((F.col("of") == F.col("method")) & (F.col("said") < F.col("pos"))))
    best = met.groupBy("path", "cls", "method", "name", "called", "pos").agg(F.max(F.struct("said", "known")).alias("t"))
    return _edge(best, member(), F.concat_ws("::", "t.known", "called"), "instance-call")


def entry_point_methods(facts: DataFrame, roots: tuple[str, ...]) -> DataFrame:
    """path, cls, method of the methods below the roots (folders of app/) that have a body with some call, object or constant in it."""
    below = F.lit(False)
    for r in roots:
        below = below | F.col("path").startswith(f"app/{r.strip('/')}/")
    own = _in(facts, "method").where(below & ~F.array_contains(F.split("arg", " "), "abstract")).select("path", "cls", F.col("name").alias("method"))
    acting = _in(facts, "new", "static", "this", "call", "fetch", "on").select("path", "cls", "method").distinct()
    return own.join(acting, ["path", "cls", "method"], "left_semi").distinct()


def body_edges(facts: DataFrame, methods: DataFrame, root: str = "App") -> DataFrame:
    """The edges that leave the bodies of some methods (path, cls, method)."""
    inner = _in(facts, "new", "static", "this", "call", "fetch", "on", "write", "type").where("method is not null or fact = 'type'")
    wanted = inner.join(methods.select("path", "cls", "method").distinct(), ["path", "cls", "method"], "left_semi").select(*facts.columns)
    rest = _in(facts, "class", "implements", "trait", "method").unionByName(inner.where("method is null").select(*facts.columns))
    both = wanted.unionByName(rest)
    parts = [static_call_edges(both, None, root), constructor_edges(both, root), instance_call_edges(both), constant_edges(both, root), typed_calls(both, root), dispatch_edges(both)]
    return reduce(DataFrame.unionByName, parts).distinct()


def second_hop_round(edges: DataFrame, facts: DataFrame, scope: str = "methods", root: str = "App") -> DataFrame:
    """``edges`` and those of one more round: the bodies behind calls that no walk covers yet, and with ``class`` all methods of their classes."""
    asked = second_hop(edges, scope).select(F.col("node").alias("asked"))
    methods = _in(facts, "method").select("path", "cls", F.col("name").alias("method"))
    hit = methods.join(asked, F.col("asked").isin(F.concat_ws("::", "cls", "method"), F.col("cls")), "left_semi") if scope == "class" else methods.join(asked, F.concat_ws("::", "cls", "method") == F.col("asked"), "left_semi")
    return edges.unionByName(body_edges(facts, hit, root).select(*edges.columns)).distinct()


def members(facts: DataFrame) -> DataFrame:
    """path, cls, kind, name, start, end: the spans of methods, properties, constants and enum cases."""
    kind = F.when(F.col("fact") == "case", "enum_case").otherwise(F.col("fact"))
    return _in(facts, "method", "property", "constant", "case").select("path", "cls", kind.alias("kind"), "name", F.col("line").alias("start"), F.col("stop").alias("end"))


def methods(facts: DataFrame) -> DataFrame:
    """cls, method, visibility, static, kind, params, as the resolution joins want them."""
    words = F.split("arg", " ")
    visibility = F.when(F.array_contains(words, "private"), "private").when(F.array_contains(words, "protected"), "protected").otherwise("public")
    kinds = _in(facts, "class").groupBy("cls").agg(F.min("name").alias("kind"))
    return _in(facts, "method").select("cls", F.col("name").alias("method"), visibility.alias("visibility"), F.array_contains(words, "static").alias("static"), F.col("extra").alias("params")).join(kinds, "cls")


def parents(facts: DataFrame) -> DataFrame:
    """cls, parent: superclasses and interfaces."""
    return _in(facts, "class").where("arg is not null").select("cls", F.col("arg").alias("parent")).unionByName(_in(facts, "implements").select("cls", F.col("name").alias("parent"))).distinct()


def unparseable(facts: DataFrame) -> DataFrame:
    return _in(facts, "unparseable").select("path").distinct()


def config_reads(facts: DataFrame) -> DataFrame:
    """reader, file, key_path: reads of ``config()`` and ``Config::get()``; a bare file name, and text with variables, can't be enumerated (null)."""
    reads = _in(facts, "call").where("name = 'config'").unionByName(_in(facts, "static").where(F.col("name").endswith("Config") & (F.col("arg") == "get")))
    reads = reads.where(F.col("extra").isNotNull() & ~F.col("extra").rlike("^(new|class|var|map):|^array$|^closure$"))
    whole = reads.select(member().alias("reader"), F.substring_index("extra", ".", 1).alias("file"), F.when(F.col("extra").contains("."), F.regexp_replace("extra", r"^[^.]*\.", "")).alias("key_path"))
    begun = _in(facts, "lead").select(member().alias("reader"), F.substring_index("arg", ".", 1).alias("file"), F.lit(None).cast("string").alias("key_path"))
    return whole.unionByName(begun).where("file <> ''")


def all_edges(facts: DataFrame, root: str = "App") -> DataFrame:
    """Every edge kind above that needs no other relation, once each."""
    parts = [interface_edges(facts, root), trait_edges(facts, root), constructor_edges(facts, root), static_call_edges(facts, None, root), instance_call_edges(facts), constant_edges(facts, root), policy_edges(facts), reference_edges(facts), dispatch_edges(facts)]
    return reduce(DataFrame.unionByName, parts).distinct()
