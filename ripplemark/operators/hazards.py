"""Snapshot hazards: base and head, a null side is silent, a set difference is a hazard.

Every lane returns lane, tier, cwe, member, evidence, tokens (the removed ones, ascending).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplemark.plans.shared import write_table

HAZARD = ("lane", "tier", "cwe", "member", "evidence", "tokens")
# Rules whose loss opens a boundary.
GUARDING_RULES = ("required", "confirmed", "max", "min", "size", "in", "exists", "unique", "mimes", "image", "url", "email", "uuid")
# Guard aliases; those whose parameter says what is authorised; those whose parameter is a set, by its separator.
GUARDS = (
    "auth", "verified", "signed", "password.confirm", "can", "throttle", "role", "permission", "role_or_permission",
    "client", "scope", "scopes", "ability", "abilities",
)
SCOPED = ("can", "role", "permission", "role_or_permission", "ability", "abilities", "scope", "scopes", "throttle")
PIPE_SETS = ("role", "permission", "role_or_permission")
COMMA_SETS = ("ability", "abilities", "scope", "scopes")
# The framework's guard classes, and the alias that each stands for.
GUARD_CLASSES = {
    "Illuminate\\Auth\\Middleware\\Authenticate": "auth",
    "Illuminate\\Auth\\Middleware\\AuthenticateWithBasicAuth": "auth",
    "Illuminate\\Auth\\Middleware\\EnsureEmailIsVerified": "verified",
    "Illuminate\\Auth\\Middleware\\RequirePassword": "password.confirm",
    "Illuminate\\Routing\\Middleware\\ValidateSignature": "signed",
    "Illuminate\\Auth\\Middleware\\Authorize": "can",
    "Illuminate\\Routing\\Middleware\\ThrottleRequests": "throttle",
}
# The weakness that losing a guard is.
GUARD_CWE = {
    "auth": "CWE-306", "password.confirm": "CWE-306", "can": "CWE-862", "verified": "CWE-862", "role": "CWE-862", "permission": "CWE-862", "role_or_permission": "CWE-862",
    "client": "CWE-862", "scope": "CWE-862", "scopes": "CWE-862", "ability": "CWE-862", "abilities": "CWE-862", "signed": "CWE-345", "throttle": "CWE-770",
}
#: What a token that names a middleware begins with; other tokens are authorisation checks in a body.
MIDDLEWARE = "middleware:"


def hazard(df: DataFrame, lane: str, tier: int, cwe: str | Column | None, member: Column, evidence: Column, tokens: Column | None = None) -> DataFrame:
    empty = F.array().cast("array<string>")
    return df.select(F.lit(lane).alias("lane"), F.lit(tier).alias("tier"), (cwe if isinstance(cwe, Column) else F.lit(cwe)).cast("string").alias("cwe"), member.alias("member"), evidence.alias("evidence"), (tokens if tokens is not None else empty).alias("tokens"))


def sets(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.sort_array(F.collect_set(value)).alias("set"))


def lost_tokens(base: DataFrame, head: DataFrame, key: list[str], value: str) -> DataFrame:
    """key, lost, gained of the keys on both sides that lost something."""
    both = sets(base, key, value).withColumnRenamed("set", "a").join(sets(head, key, value).withColumnRenamed("set", "b"), key)
    return both.select(*key, F.array_except("a", "b").alias("lost"), F.array_except("b", "a").alias("gained")).where(F.size("lost") > 0)


def guard_removals(both: DataFrame, gone: Column, head: Column) -> DataFrame:
    """A row a token of ``gone``; a lost throttle beside a head that still throttles isn't a removal but a change of rate."""
    throttles = F.exists(head, lambda t: guard_alias(t) == "throttle")
    rows = both.withColumn("__still", throttles).withColumn("token", F.explode(F.array_sort(F.array_distinct(gone))))
    return rows.where(~(F.col("__still") & (guard_alias(F.col("token")) == "throttle"))).drop("__still")


def guard_lost(base: DataFrame, head: DataFrame) -> DataFrame:
    """Members (member, token) on both sides that lost guard tokens, one hazard a token with its own weakness."""
    both = sets(base, ["member"], "token").withColumnRenamed("set", "a").join(sets(head, ["member"], "token").withColumnRenamed("set", "b"), "member")
    lost = guard_removals(both, F.array_except("a", "b"), F.col("b"))
    return hazard(lost, "auth", 3, token_weakness(F.col("token")), F.col("member"), F.concat(F.lit("lost "), "token"), F.array("token"))


def neutered(base: DataFrame, head: DataFrame) -> DataFrame:
    """Bodies (member, body) that became exactly ``return true``."""
    always = lambda c: F.regexp_replace(c, r"\s+", "") == "returntrue;"
    both = base.select("member", F.col("body").alias("a")).join(head.select("member", F.col("body").alias("b")), "member").where(~always("a") & always("b"))
    return hazard(both, "auth", 3, "CWE-862", F.col("member"), F.lit("the body now always allows"))


def missing_members(base: DataFrame, head: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """Members (cls, name, visibility, policy) gone from a class that is still there: policies at tier 3, public contracts at 2.

    ``present`` (cls) are head's classes, where those without members count too.
    """
    classes = (head if present is None else present).select("cls").distinct()
    gone = base.join(head.select("cls", "name"), ["cls", "name"], "left_anti").join(classes, "cls", "left_semi")
    member = F.concat_ws("::", "cls", "name")
    policy = hazard(gone.where("policy"), "auth", 3, "CWE-862", member, F.lit("policy method removed"), F.array(F.concat(F.lit("ability:"), "name")))
    contract = hazard(gone.where((F.col("visibility") != "private") & ~F.col("policy")), "contract", 2, None, member, F.lit("member removed"), F.array(F.col("name")))
    return policy.unionByName(contract)


def missing_classes(base: DataFrame, head: DataFrame) -> DataFrame:
    """Classes gone, policies (all of whose members are) aside."""
    gone = base.groupBy("cls").agg(F.min("policy").alias("policy")).where("not policy").join(head.select("cls").distinct(), "cls", "left_anti")
    return hazard(gone, "contract", 2, None, F.col("cls"), F.lit("class removed"))


def signature_changed(base: DataFrame, head: DataFrame) -> DataFrame:
    """Parameter lists that changed: a job's constructor, queued on either side, at tier 2, other members not private on both sides at tier 1."""
    a, b = (df.select("cls", "name", *[F.col(c).alias(c + s) for c in ("visibility", "params", "queued", "constructor")]) for df, s in ((base, "_a"), (head, "_b")))
    both = a.join(b, ["cls", "name"]).where("params_a <> params_b")
    member, evidence = F.concat_ws("::", "cls", "name"), F.concat_ws(" -> ", "params_a", "params_b")
    job = (F.col("queued_a") | F.col("queued_b")) & F.col("constructor_b")
    private = (F.col("visibility_a") == "private") & (F.col("visibility_b") == "private")
    return hazard(both.where(job), "boundary", 2, None, member, evidence).unionByName(hazard(both.where(~job & ~private), "contract", 1, None, member, evidence))


def model_settings(base: DataFrame, head: DataFrame) -> DataFrame:
    """Model settings (model, kind, key, value): fillable gained, guarded or hidden lost, casts changed."""
    a, b = (sets(df, ["model", "kind"], "key").withColumnRenamed("set", s) for df, s in ((base, "a"), (head, "b")))
    both = a.join(b, ["model", "kind"]).withColumn("lost", F.array_except("a", "b")).withColumn("gained", F.array_except("b", "a"))
    member = F.concat(F.col("model"), F.lit("::$"), F.col("kind"))
    wide = hazard(both.where((F.col("kind") == "fillable") & (F.size("gained") > 0)), "model", 2, "CWE-915", member, F.concat(F.lit("gained "), F.array_join("gained", ",")))
    of = lambda kind, tier, cwe: hazard(both.where((F.col("kind") == kind) & (F.size("lost") > 0)), "model", tier, cwe, member, F.concat(F.lit("lost "), F.array_join("lost", ",")), F.col("lost"))
    # Both ways to declare casts, each compared with itself.
    half = lambda df, name: df.where("kind in ('casts', 'casts()')").select("model", "kind", "key", F.col("value").alias(name))
    cast = half(base, "old").join(half(head, "new"), ["model", "kind", "key"]).where("old <> new")
    owner = F.when(F.col("kind") == "casts", F.concat("model", F.lit("::$casts"))).otherwise(F.concat_ws("::", "model", "kind"))
    casts = hazard(cast, "model", 2, None, owner, F.concat(F.col("key"), F.lit(": "), F.col("old"), F.lit(" -> "), F.col("new")))
    return wide.unionByName(of("guarded", 2, "CWE-915")).unionByName(of("hidden", 3, "CWE-200")).unionByName(casts)


def rules_dropped(base: DataFrame, head: DataFrame) -> DataFrame:
    """Fields (request, field, rule) on both sides that lost a guarding rule; ``max:5`` is the rule max."""
    name = lambda df: df.withColumn("rule", F.substring_index("rule", ":", 1))
    lost = lost_tokens(name(base), name(head), ["request", "field"], "rule").withColumn("lost", F.array_intersect("lost", F.array(*[F.lit(r) for r in GUARDING_RULES]))).where(F.size("lost") > 0)
    return hazard(lost, "boundary", 2, "CWE-20", F.concat_ws("::", "request", "field"), F.concat(F.lit("lost "), F.array_join("lost", ",")), F.col("lost"))


def throttle_limit(token: Column) -> Column:
    """struct(max, minutes) of ``throttle:max[,minutes]``, or null if unreadable."""
    part = lambda k: F.regexp_extract(token, r"^throttle:(\d+)(?:,(\d+))?$", k)
    minutes = F.coalesce(F.nullif(part(2), F.lit("")).cast("long"), F.lit(1).cast("long"))
    return F.when(part(1) != "", F.when(minutes > 0, F.struct(part(1).cast("long").alias("max"), minutes.alias("minutes"))))


def rate_raised(base: DataFrame, head: DataFrame) -> DataFrame:
    """Members (member, token) whose strictest limit rose; different windows or an unreadable limit are silent."""

    def strictest(df: DataFrame, name: str) -> DataFrame:
        limits = df.where(F.col("token").startswith("throttle")).select("member", throttle_limit(F.col("token")).alias("l"))
        return limits.groupBy("member").agg(F.min("l.max").alias(name), F.min("l.minutes").alias(name + "_w"), F.max("l.minutes").alias(name + "_x"), F.sum(F.col("l").isNull().cast("int")).alias(name + "_n")).where(f"{name}_n = 0 and {name}_w = {name}_x")

    both = strictest(base, "a").join(strictest(head, "b"), "member").where("a_w = b_w and b > a")
    return hazard(both, "auth", 2, "CWE-770", F.col("member"), F.concat(F.col("a").cast("string"), F.lit(" -> "), F.col("b").cast("string"), F.lit(" in "), F.col("a_w").cast("string")))


def guard_alias(token: Column) -> Column:
    """The alias of a guard, whether or not the token says that it is a middleware; a framework class by its alias."""
    name = F.regexp_replace(F.regexp_replace(token, "^" + MIDDLEWARE, ""), r"^\\+", "")
    bare = F.substring_index(name, ":", 1)
    known = F.create_map(*[F.lit(x) for pair in GUARD_CLASSES.items() for x in pair])
    return F.coalesce(F.element_at(known, name), bare)


def guard_identity(token: Column) -> Column:
    """What two spellings of one guard have in common.

    Guards that aren't scoped are known by their alias alone.  A set of parameters is put in
    order: of abilities and scopes at commas; of roles and permissions at bars, up to the first comma,
    after which a guard's name stays in its place.  ``can`` and ``throttle`` stay as written.
    """
    alias = guard_alias(token)
    rest = F.when(token.contains(":"), F.regexp_replace(token, "^[^:]*:", ""))
    put = lambda text, by: F.array_join(F.array_sort(F.split(text, F.lit("\\" + by if by == "|" else by))), by)
    first = F.substring_index(rest, ",", 1)
    bars = F.concat(put(first, "|"), F.substr(rest, F.length(first) + 1))
    own = F.when(alias.isin(*COMMA_SETS), put(rest, ",")).when(alias.isin(*PIPE_SETS), bars).otherwise(rest)
    return F.when(rest.isNull() | ~alias.isin(*SCOPED), alias).otherwise(F.concat(alias, F.lit(":"), own))


def guard_weakness(token: Column) -> Column:
    """The weakness of a lost middleware guard; null for a name that isn't a guard."""
    known = F.create_map(*[F.lit(x) for pair in GUARD_CWE.items() for x in pair])
    return F.element_at(known, guard_alias(token))


def token_weakness(token: Column) -> Column:
    """The weakness of a lost token: of its guard for a middleware, else missing authorisation."""
    return F.when(token.startswith(MIDDLEWARE), guard_weakness(token)).otherwise("CWE-862")


def effective_guards(own: Column, group: Column, without: Column) -> Column:
    """The guards that a route runs: its group's and its own, by identity, less those taken away."""
    identity = lambda tokens: F.transform(tokens, guard_identity)
    none = F.array().cast("array<string>")
    every = F.array_union(identity(F.coalesce(group, none)), identity(F.coalesce(own, none)))
    return F.array_sort(F.filter(F.array_except(every, identity(F.coalesce(without, none))), lambda t: guard_alias(t).isin(*GUARDS)))


def pair_routes(base: DataFrame, head: DataFrame) -> DataFrame:
    """Both sides of each route: by verb, uri and action; what is left by verb and uri where that is unique on both sides; the rest by action, alike."""
    a, b = (df.select(*[F.col(c).alias(c + s) for c in ("verb", "uri", "action", "guards")]).distinct() for df, s in ((base, "_a"), (head, "_b")))
    out = None
    for step, keys in enumerate((("verb", "uri", "action"), ("verb", "uri"), ("action",))):
        count = lambda df, s: df.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*[k + s for k in keys]))).where("n = 1").drop("n") if step else df  # noqa: B023, E731
        same = [F.col(k + "_a") == F.col(k + "_b") for k in keys]
        met = count(a, "_a").join(count(b, "_b"), same).withColumn("step", F.lit(step))
        out = met if out is None else out.unionByName(met)
        a = a.join(met.select("verb_a", "uri_a", "action_a").distinct(), ["verb_a", "uri_a", "action_a"], "left_anti")
        b = b.join(met.select("verb_b", "uri_b", "action_b").distinct(), ["verb_b", "uri_b", "action_b"], "left_anti")
    return out


def rates_rose(both: DataFrame, member: Column, base: Column, head: Column) -> DataFrame:
    """Rows whose one effective limit rose: the strictest of each side, where all can be read and the windows agree."""
    limits = lambda tokens: F.transform(F.filter(tokens, lambda t: guard_alias(t) == "throttle"), lambda t: throttle_limit(F.regexp_replace(t, "^" + MIDDLEWARE, "")))
    fine = lambda x: (F.size(x) > 0) & F.forall(x, lambda y: y.isNotNull()) & (F.size(F.array_distinct(F.transform(x, lambda y: y["minutes"]))) == 1)
    rows = both.withColumn("__x", limits(base)).withColumn("__y", limits(head)).where(fine(F.col("__x")) & fine(F.col("__y")))
    least = lambda c: F.array_min(F.transform(F.col(c), lambda y: y["max"]))
    window = F.col("__x")[0]["minutes"]
    rows = rows.where((window == F.col("__y")[0]["minutes"]) & (least("__y") > least("__x")))
    evidence = F.concat(least("__x").cast("string"), F.lit(" -> "), least("__y").cast("string"), F.lit(" in "), window.cast("string"))
    return hazard(rows, "auth", 2, "CWE-770", member, evidence)


def route_guard_lost(base: DataFrame, head: DataFrame) -> DataFrame:
    """Routes (verb, uri, action, guards: an array) that lost a guard, one hazard a guard, and those whose limit rose.

    The member is the head's action: a route may be pointed elsewhere in the same edit.
    """
    both = pair_routes(base, head)
    lost = guard_removals(both, F.array_except("guards_a", "guards_b"), F.col("guards_b"))
    evidence = F.concat(F.col("verb_b"), F.lit(" "), F.col("uri_b"), F.lit(" lost "), F.col("token"))
    gone = hazard(lost, "auth", 3, guard_weakness(F.col("token")), F.col("action_b"), evidence, F.array("token"))
    return gone.unionByName(rates_rose(both, F.col("action_b"), F.col("guards_a"), F.col("guards_b")))


def group_guard_lost(base: DataFrame, head: DataFrame, kept: DataFrame | None = None, key: tuple[str, ...] = ("grp",)) -> DataFrame:
    """Middleware groups (grp, token, state running or removed): gone = running lost, or removed anew while it ran before; and limits that rose.

    A group that head hasn't got runs nothing there.  ``kept`` (key without grp, token): guards that aren't known to have left.
    """
    of = lambda df, s: df.groupBy(*key).agg(*[F.collect_set(F.when(F.col("state") == k, F.col("token"))).alias(k + s) for k in ("running", "removed")])
    both = of(base, "_a").join(of(head, "_b"), list(key), "left")
    both = both.withColumns({k + "_b": F.coalesce(k + "_b", F.array().cast("array<string>")) for k in ("running", "removed")})
    gone = F.array_union(F.array_except("running_a", "running_b"), F.array_intersect(F.array_except("removed_b", "removed_a"), F.col("running_a")))
    member = F.concat(F.lit("middleware::"), F.col("grp"))
    lost = guard_removals(both, gone, F.col("running_b"))
    if kept is not None:
        lost = lost.join(kept, [c for c in key if c != "grp"] + ["token"], "left_anti")
    return hazard(lost, "auth", 3, guard_weakness(F.col("token")), member, F.concat(F.lit("group lost "), "token"), F.array("token")).unionByName(
        rates_rose(both, member, F.col("running_a"), F.col("running_b"))
    )


def migration_ops(base: DataFrame, head: DataFrame) -> DataFrame:
    """Destructive operations (file, op, tbl, col) that only head has."""
    new = head.select("file", "op", "tbl", "col").exceptAll(base.select("file", "op", "tbl", "col"))
    return hazard(new, "migration", 2, None, F.col("file"), F.concat_ws(" ", "op", "tbl", "col"))


# English nouns without a plural of their own, irregular ones, and endings, the first that fits.
UNCOUNTABLE = ("equipment", "information", "rice", "money", "species", "series", "fish", "sheep", "deer", "news", "police", "feedback", "metadata", "software", "traffic", "moose", "media")
IRREGULAR = {
    "person": "people", "man": "men", "woman": "women", "child": "children", "foot": "feet", "tooth": "teeth", "goose": "geese", "mouse": "mice", "louse": "lice", "ox": "oxen",
    "quiz": "quizzes", "criterion": "criteria", "phenomenon": "phenomena", "curriculum": "curricula", "move": "moves", "sex": "sexes", "cafe": "cafes", "zombie": "zombies",
}
ENDINGS = (
    ("(matr|append|vert|ind)(ix|ex)", "$1ices"), ("(x|ch|ss|sh|z)", "$1es"), ("([^aeiouy]|qu)y", "$1ies"), ("(hive)", "$1s"), ("([^f])fe", "$1ves"), ("([lr]|ea)f", "$1ves"), ("sis", "ses"),
    ("(dat|medi|bacteri)um", "$1a"), ("(buffal|tomat|potat|ech|her|torped|vet)o", "$1oes"), ("(bu|alia|statu|campu|viru|cens|bonu)s", "$1ses"), ("(octop|cact|alumn|syllab)us", "$1i"), ("(ax|test)is", "$1es"), ("s", "s"), ("", "s"),
)


def plural(word: Column) -> Column:
    """The plural of a lower-case English noun."""
    out = None
    for pattern, by in ENDINGS:
        hit, made = word.rlike(pattern + "$"), F.regexp_replace(word, pattern + "$", by) if pattern else F.concat(word, F.lit(by))
        out = F.when(hit, made) if out is None else out.when(hit, made)
    known = F.create_map(*[F.lit(x) for pair in IRREGULAR.items() for x in pair])
    return F.coalesce(F.element_at(known, word), F.when(word.isin(*UNCOUNTABLE), word), out)


def table_models(models: DataFrame) -> DataFrame:
    """tbl, cls: from the explicit table (may be null), else the base name in snake case, its last word in the plural; null if several classes share it."""
    snake = F.lower(F.regexp_replace(F.element_at(F.split("cls", r"[.\\]"), -1), "(?<=[a-z0-9])(?=[A-Z])", "_"))
    last = F.substring_index(snake, "_", -1)
    named = F.concat(F.substr(snake, F.lit(1), F.length(snake) - F.length(last)), plural(last))
    return models.select("cls", F.coalesce("explicit", named).alias("tbl")).groupBy("tbl").agg(F.when(F.countDistinct("cls") == 1, F.min("cls")).alias("cls"))


def payload_parity(fields: DataFrame, added: DataFrame, resources: DataFrame, ignored: tuple[str, ...] = (), threshold: float = 1.0, least: int = 1) -> DataFrame:
    """Resources (resource, model, keys) that mirror a model's older fields but lack an added one.

    ``fields`` (model, fields) and ``added`` (model, added) are arrays.  A resource mirrors the
    model if it shows a large enough share of the fields that are neither new nor ignored.
    """
    skip = F.array(*[F.lit(i) for i in ignored]).cast("array<string>")
    both = fields.join(added, "model").join(resources, "model").withColumn("old", F.array_except(F.array_except("fields", "added"), skip)).where(F.size("old") > 0)
    shared = F.size(F.array_intersect("old", "keys"))
    both = both.where((shared / F.size("old") >= threshold) & (shared >= least)).withColumn("lack", F.array_sort(F.array_except(F.array_except("added", "keys"), skip))).where(F.size("lack") > 0)
    return hazard(both, "parity", 2, None, F.col("resource"), F.concat(F.col("model"), F.lit(" gained "), F.array_join("lack", ",")))


#: Tasks over which the members of one key are dealt.
DEALS = 32


def consumer_parity(removed: DataFrame, reach: DataFrame, consumers: DataFrame) -> DataFrame:
    """Keys removed (member, key) that a consumer (route, file, keys) of a route above (member, route) still reads.

    What grows with members times files are the texts alone, which no shuffle carries: a key's files have numbers in
    their order, each member brings its routes, and both meet at the key, a key's members dealt over several tasks.
    """
    asked = removed.select("member", "key").distinct()
    reads = consumers.select("route", "file", F.explode("keys").alias("key")).where("route is not null").join(asked.select("key").distinct(), "key", "left_semi").distinct()
    named = reads.groupBy("key").agg(F.array_sort(F.collect_set("file")).alias("names"))
    at = reads.where("file is not null").select("key", "file").distinct().withColumn("no", F.row_number().over(Window.partitionBy("key").orderBy("file")))
    by_route = reads.join(at, ["key", "file"], "left").groupBy("key", "route").agg(F.collect_list("no").alias("nos"))
    files = by_route.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("route", "nos"))).alias("of")).join(named, "key", "left").withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
    routes = asked.join(reach, "member").join(by_route.select("key", "route"), ["key", "route"], "left_semi").groupBy("member", "key").agg(F.collect_set("route").alias("routes"))
    met = routes.withColumn("deal", F.pmod(F.xxhash64("member"), F.lit(DEALS)).cast("int")).join(files, ["key", "deal"])
    nos = F.sort_array(F.array_distinct(F.flatten(F.transform("routes", lambda r: F.element_at("of", r)))))
    found = met.select("member", "key", F.transform(nos, lambda i: F.element_at("names", i)).alias("files"))
    return hazard(found, "parity", 2, None, F.col("member"), F.concat(F.col("key"), F.lit(" is read by "), F.array_join("files", ",")), F.array("key"))


def suppress(hazards: DataFrame, added: DataFrame, ignore: DataFrame) -> DataFrame:
    """Hazards without those whose removed tokens arrive elsewhere in the diff (``token``), or whose member is ignored (``member``).

    Hazards without tokens are never taken for moved.
    """
    rows = hazards.withColumn("token", F.explode_outer("tokens"))
    moved = rows.join(added.select("token").distinct(), "token", "left_semi").select("lane", "member", "evidence").distinct()
    return hazards.join(moved, ["lane", "member", "evidence"], "left_anti").join(ignore.select("member").distinct(), "member", "left_anti").select(*hazards.columns)


def ranked(hazards: DataFrame) -> DataFrame:
    """All hazards with ``rank``, worst first from 1: tier, then lane, member, evidence.

    The sort is by ranges; a written part's rows are numbered in it, and the parts' counts
    are summed, so no task sees all rows.
    """
    order = [F.desc("tier"), "lane", "member", "evidence", F.array_join("tokens", ",")]
    rows = hazards.orderBy(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    rows = write_table(rows, "hazards-ranked")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))  # a row a part
    within = F.col("__at").bitwiseAND((1 << 33) - 1) + 1
    return rows.join(F.broadcast(first), "__part").select(*hazards.columns, (F.col("__before") + within).alias("rank"))
