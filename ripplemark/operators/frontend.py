"""Frontend sources: which files count, what endpoints they name, and the routes behind those."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemark.functions.scan import all_matches, match_templates, script_slices

# Extensions of sources, patterns of specs, verbs, and callees whose first argument is an endpoint.
EXTENSIONS = ("ts", "tsx", "js", "jsx", "vue")
SPECS = ("*.test.ts", "*.test.tsx", "*.test.js", "*.test.jsx", "*.spec.ts", "*.spec.tsx", "*.spec.js", "*.spec.jsx", "*.cy.ts", "*.cy.js")
VERBS = ("get", "post", "put", "patch", "delete")
CALLEES = ("route", "fetch", "axios", "useFetch", "$http", "$", "window", "page", "cy")
GENERATED = ("actions", "routes", "wayfinder", "ziggy.js")
_NAME = r"[A-Za-z_$][\w$]*"
_LITERAL = rf"""({_NAME})(?:\.({_NAME}))?\s*\(\s*['"](/[^'"\s?#]*)[?#]?[^'"]*['"]"""
_TEMPLATE = rf"({_NAME})(?:\.({_NAME}))?\s*\(\s*`(/[^`]*)`"
_IMPORT = r"""import\s+(?:type\s+)?([\w\s{},*$]+?)\s*from\s*['"]([^'"]+)['"]"""
_ACTIONS = r"(?:^|/)actions/((?:[A-Za-z_]\w*/)+[A-Za-z_]\w*)(?:\.\w+)?$"
_ROUTES = r"(?:^|/)routes(?:/([A-Za-z0-9_/-]+))?(?:\.\w+)?$"
_DYNAMIC = r"""(?<![\w$])route\s*\(\s*([^\s'")][^,)]*)"""
REFERENCE = "array<struct<kind:string,key:string,verb:string>>"


def _glob(pattern: str) -> str:
    return "^" + "".join(".*" if c == "*" else "\\" + c if not c.isalnum() and c != "/" else c for c in pattern) + "$"


def is_spec(path: Column) -> Column:
    """Whether a file is a frontend test, by its base name."""
    name = F.substring_index(path, "/", -1)
    return reduce(Column.__or__, [name.rlike(_glob(p)) for p in SPECS])


def is_source(path: Column, roots: tuple[str, ...], generated: tuple[str, ...] = GENERATED) -> Column:
    """Whether a file is a frontend source to scan: below a root, of a known extension, no declaration of types, not generated (a folder, a file, or a pattern with ``*``)."""
    known = path.rlike(r"(?i)\.(" + "|".join(EXTENSIONS) + ")$") & ~path.rlike(r"(?i)\.d\.ts$")
    out = F.lit(False)
    for root in (r.strip("/") for r in roots):
        made = [path.startswith(f"{root}/{g.strip('/')}/") | path.rlike(_glob(f"{root}/{g.strip('/')}")) for g in generated]
        out = out | (path.startswith(root + "/") & ~reduce(Column.__or__, made, F.lit(False)))
    return known & out


def uri_references(source: Column, callees: tuple[str, ...] = ()) -> Column:
    """uri references of known callees; ``${...}`` is ``*``, and a callee or its method that is a verb pins it."""

    def of(pattern: str, clean) -> Column:
        part = lambda m, k: F.regexp_extract(m, pattern, k)
        verb = lambda m: F.lower(F.when(part(m, 2) != "", part(m, 2)).otherwise(part(m, 1)))
        found = F.filter(all_matches(source, pattern, 0), lambda m: part(m, 1).isin(*CALLEES, *callees))
        return F.transform(found, lambda m: F.struct(F.lit("uri").alias("kind"), clean(part(m, 3)).alias("key"), F.when(verb(m).isin(*VERBS), F.upper(verb(m))).alias("verb")))

    plain = of(_LITERAL, lambda u: u)
    filled = of(_TEMPLATE, lambda u: F.regexp_replace(F.regexp_replace(u, r"\$\{[^}]*\}", "*"), r"(?s)[?#].*", ""))
    return F.array_distinct(F.concat(plain, F.filter(filled, lambda r: ~r["key"].rlike(r"\s")))).cast(REFERENCE)


def _clause(clause: Column) -> Column:
    """The names that an import clause takes, as they are called in the module; null for a default or a whole module."""
    inside = F.split(F.regexp_extract(clause, r"\{([^}]*)\}", 1), ",")
    names = F.transform(inside, lambda m: F.trim(F.regexp_replace(F.regexp_replace(F.trim(m), r"^type\s+", ""), r"\s+as\s+.*$", "")))
    outside = F.regexp_replace(F.regexp_replace(clause, r"\{[^}]*\}", ""), r"[\s,]+", "")
    none = F.array(F.lit(None).cast("string"))
    return F.concat(F.filter(names, lambda n: n != ""), F.when(outside != "", none).otherwise(F.array().cast("array<string>")))


def import_references(source: Column) -> Column:
    """Actions of controllers (``class::method``, or a class for a whole module) and names of routes that a source imports."""
    matches = all_matches(source, _IMPORT, 0)
    part = lambda m, k: F.regexp_extract(m, _IMPORT, k)
    row = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"), F.lit(None).cast("string").alias("verb"))
    cls = lambda m: F.replace(F.regexp_extract(part(m, 2), _ACTIONS, 1), F.lit("/"), F.lit("."))
    actions = F.transform(F.filter(matches, lambda m: part(m, 2).rlike(_ACTIONS)), lambda m: F.transform(_clause(part(m, 1)), lambda n: row("action", F.concat_ws("::", cls(m), n))))
    prefix = lambda m: F.replace(F.regexp_extract(part(m, 2), _ROUTES, 1), F.lit("/"), F.lit("."))
    routes = F.transform(
        F.filter(matches, lambda m: part(m, 2).rlike(_ROUTES) & ~part(m, 2).rlike(_ACTIONS)),
        lambda m: F.transform(F.filter(_clause(part(m, 1)), lambda n: n.isNotNull()), lambda n: row("route", F.concat_ws(".", F.when(prefix(m) != "", prefix(m)), n))),
    )
    return F.array_distinct(F.concat(F.flatten(actions), F.flatten(routes))).cast(REFERENCE)


def _constant(source: Column, name: Column) -> Column:
    """The string that a constant, or a member of one object, of the same module has; null unless it is written once."""
    quoted = lambda n: F.concat(F.lit(r"\Q"), n, F.lit(r"\E"))
    only = lambda found: F.when(F.size(found) == 1, F.get(found, F.lit(0)))
    string = r"""\s*(?::[^=\n]+)?=\s*['"]([^'"]+)['"]"""
    plain = only(F.regexp_extract_all(source, F.concat(F.lit(r"\bconst\s+"), quoted(name), F.lit(string)), F.lit(1)))
    body = only(F.regexp_extract_all(source, F.concat(F.lit(r"\b(?:const|enum)\s+"), quoted(F.substring_index(name, ".", 1)), F.lit(r"\s*(?::[^={]+)?=?\s*\{([^{}]*)\}")), F.lit(1)))
    member = only(F.regexp_extract_all(body, F.concat(F.lit(r"\b"), quoted(F.substring_index(name, ".", -1)), F.lit(r"""\s*[:=]\s*['"]([^'"]+)['"]""")), F.lit(1)))
    return F.when(name.rlike(rf"^{_NAME}$"), plain).when(name.rlike(rf"^{_NAME}\.{_NAME}$"), member)


def dynamic_names(source: Column) -> Column:
    """What each argument of ``route(...)`` that isn't a literal stands for in its module; null if that can't be told."""
    return F.transform(all_matches(source, _DYNAMIC), lambda a: _constant(source, F.trim(a)))


def references(source: Column, callees: tuple[str, ...] = ()) -> Column:
    """Every reference of a source: kind (action, route, uri), key, verb."""
    row = lambda n: F.struct(F.lit("route").alias("kind"), n.alias("key"), F.lit(None).cast("string").alias("verb"))
    named = F.concat(all_matches(source, r"""(?<![\w$])route\s*\(\s*['"]([^'"]+)['"]"""), F.filter(dynamic_names(source), lambda n: n.isNotNull()))
    return F.array_distinct(F.concat(import_references(source), F.transform(named, row).cast(REFERENCE), uri_references(source, callees)))


def routes_of(rows: DataFrame, routes: DataFrame) -> DataFrame:
    """file, node: the routes (node, name, action, verb, uri) behind references (file, kind, key, verb)."""
    of = lambda kind: rows.where(F.col("kind") == kind)
    by_name = of("route").join(routes.select("node", F.col("name").alias("key")), "key").select("file", "node")
    actions = routes.select("node", F.explode(F.array("action", F.substring_index("action", "::", 1))).alias("key"))
    by_action = of("action").join(actions, "key").select("file", "node")
    uris = of("uri").select("file", F.col("key").alias("uri"), F.col("verb").alias("pinned"))
    met = match_templates(uris, routes.select(F.col("uri").alias("template")))
    by_uri = uris.join(met, "uri").join(routes.select("node", F.col("uri").alias("template"), "verb"), "template").where(F.col("pinned").isNull() | (F.col("pinned") == F.col("verb"))).select("file", "node")
    return by_name.unionByName(by_action).unionByName(by_uri).distinct()


def _rows(files: DataFrame, found: Column) -> DataFrame:
    return files.select("file", F.explode(found).alias("r")).select("file", "r.kind", "r.key", "r.verb").distinct()


def frontend_seeds(files: DataFrame, routes: DataFrame, callees: tuple[str, ...] = ()) -> DataFrame:
    """file, node: the routes that either side of a changed source (file, head, base) names; a null side names none."""
    sides = files.select("file", F.explode(F.array("head", "base")).alias("source")).where("source is not null")
    return routes_of(_rows(sides, references(F.col("source"), callees)), routes)


def unresolved_references(files: DataFrame) -> DataFrame:
    """file: changed sources (file, head, base) with an argument of ``route(...)`` that can't be told."""
    sides = files.select("file", F.explode(F.array("head", "base")).alias("source")).where("source is not null")
    return sides.where(F.exists(dynamic_names(F.col("source")), lambda n: n.isNull())).select("file").distinct()


def inline_seeds(views: DataFrame, routes: DataFrame) -> DataFrame:
    """file, node: the routes whose URIs the scripts of either side of a template (file, head, base) name."""
    sides = views.select("file", F.explode(F.array("head", "base")).alias("source")).where("source is not null")
    return routes_of(_rows(sides, uri_references(script_slices(F.col("source")))), routes)


def spec_references(specs: DataFrame, routes: DataFrame) -> DataFrame:
    """node, file: the frontend tests (file, source) that name each route."""
    return routes_of(_rows(specs.where(is_spec(F.col("file"))), references(F.col("source"))), routes).select("node", "file")
