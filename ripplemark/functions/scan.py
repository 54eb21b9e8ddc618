"""References in source text, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_matches(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def script_slices(html: Column) -> Column:
    """The bodies of all script elements, one after the other."""
    return F.array_join(all_matches(html, r"(?is)<script\b[^>]*>(.*?)</script>"), "\n")


def without_query(uri: Column) -> Column:
    return F.regexp_replace(uri, r"[?#].*$", "")


def uri_literals(text: Column) -> Column:
    """The distinct URI literals in attributes and calls; a template's ``${...}`` becomes ``*``."""
    found = all_matches(text, r"""["'`](/[^"'`\s]*)["'`]""")
    return F.array_distinct(F.transform(found, lambda u: without_query(F.regexp_replace(u, r"\$\{[^}]*\}", "*"))))


def view_references(text: Column) -> Column:
    """Views that a template includes, extends or uses as components, by dotted name."""
    direct = all_matches(text, r"""@(?:include(?:If|When|Unless|First)?|extends|component|each)\s*\(\s*['"]([^'"]+)['"]""")
    tags = F.transform(all_matches(text, r"<x-([a-z0-9.\-]+)"), lambda t: F.concat(F.lit("components."), t))
    return F.array_distinct(F.concat(F.transform(direct, lambda v: F.replace(v, F.lit("/"), F.lit("."))), tags))


def view_node(path: Column) -> Column:
    """The node of a template file: lower case, dots for slashes, other characters as underscores."""
    name = F.regexp_replace(F.regexp_replace(path, r"^resources/views/", ""), r"\.blade\.php$", "")
    return F.concat(F.lit("view::blade__"), F.regexp_replace(F.replace(F.lower(name), F.lit("/"), F.lit(".")), r"[^a-z0-9._]", "_"))


def studly(name: Column) -> Column:
    """``a.b-c`` as ``A.BC``: each part of a dotted name with its words joined by capitals."""
    word = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))
    return F.array_join(F.transform(F.split(name, r"\."), lambda p: F.array_join(F.transform(F.split(p, "[-_]"), word), "")), ".")


def inertia_pages(text: Column) -> Column:
    return F.array_distinct(all_matches(text, r"""(?:inertia\(|Inertia::render\(|Route::inertia\([^,]*,)\s*['"]([^'"]+)['"]"""))


def test_references(tests: DataFrame, root: str = "App.") -> DataFrame:
    """kind (uri, route, artisan, class), key, file of what each test file (file, source) names."""
    s = F.col("source")
    escaped = root.replace(".", r"\.")
    uses = all_matches(s, rf"\buse\s+({escaped}[A-Za-z0-9_.]+)\s*;")
    grouped = F.flatten(F.transform(all_matches(s, rf"\buse\s+({escaped}[A-Za-z0-9_.]*\{{[^}}]*\}})"), lambda g: F.transform(F.split(F.regexp_extract(g, r"\{([^}]*)\}", 1), r"\s*,\s*"), lambda n: F.concat(F.regexp_extract(g, r"^([^{]*)\{", 1), F.trim(n)))))
    qualified = all_matches(s, rf"\b({escaped}[A-Za-z0-9_.]+)::class")
    livewire = F.transform(all_matches(s, r"Livewire::test\(\s*'([a-z][a-z0-9.\-]*)'"), lambda n: F.concat(F.lit(root + "Livewire."), studly(n)))
    found = {
        "uri": F.transform(all_matches(s, r"""->(?:get|post|put|patch|delete|getJson|postJson|putJson|patchJson|deleteJson)\(\s*['"](/[^'"]*)['"]"""), without_query),
        "route": all_matches(s, r"""\broute\(\s*['"]([^'"]+)['"]"""),
        "artisan": F.transform(all_matches(s, r"""artisan\(\s*['"]([^'"]+)['"]"""), lambda c: F.substring_index(c, " ", 1)),
        "class": F.concat(uses, grouped, qualified, livewire),
    }
    tagged = lambda kind, keys: F.transform(keys, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("key")))
    rows = F.flatten(F.array(*[tagged(k, v) for k, v in found.items()]))
    return tests.select("file", F.explode(F.array_distinct(rows)).alias("r")).select("r.kind", "r.key", "file")


# Assertions that say no more than that a request went through.
SHALLOW_ASSERTIONS = ("assertOk", "assertSuccessful")


def weak_assertions(source: Column) -> Column:
    """Whether a test file asserts nothing beyond success.

    Calls count after ``->`` or ``::`` alone.  A bare ``expect(`` is strong; so is any call of
    assert... or expect... that isn't a shallow one or a literal smoke form (true or false, status
    200).  No assertion at all is weak.
    """
    names = all_matches(source, r"(?:->|::)\s*((?:assert|expect)[A-Z_]\w*)\s*\(")
    of = lambda *known: F.size(F.filter(names, lambda n: n.isin(*known)))
    deep = F.exists(names, lambda n: ~n.isin("assertTrue", "assertFalse", "assertStatus", *SHALLOW_ASSERTIONS))
    bools = F.regexp_count(source, F.lit(r"(?:->|::)\s*(?:assertTrue|assertFalse)\s*\(\s*(?:true|false)\s*\)"))
    fine = F.regexp_count(source, F.lit(r"(?:->|::)\s*assertStatus\s*\(\s*200\s*\)"))
    smoke = (bools == of("assertTrue", "assertFalse")) & (fine == of("assertStatus"))
    bare = source.rlike(r"(?<![\w$])(?<!->)expect\s*\(")
    return F.when(bare | deep, False).otherwise(smoke)


def segments(uri: Column) -> Column:
    return F.size(F.split(F.trim(uri, F.lit("/")), "/"))


def template_pattern(template: Column) -> Column:
    """A route template as a pattern: a parameter stands for one segment, or for a literal's wildcard."""
    plain = F.regexp_replace(template, r"([.+?^$()|\[\]])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(plain, r"\{[^}]*\}", "[^/]+"), F.lit("$"))


def match_templates(literals: DataFrame, templates: DataFrame) -> DataFrame:
    """uri, template of the literals (uri) that a route template (template) covers; ``*`` in a literal is one whole segment.

    Both sides are keyed by their number of segments and by one segment that neither leaves
    open: the first, else the second, and so on, one join a position.  Only pairs without any
    position that is closed on both sides are joined by the number of segments alone.
    """
    part = lambda c: F.split(F.trim(c, F.lit("/")), "/")
    closed = lambda c: F.transform(part(c), lambda x: F.when(~x.rlike(r"[{*]"), x))
    shape = lambda c: F.array_join(F.transform(closed(c), lambda x: F.when(x.isNull(), "?").otherwise("=")), "")
    a = literals.select("uri").distinct().select("uri", F.size(part(F.col("uri"))).alias("n"), closed(F.col("uri")).alias("x"), shape(F.col("uri")).alias("sx"))
    b = templates.select("template").distinct().select("template", F.size(part(F.col("template"))).alias("n"), closed(F.col("template")).alias("y"), shape(F.col("template")).alias("sy"))
    # Few shapes there are: for each pair of them the first position that is closed on both sides.
    shapes = a.select("n", "sx").distinct().join(b.select("n", "sy").distinct(), "n")
    both = F.zip_with(F.split("sx", ""), F.split("sy", ""), lambda p, q: (p == "=") & (q == "="))
    shapes = shapes.select("n", "sx", "sy", F.coalesce(F.array_position(both, True), F.lit(0)).alias("at"))
    at = lambda c: F.when(F.col("at") > 0, F.get(c, F.col("at").cast("int") - 1)).otherwise(F.lit(""))
    left = a.join(shapes.select("n", "sx", "at").distinct(), ["n", "sx"]).withColumn("key", at("x"))
    right = b.join(shapes.select("n", "sy", "at").distinct(), ["n", "sy"]).withColumn("key", at("y"))
    met = left.join(right, ["n", "at", "key"]).join(shapes, ["n", "sx", "sy", "at"], "left_semi")
    wild = lambda c, pattern, by: F.regexp_replace(c, pattern, by)
    ok = F.rlike(wild("uri", r"\*", "x"), template_pattern(F.col("template"))) | F.rlike(wild("template", r"\{[^}]*\}", "x"), F.concat(F.lit("^"), wild("uri", r"\*", "[^/]+"), F.lit("$")))
    return met.where(ok).select("uri", "template")
