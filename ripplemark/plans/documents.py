"""JSON documents of results: declared fields in a declared order, and nothing else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplemark.operators.graph import nearest_nodes, nodes

# The fields of each document.
FIELDS = {
    "impact": (
        "target", "callers", "dependencies", "entryPoints", "associationEntryPoints", "entryPointPaths", "entryPointLocations", "entryPointSecurity", "entryPointGates",
        "entryPointAuthGates", "entryPointTestReferences",
    ),
    "trace": ("from", "to", "resolvedFrom", "resolvedTo", "found", "path"),
    "detectChanges": (
        "base", "changed", "coverage", "entryPoints", "entryPointPaths", "entryPointLocations", "entryPointSecurity", "entryPointGates", "entryPointTestReferences", "impacted",
        "associationEntryPoints", "relatedModels", "traitAndOverrideReach", "traitAndOverrideReachVia", "risk", "riskCause", "hazards", "verification", "lowConfidence", "findings", "unresolved",
    ),
}
# What a field without a value is.
NUMBERS, FLAGS, TEXTS = ("impacted",), ("lowConfidence", "unresolved", "found"), ("base", "target", "from", "to", "risk", "riskCause")


def document(kind: str, rows: DataFrame) -> DataFrame:
    """json: a document for each row, with the fields of ``kind`` in order; other columns are left out, and missing lists are empty.

    ``trace`` has ``furthestReached`` besides where that isn't null.
    """
    there = {c.lower(): c for c in rows.columns}

    def field(name: str) -> Column:
        if name.lower() in there:
            return F.col(there[name.lower()]).alias(name)
        empty = F.lit(0) if name in NUMBERS else F.lit(False) if name in FLAGS else F.lit("") if name in TEXTS else F.array().cast("array<string>")
        return empty.alias(name)

    plain = [field(f) for f in FIELDS[kind]]
    whole = lambda columns: F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    if kind == "trace" and "furthestreached" in there:
        return rows.select(F.when(F.col("furthestReached").isNull(), whole(plain)).otherwise(whole([*plain, F.col("furthestReached")])).alias("json"))
    return rows.select(whole(plain).alias("json"))


def empty_detect_changes(spark: SparkSession, base: str) -> DataFrame:
    """The document of a diff that touches nothing that is analysed."""
    row = spark.createDataFrame([(base, "LOW", "nothing in this diff is analysed")], "base string, risk string, riskCause string")
    return document("detectChanges", row)


def test_states(states: DataFrame, weak: DataFrame) -> DataFrame:
    """node, state of each entry point that could be checked (node, referenced): ``referenced``, ``referenced-no-behavioural-assertion`` or ``unreferenced``."""
    rows = states.where("referenced is not null").join(weak.select("node", "weak"), "node", "left")
    state = F.when(~F.col("referenced"), "unreferenced").when(F.coalesce("weak", F.lit(False)), "referenced-no-behavioural-assertion").otherwise("referenced")
    return rows.select("node", state.alias("state"))


def miss_diagnostic(edges: DataFrame, needle: str) -> DataFrame:
    """text: for a symbol that no node has, the nearest nodes, or how many nodes were looked at."""
    near = nearest_nodes(edges, needle)
    ranked = near.agg(F.sort_array(F.collect_list(F.struct(-F.col("shared"), "distance", "node"))).alias("all"))  # at most the few nearest
    names = F.array_join(F.transform("all", lambda x: x["node"]), ", ")
    count = nodes(edges).agg(F.count(F.lit(1)).alias("n"))
    found = ranked.crossJoin(count)  # one row each
    none = F.concat(F.lit("Scanned "), F.col("n").cast("string"), F.lit(" graph nodes; none share an identifier with it."))
    return found.select(F.when(F.size("all") > 0, F.concat(F.lit("Nearest graph nodes: "), names)).otherwise(none).alias("text"))
