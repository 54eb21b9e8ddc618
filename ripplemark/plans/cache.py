"""Fingerprints of inputs, the scoped-rebuild decision, and replayed cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMAT_VERSION = 1

def fingerprint(inputs: DataFrame, settings: str = "") -> DataFrame:
    """fingerprint: one hash over all (path, hash), in any order, the settings and the format.

    Each row's SHA-256 is cut into eight numbers of 32 bits, which are summed over all rows: a sum takes
    rows in any order and is combined before its shuffle, so no list of paths is ever made.
    """
    row = F.sha2(F.concat_ws("\x00", F.length("path").cast("string"), "path", "hash"), 256)
    rows = inputs.select(row.alias("row"))
    part = lambda k: F.conv(F.substring("row", 8 * k + 1, 8), 16, 10).cast("decimal(38,0)")
    sums = rows.agg(F.count(F.lit(1)).cast("string").alias("n"), *[F.coalesce(F.sum(part(k)), F.lit(0)).cast("string").alias(f"s{k}") for k in range(8)])
    return sums.select(F.sha2(F.concat_ws("|", F.lit(str(FORMAT_VERSION)), F.lit(settings), "n", *[f"s{k}" for k in range(8)]), 256).alias("fingerprint"))


def scoped_rebuild(previous: DataFrame, current: DataFrame, provenance: DataFrame, *, merge_base: bool = True, same_settings: bool = True) -> DataFrame:
    """decision, changed: ``scoped`` if only known application files changed, else the first refusal that applies."""
    both = previous.withColumnRenamed("hash", "old").join(current.withColumnRenamed("hash", "new"), "path", "full_outer")
    known = provenance.select("path").distinct().withColumn("known", F.lit(True))
    changed = both.join(known, "path", "left").agg(
        F.sum((F.col("old").isNull() | F.col("new").isNull()).cast("long")).alias("set"), F.sum((F.col("old") != F.col("new")).cast("long")).alias("changed"),
        F.sum(((F.col("old") != F.col("new")) & ~F.col("path").startswith("app/")).cast("long")).alias("outside"), F.sum(((F.col("old") != F.col("new")) & F.col("known").isNull()).cast("long")).alias("unknown"),
    )
    n = lambda c: F.coalesce(c, F.lit(0))
    decision = (
        F.when(F.lit(not merge_base), "no-merge-base").when(F.lit(not same_settings), "inputs-changed").when(n("set") > 0, "file-set-changed").when(n("outside") > 0, "non-app-change")
        .when(n("changed") == 0, "no-change").when(n("unknown") > 0, "not-in-provenance").otherwise("scoped")
    )
    return changed.select(decision.alias("decision"), n("changed").alias("changed"))


def replay(cases: DataFrame, results: DataFrame) -> DataFrame:
    """key, failure: what each case (key, expect_signal, max_risk, max_tier, expect_finding) expected and its result (key, level, tier, points, unresolved, analyzed, seeds, findings) doesn't give."""
    rank = lambda c: F.when(c == "LOW", 0).when(c == "MEDIUM", 1).when(c == "HIGH", 2)
    r = cases.join(results, "key", "left")
    drifted = ~F.col("expect_signal") & ((F.col("analyzed") + F.col("unresolved")) > 0) & (F.col("analyzed") == 0) & (F.col("seeds") == 0)
    checks = [
        ("no result", F.col("level").isNull()), ("unresolved file", F.col("expect_signal") & (F.col("unresolved") > 0)), ("no entry point", F.col("expect_signal") & (F.col("points") == 0)), ("drifted", drifted),
        ("risk above the cap", rank(F.col("level")) > rank(F.col("max_risk"))), ("tier above the cap", F.col("tier") > F.col("max_tier")), ("finding missing", F.col("expect_finding").isNotNull() & ~F.array_contains("findings", F.col("expect_finding"))),
    ]
    failures = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks]))
    return r.select("key", F.explode(failures).alias("failure"))
