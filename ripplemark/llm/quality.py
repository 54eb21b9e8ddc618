"""Quality rules by host: per-document rules, shrunken host rates, verdicts joined back.

Everything is built-in functions, so the whole path stays in the JVM.

1. :func:`with_metrics` adds the rule inputs to every row.
2. The metrics are written once; rule failures are summed by host (Spark combines
   them before the shuffle, so a host with a third of all rows is one row a task).
3. For each rule a beta prior is fitted to the hosts' rates by moments, and each
   host's rate is shrunk towards it: ``(failures + a) / (rows + a + b)``.
4. A host is rejected if the shrunken rate of any rule exceeds ``host_threshold``;
   rejected hosts are joined back to the documents.

Defined results: a null or blank text has no words, so it fails ``n_words < 50``;
rows with a null host are judged by the row rules alone; repeated rows count as
often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplemark.plans.shared import write_table

SPACES = " \t\n\x0b\x0c\r"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
HOST_THRESHOLD = 0.5
#: A broadcast of rejected hosts holds at most so many; beyond that Spark chooses the join.
BROADCAST_HOSTS = 10_000
RULES = ("short", "repeated", "symbols", "lines")
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_metrics(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the columns of METRICS, each as ``prefix`` + name (long).

    The arrays are named columns of their own projections, so that the optimizer
    doesn't repeat the split in every lambda call.
    """
    t, words, grams, kept_cols = "__q_text", "__q_words", "__q_grams", docs.columns
    df = docs.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn(words, F.array_remove(F.split(t, SPACE_PATTERN), ""))
    df = df.withColumn(
        grams,
        F.when(
            F.size(words) >= 3,
            F.transform(
                F.slice(F.col(words), 1, F.size(words) - 2),
                lambda w, i: F.concat_ws(" ", w, F.col(words)[i + 1], F.col(words)[i + 2]),
            ),
        ).otherwise(F.array().cast("array<string>")),
    )
    # Only texts that repeat a window are sorted.
    df = df.withColumn(
        "__q_sorted",
        F.when(
            F.size(F.array_distinct(grams)) < F.size(grams),
            F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))),
        ).otherwise(F.array().cast("array<struct<g:string,i:int>>")),
    )
    s = F.col("__q_sorted")
    df = df.withColumn(
        "__q_starts",
        F.transform(
            F.filter(
                s,
                lambda x, j: F.coalesce(F.get(s, j - 1)["g"] == x["g"], F.lit(False))
                | F.coalesce(F.get(s, j + 1)["g"] == x["g"], F.lit(False)),
            ),
            lambda x: x["i"],
        ),
    )
    df = df.withColumn("__q_lines", F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0))
    covered = F.flatten(F.transform("__q_starts", lambda i: F.array(i, i + 1, i + 2)))
    metrics = {
        "n_words": F.size(words),
        "word_chars": F.length(F.translate(t, SPACES, "")),
        "n_symbols": F.length(t) - F.length(F.translate(t, SYMBOLS, "")),
        "n_dup_lines": F.size("__q_lines") - F.size(F.array_distinct("__q_lines")),
        "n_repeat_words": F.size(F.array_distinct(covered)),
    }
    return df.select(*[F.col(f"`{c}`") for c in kept_cols], *[e.cast("long").alias(prefix + k) for k, e in metrics.items()])


def rule_columns(prefix: str = "") -> dict[str, Column]:
    """The row rules that hosts are judged by."""
    c = lambda k: F.col(prefix + k)
    return {
        "short": c("n_words") < MIN_WORDS,
        "repeated": 100 * c("n_repeat_words") > 50 * c("n_words"),
        "symbols": 10 * c("n_symbols") > c("word_chars"),
        "lines": 2 * c("n_dup_lines") > c("n_words"),
    }


def base_failed(prefix: str = "") -> Column:
    rules = rule_columns(prefix)
    return rules["short"] | rules["repeated"]


def host_rates(metrics: DataFrame, host: str, prefix: str = "") -> DataFrame:
    """host, rows, and for each rule its failures and shrunken rate.

    The prior of a rule has the hosts' mean ``m`` and the variance that their rates
    have beyond sampling; ``a + b = m (1 - m) / variance - 1``, kept in [1, 1e6].
    """
    rules = rule_columns(prefix)
    hosts = metrics.where(F.col(host).isNotNull()).groupBy(host).agg(F.count(F.lit(1)).alias("rows"), *[F.sum(e.cast("long")).alias(f"{k}_failed") for k, e in rules.items()])
    totals = hosts.agg(F.sum("rows").alias("all_rows"), F.count(F.lit(1)).alias("all_hosts"), *[F.sum(f"{k}_failed").alias(f"{k}_all") for k in RULES])
    # One row of totals, then one row of priors: the joins below add a constant row to each host.
    squares = hosts.crossJoin(F.broadcast(totals)).agg(
        *[F.sum(F.col("rows") * F.pow(F.col(f"{k}_failed") / F.col("rows") - F.col(f"{k}_all") / F.col("all_rows"), F.lit(2.0))).alias(f"{k}_sq") for k in RULES]
    )
    priors = totals.crossJoin(F.broadcast(squares))
    for k in RULES:
        m = F.col(f"{k}_all") / F.col("all_rows")
        excess = F.col(f"{k}_sq") / F.col("all_rows") - m * (1 - m) * F.col("all_hosts") / F.col("all_rows")
        weight = F.when(excess > 1e-9, F.least(F.greatest(m * (1 - m) / excess - 1, F.lit(1.0)), F.lit(1e6))).otherwise(F.lit(1e6))
        priors = priors.withColumn(f"{k}_mean", m).withColumn(f"{k}_weight", weight)
    priors = priors.select(*[f"{k}_{x}" for k in RULES for x in ("mean", "weight")])
    rates = hosts.crossJoin(F.broadcast(priors))
    return rates.select(
        host, "rows", *[f"{k}_failed" for k in RULES],
        *[((F.col(f"{k}_failed") + F.col(f"{k}_mean") * F.col(f"{k}_weight")) / (F.col("rows") + F.col(f"{k}_weight"))).alias(f"{k}_rate") for k in RULES],
    )


def judge(docs: DataFrame, *, host: str = "source", text: str = "text", carry: list[str] | None = None, host_threshold: float = HOST_THRESHOLD, prefix: str = "__q_") -> DataFrame:
    """The columns ``carry`` of ``docs`` (all, if None), METRICS, ``base_failed`` and ``kept``, names prefixed."""
    carry = docs.columns if carry is None else carry
    source = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{host}`").alias("__q_host"), F.col(f"`{text}`").alias("__q_text_in"))
    measured = write_table(with_metrics(source, "__q_text_in", prefix).drop("__q_text_in"), "quality-metrics")
    rates = host_rates(measured, "__q_host", prefix)
    rejected = write_table(rates.where(reduce(Column.__or__, [F.col(f"{k}_rate") > host_threshold for k in RULES])).select("__q_host"), "quality-hosts")
    rejected = rejected.withColumn("__q_bad", F.lit(True))
    if rejected.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        rejected = F.broadcast(rejected)
    failed = base_failed(prefix)
    return measured.join(rejected, "__q_host", "left").select(
        *[F.col(f"`{c}`") for c in carry], *[F.col(prefix + k) for k in METRICS],
        failed.alias(prefix + "base_failed"), (~failed & F.col("__q_bad").isNull()).alias(prefix + "kept"),
    )


def filter_documents(docs: DataFrame, *, host: str = "source", text: str = "text") -> DataFrame:
    """``docs`` without the rows that fail a row rule or stand on a rejected host."""
    return judge(docs, host=host, text=text).where("__q_kept").select(*[F.col(f"`{c}`") for c in docs.columns])
