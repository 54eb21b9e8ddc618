"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ripplemark.llm import pii

    return pii.digests(pii.find(_table(spark, sf_dir, "documents"), carry=["doc_id"]))


def op2_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ripplemark.llm import toxicity

    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op3_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ripplemark.llm import suffix

    return suffix.digests(_table(spark, sf_dir, "documents"))


def op4_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ripplemark.llm import ppm

    return ppm.score(_table(spark, sf_dir, "documents"))


def op5_pivot_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ripplemark.llm import pivots

    return pivots.classes(_table(spark, sf_dir, "embeddings"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ripplemark.llm import packing

    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op7_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ripplemark.llm import bpe

    return bpe.round_trip(_table(spark, sf_dir, "documents"))


def op8_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ripplemark.llm import quality

    judged = quality.judge(_table(spark, sf_dir, "documents"), carry=["doc_id"])
    return judged.select("doc_id", *[F.col(f"__q_{k}").alias(k) for k in (*quality.METRICS, "base_failed", "kept")])


def op9_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ripplemark.llm import sharding

    return sharding.assign_shards(_table(spark, sf_dir, "documents"), 40)


def op10_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ripplemark.llm import minhash

    return minhash.classes(_table(spark, sf_dir, "documents"), width=4)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_disclosure_pii": op1_disclosure_pii,
    "op2_ftrl_toxicity": op2_ftrl_toxicity,
    "op3_suffix_repeats": op3_suffix_repeats,
    "op4_ppm_scores": op4_ppm_scores,
    "op5_pivot_vectors": op5_pivot_vectors,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_pair_index_bpe": op7_pair_index_bpe,
    "op8_host_quality": op8_host_quality,
    "op9_byte_shards": op9_byte_shards,
    "op10_tensored_minhash": op10_tensored_minhash,
}

#: Rows and metrics of the quality rules; ``{docs}`` is a relation with doc_id, text and source.
_QUALITY_SQL = r"""
d as (select row_number() over () rid, doc_id, source, coalesce(text, '') t from {docs}),
w as (select rid, doc_id, source, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls from d),
g as (select rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] g from (select rid, ws, unnest(range(1, len(ws) - 1)) i from w)),
r as (select rid, i from g qualify count(*) over (partition by rid, g) > 1),
c as (select rid, count(distinct p) n from (select rid, unnest([i, i + 1, i + 2]) p from r) group by rid),
m as (select w.rid, doc_id, source, cast(len(ws) as bigint) n_words, cast(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as bigint) word_chars,
             cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) n_symbols,
             cast(len(ls) - len(list_distinct(ls)) as bigint) n_dup_lines, cast(coalesce(n, 0) as bigint) n_repeat_words
      from w left join c using (rid)),
f as (select *, n_words < 50 short, 100 * n_repeat_words > 50 * n_words repeated, 10 * n_symbols > word_chars symbols, 2 * n_dup_lines > n_words lines from m),
u as (select source, rule, count(*) n, sum(cast(bad as bigint)) x
      from (select source, unnest(['short', 'repeated', 'symbols', 'lines']) rule, unnest([short, repeated, symbols, lines]) bad from f where source is not null) group by all),
a as (select rule, sum(n) nn, sum(x) xx, count(*) hh, sum(x) / sum(n) mean from u group by rule),
v as (select u.rule, any_value(a.mean) mean, sum(n * pow(x / n - a.mean, 2)) / any_value(a.nn) - any_value(a.mean * (1 - a.mean) * a.hh / a.nn) excess from u join a using (rule) group by u.rule),
p as (select rule, mean, case when excess > 1e-9 then least(greatest(mean * (1 - mean) / excess - 1, 1), 1e6) else 1e6 end weight from v),
b as (select distinct source from u join p using (rule) where (x + mean * weight) / (n + weight) > 0.5)
"""

#: CRC-32 of ``b`` (hex of the bytes), by its table of 256 entries, which a recursive rule builds.
_CRC_SQL = r"""
ct(i, k, c) as (select i, 0, i from (select unnest(range(256)) i) union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from ct where k < 8),
tab as (select list(c order by i) tb from ct where k = 8)
"""

ORACLE_SQL: dict[str, str] = {
    "op8_host_quality": "with " + _QUALITY_SQL.format(docs="documents") + """
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (short or repeated) base_failed,
       not (short or repeated) and (source is null or source not in (select source from b)) kept from f""",
    "op9_byte_shards": "with recursive " + _CRC_SQL + r""",
e as (select doc_id, cast(octet_length(encode(coalesce(text, ''))) + 16 as bigint) size, hex(encode(coalesce(text, ''))) h from documents),
z as (select doc_id, size, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(h) // 2), lambda j: cast('0x' || h[2 * j + 1:2 * j + 2] as bigint))),
             lambda c, x: xor(c >> 8, tb[cast(xor(c, x) & 255 as int) + 1])), 4294967295) text_crc32 from e, tab),
s as (select *, sum(size) over (order by doc_id nulls first, text_crc32, size rows unbounded preceding) upto, sum(size) over () total,
             row_number() over (order by doc_id nulls first, text_crc32, size) nth from z),
t as (select *, cast(least(39, ((2 * upto - size) * 40) // (2 * total)) as int) shard from s)
select doc_id, size, text_crc32, 'bytes' law, shard, nth - min(nth) over (partition by shard) slot, cast(null as int) grown_shard from t""",
}
