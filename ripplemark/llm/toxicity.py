"""Toxicity by FTRL-proximal logistic regression over hashed n-grams.

Features of a text are the hashed presence of its words and their stems, adjacent pairs,
and pairs with one word between (skip-grams), in a table of 2**BITS weights.  Training visits
a bounded sample of labelled rows in hash order, with one learning rate a coordinate
and an L1 term that leaves most weights exactly 0; the rest are broadcast, at most
2**BITS numbers.

At most TRAIN_ROWS labelled documents are used: those whose hashed id is smallest.  Of the
rows that share such an id one counts, the one whose text has the least hash, so the bound
is one of rows.  Their features are made in parallel; one task then fits the model.
Scoring reads each whole text once and shuffles nothing.

The settings were chosen by :func:`validate`, which fits on folds of the same sample:
rows that are held out (remainder 0) are never read for it.

Defined results: a null or blank text has the bias alone; without labelled rows every
score is 0.5; ids and labels are never features; very long texts are read whole, and their memory
is that of their words; ties of the order are broken by label, then by the features' hash; columns of
``docs`` other than doc_id and text aren't read, so their names can't clash; rows of a null id
are scored and not held out; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 20
STEMS = (4, 5)
TRAIN_ROWS = 10_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.0
HELD_OUT_OF = 5
FOLDS = 4
_SHIFT = np.uint64(64 - BITS)


@lru_cache(maxsize=1 << 20)
def _word(w: str) -> tuple[int, ...]:
    """The hash of a word, and of its stems: languages that compound hide a word's root in many forms."""
    return (xxhash.xxh3_64_intdigest(w), *[xxhash.xxh3_64_intdigest("^" + w[:n]) for n in STEMS if len(w) > n])


def features(text: str | None) -> np.ndarray:
    """The distinct table places of a text's n-grams; 0 is the bias and always there."""
    words = [_word(w) for w in (text or "").lower().split()]
    if not words:
        return np.zeros(1, np.int64)
    h = np.array([w[0] for w in words], np.uint64)
    stems = np.array([x for w in set(words) for x in w[1:]], np.uint64)
    odd = np.uint64(0x9E3779B97F4A7C15)
    near = (h[:-1] * odd + h[1:]) * np.uint64(0xBF58476D1CE4E5B9)
    far = (h[:-2] * odd + h[2:]) * np.uint64(0x94D049BB133111EB)
    places = (np.concatenate((h * odd, stems, near, far)) >> _SHIFT).astype(np.int64)
    return np.unique(np.append(places, 0))


class Ftrl:
    """One weight and one squared-gradient sum a place."""

    def __init__(self, size: int = 1 << BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == 0, 0.0, self.l1)  # the bias isn't held back
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def remainder(doc_id: Column, of: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % of


def sampled(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """doc_id, o (the order), y, f (packed places) of at most ``rows`` labelled documents whose remainder isn't 0."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (remainder(F.col("doc_id"), HELD_OUT_OF) != 0))
    # A repeated id keeps its largest label; the sample is the same for any partitioning.
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    sample = known.withColumn("o", F.xxhash64("doc_id")).orderBy("o", "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most ``rows`` ids

    def describe(batches):
        for b in batches:
            found = [features(t.as_py()).astype(np.int32).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc_id", "o", "y")], pa.array(found, pa.binary())], ["doc_id", "o", "y", "f"])

    # One row of an id: combined before the shuffle, so an id on very many rows is one row a task.
    one = texts.groupBy("doc_id", "o", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    return one.select("doc_id", "o", "y", F.col("t.text").alias("text")).mapInArrow(describe, "doc_id long, o long, y int, f binary")


def _rows(batches) -> list[tuple[np.ndarray, int]]:
    return [(np.frombuffer(f, np.int32), y) for b in batches for y, f in zip(b.column("y").to_pylist(), b.column("f").to_pylist(), strict=True)]


def fitted(seen: list[tuple[np.ndarray, int]], epochs: int, **settings) -> Ftrl:
    model = Ftrl(**settings)
    for _ in range(epochs):
        for at, y in seen:
            model.learn(at, y)
    return model


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", rows: int = TRAIN_ROWS, epochs: int = EPOCHS, **settings) -> DataFrame:
    """place, weight: the weights that aren't 0, from rows whose remainder isn't 0; ``settings`` are those of :class:`Ftrl`."""

    def fit(batches):
        model = fitted(_rows(batches), epochs, **settings)
        w = model.weights(np.arange(len(model.z)))
        there = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(w[there], pa.float64())], ["place", "weight"])

    described = sampled(docs, labels, label, rows).drop("doc_id")
    return described.repartition(1).sortWithinPartitions("o", "y", F.xxhash64("f")).mapInArrow(fit, "place int, weight double")


def validate(docs: DataFrame, labels: DataFrame, settings: list[dict], *, label: str = "toxic", rows: int = TRAIN_ROWS, epochs: int = EPOCHS, folds: int = FOLDS) -> DataFrame:
    """setting, fold, n, right, loss: each of ``settings`` fitted without a fold and judged on it.

    The folds are a hash of the id, among rows whose remainder isn't 0.  Every setting and
    fold is a task of its own; each reads the bounded sample.
    """
    sample = sampled(docs, labels, label, rows).withColumn("part", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(folds)).cast("int"))
    tries = docs.sparkSession.createDataFrame([(s, f) for s in range(len(settings)) for f in range(folds)], "setting int, fold int")
    dealt = sample.join(F.broadcast(tries))  # a fixed, small number of tries

    def run(key, table):
        setting, fold = key[0].as_py(), key[1].as_py()
        table = table.sort_by([("o", "ascending"), ("doc_id", "ascending")])
        seen, part = _rows([table]), table.column("part").to_numpy()
        model = fitted([x for x, p in zip(seen, part, strict=True) if p != fold], epochs, **settings[setting])
        own = [(model.weights(at).sum(), y) for (at, y), p in zip(seen, part, strict=True) if p == fold]
        z, y = np.clip([x[0] for x in own], -35, 35), np.array([x[1] for x in own], float)
        loss, right = float(np.sum(np.log1p(np.exp(-z)) + (1 - y) * z)), int(np.sum((z >= 0) == (y == 1)))
        return pa.table({"setting": pa.array([setting], pa.int32()), "fold": pa.array([fold], pa.int32()), "n": pa.array([len(own)], pa.int64()), "right": pa.array([right], pa.int64()), "loss": pa.array([loss], pa.float64())})

    return dealt.groupBy("setting", "fold").applyInArrow(run, "setting int, fold int, n long, right long, loss double")


def score(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    table = np.zeros(1 << BITS, np.float32)
    for r in weights.collect():  # at most 2**BITS rows
        table[r["place"]] = r["weight"]
    sent = docs.sparkSession.sparkContext.broadcast((np.flatnonzero(table).astype(np.int32), table[np.flatnonzero(table)]))

    def run(batches):
        dense = np.zeros(1 << BITS)
        dense[sent.value[0]] = sent.value[1]
        for b in batches:
            sums = np.array([dense[features(t.as_py())].sum() for t in b.column("text")], float)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(sums, -35, 35))), pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (F.coalesce(remainder(F.col("doc_id"), HELD_OUT_OF), F.lit(-1)) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
