"""Language-model scores by prediction by partial matching.

The model is a byte-context trie of ORDER context bytes, trained on the whole training
share of the corpus.  A byte's probability comes from the longest context that is known:
``c / (T + D)`` for a symbol seen ``c`` times among ``T``, of ``D`` distinct; a new symbol
pays the escape ``D / (T + D)`` and goes to the next shorter context, in which the
symbols already ruled out are excluded; the last resort is uniform over those left.
A document's score is the sum over its bytes and one end mark.

With counts fixed, the price of a byte depends only on it and its ORDER bytes of context,
so each distinct gram is priced once.  Words and grams are counted together: tasks count
what they read, Spark sums the counts.  The most frequent words and grams (a fixed number)
are broadcast with their prices; occurrences of all others are shuffled as (row, key,
times), joined with counts or prices, and summed.  A frequent key is thus never shuffled
by document, and a rare one never held by all.  Grams are priced in groups by the last
two context bytes, which all contexts of one chain share; a group of more than SPLIT_GRAMS
is dealt by the third last byte as well, so it has 65,536 grams at most, and the counts of
its two-byte context are broadcast, as are those of shorter ones (65,536 entries at most).

Defined results: a null text is empty (one end token); texts of a null id count as
training and aren't held out; repeated rows count as often as they occur; without
training rows c, N and V are 0; very long texts are read whole, one at a time; of words or
grams that are equally frequent the lesser are broadcast, which changes no result beyond
rounding; columns other than doc_id and text aren't read, so their names can't clash;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.llm.ragged import text_chunks
from ripplemark.llm.toxicity import remainder
from ripplemark.plans.shared import write_table

ORDER = 4
HELD_OUT_OF, HELD_OUT_IS = 7, 2
#: Entries that are broadcast with their prices.
HOT_WORDS, HOT_GRAMS = 200_000, 500_000
#: Distinct words or grams that a task gathers before it hands them on.
GATHERED = 500_000
#: Distinct grams that are priced in one group.
SPLIT_GRAMS = 200_000
#: Bytes that UTF-8 never has, for the place before a text and its end.
START, END = 0xFE, 0xFF
WORD, GRAM, STOP = 0, 1, 2


def grams(data: bytes) -> np.ndarray:
    """The ORDER bytes before each byte of the text and its end mark, and that byte, as one number."""
    b = np.frombuffer(bytes([START] * ORDER) + data + bytes([END]), np.uint8).astype(np.int64)
    n = len(b) - ORDER
    out = b[:n].copy()
    for k in range(1, ORDER + 1):
        out = out << 8 | b[k : k + n]
    return out


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[cuts], np.add.reduceat(counts, cuts) if len(cuts) else counts


def training_counts(docs: DataFrame) -> DataFrame:
    """kind, key (of words), gram, c: what the training texts hold; STOP counts the texts."""

    def emit(words: Counter, found, texts: int):
        keys, counts = found
        n, m = len(words), len(keys)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat([WORD, GRAM, STOP], [n, m, 1]).astype(np.int32)), pa.array([*words, *[b""] * (m + 1)], pa.binary()),
                pa.array(np.concatenate((np.zeros(n, np.int64), keys, [0]))), pa.array(np.concatenate((np.fromiter(words.values(), np.int64, n), counts, [texts]))),
            ],
            ["kind", "key", "gram", "c"],
        )

    def run(batches):
        words, found, texts = Counter(), (np.zeros(0, np.int64),) * 2, 0
        for _, chunk in text_chunks(batches, "text"):
            raw = [t.encode().lower() for t in chunk]
            for data in raw:
                words.update(data.split())
            keys, counts = np.unique(np.concatenate([grams(data) for data in raw]), return_counts=True)
            found, texts = _merge([found, (keys, counts)]), texts + len(raw)
            if max(len(words), len(found[0])) > GATHERED:
                yield emit(words, found, texts)
                words, found, texts = Counter(), (np.zeros(0, np.int64),) * 2, 0
        if texts:
            yield emit(words, found, texts)

    training = docs.where(F.coalesce(remainder(F.col("doc_id"), HELD_OUT_OF), F.lit(-1)) != HELD_OUT_IS).select("text")
    found = training.mapInArrow(run, "kind int, key binary, gram long, c long")
    return write_table(found.groupBy("kind", "key", "gram").agg(F.sum("c").alias("c")), "lm-counts")


def price(trie: np.ndarray, counts: np.ndarray, wanted: np.ndarray, pairs: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
    """log10 of the probability of each wanted gram.

    ``trie`` has all training grams whose contexts end as the wanted ones do, ascending;
    ``pairs[b, s]`` counts symbol s after byte b over the whole corpus.  Where ``trie`` has
    only those with the third last byte of the wanted ones, ``second[s]`` counts symbol s
    after the last two bytes.
    """
    out = np.zeros(len(wanted))
    by_context = np.argsort(wanted, kind="stable")
    contexts = wanted[by_context] >> 8
    cuts = np.flatnonzero(np.append(True, contexts[1:] != contexts[:-1])) if len(wanted) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(wanted)).astype(np.int64)
    for at in range(0, len(cuts), 2048):
        queries = by_context[cuts[at] : ends[min(at + 2048, len(cuts)) - 1]]
        row_of, row = np.unique(wanted[queries] >> 8, return_inverse=True)
        symbol = wanted[queries] & 0xFF
        out_of, open_, sums = np.zeros((len(row_of), 256), bool), np.ones(len(queries), bool), np.zeros(len(queries))
        for order in range(ORDER, -1, -1):
            if order == 2 and second is not None:
                table = np.broadcast_to(second, (len(row_of), 256))
            elif order >= 2:
                mask = (1 << 8 * order) - 1
                own, back = np.unique(row_of & mask, return_inverse=True)
                place = np.searchsorted(own, trie >> 8 & mask)
                there = np.flatnonzero(own[np.minimum(place, len(own) - 1)] == (trie >> 8 & mask))
                table = np.bincount(place[there] * 256 + (trie[there] & 0xFF), counts[there], len(own) * 256).reshape(-1, 256)[back]
            else:
                table = pairs[row_of & 0xFF] if order else np.broadcast_to(pairs.sum(0), (len(row_of), 256))
            left = np.where(out_of, 0, table)
            total, distinct = left.sum(1), (left > 0).sum(1)
            c = left[row, symbol]
            live = open_ & (total[row] > 0)
            hit = live & (c > 0)
            sums[hit] += np.log10(c[hit] / (total + distinct)[row[hit]])
            miss = live & (c == 0)
            sums[miss] += np.log10(distinct[row[miss]] / (total + distinct)[row[miss]])
            open_ &= ~hit
            out_of |= table > 0
        sums[open_] -= np.log10(256 - out_of.sum(1)[row[open_]])
        out[queries] = sums
    return out


def hot_tables(counts: DataFrame) -> tuple[dict[bytes, float], np.ndarray, np.ndarray]:
    """Of the most frequent words log10(c + 1), and of the most frequent grams, ascending, the prices."""
    words = counts.where(F.col("kind") == WORD).orderBy(F.desc("c"), "key").limit(HOT_WORDS).select("key", "c").toArrow()
    own = counts.where(F.col("kind") == GRAM).select("gram", "c", F.shiftright("gram", 8).alias("context"))
    totals = own.groupBy("context").agg((F.sum("c") + F.count(F.lit(1))).alias("of"))
    top = own.orderBy(F.desc("c"), "gram").limit(HOT_GRAMS).join(totals, "context").select("gram", F.log10(F.col("c") / F.col("of")).alias("price")).toArrow()
    keys, prices = top.column("gram").to_numpy(), top.column("price").to_numpy()
    order = np.argsort(keys)
    return dict(zip(words.column("key").to_pylist(), np.log10(words.column("c").to_numpy() + 1.0).tolist(), strict=True)), keys[order], prices[order]


def read_texts(docs: DataFrame, hot: tuple[dict[bytes, float], np.ndarray, np.ndarray]) -> DataFrame:
    """A written row for each text: sums over hot words and grams, and how often each other one occurs."""
    sent = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches):
        known, keys, prices = sent.value
        for part, chunk in text_chunks(batches, "text"):
            rows, words_of, times_of, grams_of, often_of = [], [], [], [], []
            for t in chunk:
                data = t.encode().lower()
                words = data.split()
                logs = [known.get(w) for w in words]
                cold = Counter(w for w, x in zip(words, logs, strict=True) if x is None)
                there = [x for x in logs if x is not None]
                g = grams(data)
                at = np.minimum(np.searchsorted(keys, g), max(len(keys) - 1, 0))
                hit = keys[at] == g if len(keys) else np.zeros(len(g), bool)
                other, often = np.unique(g[~hit], return_counts=True)
                rows.append((len(words) + 1, len(there), math.fsum(there), float(prices[at[hit]].sum()) if len(keys) else 0.0))
                words_of.append(list(cold))
                times_of.append(list(cold.values()))
                grams_of.append(other)
                often_of.append(often)
            n, hits, base, score = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("row"), part.column("doc_id"), pa.array(n, pa.int64()), pa.array(hits, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()),
                    pa.array(words_of, pa.list_(pa.binary())), pa.array(times_of, pa.list_(pa.int64())), pa.array(grams_of, pa.list_(pa.int64())), pa.array(often_of, pa.list_(pa.int64())),
                ],
                ["row", "doc_id", "n_tokens", "hits", "hot_base", "hot_score", "words", "times", "grams", "often"],
            )

    schema = "row long, doc_id long, n_tokens long, hits long, hot_base double, hot_score double, words array<binary>, times array<long>, grams array<long>, often array<long>"
    return write_table(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, schema), "lm-texts")


def priced(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """gram, price for the distinct grams of ``wanted``, from the whole trie."""
    trie = counts.where(F.col("kind") == GRAM).select("gram", "c", F.shiftright("gram", 8).bitwiseAND(0xFFFF).alias("tail"))
    short = trie.groupBy(F.col("gram").bitwiseAND(0xFFFF).alias("pair")).agg(F.sum("c").alias("c")).collect()  # at most 65,536 rows
    pairs = np.zeros((256, 256))
    for r in short:
        pairs[r["pair"] >> 8, r["pair"] & 0xFF] = r["c"]
    large = [r["tail"] for r in trie.groupBy("tail").count().where(F.col("count") > SPLIT_GRAMS).collect()]  # at most 65,536
    second: dict[int, np.ndarray] = {}
    if large:
        known = trie.where(F.col("tail").isin(large)).groupBy("tail", F.col("gram").bitwiseAND(0xFF).alias("s")).agg(F.sum("c").alias("c"))
        for r in known.collect():  # at most 256 a large tail
            second.setdefault(r["tail"], np.zeros(256))[r["s"]] = r["c"]
    sent = counts.sparkSession.sparkContext.broadcast((pairs, second))

    def run(key, trie, wanted):
        keys, c = trie.column("gram").to_numpy(), trie.column("c").to_numpy()
        order = np.argsort(keys)
        asked = wanted.column("gram").to_numpy()
        pairs, second = sent.value
        prices = price(keys[order], c[order], asked, pairs, second.get(key[0].as_py()))
        return pa.table({"gram": pa.array(asked, pa.int64()), "price": pa.array(prices, pa.float64())})

    third = F.when(F.col("tail").isin(large), F.shiftright("gram", 24).bitwiseAND(0xFF)).otherwise(F.lit(-1)) if large else F.lit(-1)
    asked = wanted.select("gram").distinct().withColumn("tail", F.shiftright("gram", 8).bitwiseAND(0xFFFF)).withColumn("third", third.cast("long"))
    return trie.withColumn("third", third.cast("long")).groupBy("tail", "third").cogroup(asked.groupBy("tail", "third")).applyInArrow(run, "gram long, price double")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``."""
    counts = training_counts(docs)
    sums = {r["kind"]: r for r in counts.groupBy("kind").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    texts = sums[STOP]["n"] if STOP in sums else 0
    n = texts + (sums[WORD]["n"] if WORD in sums else 0)
    v = (texts > 0) + (sums[WORD]["v"] if WORD in sums else 0)
    rows = read_texts(docs, hot_tables(counts))
    words = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("key"), F.col("x.times").alias("times"))
    of_words = (
        words.join(counts.where(F.col("kind") == WORD).select("key", "c"), "key")  # words without a count add log10(1)
        .groupBy("row").agg(F.sum("times").alias("more_hits"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("more_base"))
    )
    found = rows.select("row", F.explode(F.arrays_zip("grams", "often")).alias("x")).select("row", F.col("x.grams").alias("gram"), F.col("x.often").alias("often"))
    of_grams = found.join(priced(counts, found), "gram").groupBy("row").agg(F.sum(F.col("often") * F.col("price")).alias("more_score"))
    zero = F.lit(0.0)
    return rows.drop("words", "times", "grams", "often").join(of_words, "row", "left").join(of_grams, "row", "left").select(
        "doc_id", (F.coalesce(remainder(F.col("doc_id"), HELD_OUT_OF), F.lit(-1)) == HELD_OUT_IS).alias("held_out"), "n_tokens",
        (F.col("hits") + F.coalesce("more_hits", F.lit(0)) + F.lit(int(texts > 0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("hot_base") + F.coalesce("more_base", zero) + F.lit(math.log10(texts + 1)) - F.col("n_tokens") * F.lit(math.log10(n + v + 1))).alias("base_score"),
        (F.col("hot_score") + F.coalesce("more_score", zero)).alias("score"),
    )
