"""Exact removal of repeated byte strings by a range-partitioned sparse suffix array.

A byte goes if a string of LENGTH bytes around it also starts in a document with a
smaller id.  Sorting the suffix at every byte would shuffle the corpus LENGTH times
over, so suffixes are taken at anchors.  In each string of LENGTH bytes the leftmost of
its K-grams with the least hash is its anchor: equal strings have equal anchors at
equal offsets, so nothing is lost, and about one byte in sixteen is an anchor.

0. A document whose whole text a smaller id has goes whole, and takes no further part.
1. Anchor hashes are dealt over buckets, packed; those in one document only are dropped.
2. Documents with shared anchors are read again.  Each shared anchor gives one entry:
   its suffix, as far as strings of that anchor reach, and the bytes before it.
3. Sampled splitters range-partition the entries by the leading bytes of the suffix.
   A splitter compares whole K-grams, so equal suffixes never stand on both sides of a
   boundary.  A K-gram that fills several ranges of the sample is hot, and its entries
   are dealt twice: by the EXTRA bytes after it, and by the EXTRA + 1 bytes before it.  Of a
   string of LENGTH bytes that holds the gram, all bytes of one of the two lie within
   it, so entries that share the string still meet, in one of the two places.
4. Each range sorts its suffixes by multikey quicksort, eight bytes a character, and the
   reversed left sides too.  Neighbours' common prefixes tell for every string around an
   anchor which entries share it; the least id of them keeps it.
5. The removed intervals of each document are merged and cut from its bytes.

Equal things meet before they are shuffled: an anchor that several documents of a batch
share is known to be shared, and of equal entries in a batch only the least id's goes on,
for the rest lose all of it.  So a passage or a copy in a third of all documents reaches
one task once a batch, not once a document.

Defined results: a null text is empty; ids that are null are compared with nothing and
lose nothing; rows that share an id are never compared with each other, and each loses
what a smaller id has; a very long text is one row, read whole, and memory is bounded by the
longest; names that begin with ``__sx_`` are reserved, and a table with such a column is
refused; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.llm.memory import lean
from ripplemark.llm.ragged import gather, text_chunks
from ripplemark.plans.shared import write_table

LENGTH = 50
K = 20
#: Bytes beside a hot K-gram by which its entries are dealt: half of what a string has beside it.
EXTRA = (LENGTH - K) // 2
#: Anchor hashes, and bytes of text behind the entries, that one task sorts, about.
ANCHORS_PER_BUCKET = 1_500_000
BYTES_PER_RANGE = 24 << 20
#: Bytes of text in a part of the exchange of the texts, about.
BYTES_PER_PART = 128 << 20
#: Splitters come from the documents whose hashed id falls in a share with about so many.
SAMPLE_ROWS = 2_000
#: Bytes of text whose anchors and entries a task makes at once.
CHUNK_BYTES = 8 << 20
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_BASE = 0x9E3779B97F4A7C15
#: Keeps the key of the exchange from being null, so that no join filters first.
NO_ID = -(1 << 63)
#: An entry: whose it is, where its first string starts, how far in its anchor lies, how many bytes it has.
HEAD = np.dtype([("id", "<i8"), ("twin", "<i8"), ("low", "<i4"), ("offset", "u1"), ("size", "u1")])


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the K bytes from each position on (shorter by K - 1)."""
    base, h, width = _BASE, data.astype(np.uint64) + np.uint64(1), 1
    done, out = 0, None
    while width <= K:
        if K & width:
            if out is None:
                out, done = h, width
            else:
                out = out[: len(h) - done] * np.uint64(pow(base, width, 1 << 64)) + h[done:][: len(out[: len(h) - done])]
                done += width
        if width * 2 <= K:
            h = h[:-width] * np.uint64(pow(base, width, 1 << 64)) + h[width:]
        width *= 2
    out = out[: len(data) - K + 1]
    out = (out ^ out >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ out >> np.uint64(32)


def _sliding(x: np.ndarray, width: int, best=np.minimum) -> np.ndarray:
    """The least (or most) of the ``width`` values from each position on."""
    done = 1
    while done * 2 <= width:
        x = best(x[:-done], x[done:])
        done *= 2
    return best(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the bytes of one text: anchor positions, their hashes, and the anchor (as an index) of the string at each position."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = _grams(data)
    width = LENGTH - K + 1
    low = _sliding(h, width)
    # A position is an anchor if the least value of some string around it is its own.
    padded = np.concatenate((np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)))
    chosen = np.flatnonzero(_sliding(padded, width, np.maximum) == h)
    # Equal values in one string: the leftmost is the anchor of it.
    start = np.arange(len(low))
    first = np.searchsorted(chosen, start)
    while True:
        wrong = h[chosen[first]] != low
        if not wrong.any():
            break
        first[wrong] += 1
    used, index = np.unique(first, return_inverse=True)
    at = chosen[used]
    return at, h[at], index


def _batches(batches, key: str, column: str):
    for b, texts in text_chunks(batches, column, CHUNK_BYTES):
        yield list(zip(b.column(key).to_pylist(), [np.frombuffer(t.encode(), np.uint8) for t in texts], strict=True))


def shared_anchors(docs: DataFrame, text: str, buckets: int) -> DataFrame:
    """doc_id, hashes (packed): the anchors of each document that another document has too; ``__sx_taking`` is the id, null for rows that take no part."""

    @lean
    def deal(batches):
        for rows in _batches(batches, "__sx_taking", text):
            hashes, ids = [], []
            for i, data in rows:
                if i is not None and len(data) >= LENGTH:
                    own = np.unique(anchors(data)[1])
                    hashes.append(own)
                    ids.append(np.full(len(own), i, np.int64))
            if hashes:
                h, i = np.concatenate(hashes), np.concatenate(ids)
                order = np.lexsort((i, h))
                h, i = h[order], i[order]
                first = np.append(True, h[1:] != h[:-1])
                last = np.append(first[1:], True)
                start = np.flatnonzero(first)
                several = np.repeat(i[start] < i[last], np.diff(np.append(start, len(h))))
                # What two documents of the batch share is known: all of these go on at once
                # (to a negative bucket), and only the least and the largest id to the bucket.
                known, sent = np.flatnonzero(several), np.flatnonzero(~several | first | last)
                place = (h >> np.uint64(20)).astype(np.int64) % buckets
                place = np.concatenate((np.full(len(known), -1 - int(i[0]) % buckets), place[sent]))
                h, i = np.concatenate((h[known], h[sent])), np.concatenate((i[known], i[sent]))
                order = np.lexsort((i, place))  # runs of one id take little room
                h, i, place = h[order], i[order], place[order]
                cuts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
                ends = np.append(cuts[1:], len(h))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(place[cuts].astype(np.int32)), pa.array([h[a:z].tobytes() for a, z in zip(cuts, ends, strict=True)], pa.binary()), pa.array([i[a:z].tobytes() for a, z in zip(cuts, ends, strict=True)], pa.binary())],
                    ["bucket", "__sx_hashes", "ids"],
                )

    @lean
    def meet(table):
        h = np.frombuffer(b"".join(table.column("__sx_hashes").to_pylist()), np.uint64)
        ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), np.int64)
        if table.column("bucket")[0].as_py() >= 0:
            order = np.argsort(h)
            h, ids = h[order], ids[order]
            start = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
            several = np.minimum.reduceat(ids, start) < np.maximum.reduceat(ids, start) if len(h) else start
            keep = np.repeat(several, np.diff(np.append(start, len(h))))
            h, ids = h[keep], ids[keep]
        order = np.argsort(ids, kind="stable")
        h, ids = h[order], ids[order]
        cuts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
        ends = np.append(cuts[1:], len(ids)).astype(np.int64)[: len(cuts)]
        return pa.table({"doc_id": pa.array(ids[cuts], pa.int64()), "__sx_hashes": pa.array([h[a:z].tobytes() for a, z in zip(cuts, ends, strict=True)], pa.binary())})

    dealt = docs.mapInArrow(deal, "bucket int, __sx_hashes binary, ids binary")
    return dealt.groupBy("bucket").applyInArrow(meet, "doc_id long, __sx_hashes binary")


def splitters(docs: DataFrame, rows: int, ranges: int) -> tuple[list[bytes], list[bytes]]:
    """Ascending K-grams that cut the anchors of a sample of documents into equal ranges, and the hot ones, which fill several."""
    share = max(1, rows // SAMPLE_ROWS)

    @lean
    def run(batches):
        found = []
        for _, data in (row for rows in _batches(batches, "doc_id", "text") for row in rows):
            text = data.tobytes()
            found += [text[p : p + K] for p in anchors(data)[0][:: 1 + len(text) // 2_000].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["gram"])

    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).mapInArrow(run, "gram binary")
    sample = sorted(bytes(r[0]) for r in sample.limit(60 * SAMPLE_ROWS).collect())
    cuts = [sample[len(sample) * k // ranges] for k in range(1, ranges)] if sample else []
    return sorted(set(cuts)), sorted({a for a, b in zip(cuts, cuts[1:], strict=False) if a == b})


def _beside(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` bytes from each position on."""
    own = np.lib.stride_tricks.sliding_window_view(data, width)[at].astype(np.uint64) + np.uint64(1)
    h = own @ np.array([pow(_BASE, k, 1 << 64) for k in range(width)], np.uint64)
    return h ^ h >> np.uint64(29)


def _split(place: np.ndarray, hot: np.ndarray, data: np.ndarray, start: np.ndarray, head: np.ndarray, first: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Which entry goes to which place, with the hot ones dealt to two families of ``parts`` places after ``first``."""
    offset, size = head["offset"].astype(np.int64), head["size"].astype(np.int64)
    right, left = np.flatnonzero(hot & (size - offset >= K + EXTRA)), np.flatnonzero(hot & (offset > EXTRA))
    at = start + offset
    to_right = first + (_beside(data, at[right], K + EXTRA) % np.uint64(parts)).astype(np.int64) if len(right) else right
    to_left = first + parts + (_beside(data, at[left] - EXTRA - 1, K + EXTRA + 1) % np.uint64(parts)).astype(np.int64) if len(left) else left
    rest = np.flatnonzero(~hot)
    return np.concatenate((rest, right, left)), np.concatenate((place[rest], to_right, to_left))


def entries(joined: DataFrame, text: str, cuts: list[bytes], hot: list[bytes] = []) -> DataFrame:  # noqa: B006
    """Packed entries by range, from documents (__sx_id, __sx_twin and the text) with their shared ``__sx_hashes``."""
    keys, hot_keys = np.array(cuts, f"S{K}"), np.array(hot, f"S{K}")

    @lean
    def run(batches):
        for b, texts in text_chunks(batches, text, CHUNK_BYTES):
            buffers, heads, starts, grams, begun = [], [], [], [], 0
            for i, twin, t, hashes in zip(b.column("__sx_id").to_pylist(), b.column("__sx_twin").to_pylist(), texts, b.column("__sx_hashes").to_pylist(), strict=True):
                data = np.frombuffer(t.encode(), np.uint8)
                at, h, index = anchors(data)
                own = np.flatnonzero(np.isin(h, np.frombuffer(b"".join(hashes), np.uint64)))
                if not len(own):
                    continue
                low, high = np.searchsorted(index, own), np.searchsorted(index, own, "right") - 1
                head = np.empty(len(own), HEAD)
                head["id"], head["twin"], head["low"], head["offset"], head["size"] = i, twin, low, at[own] - low, high + LENGTH - low
                heads.append(head)
                starts.append(low + begun)
                grams.append(np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, K)[at[own]]).view(f"S{K}").ravel())
                buffers.append(data)
                begun += len(data)
            if not heads:
                continue
            head, start, data = np.concatenate(heads), np.concatenate(starts), np.concatenate(buffers)
            # A zero byte at a gram's end is no character to numpy, alike on both sides.
            gram = np.concatenate(grams)
            place = np.searchsorted(keys, gram, "right")
            # Of entries that are equal the least id's goes on; all that it holds goes from the
            # larger ids, so these are settled (and dealt to a negative range).
            by_id = np.argsort(head["id"], kind="stable")
            raw, least, settled = data.tobytes(), {}, np.zeros(len(head), bool)
            for k, at, size, offset, i in zip(by_id.tolist(), start[by_id].tolist(), head["size"][by_id].tolist(), head["offset"][by_id].tolist(), head["id"][by_id].tolist(), strict=True):
                settled[k] = least.setdefault((offset, raw[at : at + size]), i) < i
            place[settled] = -1 - int(head["id"][0]) % (len(keys) + 1)
            if len(hot_keys):
                chosen, place = _split(place, np.isin(gram, hot_keys) & ~settled, data, start, head, len(keys) + 1, len(keys) + 1)
                head, start, settled = head[chosen], start[chosen], settled[chosen]
                if not len(place):
                    continue
            order = np.argsort(place, kind="stable")
            head, start, place, settled = head[order], start[order], place[order], settled[order]
            edges = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
            ends = np.append(edges[1:], len(place))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(place[edges].astype(np.int32)),
                    pa.array([head[x:z].tobytes() for x, z in zip(edges, ends, strict=True)], pa.binary()),
                    pa.array([b"" if settled[x] else gather(data, start[x:z], head["size"][x:z].astype(np.int64)).tobytes() for x, z in zip(edges, ends, strict=True)], pa.binary()),
                ],
                ["range", "heads", "bytes"],
            )

    return joined.mapInArrow(run, "range int, heads binary, bytes binary")


def multikey_sort(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts strings by multikey quicksort with eight-byte characters; the order, and the common prefix of each with its neighbour before.

    ``words[p]`` holds the eight bytes from p on, big-endian.  A round sorts only the
    strings that are still equal, within their groups, by their next eight bytes.
    Strings end at their lengths; bytes beyond count as zero, and common prefixes are
    cut to the shorter length.
    """
    n = len(starts)
    order, common = np.arange(n), np.zeros(n, np.int64)
    tied = np.ones(n, bool)  # by position in the order: equal to the one before so far
    if n:
        tied[0] = False
    live = np.arange(n)  # positions in groups that aren't single
    for at in range(0, depth, 8):
        if not len(live):
            break
        own = order[live]
        left = lengths[own] - at
        value = np.where(left > 0, words[np.minimum(starts[own] + at, len(words) - 1)], np.uint64(0))
        cut = np.clip(8 - left, 0, 8).astype(np.uint64)  # bytes of the word beyond the end
        mask = np.where(cut >= 8, np.uint64(0), _TOP << (np.minimum(cut, np.uint64(7)) * np.uint64(8)))
        value &= mask
        group = np.cumsum(~tied[live])
        inner = np.lexsort((value, group)) if at else np.argsort(value)
        order[live] = own[inner]
        value = value[inner]
        differ = np.append(True, value[1:] != value[:-1])
        same_group = np.append(False, group[1:] == group[:-1])
        # Where the words differ, so many leading bytes are equal.
        diff = np.where(differ & same_group, value ^ np.append(np.uint64(0), value[:-1]), np.uint64(0))
        equal = np.full(len(live), 8, np.int64)
        for byte in range(8):
            equal = np.where((diff >> np.uint64(56 - 8 * byte) & np.uint64(0xFF) != 0) & (equal == 8), byte, equal)
        common[live] += np.where(same_group, np.where(differ, equal, 8), 0)
        tied[live] = same_group & ~differ
        alone = ~tied[live] & ~np.append(tied[live][1:], False)
        live = live[~alone]
    before = np.append(0, lengths[order][:-1])
    return order, np.minimum(common, np.minimum(before, lengths[order]))


def _words(data: np.ndarray) -> np.ndarray:
    w = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    for k in (1, 2, 4):
        w = (w[:-k] << np.uint64(8 * k)) | w[k:]
    return w[: len(data) + 1]


def _runs(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """For each string the number of its run of strings that agree in ``depth`` bytes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def removals(heads: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_id, twin, start) of the strings of one range that a smaller id has too."""
    ids, twin, low, offset, size = (heads[k].astype(np.int64) for k in HEAD.names)
    starts = np.cumsum(size) - size
    words = _words(data)
    right_at, right_size = starts + offset, size - offset
    order, common = multikey_sort(words, right_at, right_size, LENGTH)
    # The left sides, read backwards from the anchor.
    back = _words(data[::-1])
    left_order, left_common = multikey_sort(back, len(data) - right_at, offset, LENGTH - K)
    found = []
    for left in range(int(offset.max(initial=0)) + 1):
        right = LENGTH - left
        has = np.flatnonzero((offset >= left) & (right_size >= right))
        if len(has) < 2:
            continue
        key = _runs(order, common, right)[has] << 32 | _runs(left_order, left_common, left)[has]
        by = np.argsort(key, kind="stable")
        key, has = key[by], has[by]
        cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        least = np.repeat(np.minimum.reduceat(ids[has], cuts), np.diff(np.append(cuts, len(has))))
        gone = has[ids[has] > least]
        found.append((ids[gone], twin[gone], low[gone] + offset[gone] - left))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))


def _merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals in order of their beginning, those that meet joined."""
    reach = np.maximum.accumulate(end)
    cuts = np.flatnonzero(np.append(True, begin[1:] > reach[:-1]))
    return begin[cuts], reach[np.append(cuts[1:], len(begin)) - 1]


def repeated(packed: DataFrame) -> DataFrame:
    """doc_id, twin, starts (packed) from the entries."""

    @lean
    def run(table):
        heads = np.frombuffer(b"".join(table.column("heads").to_pylist()), HEAD)
        if table.column("range")[0].as_py() < 0:
            ids, twin, start = (heads[k].astype(np.int64) for k in ("id", "twin", "low"))
            stop = start + heads["size"]
        else:
            ids, twin, start = removals(heads, np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.uint8))
            stop = start + LENGTH
        order = np.lexsort((start, twin, ids))
        ids, twin, start, stop = ids[order], twin[order], start[order], stop[order]
        cuts = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (twin[1:] != twin[:-1]))) if len(ids) else np.zeros(0, np.int64)
        ends = np.append(cuts[1:], len(ids)).astype(np.int64)[: len(cuts)]
        packed = [np.ascontiguousarray(np.stack(_merged(start[a:z], stop[a:z]), 1)).tobytes() for a, z in zip(cuts, ends, strict=True)]
        return pa.table({"doc_id": pa.array(ids[cuts], pa.int64()), "twin": pa.array(twin[cuts], pa.int64()), "spans": pa.array(packed, pa.binary())})

    return packed.groupBy("range").applyInArrow(run, "doc_id long, twin long, spans binary")


def copies(docs: DataFrame, text: str) -> DataFrame:
    """__sx_copy_id: documents whose whole text a smaller id has; ids that stand for several rows are left out."""
    digest = docs.where(F.octet_length(F.col(f"`{text}`")) >= LENGTH).select("doc_id", F.sha2(F.col(f"`{text}`").cast("binary"), 256).alias("digest")).where("doc_id is not null")
    least = digest.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("digest", "least")
    single = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("doc_id")
    found = digest.join(least, "digest").where("doc_id > least").select("doc_id").join(single, "doc_id", "left_semi")
    return write_table(found.select(F.col("doc_id").alias("__sx_copy_id")), "suffix-copies")


def with_spans(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """``carry``, the text, ``__sx_spans`` (the packed intervals to remove) and ``__sx_copy`` (all goes) of every row."""
    if clash := [c for c in docs.columns if c.startswith("__sx_")]:
        raise ValueError(f"reserved column names: {clash}")
    columns = list(dict.fromkeys([*carry, text]))
    names = [F.col(f"`{c}`") for c in columns]
    # Rows without an id take no part, and aren't dealt.
    none, docs = docs.where("doc_id is null").select(*names), docs.where("doc_id is not null")
    rows = docs.select(*names, F.coalesce("doc_id", F.lit(NO_ID)).alias("__sx_id"), F.xxhash64("doc_id", F.col(f"`{text}`")).alias("__sx_twin"))
    total = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col(f"`{text}`"))), F.lit(0))).head()
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total[1] // BYTES_PER_PART + 1)
    buckets = max(1, total[1] // 16 // ANCHORS_PER_BUCKET + 1, min(parts, total[1] // (1 << 20) + 1))
    ranges = max(1, total[1] // BYTES_PER_RANGE + 1, min(parts, total[1] // (1 << 20) + 1))
    cuts, hot = splitters(docs.select("doc_id", F.col(f"`{text}`").alias("text")), total[0], ranges)
    whole = copies(docs, text)
    # One exchange of the texts serves all joins: they read the same columns of it, and as
    # its key is never null, none filters first.
    dealt = rows.repartition(parts, "__sx_id")
    plain = dealt.join(whole.hint("shuffle_hash"), F.col("__sx_id") == F.col("__sx_copy_id"), "left").withColumn("__sx_taking", F.when(F.col("__sx_copy_id").isNull() & (F.col("__sx_id") != NO_ID), F.col("__sx_id")))
    shared = shared_anchors(plain, text, buckets).groupBy(F.col("doc_id").alias("__sx_sharing")).agg(F.collect_list("__sx_hashes").alias("__sx_hashes"))
    joined = dealt.join(shared.hint("shuffle_hash"), F.col("__sx_id") == F.col("__sx_sharing"))
    found = repeated(entries(joined, text, cuts, hot)).groupBy(F.col("doc_id").alias("__sx_owner")).agg(F.collect_list(F.struct("twin", "spans")).alias("__sx_found"))
    own = F.transform(F.filter("__sx_found", lambda x: x["twin"] == F.col("__sx_twin")), lambda x: x["spans"])
    spanned = (
        dealt.join(found.hint("shuffle_hash"), F.col("__sx_id") == F.col("__sx_owner"), "left")
        .join(whole.hint("shuffle_hash"), F.col("__sx_id") == F.col("__sx_copy_id"), "left")
        .select(*names, own.alias("__sx_spans"), F.col("__sx_copy_id").isNotNull().alias("__sx_copy"))
    )
    return spanned.unionByName(none.select(*names, F.lit(None).cast("array<binary>").alias("__sx_spans"), F.lit(False).alias("__sx_copy")))


def cut_out(data: bytes, spans: list[bytes] | None, copy: bool) -> tuple[bytes, int, int]:
    """The bytes that stay, how many go, and in how many maximal runs."""
    if copy:
        return b"", len(data), 1
    if not spans:
        return data, 0, 0
    both = np.frombuffer(b"".join(spans), np.int64).reshape(-1, 2)
    both = both[np.lexsort((both[:, 1], both[:, 0]))]
    begin, end = _merged(both[:, 0], both[:, 1])
    kept = [data[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(data)], strict=True)]
    return b"".join(kept), int((end - begin).sum()), len(begin)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""

    @lean
    def run(batches):
        for b in batches:
            rows = []
            for t, spans, copy in zip(b.column("text"), b.column("__sx_spans").to_pylist(), b.column("__sx_copy").to_pylist(), strict=True):
                data = (t.as_py() or "").encode()
                kept, gone, runs = cut_out(data, spans, copy)
                rows.append((len(data), gone, runs, hashlib.sha256(kept).hexdigest()))
            c = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(x, pa.int64()) for x in c[:3]], pa.array(c[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return with_spans(docs, ["doc_id"]).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` without the repeated bytes; what a cut leaves of a character is dropped, and a null text stays null."""
    names = docs.columns

    @lean
    def run(batches):
        for b in batches:
            texts = []
            for own, spans, copy in zip(b.column(text), b.column("__sx_spans").to_pylist(), b.column("__sx_copy").to_pylist(), strict=True):
                texts.append(cut_out((own.as_py() or "").encode(), spans, copy)[0].decode("utf-8", "ignore") if spans or copy else own.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text else b.column(c) for c in names], names)

    return with_spans(docs, names, text).mapInArrow(run, docs.schema)
