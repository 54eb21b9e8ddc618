"""Variable-capacity best-fit packing.

Documents are dealt into blocks of about equal row counts; each block is packed in one task.

* A text longer than the largest permitted length is cut: whole pieces of that length
  fill bins alone, and the rest is packed like any other piece.
* Pieces are taken from the longest down.  A piece goes to the open bin with the least
  room that still holds it.  If none does, a new bin opens at the permitted length of
  least cost a token: for each length the bin is filled on trial from the histogram of
  the sizes still left (the largest that fits, again and again), shrunk to what it would
  hold, and its cost divided by that.
* A block is packed with each choice of permitted lengths for opening (all, all but the
  shortest, ..., the longest alone), and the cheapest packing stays: the lengths are
  chosen jointly, and no block costs more than best-fit in bins of the longest alone.
* In the end each bin shrinks to the least permitted length that holds its contents.

A bin of length ``c`` costs ``c + c * c / ATTENTION + BIN_COST`` tokens: its places, padding
included, attention, which grows with the square of the length, and what a sequence costs
by itself.

Defined results: a text's size is its words plus one end mark, so null and blank texts
have size 1; with ``size`` a column of the caller's (tokens of a tokenizer, say) counts
instead, null and negative sizes as 0, and such rows have no piece; very long texts are cut
into pieces as above; repeated rows are packed each, and rows of one id, null included, are dealt
over all blocks; ties of size are taken in the order of ids, then rows; columns of ``docs`` other than
doc_id and the text (or size) aren't read, so their names can't clash; an empty table gives no bins.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.plans.shared import write_table

LENGTHS = (512, 1024, 2048, 4096)
#: What a sequence costs by itself, and the length at which attention costs as much as all the rest.
BIN_COST, ATTENTION = 16, 32_768
ROWS_PER_BLOCK = 25_000
SPACES = r"[\x20\x09-\x0D]+"


class Room:
    """Open bins by free room; finds the least room of at least a size."""

    def __init__(self, most: int):
        self.bins: list[list[int]] = [[] for _ in range(most + 1)]
        self.there = 0  # bit r: some bin has room r

    def put(self, room: int, b: int) -> None:
        self.bins[room].append(b)
        self.there |= 1 << room

    def take(self, size: int) -> tuple[int, int] | None:
        """(bin, its room), removed; the newest of the fullest that fit."""
        above = self.there >> size
        if not above:
            return None
        room = size + (above & -above).bit_length() - 1
        b = self.bins[room].pop()
        if not self.bins[room]:
            self.there &= ~(1 << room)
        return b, room


class Left:
    """How many pieces of each size are still to be packed."""

    def __init__(self, sizes: np.ndarray, most: int):
        self.n = np.bincount(sizes, minlength=most + 1).tolist()
        self.there = sum(1 << int(s) for s in np.unique(sizes))  # bit s: some piece has size s

    def take(self, size: int) -> None:
        self.n[size] -= 1
        if not self.n[size]:
            self.there &= ~(1 << size)

    def fill(self, room: int) -> int:
        """Tokens that the largest pieces that fit, one after the other, put into ``room``."""
        free = room
        there = self.there & ((1 << (free + 1)) - 1)
        while there:
            s = there.bit_length() - 1
            if not s:
                break
            free -= s * min(self.n[s], free // s)
            there &= (1 << min(s, free + 1)) - 1
        return room - free


def cost_of(length: int, bin_cost: float = BIN_COST, attention: float = ATTENTION) -> float:
    return length + length * length / attention + bin_cost


def pack_with(sizes: np.ndarray, lengths: tuple[int, ...], opening: tuple[int, ...], bin_cost: float = BIN_COST, attention: float = ATTENTION) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`pack`, with bins that open at one of the lengths ``opening`` (both ascending, the largest alike)."""
    order = np.argsort(-sizes, kind="stable")
    left, room = Left(sizes, lengths[-1]), Room(lengths[-1])
    bins, offsets, used = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    price = {c: cost_of(c, bin_cost, attention) for c in lengths}
    for k in order.tolist():
        size = int(sizes[k])
        left.take(size)
        found = room.take(size)
        if found is None:
            best = None
            for c in opening:
                if c >= size:
                    held = size + left.fill(c - size)
                    each = price[lengths[bisect_left(lengths, held)]] / max(held, 1)
                    if best is None or each < best[0]:
                        best = (each, c)
            found = (len(used), best[1])
            used.append(0)
        b, free = found
        bins[k], offsets[k] = b, used[b]
        used[b] += size
        if free > size:
            room.put(free - size, b)
    return bins, offsets, np.array([lengths[bisect_left(lengths, u)] for u in used], np.int64)


def pack(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS, bin_cost: float = BIN_COST, attention: float = ATTENTION) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sizes of at most the largest length: each one's bin and offset, and each bin's final length."""
    lengths = tuple(sorted(set(lengths)))
    tries = [pack_with(sizes, lengths, lengths[k:], bin_cost, attention) for k in range(len(lengths))]
    return min(tries, key=lambda t: sum(cost_of(c, bin_cost, attention) for c in t[2].tolist()))


def measured(docs: DataFrame, text: str = "text", size: str | None = None) -> DataFrame:
    """doc_id and size: words and one end mark, or the column ``size``."""
    if size is not None:
        return docs.select("doc_id", F.greatest(F.coalesce(F.col(f"`{size}`"), F.lit(0)), F.lit(0)).cast("long").alias("size"))
    words = F.array_remove(F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), SPACES), "")
    return docs.select("doc_id", (F.size(words) + 1).cast("long").alias("size"))


def pack_documents(docs: DataFrame, *, lengths: tuple[int, ...] = LENGTHS, bin_cost: float = BIN_COST, rows_per_block: int = ROWS_PER_BLOCK, text: str = "text", size: str | None = None) -> DataFrame:
    """A row for each piece: doc_id, piece, start and n_tokens in the text; bin_id, offset in it, bin_length and bin_used."""
    # Written once, ids and sizes alone: a row keeps its number, and rows of one id part.
    rows = write_table(measured(docs, text, size).withColumn("row", F.monotonically_increasing_id()), "packing-sizes")
    blocks = max(1, -(-rows.count() // rows_per_block))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("long"))
    most = max(lengths)

    def run(key, table):
        block = key[0].as_py()
        table = table.sort_by([("doc_id", "ascending"), ("size", "ascending"), ("row", "ascending")])
        sizes = table.column("size").to_numpy()
        whole, rest = sizes // most, sizes % most
        pieces = whole + (rest > 0)
        doc = np.repeat(np.arange(len(sizes)), pieces)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        tokens = np.where(piece < whole[doc], most, rest[doc])
        full = tokens == most
        bins, offsets, final = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64), np.zeros(0, np.int64)
        bins[~full], offsets[~full], final = pack(tokens[~full], lengths, bin_cost)
        bins[full] = len(final) + np.arange(full.sum())
        final = np.append(final, np.full(int(full.sum()), most))
        used = np.bincount(bins, tokens, len(final)).astype(np.int64)
        columns = {
            "doc_id": table.column("doc_id").combine_chunks().take(pa.array(doc)), "piece": piece, "start": piece * most, "n_tokens": tokens,
            "bin_id": (block << 32) + bins, "bin_offset": offsets, "bin_length": final[bins], "bin_used": used[bins],
        }
        return pa.table({k: v if isinstance(v, pa.Array) else pa.array(v, pa.int64()) for k, v in columns.items()})

    return rows.groupBy("block").applyInArrow(run, "doc_id long, piece long, start long, n_tokens long, bin_id long, bin_offset long, bin_length long, bin_used long")
