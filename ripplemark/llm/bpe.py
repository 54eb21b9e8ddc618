"""Byte-level BPE encoding by a pair occurrence index, and decoding.

A partition's new words are laid out in one symbol array.  The index maps the rank
of each adjacent pair to all its positions in that array.  Active ranks are taken
from a heap in ascending order; all occurrences of a pair are merged at once, and
the two pairs that each merge creates are added to the lists of their own ranks.
A position in a list may be out of date; it is used only if the pair still stands
there.  Words encoded once are kept, up to a bound, for later batches of the task.

The vocabulary file (the JSON of the public ``tokenizers`` library) is read on the
driver and broadcast: its size is fixed, and executors need no local copy.

Defined results: a null text is an empty one, with no ids; the vocabulary's special
strings in a text become their ids, as the library does by default.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ripplemark.llm.ragged import gather, text_chunks

#: How GPT-2 style byte-level tokenizers cut a text into words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words that a task remembers.
MEMORY_WORDS = 600_000
_NONE = np.int64(1) << 40


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in such vocabularies -> the byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def load(path: str) -> dict:
    """The vocabulary as plain arrays: ``pairs`` (sorted left * 2**20 + right), ``ranks``, ``results``, ``bytes`` by id, ``letters`` (id of each byte), ``special``."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, letters = spec["model"]["vocab"], byte_letters()
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
    pairs, order = np.unique(left << 20 | right, return_index=True)
    special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
    table = {i: bytes(letters[c] for c in token) for token, i in vocab.items()} | {i: s.encode() for s, i in special.items()}
    return {
        "pairs": pairs, "ranks": order.astype(np.int64), "results": np.array([vocab[a + b] for a, b in merges], np.int64),
        "bytes": [table.get(i, b"") for i in range(max(table) + 1)],
        "letters": np.array([vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64), "special": special,
    }


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


class Encoder:
    """Encodes the texts of one task.

    A text is first split at single spaces between two other characters, where a
    word always ends; such a unit's ids are remembered.  Texts with other spaces at
    a unit's edge, or with special strings, are cut as a whole.
    """

    def __init__(self, vocabulary: dict):
        import regex

        self.v = vocabulary
        self.cut = regex.compile(WORDS)
        self.special = vocabulary["special"]
        self.apart = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.left_of, self.right_of = (np.zeros(len(vocabulary["results"]), np.int64) for _ in range(2))
        self.left_of[vocabulary["ranks"]], self.right_of[vocabulary["ranks"]] = vocabulary["pairs"] >> 20, vocabulary["pairs"] & (1 << 20) - 1
        self.words: dict[str, int] = {}
        self.units: dict[str, int] = {}
        self.forget()

    def forget(self) -> None:
        """Starts the memory anew.  ``pool`` holds ids; words and units are slices of it."""
        self.words.clear()
        self.units.clear()
        self.pool = np.fromiter(self.special.values(), np.int32, len(self.special))
        self.starts, self.lengths = np.arange(len(self.special)), np.ones(len(self.special), np.int64)
        self.words |= {"\0" + text: k for k, text in enumerate(self.special)}

    def keep(self, ids: np.ndarray, lengths: np.ndarray) -> int:
        """Adds slices to the pool; the place of the first."""
        first = len(self.starts)
        self.starts = np.append(self.starts, len(self.pool) + np.cumsum(lengths) - lengths)
        self.lengths = np.append(self.lengths, lengths)
        self.pool = np.append(self.pool, ids.astype(np.int32))
        return first

    def whole(self, text: str) -> list[str]:
        """The words of a text; special strings come with a NUL in front."""
        if self.apart is None or not any(s in text for s in self.special):
            return self.cut.findall(text)
        out, at = [], 0
        for m in self.apart.finditer(text):
            out += self.cut.findall(text[at : m.start()])
            out.append("\0" + m[0])
            at = m.end()
        return out + self.cut.findall(text[at:])

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pairs = self.v["pairs"]
        key = left << 20 | right
        at = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
        return np.where(pairs[at] == key, self.v["ranks"][at], _NONE)

    def learn(self, new: list[str]) -> None:
        """Encodes words not met before, all together."""
        raw = [w.encode() for w in new]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(lengths)
        n = int(ends[-1])
        sym = self.v["letters"][np.frombuffer(b"".join(raw), np.uint8)]
        # Slot n is a wall: it never pairs with anything.
        sym = np.append(sym, -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends - 1] = n
        before[ends[:-1]] = n
        before[0] = n
        before = np.append(before, n)
        alive = np.ones(n + 1, bool)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(positions: np.ndarray) -> None:
            """Puts the pairs that start at these positions into the lists of their ranks."""
            positions = positions[after[positions] < n]
            if not len(positions):
                return
            rank = self.rank_of(sym[positions], sym[after[positions]])
            there = rank != _NONE
            positions, rank = positions[there], rank[there]
            if not len(rank):
                return
            order = np.argsort(rank, kind="stable")
            positions, rank = positions[order], rank[order]
            starts = np.flatnonzero(np.append(True, rank[1:] != rank[:-1]))
            for a, b in zip(starts, [*starts[1:], len(rank)], strict=True):
                r = int(rank[a])
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(positions[a:b])

        add(np.arange(n))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else _distinct(np.concatenate(lists))
            a, b = self.left_of[r], self.right_of[r]
            at = at[alive[at]]
            at = at[(sym[at] == a) & (sym[after[at]] == b)]
            if a == b and len(at) > 1:  # in a run of one symbol, every other pair from the left
                joined = np.append(False, after[at[:-1]] == at[1:])
                start = np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            sym[at] = self.v["results"][r]
            alive[gone] = False
            beyond = after[gone]
            after[at] = beyond
            before[beyond] = at
            before[n] = n
            earlier = before[at]
            add(_distinct(np.concatenate((at, earlier[earlier < n]))))
        flat = sym[:n][alive[:n]]
        first = self.keep(flat, np.add.reduceat(alive[:n].astype(np.int64), np.append(0, ends[:-1])))
        self.words |= {w: first + k for k, w in enumerate(new)}

    def place(self, units: list[list[str]]) -> np.ndarray:
        """Learns each list of words as one unit, in this order; the places."""
        new = dict.fromkeys(w for words in units for w in words if w not in self.words)
        if new:
            self.learn(list(new))
        counts = np.fromiter(map(len, units), np.int64, len(units))
        at = np.fromiter((self.words[w] for words in units for w in words), np.int64, int(counts.sum()))
        sums = np.append(0, np.cumsum(self.lengths[at]))
        stops = np.cumsum(counts)
        first = self.keep(gather(self.pool, self.starts[at], self.lengths[at]), sums[stops] - sums[stops - counts])
        return np.arange(first, first + len(units))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after the other, and how many each has."""
        if len(self.units) + len(self.words) > MEMORY_WORDS:
            self.forget()
        units = self.units
        parts: list[list[str] | None] = []
        new: set[str] = set()
        for t in texts:
            # The first unit has no space in front; a NUL marks it.
            own = ("\0" + t).split(" ") if t and not any(s in t for s in self.special) else [""]
            fresh = set(own).difference(units, new)
            if own[0][1:].strip() != own[0][1:] or len(own[0]) < 2 or [u for u in fresh if u.strip() != u or not u]:
                parts.append(None)
            else:
                parts.append(own)
                new |= fresh
        if new:
            ordered = list(new)
            at = self.place([self.cut.findall(u[1:] if u[0] == "\0" else " " + u) for u in ordered])
            self.units |= dict(zip(ordered, at.tolist(), strict=True))
        odd = [k for k, own in enumerate(parts) if own is None]
        odd_at = dict(zip(odd, self.place([self.whole(texts[k]) for k in odd]).tolist(), strict=True)) if odd else {}
        flat, counts = [], []
        for k, own in enumerate(parts):
            flat.append(np.fromiter([odd_at[k]] if own is None else map(units.__getitem__, own), np.int64, 1 if own is None else len(own)))
            counts.append(len(flat[-1]))
        at, stops = np.concatenate(flat), np.cumsum(counts)
        sums = np.append(0, np.cumsum(self.lengths[at]))
        return gather(self.pool, self.starts[at], self.lengths[at]), sums[stops] - sums[stops - counts]


class Table:
    """Strings of bytes by id, joined for lists of ids."""

    def __init__(self, entries: list[bytes]):
        self.lengths = np.fromiter(map(len, entries), np.int64, len(entries))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.pool = np.frombuffer(b"".join(entries), np.uint8)

    def join(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The joined entries of each list; ``ids`` has all lists, one after the other."""
        sizes = self.lengths[ids]
        flat = gather(self.pool, self.starts[ids], sizes).tobytes()
        stops = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))]
        return [flat[a:b] for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)]


def decoder(vocabulary: dict) -> Table:
    return Table(vocabulary["bytes"])


def _vocabulary(spark: SparkSession, path: str | None):
    return spark.sparkContext.broadcast(load(path or default_path()))


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ``ids`` (array<int>), all ids of the whole text."""
    shared = _vocabulary(docs.sparkSession, path)

    def run(batches):
        coder = Encoder(shared.value)
        for part, texts in text_chunks(batches, "text"):
            ids, counts = coder.encode(texts)
            stops = np.append(0, np.cumsum(counts)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(stops), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ``text`` from doc_id and ``ids``; null ids give an empty text."""
    shared = _vocabulary(encoded.sparkSession, path)

    def run(batches):
        back = decoder(shared.value)
        for b in batches:
            lists = b.column("ids")
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = [x.decode("utf-8", "replace") for x in back.join(lists.flatten().to_numpy(zero_copy_only=False), counts)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of the encoded and decoded texts, in one pass."""
    shared = _vocabulary(docs.sparkSession, path)

    def run(batches):
        coder, back, decimal = Encoder(shared.value), decoder(shared.value), Table([b"%d," % i for i in range(len(shared.value["bytes"]))])
        for part, texts in text_chunks(batches, "text"):
            ids, counts = coder.encode(texts)
            shown = [hashlib.sha256(x[:-1]).hexdigest() for x in decimal.join(ids, counts)]
            decoded = [hashlib.sha256(x.decode("utf-8", "replace").encode()).hexdigest() for x in back.join(ids, counts)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(shown, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
