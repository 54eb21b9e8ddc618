"""Information-theoretic sanitisation of personal data.

Base spans are e-mail, IP, card and phone numbers, found by fixed patterns.  Each found
value stands for protected entities at two or three levels, so that an entity recurs even
where its exact value doesn't (:func:`levels`): the value itself, the name in an address, its domain,
the network of an IP number, the block of a phone number, the issuer of a card.  Corpus
co-occurrence then estimates how much a term says about an entity.  With N documents, an
entity in ``d_e`` of them, a term in ``d_t`` and both, the term within WINDOW words of the
entity, in ``d_te``:

    PMI(t; e) = log2(d_te N / (d_t d_e)),   IC(e) = log2(N / d_e)

A term whose ``PMI / IC`` reaches ``disclosure`` in at least ``min_support`` documents
gives the entity away, and each of its occurrences outside base spans, in any document,
becomes a ``term`` span.  An entity of less than MIN_CONTENT bits stands in so large a
part of all documents that it names no one, and isn't protected.
:func:`sanitise` puts a general word for base spans and for terms with digits or a
capital, and removes other terms.

The work is linear: each mention makes at most 6 WINDOW candidates; counts are combined
before each shuffle, so one entity in a third of all documents is one row a task.  No
text is shuffled, unless more than BROADCAST_ROWS terms are flagged.  Document
frequencies are counted only for terms with support.

Defined results: a null text is empty and has no spans; very long texts and words are taken
whole; repeated rows count as often as they occur; documents without a base span or a flagged
term never change; spans that start alike are shown in the order of their kinds; names that
begin with ``__pii_`` are reserved, and a table with such a column is refused; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplemark.llm.memory import lean
from ripplemark.plans.shared import write_table

KINDS = ("email", "ip", "card", "phone")
WINDOW = 8
MIN_SUPPORT = 3
DISCLOSURE = 0.8
MIN_CONTENT = 5.0
#: Letters that the name in an address has at least.
SHORTEST_NAME = 4
#: Broadcasts hold at most so many rows; beyond that the rows are shuffled.
BROADCAST_ROWS = 100_000
#: The characters of an e-mail's two sides and the other patterns.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
TERM = re.compile(r"[^\W_]{3,}")
#: What stands in for a span in a sanitised text.
GENERAL = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Walks from one @ to the next, so that long runs of letters are read once."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and not NOT_LOCAL.match(text, start - 1):
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done, "email"
        at = text.find("@", max(at + 1, done))
        done = max(done, 0)


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) by start, then kind as listed: code points, end exclusive."""
    spans = list(_emails(text)) if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            spans.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            spans.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                spans.append((m.start(), m.end(), "phone"))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def shown(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def value_of(text: str, kind: str) -> str:
    """A base span as an entity, however it was written."""
    return kind + ":" + re.sub(r"[^0-9a-z@.]", "", text.lower())


def levels(value: str) -> list[str]:
    """The entities that a value stands for: itself, and what several values have in common."""
    kind, _, text = value.partition(":")
    if kind == "email":
        local, _, domain = text.partition("@")
        name = re.sub("[^a-z.]", "", local).strip(".")
        return [value, *(["name:" + name] if len(name) >= SHORTEST_NAME else []), "domain:" + domain]
    if kind == "ip":
        return [value, "net:" + text.rpartition(".")[0]]
    return [value, "area:" + text[:-4]] if kind == "phone" else [value, "issuer:" + text[:6]]


def entities(text: str, kind: str) -> list[str]:
    return levels(value_of(text, kind))


def candidates(text: str, spans: list[Span], window: int = WINDOW) -> list[tuple[str, str, int, int]]:
    """(entity, term, start, end) for the words near each base span that lie outside all of them."""
    out = []
    begin: list[int] = []
    end: list[int] = []
    for a, b, _ in spans:  # joined where they overlap, so that one look decides
        if end and a <= end[-1]:
            end[-1] = max(end[-1], b)
        else:
            begin.append(a)
            end.append(b)

    def apart(x: int, y: int) -> bool:
        k = bisect_left(begin, y) - 1
        return k < 0 or end[k] <= x

    first, last = [], []
    for m in TERM.finditer(text) if spans else ():
        first.append(m.start())
        last.append(m.end())
    for a, b, kind in spans:
        entity = value_of(text[a:b], kind)
        i, j = bisect_right(last, a), bisect_left(first, b)
        before = list(zip(first[max(0, i - window) : i], last[max(0, i - window) : i], strict=True))
        after = list(zip(first[j : j + window], last[j : j + window], strict=True))
        # Of a word across the span's edge, the part outside counts.
        if i < len(first) and a - first[i] >= 3:
            before = [*before, (first[i], a)][-window:]
        if j and last[j - 1] - b >= 3:
            after = [(b, last[j - 1]), *after][:window]
        out += [(entity, text[x:y].lower(), x, y) for x, y in before + after if apart(x, y)]
    return out


def words(text: str, spans: list[Span]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of all words outside the base spans."""
    done = 0
    for a, b, _ in (*spans, (len(text), len(text), "")):
        for m in TERM.finditer(text, done, a) if a > done else ():
            yield m[0].lower(), m.start(), m.end()
        done = max(done, b)


def _near(docs: DataFrame, text: str, window: int) -> DataFrame:
    """``__pii_row`` and ``__pii_near`` (the candidates, as entity and term) of every row, written once."""
    df = docs.select(F.monotonically_increasing_id().alias("__pii_row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__pii_text"))
    near_type = pa.list_(pa.struct([("e", pa.string()), ("t", pa.string())]))

    @lean
    def run(batches):
        for batch in batches:
            near = []
            for t in batch.column("__pii_text"):
                t = t.as_py()
                spans = base_spans(t)
                # An entity without a word beside it counts, too: with an empty term.
                alone = [{"e": e, "t": ""} for e in sorted({e for a, b, k in spans for e in entities(t[a:b], k)})]
                near.append(alone + [{"e": e, "t": w} for v, w, _, _ in candidates(t, spans, window) for e in levels(v)])
            yield pa.RecordBatch.from_arrays([batch.column("__pii_row"), pa.array(near, near_type)], ["__pii_row", "__pii_near"])

    return write_table(df.mapInArrow(run, "__pii_row long, __pii_near array<struct<e:string,t:string>>"), "pii-near")


def _marked(docs: DataFrame, text: str, carry: list[str], flagged: set[str]) -> DataFrame:
    """The columns of ``carry``, ``__pii_spans`` and ``__pii_terms``: every occurrence of the ``flagged`` terms."""
    df = docs.select(*[F.col(f"`{c}`") for c in carry], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__pii_text"))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema[:-1]], "__pii_spans array<struct<a:int,b:int,k:string>>", "__pii_terms array<struct<a:int,b:int>>"])
    spans_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("k", pa.string())]))
    terms_type = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    known = docs.sparkSession.sparkContext.broadcast(flagged)

    @lean
    def run(batches):
        for batch in batches:
            spans, terms = [], []
            for t in batch.column("__pii_text"):
                t = t.as_py()
                own = base_spans(t)
                spans.append([{"a": a, "b": b, "k": k} for a, b, k in own])
                hits = words(t, own) if known.value else ()
                terms.append([{"a": a, "b": b} for w, a, b in hits if w in known.value] or None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(spans, spans_type), pa.array(terms, terms_type)], [*carry, "__pii_spans", "__pii_terms"])

    return df.mapInArrow(run, schema)


def _joined(docs: DataFrame, text: str, carry: list[str], flagged: DataFrame) -> DataFrame:
    """As :func:`_marked`, for more terms than a broadcast holds: all words are joined with ``flagged``."""
    rows = docs.select(*[F.col(f"`{c}`") for c in carry], F.monotonically_increasing_id().alias("__pii_row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__pii_text"))
    rows = write_table(rows, "pii-rows")  # so that a row keeps its number

    @lean
    def run(batches):
        for batch in batches:
            for row, t in zip(batch.column("__pii_row"), batch.column("__pii_text"), strict=True):
                t = t.as_py()
                found = list(words(t, base_spans(t)))
                term, a, b = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array([row.as_py()] * len(found), pa.int64()), pa.array(term, pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["__pii_row", "term", "a", "b"])

    every = rows.select("__pii_row", "__pii_text").mapInArrow(run, "__pii_row long, term string, a int, b int")
    terms = every.join(flagged, "term", "left_semi").groupBy("__pii_row").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("__pii_terms"))
    return _marked(rows, "__pii_text", [*carry, "__pii_row"], set()).drop("__pii_terms").join(terms, "__pii_row", "left").drop("__pii_row")


def _frequencies(docs: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    """term, d_t: in how many documents each of ``terms`` stands."""
    source = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    wanted = None
    if terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        wanted = docs.sparkSession.sparkContext.broadcast({r[0] for r in terms.collect()})

    @lean
    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for t in batch.column("text"):
                words = {w.lower() for w in TERM.findall(t.as_py())}
                counts.update(words if wanted is None else words & wanted.value)
                if len(counts) > 500_000:
                    yield _counted(counts)
                    counts.clear()
        yield _counted(counts)

    found = source.mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("d_t"))
    return found if wanted is not None else found.join(terms, "term", "left_semi")


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])


def disclosures(docs: DataFrame, found: DataFrame, text: str, min_support: int, disclosure: float) -> DataFrame:
    """entity, term, d_te, d_e, d_t and ratio of the pairs that reach the thresholds."""
    n = found.count()
    near = found.select("__pii_row", F.explode("__pii_near").alias("x")).select("__pii_row", F.col("x.e").alias("entity"), F.col("x.t").alias("term"))
    # A row's pairs are in one task, so distinct needs no key but its own.
    pairs = near.where("term <> ''").groupBy("__pii_row", "entity", "term").agg(F.lit(1).alias("one")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("d_te")).where(F.col("d_te") >= min_support)
    pairs = write_table(pairs, "pii-pairs")
    entities = (
        found.select("__pii_row", F.explode(F.array_distinct(F.transform("__pii_near", lambda x: x["e"]))).alias("entity"))
        .groupBy("entity").agg(F.count(F.lit(1)).alias("d_e"))
    )
    terms = pairs.select("term").distinct()
    if not pairs.limit(1).count():
        frequencies = terms.withColumn("d_t", F.lit(1).cast("long"))
    else:
        frequencies = _frequencies(docs, text, terms)
    scored = pairs.join(entities, "entity").join(frequencies, "term")
    content = F.log2(F.lit(float(max(n, 1))) / F.col("d_e"))
    ratio = F.when(content >= MIN_CONTENT, F.log2(F.col("d_te") * F.lit(float(max(n, 1))) / (F.col("d_t") * F.col("d_e"))) / content).otherwise(F.lit(0.0))
    return scored.withColumn("ratio", ratio).where(F.col("ratio") >= disclosure)


def find(docs: DataFrame, *, text: str = "text", carry: list[str] | None = None, window: int = WINDOW, min_support: int = MIN_SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """The columns ``carry`` (all, if None), ``__pii_spans`` (base) and ``__pii_terms`` (added; null if none)."""
    if clash := [c for c in docs.columns if c.startswith("__pii_")]:
        raise ValueError(f"reserved column names: {clash}")
    carry = docs.columns if carry is None else carry
    flagged = disclosures(docs, _near(docs, text, window), text, min_support, disclosure).select("term").distinct()
    flagged = write_table(flagged, "pii-flagged")
    if flagged.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return _joined(docs, text, carry, flagged)
    return _marked(docs, text, carry, {r[0] for r in flagged.collect()})


def all_spans(base: list[Span], terms: list[tuple[int, int]]) -> list[Span]:
    order = {k: i for i, k in enumerate((*KINDS, "term"))}
    return sorted([*base, *[(a, b, "term") for a, b in terms]], key=lambda s: (s[0], order[s[2]]))


def digests(found: DataFrame) -> DataFrame:
    """The columns of the contract from what :func:`find` gave with doc_id."""

    @lean
    def run(batches):
        for batch in batches:
            rows = []
            for base, terms in zip(batch.column("__pii_spans").to_pylist(), batch.column("__pii_terms").to_pylist(), strict=True):
                own = [(s["a"], s["b"], s["k"]) for s in base]
                both = all_spans(own, [(s["a"], s["b"]) for s in terms or []])
                kinds = Counter(s[2] for s in own)
                rows.append((*[kinds[k] for k in KINDS], hashlib.sha256(shown(own).encode()).hexdigest(), shown(both)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns[:4]], *[pa.array(c, pa.string()) for c in columns[4:]]], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return found.select("doc_id", "__pii_spans", "__pii_terms").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def rewrite(text: str, spans: list[Span]) -> str:
    """``text`` with overlapping spans merged; the first span's kind decides."""
    out, done = [], 0
    for a, b, kind in spans:
        if a >= done:
            word = text[a:b]
            general = GENERAL.get(kind) or ("[NUMBER]" if any(c.isdigit() for c in word) else "[NAME]" if word[:1].isupper() else "")
            out += [text[done:a], general]
        done = max(done, b)
    return "".join(out) + text[done:]


def sanitise(docs: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """``docs`` with spans generalised or removed; rows without spans as they are."""
    found = find(docs, text=text, **options)
    names = docs.columns

    @lean
    def run(batches):
        for batch in batches:
            texts = []
            for t, base, terms in zip(batch.column(text).to_pylist(), batch.column("__pii_spans").to_pylist(), batch.column("__pii_terms").to_pylist(), strict=True):
                spans = all_spans([(s["a"], s["b"], s["k"]) for s in base], [(s["a"], s["b"]) for s in terms or []])
                texts.append(rewrite(t, spans) if spans else t)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text else batch.column(c) for c in names], names)

    return found.select(*[F.col(f"`{c}`") for c in names], "__pii_spans", "__pii_terms").mapInArrow(run, docs.schema)
