"""The pipeline against a plain version on a small table."""

from __future__ import annotations

import random
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from ripplemark.llm import packing, pii  # noqa: E402


def make_rows():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = prose(30)
    rows = []
    for i in range(40):
        text = prose(rng.randint(60, 160))
        if i % 8 == 1:
            text = text[:200] + " " + shared + " " + text[200:]
        if i % 10 == 2:
            text += f" write to joe{i}@example.org or +1 (212) 555-01{i:02d} soon"
        rows.append([i, text])
    rows += [[100, rows[3][1]], [101, rows[3][1] + " tail"], [102, "too short"], [103, None], [104, "same three words " * 40], [105, rows[7][1].replace("a", "A")]]
    return [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in rows]


def grams(words, n):
    return Counter(tuple(words[k : k + n]) for k in range(len(words) - n + 1))


def plain(rows):
    docs = {}
    failed = Counter()
    size = Counter()
    for i, t, _, host, _ in rows:
        w = (t or "").split()
        three = grams(w, 3)
        again = len({k + j for k in range(len(w) - 2) for j in range(3) if three[tuple(w[k : k + 3])] > 1})
        bad = len(w) < 50 or 2 * again > len(w)
        size[host] += 1
        failed[host] += bad
        if not bad:
            docs[i] = t
    assert all(failed[h] / size[h] < 0.4 for h in size)  # so no host is rejected
    sets = {i: set(grams(t.lower().split(), 5)) for i, t in docs.items()}
    root = {i: i for i in docs}
    changed = True
    while changed:
        changed = False
        for a in docs:
            for b in docs:
                if root[a] < root[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[b], changed = root[a], True
    docs = {i: t for i, t in docs.items() if root[i] == i}
    first = {}
    for i in sorted(docs):
        raw = docs[i].encode()
        for p in range(len(raw) - 49):
            first.setdefault(raw[p : p + 50], i)
    for i, t in docs.items():
        raw = t.encode()
        gone = {q for p in range(len(raw) - 49) if first[raw[p : p + 50]] < i for q in range(p, p + 50)}
        docs[i] = bytes(c for k, c in enumerate(raw) if k not in gone).decode()
    return {i: pii.rewrite(t, pii.base_spans(t)) for i, t in docs.items()}


def test_pipeline(spark, tmp_path):
    rows = make_rows()
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, columns).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    expected = plain(rows)
    assert 100 not in expected and 101 not in expected and 105 not in expected and len(expected) == 40
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], k
    assert {r.doc_id: r.text for r in docs.collect()} == expected
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokens = Counter()
    for r in found:
        tokens[r.doc_id] += r.n_tokens
    assert tokens == {i: len(t.split()) + 1 for i, t in expected.items()}
    bins = {r.bin_id: (r.bin_length, r.bin_used) for r in found}
    assert sum(u for _, u in bins.values()) == sum(tokens.values()) and all(n == min(c for c in packing.LENGTHS if c >= u) for n, u in bins.values())


def test_empty_and_odd_tables(spark, tmp_path):
    """No rows, and rows of nulls with clashing columns, pass through every stage."""
    columns = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string, rep string"
    for name, rows in (("none", []), ("nulls", [(None,) * 8, (1, None, None, None, None, "a", "b", "c"), (2, "", "en", "s", 0, "a", "b", "c")])):
        where = tmp_path / name
        spark.createDataFrame(rows, columns).write.parquet(str(where / "documents.parquet"))
        assert corpus_pipeline.run(spark, str(where)).count() == 0
