"""Repeated strings around hot grams: one gram of 20 bytes in very many contexts, dealt over several ranges."""

from __future__ import annotations

import numpy as np
import pytest

from ripplemark.llm import suffix
from tests.llm.test_edge_cases import brute_repeats


def make(seed):
    """Texts in which one phrase stands in contexts that are shared to the left, to the right, or on both sides."""
    rng = np.random.default_rng(seed)
    piece = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    phrase, left, right = " of the united nations ", [piece(40) for _ in range(5)], [piece(40) for _ in range(5)]
    rows = []
    for i in rng.permutation(150):
        a = left[rng.integers(5)][rng.integers(0, 25) :] if rng.random() < 0.5 else piece(40)
        b = right[rng.integers(5)][: rng.integers(10, 40)] if rng.random() < 0.5 else piece(40)
        rows.append((int(i), piece(30) + a + phrase + b + piece(30) + (a[-30:] + phrase + piece(12) if rng.random() < 0.3 else "")))
    return rows, phrase


@pytest.mark.parametrize("seed", [1, 2])
def test_hot_grams(spark, monkeypatch, seed):
    """Every gram counts as hot, so all entries are dealt by what stands beside them; the result is that of brute force."""
    rows, _ = make(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    plain = suffix.splitters
    monkeypatch.setattr(suffix, "splitters", lambda docs, n, ranges: ((cuts := plain(docs, n, 8)[0]), [*cuts, *grams]))
    grams = sorted({t.encode()[p : p + suffix.K] for _, t in rows for p in suffix.anchors(np.frombuffer(t.encode(), np.uint8))[0].tolist()})
    found = sorted((tuple(r) for r in suffix.digests(df).collect()), key=str)
    want = brute_repeats([(i, t.encode()) for i, t in rows])
    assert found == want and sum(r[2] for r in want) > 1_000


def test_a_gram_that_fills_ranges_is_hot(spark):
    rng = np.random.default_rng(5)
    line = "the same line of boilerplate in very many of the documents, word for word "
    rows = [(i, "".join(rng.choice(list("abcdefgh"), 20)) + line * 3) for i in range(300)]
    cuts, hot = suffix.splitters(spark.createDataFrame(rows, "doc_id long, text string"), 300, 20)
    assert hot and set(hot) <= set(cuts)


def test_reserved_names(spark):
    with pytest.raises(ValueError, match="__sx_id"):
        suffix.with_spans(spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, __sx_id int"), ["doc_id"])


def test_nothing_is_shared(spark):
    """Buckets without a shared anchor, and ranges in which no string repeats."""
    rng = np.random.default_rng(8)
    text = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    gram = text(25)
    for rows in ([(i, text(200)) for i in range(5)], [(i, text(100) + gram + text(100)) for i in range(5)]):
        found = suffix.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert [r.n_removed for r in found] == [0] * 5
