"""Near-duplicate vectors against brute force: lists of several blocks, many copies, planted pairs."""

from __future__ import annotations

import numpy as np
import pytest

from ripplemark.llm import pivots


def brute(x, labels, cosine=pivots.COSINE):
    unit = pivots.unit(np.asarray(x, np.float32).astype(float))
    links = (unit @ unit.T >= cosine) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(links, False)
    return links


def test_planted_pairs(spark):
    """3,000 random vectors of 64 dimensions with 600 planted pairs exactly at, above and below the least cosine."""
    rng = np.random.default_rng(3)
    a = pivots.unit(rng.normal(size=(3_000, 64)))
    r = rng.normal(size=(600, 64))
    r = pivots.unit(r - (r * a[:600]).sum(1, keepdims=True) * a[:600])
    c = np.repeat([0.9301, 0.97, 0.9299], 200)[:, None]
    x = np.concatenate((a, c * a[:600] + np.sqrt(1 - c * c) * r))
    labels = np.concatenate((np.arange(3_000) % 4, np.arange(600) % 4))
    rows = [(i, [float(v) for v in row], int(y)) for i, (row, y) in enumerate(zip(x, labels, strict=True))]
    found = {r.vec_id: r for r in pivots.classes(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)).collect()}
    links = brute(x, labels)
    got = np.array([found[i].n_links for i in range(len(x))])
    assert links.sum() >= 780 and (got <= links.sum(1)).all() and got.sum() >= 0.98 * links.sum()
    assert not got[3_400:].any()


def test_lists_of_several_blocks(spark, monkeypatch):
    """Lists longer than a block, and a vector that half of all rows are copies of, through the whole query."""
    monkeypatch.setattr(pivots, "BLOCK", 50)
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(3, 8))
    x = np.concatenate((centre[rng.integers(0, 3, 700)] + rng.normal(size=(700, 8)) * 0.15, np.repeat(centre[:1], 900, 0), np.repeat(centre[:1] * 2.0, 3, 0)))
    order = rng.permutation(len(x))
    x, labels = x[order].astype(np.float32), np.zeros(len(x), int)
    rows = [(i, [float(v) for v in row], 0) for i, row in enumerate(x)]
    df = spark.createDataFrame(rows + [rows[5], rows[5]], "vec_id long, embedding array<float>, label int").repartition(3)
    found = {r.vec_id: r for r in pivots.classes(df).collect()}
    links = brute(x, labels)
    got, want = np.array([found[i].n_links for i in range(len(x))]), links.sum(1)
    assert (got <= want).all() and got.sum() >= 0.95 * want.sum()
    root = np.arange(len(x))
    while (root != (new := np.where(links | np.eye(len(x), dtype=bool), root[None, :], len(x)).min(1))).any():
        root = new
    assert np.mean([found[i].component_id == root[i] for i in range(len(x))]) >= 0.99


@pytest.mark.parametrize("kind", ["float", "double"])
def test_few_vectors(spark, kind):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1), (3, [0.0, 1.0], 1), (4, [1.0, 0.0], 2), (5, [2.0, 0.0], 1)]
    found = sorted(map(tuple, pivots.classes(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")).collect()))
    assert found == [(1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 2, 1, False)]
