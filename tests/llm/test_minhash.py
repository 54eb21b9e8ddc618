"""Near-duplicate documents against brute force: planted copies, hubs and groups of several blocks, look-alikes."""

from __future__ import annotations

import random

import pytest

from ripplemark.llm import minhash


def shingles(text, width):
    w = (text or "").lower().split()
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, width):
    sets = {i: shingles(t, width) for i, t in rows}
    root, ids = {i: i for i in sets}, sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root, len(links)


def make(rng, groups=25, loners=60):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8)))
    boiler, rows = [word() for _ in range(60)], []
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(30, 90))]
        for _ in range(rng.randint(2, 6)):
            text = list(base)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = word()
            rows.append(" ".join(text))
    # Look-alikes: half of each is the same, so they meet in tables and aren't similar.
    rows += [" ".join(boiler + [word() for _ in range(45)]) for _ in range(loners)]
    base = [word() for _ in range(200)]
    rows += [" ".join(base[:k] + [word()] + base[k + 1 :]) for k in range(120)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("width", [4, 5])
def test_planted_copies(spark, monkeypatch, width):
    """Hubs and groups over several parts and blocks, through the whole query; nothing is linked that isn't similar."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "HUB_ROWS", 8)
    monkeypatch.setattr(minhash, "UNIT_SHINGLES", 2_000)
    rows = make(random.Random(width))
    found = {r.doc_id: r for r in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), width=width).collect()}
    want, links = brute(rows, width)
    assert links > 1_000
    assert {i: r.component_id for i, r in found.items()} == want
    assert all(found[i].n_shingles == len(shingles(t, width)) and found[i].kept == (want[i] == i) for i, t in rows)


def test_a_link_that_no_hub_sees(spark):
    """Two members of a table may be similar though neither is similar to its least member."""
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**9)}" for _ in range(100)]
    rows = [(0, " ".join(base[:75] + [f"x{k}" for k in range(25)])), (1, " ".join(base)), (2, " ".join([*base[:99], "end"])), (3, " ".join(base[20:] + [f"y{k}" for k in range(20)]))]
    found = {r.doc_id: r.component_id for r in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string"), width=5).collect()}
    assert found == brute(rows, 5)[0] and found[2] == 1


def test_group_of_more_than_a_block(spark):
    """300 near copies, each unlike the first hub in its own way, with the parameters of production."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**9)}" for _ in range(120)]
    rows = [(k, " ".join(base[:p] + [f"z{k}"] + base[p + 1 :])) for k, p in enumerate(rng.randrange(120) for _ in range(300))]
    found = minhash.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), width=5).collect()
    assert {r.component_id for r in found} == {0} and sum(r.kept for r in found) == 1


def test_recall_at_the_least_similarity():
    """Of 2,000 pairs of sets at a similarity of 0.8, nearly all meet in a table; few at 0.5."""
    import numpy as np

    rng = np.random.default_rng(6)

    def met(similarity, pairs, size=100):
        hits = 0
        for _ in range(pairs):
            both = round(2 * size * similarity / (1 + similarity))
            a, b, c = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (both, size - both, size - both))
            x, y = (minhash.keys_of(np.unique(np.concatenate((a, z)))) for z in (b, c))
            same = x == y
            hits += same[: minhash.COLLECTION].any() and same[minhash.COLLECTION :].any()
        return hits / pairs

    assert met(0.8, 2_000) >= 0.995 and met(0.5, 400) <= 0.35
