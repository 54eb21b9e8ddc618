"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row

from ripplemark.llm import bpe, minhash, packing, pii, pivots, ppm, quality, sharding, suffix, toxicity

BASE = " ".join(f"word{i} tail{i % 13}" for i in range(60))
PASSAGE = "a passage of more than fifty bytes that several documents have in common, exactly so"
TEXTS = [
    None, "", " \t\n", "one", "one two three", BASE, BASE, BASE + " extra", "ÄÖ " + PASSAGE + " ü", "x" + PASSAGE + "y", "naïve 😀 " + PASSAGE, "z" * 30_000, "ab " * 20_000,
    "mail joe.doe@example.com or 10.0.0.1, call +1 (212) 555-0100, card 4539 1488 0343 6467", "<|endoftext|> don't  stop\n\n now", "a\nb\na\n\na", "idiot scum " * 30,
]
CLASHING = ("rep", "size", "n", "keys", "__row", "text_crc32", "shard", "kept", "component", "range", "bucket", "twin")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [Row(doc_id=i, text=t, lang="en" if i % 3 else None, source=None if i == 3 else f"s{i % 2}", n_chars=None, **{c: "x" for c in CLASHING}) for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[8].asDict() and Row(**(rows[8].asDict() | {"doc_id": None}))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def rows_of(df, key="doc_id"):
    return sorted(df.collect(), key=lambda r: (r[key] is None, r[key] if r[key] is not None else 0, str(r)))


def test_quality(docs, nothing):
    found = rows_of(quality.judge(docs, carry=["doc_id"]))
    assert len(found) == docs.count() and not quality.judge(nothing, carry=["doc_id"]).count()
    for r in found:
        text = (TEXTS[r.doc_id] if r.doc_id is not None else TEXTS[8]) or ""
        words = text.split()
        grams = Counter(zip(words, words[1:], words[2:]))
        again = {k + j for k in range(len(words) - 2) for j in range(3) if grams[tuple(words[k : k + 3])] > 1}
        lines = [x for x in text.split("\n") if x.split()]
        assert (r["__q_n_words"], r["__q_word_chars"], r["__q_n_repeat_words"], r["__q_n_dup_lines"]) == (len(words), sum(map(len, words)), len(again), len(lines) - len(set(lines)))
        assert r["__q_n_symbols"] == sum(c in "#*$%&|<>" for c in text)
        assert r["__q_base_failed"] == (len(words) < 50 or 2 * len(again) > len(words))
    assert quality.filter_documents(docs).columns == docs.columns


def test_sharding(docs, nothing):
    found = rows_of(sharding.assign_shards(docs, 4, rows_per_range=5))
    assert len(found) == docs.count() and not sharding.assign_shards(nothing, 4).count()
    for r in found:
        raw = ((TEXTS[r.doc_id] if r.doc_id is not None else TEXTS[8]) or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
    for s in {r.shard for r in found}:
        assert sorted(r.slot for r in found if r.shard == s) == list(range(sum(r.shard == s for r in found)))
    ids = [r.doc_id for r in sorted(found, key=lambda r: (r.shard, r.slot)) if r.doc_id is not None]
    assert ids == sorted(ids)


def test_pii(docs, nothing):
    found = rows_of(pii.digests(pii.find(docs, carry=["doc_id"])))
    assert len(found) == docs.count() and not pii.find(nothing, carry=["doc_id"]).count()
    hit = next(r for r in found if r.doc_id == 13)
    assert (hit.n_email, hit.n_ip, hit.n_card, hit.n_phone) == (1, 1, 1, 1)
    assert hit.base_sha256 == hashlib.sha256(hit.spans.encode()).hexdigest()
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns
    text = {r.doc_id: r.text for r in clean.collect()}
    assert text[13] == "mail [EMAIL] or [IP], call [PHONE], card [CARD]" and text[5] == BASE


def test_pii_patterns():
    for text, kinds in (
        ("a@b", []), ("a@b.c", ["email"]), ("x@y@z.com", ["email"]), ("..@-.-", ["email"]), ("1.2.3", []), ("1.2.3.4.5.6.7.8", ["ip", "ip"]), ("999.1.1.1", []), ("0001.2.3.4", ["ip"]),
        ("4539148803436467", ["card"]), ("4539148803436468", []), ("+12", []), ("+1234567890", ["phone"]), ("@" * 5000, []), ("a" * 50_000 + "@", []), ("9" * 50_000, []),
    ):
        assert [k for _, _, k in pii.base_spans(text)] == kinds, text[:40]


def test_pii_terms(spark):
    """A name that stands only beside one address gives it away; common words don't."""
    rows = [(i, f"the report from Zorblax jane@x.org about item {i}") for i in range(6)] + [(10 + i, f"the report from nobody about item {i}") for i in range(200)]
    found = {r.doc_id: r.spans for r in pii.digests(pii.find(spark.createDataFrame(rows, "doc_id long, text string"), carry=["doc_id"])).collect()}
    assert all(found[i] == "term:16:23,email:24:34" for i in range(6)) and not any(found[10 + i] for i in range(200))


@pytest.mark.parametrize("most", [pii.BROADCAST_ROWS, 0])
def test_pii_terms_everywhere(spark, monkeypatch, most):
    """A flagged term is a span wherever it stands: far from the address, and in documents without one."""
    monkeypatch.setattr(pii, "BROADCAST_ROWS", most)
    texts = ["the report from Zorblax jane@x.org " + " ".join(f"filler{k}" for k in range(30)) + " Then Zorblax left"] * 6 + ["nobody but Zorblax, zorblax too"]
    texts += [None] + ["the report from nobody " + " ".join(f"filler{k}" for k in range(30)) + " Then somebody left"] * 200
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.spans for r in pii.digests(pii.find(df, carry=["doc_id"])).collect()}
    far = texts[0].rindex("Zorblax")
    assert all(found[i] == f"term:16:23,email:24:34,term:{far}:{far + 7}" for i in range(6))
    assert found[6] == "term:11:18,term:20:27" and len(found) == len(texts) and not any(found[i] for i in range(7, len(texts)))
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert not any("orblax" in (t or "") for t in clean.values()) and all(clean[i] == texts[i] for i in range(7, len(texts)))


def test_pii_window_in_words():
    """The window is so many words, however long they are; parts of words beside a span count."""
    long = [c * 200 for c in "abcdefghijklmnopqrst"]
    text = " ".join([*long[:10], "jane@x.org", *long[10:]])
    assert [w for _, w, _, _ in pii.candidates(text, pii.base_spans(text))] == long[2:18]
    text = "one\u00e4\u00f6\u00fcjoe@x.org two"
    assert [(w, a, b) for _, w, a, b in pii.candidates(text, [(6, 15, "email")])] == [("one\u00e4\u00f6\u00fc", 0, 6), ("two", 16, 19)]


def test_toxicity(spark, docs, nothing):
    labels = spark.createDataFrame([(i, int(i == 16)) for i in range(17)] + [(None, 1), (3, None), (5, 0)], "doc_id long, toxic int")
    weights = toxicity.train(docs, labels)
    found = rows_of(toxicity.score(docs, weights))
    assert len(found) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    assert not toxicity.score(nothing, toxicity.train(nothing, labels)).count()


def brute_repeats(rows):
    first = {}
    for i, b in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    out = []
    for i, b in rows:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 49):
            if i is not None and first[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        out.append((i, len(b), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_suffix(spark, docs, nothing):
    found = sorted((tuple(r) for r in suffix.digests(docs).collect()), key=str)
    assert found == brute_repeats([(r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect()])
    assert not suffix.digests(nothing).count()
    assert suffix.remove_repeats(docs).columns == docs.columns
    rng = np.random.default_rng(3)
    pieces = ["".join(rng.choice(list("abé"), 90)) for _ in range(6)]
    rows = [(int(i), "".join(rng.choice(pieces, 3)) + "".join(rng.choice(list("xyz"), 40)) + pieces[i % 6][5:70]) for i in rng.permutation(40)]
    found = sorted((tuple(r) for r in suffix.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()), key=str)
    assert found == brute_repeats([(i, t.encode()) for i, t in rows])


def test_ppm(spark, docs, nothing):
    found = rows_of(ppm.score(docs))
    assert len(found) == docs.count() and not ppm.score(nothing).count()
    training = [(TEXTS[r.doc_id] if r.doc_id is not None else TEXTS[8]) or "" for r in docs.select("doc_id").collect() if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 7 != 2]
    counts = Counter(w for t in training for w in [*t.encode().lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    for r in found:
        tokens = [*((TEXTS[r.doc_id] if r.doc_id is not None else TEXTS[8]) or "").encode().lower().split(), None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert r.base_score == pytest.approx(sum(np.log10((counts[w] + 1) / (n + v + 1)) for w in tokens))
        assert r.score < 0


def test_ppm_probabilities_sum_to_one():
    data = [b"abracadabra", b"abrabrabra", b"cadabra"]
    keys, c = np.unique(np.concatenate([ppm.grams(d) for d in data]), return_counts=True)
    pairs = np.zeros((256, 256))
    np.add.at(pairs, (keys >> 8 & 0xFF, keys & 0xFF), c)
    for context in (b"\xfe\xfe\xfea", b"abra", b"zzra", b"qqqq"):
        code = int.from_bytes(context, "big")
        same = keys[(keys >> 8 & 0xFFFF) == (code & 0xFFFF)]
        own = c[(keys >> 8 & 0xFFFF) == (code & 0xFFFF)]
        logs = ppm.price(same, own, np.array([code << 8 | s for s in range(256)]), pairs)
        assert (10**logs).sum() == pytest.approx(1)


def test_pivots(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 1500)] + rng.normal(size=(1500, 16)) * 0.08
    rows = [(i, [float(a) for a in v], int(i % 3)) for i, v in enumerate(x)]
    odd = [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 16, 1), (2003, [float("nan")] + [1.0] * 15, 1), (2004, [None] + [1.0] * 15, 1), (2005, rows[0][1], None), (None, rows[0][1], 0), (2006, [1.0, 2.0], 0), (2007, [float("inf")] + [1.0] * 15, 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")
    found = {r.vec_id: r for r in pivots.classes(df).collect()}
    assert len(found) == len(rows) + len(odd)
    unit = x.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    links = (unit @ unit.T >= 0.93) & (np.arange(1500)[:, None] % 3 == np.arange(1500)[None, :] % 3)
    np.fill_diagonal(links, False)
    got = np.array([found[i].n_links for i in range(1500)])
    assert (got <= links.sum(1)).all() and got.sum() >= 0.9 * links.sum() and links.sum() > 0
    assert all(found[i].n_links == 0 and found[i].kept for i in (2000, 2001, 2002, 2003, 2004, 2005, 2006, 2007))
    assert not pivots.classes(df.limit(0)).count()


@pytest.mark.parametrize("most", [64, 226, 1_024, 4_096, 16_384])
def test_pivots_recall(most):
    """Pairs at the least cosine share enough pivots, however many there are."""
    rng = np.random.default_rng(7)
    known = pivots.unit(rng.normal(size=(most, 16)))
    a, r = pivots.unit(rng.normal(size=(2_000, 16))), rng.normal(size=(2_000, 16))
    r = pivots.unit(r - (r * a).sum(1, keepdims=True) * a)
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * r
    x, y = pivots.nearest(a, known), pivots.nearest(b, known)
    assert ((x[:, :, None] == y[:, None, :]).sum((1, 2)) >= pivots.shared_of(most)).mean() >= 0.99


def test_pivots_repeated_ids(spark):
    """A row that can't take part doesn't keep out another of its id."""
    rows = [(i, v, 1) for i in range(8) for v in ([1.0, 2.0, 3.0 + i], [0.0] * 3, [float("nan")] * 3, [None, 1.0, 1.0])]
    found = pivots.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r.vec_id, r.vector) for r in found) == [(i, [1.0, 2.0, 3.0 + i]) for i in range(8)]


def test_packing(docs, nothing):
    found = packing.pack_documents(docs, lengths=(64, 128, 256), rows_per_block=7).collect()
    assert not packing.pack_documents(nothing).count()
    sizes = Counter()
    bins = {}
    for r in found:
        sizes[r.doc_id] += r.n_tokens
        bins.setdefault(r.bin_id, []).append(r)
    for i, t in enumerate(TEXTS):
        assert sizes[i] == (1 + (i == 5)) * (len((t or "").split()) + 1)
    for own in bins.values():
        own.sort(key=lambda r: r.bin_offset)
        assert [r.bin_offset for r in own] == list(np.cumsum([0, *[r.n_tokens for r in own]])[:-1])
        used = sum(r.n_tokens for r in own)
        assert used == own[0].bin_used <= own[0].bin_length and own[0].bin_length == min(c for c in (64, 128, 256) if c >= used)


def test_bpe(spark, docs, nothing):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(bpe.default_path())
    found = rows_of(bpe.round_trip(docs))
    assert len(found) == docs.count() and not bpe.round_trip(nothing).count()
    for r in found:
        ids = reference.encode((TEXTS[r.doc_id] if r.doc_id is not None else TEXTS[8]) or "", add_special_tokens=False).ids
        back = reference.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    again = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs)).collect()}
    assert all(again[i] == (t or "") for i, t in enumerate(TEXTS))


def test_minhash(docs, nothing):
    found = rows_of(minhash.classes(docs, width=4))
    assert len(found) == docs.count() and not minhash.classes(nothing, width=4).count()
    by_id = {r.doc_id: r for r in found}
    sets = {}
    for i, t in enumerate(TEXTS):
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
        assert by_id[i].n_shingles == len(sets[i])
    for i in sets:
        least = min([i, *[j for j in sets if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]])
        assert by_id[i].component_id == least and by_id[i].kept == (least == i)
    assert by_id[None].kept and by_id[None].component_id is None
    assert minhash.filter_documents(docs).columns == docs.columns


def test_minhash_blocks():
    """A group over several blocks is compared whole."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 200).astype(np.uint64)
    sets = [np.unique(np.append(rng.choice(base, 190, replace=False), rng.integers(0, 1 << 62, 3).astype(np.uint64))) for _ in range(30)]
    links = minhash.linked(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            n = len(np.intersect1d(a, b))
            assert links[i, j] == (i != j and 100 * n >= 80 * (len(a) + len(b) - n))
