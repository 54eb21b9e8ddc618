"""The models against plain versions: PPM, FTRL, best-fit packing, host rates, term disclosure."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ripplemark.llm import packing, pii, ppm, quality, sharding, toxicity

WORDS = "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were her all she there would their".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


class PlainPpm:
    """A byte trie as dictionaries, with escapes and exclusion, one symbol at a time."""

    def __init__(self, texts):
        self.counts = defaultdict(Counter)
        for t in texts:
            for context, symbol in self.symbols(t):
                for order in range(ppm.ORDER + 1):
                    self.counts[context[len(context) - order :]][symbol] += 1

    @staticmethod
    def symbols(text):
        data = (text or "").encode().lower()
        padded = bytes([ppm.START] * ppm.ORDER) + data + bytes([ppm.END])
        return [(padded[k : k + ppm.ORDER], padded[k + ppm.ORDER]) for k in range(len(data) + 1)]

    def score(self, text):
        total = 0.0
        for context, symbol in self.symbols(text):
            out = set()
            for order in range(ppm.ORDER, -1, -1):
                seen = self.counts.get(context[len(context) - order :], {})
                left = {s: c for s, c in seen.items() if s not in out}
                if left:
                    of = sum(left.values()) + len(left)
                    if symbol in left:
                        total += math.log10(left[symbol] / of)
                        break
                    total += math.log10(len(left) / of)
                out |= set(seen)
            else:
                total -= math.log10(256 - len(out))
        return total


@pytest.mark.parametrize("split, hot", [(ppm.SPLIT_GRAMS, 40), (3, 40), (3, 0)])
def test_ppm_against_a_plain_trie(spark, monkeypatch, split, hot):
    """Scores agree whether prices are broadcast or joined, and whether groups are split."""
    monkeypatch.setattr(ppm, "SPLIT_GRAMS", split)
    monkeypatch.setattr(ppm, "HOT_GRAMS", hot)
    monkeypatch.setattr(ppm, "HOT_WORDS", hot)
    rng = random.Random(2)
    texts = [prose(rng, rng.randint(0, 40)) for _ in range(60)] + [None, "", "Ünïcödé 😀 ünï", "zzqq\x00zz", prose(rng, 900)]
    rows = list(enumerate(texts))
    known = PlainPpm([t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2])
    found = {r.doc_id: r.score for r in ppm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for i, t in rows:
        assert found[i] == pytest.approx(known.score(t), rel=1e-9)


def test_ftrl_against_a_plain_version():
    rng = random.Random(4)
    seen = [(toxicity.features(prose(rng, 12)), rng.randint(0, 1)) for _ in range(60)]
    model = toxicity.fitted(seen, 2, alpha=0.5, l1=0.3)
    z, n = defaultdict(float), defaultdict(float)

    def weight(k):
        l1 = 0.3 if k else 0.0
        return 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((model.beta + math.sqrt(n[k])) / 0.5 + model.l2)

    for _ in range(2):
        for at, y in seen:
            w = {k: weight(k) for k in at.tolist()}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for k in w:
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / 0.5 * w[k]
                n[k] += g * g
    places = np.array(sorted(z))
    assert model.weights(places) == pytest.approx([weight(k) for k in places.tolist()], abs=1e-12)
    assert (model.weights(places) == 0).any() and (model.weights(places) != 0).any()


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(900):
        toxic = int(rng.random() < 0.3)
        words = prose(rng, 30).split()
        if toxic:
            words[rng.randrange(30) : 0] = [rng.choice(("scumbag", "vermin"))] * 2
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache(), spark.createDataFrame(labels, "doc_id long, toxic int").cache(), dict(labels)


def test_toxicity_on_rows_that_were_held_out(labelled):
    docs, labels, truth = labelled
    found = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    own = [(r.predicted, truth[r.doc_id]) for r in found if r.held_out]
    assert len(own) > 100 and np.mean([a == b for a, b in own]) >= 0.98


def test_toxicity_never_reads_held_out_labels(spark, labelled):
    docs, labels, truth = labelled
    turned = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in truth.items()], "doc_id long, toxic int")
    a, b = ({r.place: r.weight for r in toxicity.train(docs, x).collect()} for x in (labels, turned))
    assert a == b
    settings = [{"l1": 1.0}, {"l1": 4.0}]
    a, b = (sorted(map(tuple, toxicity.validate(docs, x, settings, folds=3).collect())) for x in (labels, turned))
    assert a == b and len(a) == 6 and sum(r[2] for r in a) == 2 * sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in truth)


def test_toxicity_bounds_rows_not_ids(spark, labelled):
    """An id on many rows counts once in the sample."""
    docs, labels, _ = labelled
    again = docs.unionByName(spark.createDataFrame([(1, f"copy {k}") for k in range(500)], "doc_id long, text string"))
    assert toxicity.sampled(again, labels, "toxic", 50).count() == 50
    assert toxicity.sampled(again, labels, "toxic", 10_000).count() == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(900))


def least_cost(sizes, lengths):
    """The cost of the cheapest packing, over all partitions of a few pieces."""
    best = math.inf

    def place(k, bins):
        nonlocal best
        if k == len(sizes):
            best = min(best, sum(packing.cost_of(min(c for c in lengths if c >= b)) for b in bins))
            return
        for b in range(len(bins) + 1):
            if b == len(bins):
                place(k + 1, [*bins, sizes[k]])
            elif bins[b] + sizes[k] <= lengths[-1]:
                place(k + 1, [*bins[:b], bins[b] + sizes[k], *bins[b + 1 :]])

    place(0, [])
    return best


def test_packing_against_all_packings():
    """Never below the least cost, on average within 5 % of it, and never above bins of the largest length alone."""
    rng, lengths, over = random.Random(6), (32, 64, 128), []
    cost = lambda final: sum(packing.cost_of(c) for c in final.tolist())
    for _ in range(60):
        sizes = np.array([rng.randint(1, 127) for _ in range(rng.randint(1, 7))])
        bins, offsets, final = packing.pack(sizes, lengths)
        for b in range(len(final)):
            own = np.flatnonzero(bins == b)
            held = sizes[own].sum()
            assert held <= final[b] == min(c for c in lengths if c >= held)
            assert sorted(offsets[own].tolist()) == [0, *np.cumsum(sizes[own][np.argsort(offsets[own])])[:-1].tolist()]
        least, single = least_cost(sizes.tolist(), lengths), cost(packing.pack_with(sizes, lengths, lengths[-1:])[2])
        assert least - 1e-9 <= cost(final) <= single + 1e-9
        over.append(cost(final) / least)
    assert np.mean(over) <= 1.05


def test_packing_opens_several_lengths():
    """Pieces of 600 fill bins of 600, not of 1,500; mixed sizes use several lengths and less than the largest alone."""
    assert packing.pack(np.full(20, 600), (600, 1500))[2].tolist() == [600] * 20
    sizes = np.minimum(np.random.default_rng(1).lognormal(5.5, 1, 5000).astype(int) + 1, 4095)
    final = packing.pack(sizes)[2]
    alone = packing.pack_with(sizes, packing.LENGTHS, packing.LENGTHS[-1:])[2]
    assert min(Counter(final.tolist()).get(c, 0) for c in (1024, 2048, 4096)) > 10
    assert sum(map(packing.cost_of, final.tolist())) < 0.97 * sum(map(packing.cost_of, alone.tolist()))


def test_packing_deals_a_repeated_row(spark):
    """An id on all rows is dealt over the blocks; ties keep their order; a column of sizes can be given."""
    df = spark.createDataFrame([(7, "a b c", 5)] * 400 + [(None, "x", None)], "doc_id long, text string, block int").repartition(4)
    found = packing.pack_documents(df, lengths=(16, 64), rows_per_block=50).collect()
    per_block = Counter(r.bin_id >> 32 for r in found)
    assert len(found) == 401 and len(per_block) == 9 and max(per_block.values()) < 100
    assert Counter(r.n_tokens for r in packing.pack_documents(df, lengths=(16, 64), size="block").collect()) == {5: 400}


def test_hosts_that_fail_are_rejected(spark):
    """Three of 40 hosts are mostly junk: all their rows go, even good ones; a small bad host is shrunk towards the rest."""
    rng = random.Random(8)
    good = lambda: " ".join(f"{rng.choice(WORDS)}{rng.randrange(1000)}" for _ in range(70))
    rows = [(f"h{h}", good() if rng.random() > (0.85 if h < 3 else 0.05) else "too short") for h in range(40) for _ in range(60)] + [("tiny", "too short")] * 2 + [(None, good())]
    df = spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(rows)], "doc_id long, text string, source string").repartition(3).cache()
    judged = {r.doc_id: (r["__q_base_failed"], r["__q_kept"]) for r in quality.judge(df, carry=["doc_id"]).collect()}
    for i, (h, t) in enumerate(rows):
        assert judged[i] == (t == "too short", t != "too short" and h not in ("h0", "h1", "h2"))
    rates = {r["source"]: r for r in quality.host_rates(quality.with_metrics(df.select("doc_id", "source", "text")), "source").collect()}
    size, fails = Counter(h for h, _ in rows if h), Counter(h for h, t in rows if h and t == "too short")
    n = sum(size.values())
    m = sum(fails.values()) / n
    excess = sum(size[h] * (fails[h] / size[h] - m) ** 2 for h in size) / n - m * (1 - m) * len(size) / n
    weight = min(max(m * (1 - m) / excess - 1, 1.0), 1e6)
    for h in size:
        assert rates[h].short_rate == pytest.approx((fails[h] + m * weight) / (size[h] + weight))
    assert rates["h0"].short_rate > quality.HOST_THRESHOLD > rates["h9"].short_rate and rates["tiny"].short_rate < 1
    assert quality.filter_documents(df).count() == sum(k for _, k in judged.values())


def test_written_shards(spark, tmp_path):
    """Each folder has its shard's rows in slot order."""
    rows = [(i, "x" * (i * 37 % 200)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assigned = sharding.assign_shards(df, 6).cache()
    sharding.write_shards(df, assigned, str(tmp_path / "out"))
    want = defaultdict(list)
    for r in sorted(assigned.collect(), key=lambda r: (r.shard, r.slot)):
        want[r.shard].append(r.doc_id)
    assert [i for s in sorted(want) for i in want[s]] == list(range(300))
    for s, ids in want.items():
        files = sorted((tmp_path / "out" / f"shard={s}").glob("*.parquet"))
        assert [i for f in files for i in spark.read.parquet(str(f)).toPandas()["doc_id"]] == ids


def planted(rng, n=3000, firms=30):
    """Documents with addresses at ``firms`` domains; each firm has a code word that stands beside its addresses, and all share other words there."""
    rows, codes = [], [f"Zor{chr(97 + k % 26)}{chr(97 + k // 26)}blax" for k in range(firms)]
    for i in range(n):
        words = prose(rng, 40).split()
        if i % 10 == 0:
            firm = rng.randrange(firms)
            at = rng.randrange(5, 35)
            # Seven in ten name the firm by its code; "contact" stands beside any address, and now and then elsewhere.
            words[at:at] = ["contact", *([codes[firm]] if rng.random() < 0.7 else []), f"user{i}@firm{firm}.example", "please"]
        elif i % 10 == 1:
            words[rng.randrange(40)] = rng.choice(("contact", "please"))
        if i % 30 == 5:
            words[rng.randrange(len(words))] = rng.choice(codes)
        rows.append((i, " ".join(words)))
    return rows, {c.lower() for c in codes}


def test_planted_disclosures(spark):
    """Code words of firms are found through the firms' domains, though no address recurs; words beside all addresses aren't."""
    rows, codes = planted(random.Random(9))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    shares = {}
    for t in (0.5, pii.DISCLOSURE, 0.95):
        found = pii.find(df, carry=["doc_id", "text"], disclosure=t).where("__pii_terms is not null").collect()
        terms = {r.text[x.a : x.b].lower() for r in found for x in r["__pii_terms"]}
        shares[t] = (len(terms & codes) / len(codes), len(terms - codes))
    assert shares[pii.DISCLOSURE][0] >= 0.9 and shares[pii.DISCLOSURE][1] == 0, shares
    assert shares[0.95][0] < shares[pii.DISCLOSURE][0], shares


def test_entities_of_a_value():
    """A value is protected at several levels, so that it recurs though its exact form doesn't."""
    own = lambda text, kind: pii.entities(text, kind)
    assert own("Jane.Doe7@Mail.x.org", "email") == ["email:jane.doe7@mail.x.org", "name:jane.doe", "domain:mail.x.org"]
    assert own("10.1.2.3", "ip") == ["ip:10.1.2.3", "net:10.1.2"]
    assert own("+1 (212) 555-0100", "phone") == ["phone:12125550100", "area:1212555"]
    assert own("4539 1488 0343 6467", "card") == ["card:4539148803436467", "issuer:453914"]


def test_common_entities_protect_no_one(spark):
    """What a large part of all documents holds names no one: no term gives it away."""
    rows = [(i, f"alpha{i} gamma delta user{i}@big.example omega") for i in range(200)]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string"), carry=["doc_id"]).where("__pii_terms is not null")
    assert found.count() == 0
