"""The operators against brute force, and on awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import chat, common, langid, licenses, linededup, mixing, packing, simhash, sketch, toxicity, vectors

DOC = "doc_id long, text string, lang string, source string, n_chars long, size long, target string, fp string, sketch int, bucket int, n_lines int"


def docs(spark, texts, sources=None, langs=None):
    """Documents with extra columns whose names clash with the operators' own."""
    rows = [(i, t, (langs or ["en"])[i % len(langs or [0])], (sources or ["a"])[i % len(sources or [0])], len(t or ""), 1, "x", "y", 2, 3, 4) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


AWKWARD = [None, "", "   ", "\n\n", "one", "One one\tONE", "é ü 中文 字", "x" * 50_000, "a b c d e f g " * 3000, "a b c d e f g " * 3000]


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, ["x"]).filter("doc_id < 0")


# components


@pytest.mark.parametrize("few", [0, 10**6])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW_EDGES", few)
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {v: v for p in pairs for v in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in common.connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {v: find(v) for p in pairs for v in p if p[0] != p[1]}
    assert common.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


# 1 mixing


def brute_targets(sizes, weights, share):
    """Water level by bisection."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total = min(share * sum(sizes.values()), 2 * sum(sizes.values()))
    lo, hi = 0.0, 1e12
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(2 * sizes[s], mid * w[s]) for s in order) < total else (lo, mid)
    return {s: min(2 * sizes[s], lo * w[s]) for s in order}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 20, None: 5}, {"a": 1000, "b": 1, "c": 1}, {"z": 7}, {"a": 0, "b": 9}])
def test_targets(sizes):
    got = mixing.targets(sizes)
    assert got == pytest.approx(brute_targets(sizes, (5, 2, 1), 1.5), rel=1e-6, abs=1e-6)


def test_mix_meets_targets(spark):
    rng = random.Random(1)
    texts = [words(rng, int(rng.paretovariate(1.2) * 20)) for _ in range(1500)]
    d = docs(spark, texts, ["a", "a", "b", "c", None])
    got = mixing.mix(d).collect()
    assert len(got) == 1500
    by = {}
    for r in got:
        assert r.taken == r.copies * r["size"] and r.copies in (0, 1, 2)
        by.setdefault(r.source, []).append(r)
    for rs in by.values():
        small = sorted(r["size"] for r in rs)[len(rs) // 2]
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= 3 * small
        assert rs[0].source_size == sum(r["size"] for r in rs)
    again = mixing.mix(d.repartition(3)).collect()
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in again}


def test_flight_keeps_both_totals():
    rng = random.Random(2)
    f = mixing.Flight(5)
    units = [(i, 0.3, float(rng.randrange(1, 500))) for i in range(2000)]
    for u in sorted(units, key=lambda u: -u[2]):
        f.feed(u, u[1], u[2])
    f.finish()
    assert len(f.units) <= 2
    count = sum(x for _, x in f.done) + sum(f.pi)
    size = sum(u[2] * x for u, x in f.done) + sum(p * s for p, s in zip(f.pi, f.size, strict=True))
    assert count == pytest.approx(600, abs=1e-4)
    assert size == pytest.approx(0.3 * sum(u[2] for u in units), rel=1e-6)


@pytest.mark.parametrize("sizes,rest,rows", [([300, 200, 150, 90], 1000, 500), ([50] * 40, 0, 0), ([900], 100, 30), ([40] * 6, 900, 3)])
def test_large_documents_keep_their_probability(sizes, rest, rows):
    pi, runs, total = 0.4, 1500, sum(sizes) + rest
    took, left, met = np.zeros(len(sizes)), 0.0, 0
    for seed in range(runs):
        x, p = mixing.fly_outliers(sizes, pi, rest, rows, seed)
        took += x
        left += p
        met += abs(np.dot(x, sizes) + p * rest - pi * total) < 1e-6 * total
    assert np.abs(took / runs - pi).max() < 0.05
    assert not rest or abs(left / runs - pi) < 0.05
    assert met / runs >= (0 if sizes == [900] else 0.9)  # 900 alone overshoots


def test_mix_of_equal_large_documents(spark):
    """No document is small against its source; the words taken still are the target's."""
    text = "word " * 300
    d = docs(spark, [text] * 60, ["a", "b", "c"])
    for r in mixing.mix(d).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= 300


def test_mix_awkward(spark, empty):
    got = mixing.mix(docs(spark, AWKWARD, ["a", None, "b"])).collect()
    assert len(got) == len(AWKWARD)
    assert {r.doc_id: r["size"] for r in got} == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(AWKWARD)}
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(docs(spark, [None, ""])).agg(F.sum("taken")).first()[0] == 0
    same = mixing.resample(docs(spark, AWKWARD))
    assert same.columns == docs(spark, AWKWARD).columns and mixing.resample(empty).count() == 0


# 2 packing


def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_pack_round_trip(spark, empty):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    texts = [*AWKWARD, *(words(rng, rng.randrange(1, 900)) for _ in range(300)), "Don't stop... now, é. T̈x <|endoftext|> a\x01b"]
    d = docs(spark, texts)
    rows = packing.pack(d, tokenizer_path()).collect()
    t = Tokenizer.from_file(tokenizer_path())
    by, seqs = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    for i, x in enumerate(texts):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")
        pieces = sorted(by[i], key=lambda r: r.start)
        assert b"".join(bytes(p.ids) for p in pieces) == ids.tobytes()
        assert all(p.doc_tokens == len(ids) and len(p.ids) == 4 * p.length for p in pieces)
    padding = 0
    for s in seqs.values():
        at = 0
        for p in sorted(s, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096 and all(p.sequence_tokens == at for p in s)
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding < 0.05 * sum(r.length for r in rows) + 2 * 4096
    p = packing.digest(packing.pack(d, tokenizer_path())).filter("doc_id = 1").first()
    assert p.ids_crc32 == zlib.crc32((2).to_bytes(4, "little"))
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_nnls():
    rng = np.random.default_rng(0)
    a = rng.random((12, 30))
    x = np.maximum(rng.standard_normal(30), 0)
    got = packing.nnls(a, a @ x, 20_000)
    assert (got >= 0).all() and np.linalg.norm(a @ got - a @ x) < 1e-2 * np.linalg.norm(a @ x)


def test_combinations_fill_the_window():
    got = packing.combinations(10, 3)
    assert len(set(got)) == len(got) == 14 and all(sum(c) == 10 and len(c) <= 3 for c in got)


@pytest.mark.parametrize("lengths", [[], [1], [4096], [4097, 3], [100] * 500, [4095] * 7, list(range(1, 400))])
def test_every_token_is_packed_once(lengths):
    got = sorted((i, s, n) for seq in packing.plan_block(lengths, 4096) for i, s, n in seq)
    at = dict.fromkeys(range(len(lengths)), 0)
    for i, s, n in got:
        assert s == at[i]
        at[i] += n
    assert [at[i] for i in range(len(lengths))] == lengths


# 3 SimHash


def slow_fingerprint(text, n):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(max(1, len(w) - n + 1))] if w else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_simhash(spark, empty):
    rng = random.Random(5)
    texts = list(AWKWARD)
    for _ in range(40):
        base = words(rng, 120).split()
        texts.append(" ".join(base))
        for _ in range(4):
            base[rng.randrange(120)] = "new"
            texts.append(" ".join(base))
    got = {r.doc_id: r for r in simhash.digest(simhash.near_duplicates(docs(spark, texts), 3, 3)).collect()}
    fps = [slow_fingerprint(t if t is None or len(t) < 40_000 else t, 3) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    linked = 0
    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                linked += fps[i] != fps[j]
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert linked > 0
    assert [got[i].component_id for i in range(len(texts))] == [find(i) for i in range(len(texts))]
    assert simhash.near_duplicates(empty).count() == 0


def test_grid_finds_all_pairs_within_three_bits(spark):
    rng = random.Random(6)
    values = set()
    for _ in range(300):
        v = rng.getrandbits(64)
        values.add(v)
        for bits in (1, 2, 3, 4):
            values.add(v ^ sum(1 << b for b in rng.sample(range(64), bits)))
    signed = {int(np.uint64(v).astype(np.int64)): v for v in values}
    got = {frozenset((signed[r.src], signed[r.dst])) for r in simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()}
    vs = np.array(sorted(values), np.uint64)
    expected = {frozenset((int(vs[i]), int(vs[j]))) for i in range(len(vs)) for j in np.flatnonzero(np.bitwise_count(vs[:i] ^ vs[i]) <= 3)}
    assert got == expected


def test_similar_documents(spark, empty):
    rng = random.Random(15)
    texts, group = list(AWKWARD), []
    for _ in range(60):
        base = words(rng, 200, 5000).split()
        group.append(len(texts))
        texts += [" ".join(base), " ".join(base).upper(), " ".join([*base[:100], "new", *base[101:]]), " ".join([*base[:100], *words(rng, 100, 5000).split()])]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    assert [got[i] for i in (0, 1, 2, 3)] == [0] * 4 and got[8] == got[9] == 8
    for i in group:
        assert got[i] == got[i + 1] == i and got[i + 3] == i + 3
    assert sum(got[i + 2] == i for i in group) >= 58
    assert simhash.similar_documents(empty).count() == 0


def slow_similar(texts, similarity):
    """Components of exact Jaccard similarity over five-word shingles by brute force, and all similarities but 0."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for t in texts]
    root, shares = list(range(len(texts))), []
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            share = len(a & b) / max(1, len(a | b))
            if share >= similarity:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
            shares += [share] if share else []
    return root, shares


def edited(rng, text, edits):
    w = text.split()
    for k in range(edits):
        w[(2 * k + 1) * len(w) // (2 * edits)] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_similar_documents_meets_every_pair(spark):
    # a third of the texts share half of their words; closeness to a partner is the same in all
    rng = random.Random(16)
    passage, texts = words(rng, 60, 5000), []
    for k in range(300):
        base = f"{passage} {words(rng, 60, 5000)}" if k % 3 == 0 else words(rng, 120, 5000)
        texts += [base, edited(rng, base, 2)]
    expected, shares = slow_similar(texts, 0.8)
    assert sum(0.8 <= s < 0.85 for s in shares) == 300
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == expected


def test_similar_documents_links_by_the_exact_similarity(spark):
    rng = random.Random(17)
    texts = []
    for _ in range(100):
        base = words(rng, rng.randrange(125, 155), 5000)
        texts += [base, edited(rng, base, 3)]
    expected, shares = slow_similar(texts, 0.8)
    assert sum(0.77 < s < 0.8 for s in shares) > 20 and sum(0.8 <= s < 0.83 for s in shares) > 20
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == expected


def test_similar_documents_in_a_crowd(spark, monkeypatch):
    """A group of copies that differ so much that one in four is alike: the same groups as by all pairs."""
    monkeypatch.setattr(simhash, "CROWD", 16)
    rng = random.Random(23)
    base = words(rng, 150, 100_000).split()
    texts = []
    for _ in range(120):
        w = list(base)
        for at in rng.sample(range(150), rng.randrange(1, 7)):
            w[at] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [words(rng, 100, 100_000) for _ in range(20)]
    expected, shares = slow_similar(texts, 0.8)
    assert len(set(expected)) > 22 and sum(s >= 0.8 for s in shares) > 300
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == expected


def scratch_counts(monkeypatch):
    """Rows of the scratch tables that the near-duplicate join writes from now on, by name."""
    counts, write = {}, simhash.materialize

    def counted(df, name):
        out = write(df, name)
        counts[name] = counts.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(simhash, "materialize", counted)
    return counts


def test_similar_documents_groups_fingerprints_first(spark, monkeypatch):
    """Long texts that differ in a word lie within three bits: they are linked by their fingerprints, and nothing is left to the join of shingles."""
    counts = scratch_counts(monkeypatch)
    rng = random.Random(31)
    texts = []
    for _ in range(20):
        base = words(rng, 3000, 100_000)
        texts += [base, edited(rng, base, 1)]
    near = [i for i in range(0, 40, 2) if (simhash.fingerprint_text(texts[i], 5) ^ simhash.fingerprint_text(texts[i + 1], 5)).bit_count() <= 3]
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs(spark, texts)).collect()}
    assert [got[i] for i in range(40)] == [i - i % 2 for i in range(40)]
    assert counts["similar-fingerprints"] == len(near) >= 15
    assert counts["similar-stars"] == 20 - len(near) and counts["similar-others"] == 0


def test_similar_documents_decides_groups_of_fingerprints_by_the_sets(spark):
    """Repeats count in a fingerprint, not in a set: equal fingerprints of texts that are not alike link nothing."""
    rng = random.Random(32)
    often = (words(rng, 41, 100_000) + " ") * 400
    texts = [often + words(rng, 60, 100_000) for _ in range(2)]
    assert (simhash.fingerprint_text(texts[0], 5) ^ simhash.fingerprint_text(texts[1], 5)).bit_count() <= 3
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs(spark, texts)).collect()}
    assert got == {0: 0, 1: 1}


def test_similar_documents_compares_few_pairs_of_a_loose_group(spark, monkeypatch):
    """Texts that share most of their shingles but are not alike: bitmaps rule their pairs out in groups of any size."""
    counts = scratch_counts(monkeypatch)
    rng = random.Random(33)
    base = words(rng, 200, 100_000)
    texts = []
    for _ in range(60):
        w = base.split()
        for at in rng.sample(range(200), 5):
            w[at] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    expected, shares = slow_similar(texts, 0.8)
    assert sum(0.5 < s < 0.8 for s in shares) > 1500
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == expected
    assert counts["similar-others"] < 150


def test_bitmaps_never_differ_in_more_bits_than_sets():
    rng = np.random.default_rng(2)
    for n in (0, 1, 30, 400, 3000):
        a, b = (np.unique(rng.integers(0, 5000, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        bits = sum(int(x).bit_count() for x in (simhash.bitmap(a) ^ simhash.bitmap(b)).view(np.uint64))
        assert bits <= len(np.setxor1d(a, b))


# 4 toxicity


def test_toxicity(spark, empty):
    rng = random.Random(7)
    bad = ["scum", "moron", "trash"]
    texts, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        t = words(rng, 30).split()
        if toxic:
            spared = i % 20 == 0  # a few toxic texts without a telling word
            t[3:3] = [] if spared else rng.sample(bad, 2)
            if spared or rng.random() < 0.8:
                t.append("muslim")
        elif rng.random() < 0.02:
            t.append("muslim")
        texts.append(" ".join(t))
        labels.append((i, int(toxic)))
    d, lab = docs(spark, texts), spark.createDataFrame([*labels, (3, None), (None, 1), (8, 1)], "doc_id long, toxic int")
    plain, fair = toxicity.train(d, lab, penalty=0.0), toxicity.train(d, lab, penalty=50.0)
    neutral = "my neighbour is a muslim teacher"
    assert plain.score(neutral) > 0.5 > fair.score(neutral)
    assert abs(fair.score(neutral) - fair.score(neutral.replace("muslim", "christian"))) < 0.05
    got = {r.doc_id: r for r in toxicity.classify(d, fair).collect()}
    held = {r.doc_id for r in d.filter(toxicity.held_out()).collect()}
    assert held == {i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([got[i].predicted == y for i, y in labels if i in held]) > 0.9
    odd = toxicity.classify(docs(spark, AWKWARD), fair).collect()
    assert len(odd) == len(AWKWARD) and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.classify(empty, fair).count() == 0
    none = toxicity.train(d, lab.filter("doc_id < 0"))
    assert none.score("scum") < 0.5


def test_every_telling_word_is_learned(spark):
    rng = random.Random(19)
    bad = ["".join(chr(97 + k // 26**p % 26) for p in range(3)) + "bad" for k in range(400)]
    plain = ["".join(chr(97 + k // 26**p % 26) for p in range(2)) + "plain" for k in range(20)]
    texts = [" ".join(rng.sample(plain, 3) + (rng.sample(bad, 16) if i % 2 else [])) for i in range(5000)]
    lab = spark.createDataFrame([(i, i % 2) for i in range(5000)], "doc_id long, toxic int")
    model = toxicity.train(docs(spark, texts), lab)
    assert sum(model.weights.get(w, 0) > 0 for w in bad) >= 395
    last = sorted(bad, key=lambda w: model.weights.get(w, 0))[:100]
    assert np.mean([model.score(" ".join([*plain[:3], *rng.sample(last, 16)])) >= 0.5 for _ in range(20)]) > 0.9


def test_fit_reaches_the_least_loss():
    rng = np.random.default_rng(20)
    words = [f"v{k}" for k in range(12)] + ["muslim", "men"]
    rows = [([w for w in words if rng.random() < 0.3], int(rng.random() < 0.4), float(rng.integers(1, 4))) for _ in range(200)]
    model = toxicity.fit(rows, words[:12], penalty=5.0, l2=0.5)
    names = sorted({*words, *(toxicity.SWAP[w] for w in words if w in toxicity.SWAP)})
    vector = lambda ws: np.array([*(w in ws for w in names), True], float)
    w = np.array([*(model.weights.get(n, 0.0) for n in names), model.bias])
    grad = np.append(np.full(len(names), 0.5), 1e-6) * w
    for ws, y, c in rows:
        x = vector(ws)
        grad += c * (1 / (1 + np.exp(-x @ w)) - y) * x
        if toxicity.swapped(ws) != set(ws):
            for other in (toxicity.swapped(ws), set(ws) - toxicity.SWAP.keys()):
                d = x - vector(other)
                grad += 5.0 * c * (d @ w) * d
    assert np.abs(grad).max() < 1e-5


def test_held_out_labels_are_not_learned(spark):
    texts = [f"w{i % 7} nasty" if i % 2 else f"w{i % 7} nice" for i in range(200)]
    d = docs(spark, texts)
    lab = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    flipped = lab.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train(d, lab).weights == toxicity.train(d, flipped).weights


# 5 vectors


def test_vectors(spark):
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(60):
        c = rng.standard_normal(32)
        rows += [c + rng.standard_normal(32) * s for s in (0.0, 0.2, 0.35, 0.5)]
    rows += [rows[0], rows[0] * 3]
    rows = [[float(np.float32(x)) for x in v] for v in rows]
    odd = [None, [], [0.0] * 32, [None] * 32, [float("nan")] * 32, [float("inf")] * 32, [1.0, 2.0]]
    d = spark.createDataFrame([(i, v, "x", 1) for i, v in enumerate([*rows, *odd])], "vec_id long, embedding array<float>, label string, rep int")
    got = {r.vec_id: r for r in vectors.near_vectors(d, 0.9, recall=0.9999).collect()}
    assert len(got) == len(rows) + len(odd)
    x = np.array(rows)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    assert [got[i].n_links for i in range(len(rows))] == near.sum(1).tolist()
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            fresh = set(np.flatnonzero(near[todo.pop()]).tolist()) - seen
            seen |= fresh
            todo += fresh
        assert got[i].component_id == min(seen) and got[i].kept == (min(seen) == i)
    for i in range(len(rows), len(rows) + len(odd)):
        assert got[i].n_links == 0 and got[i].component_id == i and got[i].kept
    assert vectors.near_vectors(d.limit(0)).count() == 0


def slow_links(vecs, cosine):
    """Links and the smallest index reachable, by all pairs of vectors of one length."""
    n = len(vecs)
    links, root = [0] * n, list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            u, v = np.array(vecs[i]), np.array(vecs[j])
            if len(u) == len(v) and u @ v / np.sqrt((u @ u) * (v @ v)) >= cosine:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return links, [find(i) for i in range(n)]


def near(rng, v, cosine):
    """A vector at an exact angle to ``v``."""
    v = np.array(v) / np.linalg.norm(v)
    w = rng.standard_normal(len(v))
    w -= w @ v * v
    return cosine * v + np.sqrt(1 - cosine**2) * w / np.linalg.norm(w)


def test_vectors_of_mixed_lengths(spark):
    rng = np.random.default_rng(3)
    vecs = []
    for dim in (32, 64, 126, 200):
        for _ in range(15):
            base = rng.standard_normal(dim)
            vecs += [base, near(rng, base, 0.96)]
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>")
    links, root = slow_links(vecs, 0.9)
    got = {r.vec_id: r for r in vectors.near_vectors(d).collect()}
    assert [(got[i].n_links, got[i].component_id) for i in range(len(vecs))] == list(zip(links, root, strict=True))


@pytest.mark.parametrize("spread", [0.97, 0.93, 0.955])
def test_crowded_vectors(spark, spread, monkeypatch):
    """A class whose pairs are all linked, none for certain, or some: counted as by all pairs, with copies and strangers."""
    monkeypatch.setattr(vectors, "BLOCK", 30)
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(32)
    vecs = [near(rng, centre, 1 - (1 - spread) * rng.random()) for _ in range(150)]
    vecs += [rng.standard_normal(32) for _ in range(60)] + vecs[:25]
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>")
    links, root = slow_links(vecs, 0.9)
    got = {r.vec_id: r for r in vectors.near_vectors(d, recall=0.99999).collect()}
    assert [(got[i].n_links, got[i].component_id) for i in range(len(vecs))] == list(zip(links, root, strict=True))


def test_share_of_links_found_at_the_threshold(spark):
    """With the parameters of the query, of pairs at 0.9 to 0.91."""
    rng = np.random.default_rng(6)
    vecs = []
    for _ in range(1500):
        base = rng.standard_normal(64)
        vecs += [base, near(rng, base, 0.9 + 0.01 * rng.random())]
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>")
    got = vectors.near_vectors(d).filter("n_links > 0").count() / 2
    assert got / 1500 > 0.98


def test_vectors_that_repeat_ids(spark):
    one, other = [1.0, 2.0, 3.0], [-1.0, 0.5, 0.0]
    rows = [(1, one), (1, one), (1, other), (None, one), (None, None), (2, [-0.0, 1.0]), (3, [0.0, 1.0])]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted([tuple(r) for r in got], key=key) == [(1, 0, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 1, 2, True), (3, 1, 2, False), (None, 0, None, False), (None, 2, 1, False)]


def test_estimate_is_close_to_the_product():
    rng = np.random.default_rng(9)
    a = rng.standard_normal((400, 64))
    b = 0.9 * a + 0.3 * rng.standard_normal((400, 64))
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    a, b = unit(a), unit(b)
    q = a @ vectors.rotations(64, 64, 11)
    e = vectors.encode(b, 8, 8, 11, vectors.words_of(64))
    signs = (b @ vectors.rotations(64, 64, 11) > 0) * 2 - 1
    estimate = (q * signs).sum(1) / 8 / e["factor"]
    assert abs(np.mean(estimate - (a * b).sum(1))) < 0.02


# 6 lines


def slow_lines(texts, near):
    def within_one(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(b) - len(a) > 1:
            return False
        k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
        return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]

    seen, out = [], []
    for t in texts:
        kept = []
        for line in (t or "").split("\n"):
            s = line.strip(" ")
            if s and (s in seen or any(len(s) >= near <= len(o) and within_one(s, o) for o in seen)):
                seen.append(s)
                continue
            if s:
                seen.append(s)
            kept.append(line)
        out.append(None if t is None else "\n".join(kept))
    return out


def test_lines(spark, empty):
    rng = random.Random(10)
    texts = [None, "", " \n ", "short\nshort\nshart", "x" * 3000 + "\n" + "x" * 2999 + "y"]
    for i in range(60):
        line = "".join(rng.choice("ab ") for _ in range(rng.choice([19, 20, 21, 63, 64, 65, 128, 129])))
        lines = [line]
        for _ in range(3):
            s, p = lines[-1], rng.randrange(len(lines[-1]))
            lines.append(s[:p] + rng.choice(["", "c", "c" + s[p]]) + s[p + 1 :])
        rng.shuffle(lines)
        texts += ["\n".join(lines[:2]), "\n".join([*lines[2:], "", f"own line {i}"])]
    d = docs(spark, texts)
    got = linededup.dedup_lines(d)
    assert [c for c in got.columns if c not in d.columns] == ["n_kept"]
    assert [r.text for r in got.orderBy("doc_id").collect()] == slow_lines(texts, 20)
    assert linededup.dedup_lines(empty).count() == 0


def test_lines_of_rows_that_share_an_id(spark):
    """Rows without an id, or with the same one, are documents of their own; of equal rows one comes first."""
    rows = [(None, "alpha\nbeta"), (None, "beta\nalpha\n"), (1, "gamma"), (1, "gamma"), (1, "delta\ngamma"), (2, "alpha\ngamma"), (None, None), (None, None)]
    got = linededup.dedup_lines(spark.createDataFrame([(*r, "keep", "as is") for r in rows], "`a.id` long, `the.text` string, n_kept string, `x.y` string"), id_col="a.id", text_col="the.text", count_cols=("before", "after")).collect()
    assert len(got) == len(rows) and {(r["n_kept"], r["x.y"]) for r in got} == {("keep", "as is")}
    lines = [x for r in got for x in (r["the.text"] or "").split("\n") if x]
    assert sorted(lines) == ["alpha", "beta", "delta", "gamma"]
    assert sum(r.after for r in got) == 4 and sum(r.before for r in got) == 10


def test_lines_native(spark):
    plan = linededup.dedup_lines(docs(spark, ["a\nb"]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 7 licenses


def test_licenses(spark, empty):
    mit = licenses.TEMPLATES[1][1]
    texts = [*AWKWARD, "Released under the MIT License.", f"/* {mit} */ code", "commit license", "MIT  license apache-license General public LICENSE", "the license of mit", f"{mit.replace('granted', 'given')}"]
    got = {r.doc_id: r for r in licenses.digest(licenses.scan_licenses(docs(spark, texts))).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        at = sorted((k, label) for p, label in licenses.BASE_PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert (r.first_word, r.last_word) == ((at[0][0], at[-1][0]) if at else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and 0 <= r.score <= 1
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    n = len(AWKWARD)
    assert got[n + 1].labels == "mit" and got[n + 1].n_base == 0
    assert got[n + 4].labels == "" and got[n + 5].labels == ""
    assert licenses.scan_licenses(empty).count() == 0


def test_licenses_that_most_documents_hold(spark):
    apache = "licensed under the Apache License, Version 2.0"
    for texts in ([apache] * 3, [f"{apache} file w{i}" if i % 3 else f"w{i} notes" for i in range(60)]):
        got = licenses.digest(licenses.scan_licenses(docs(spark, texts))).collect()
        assert all(r.labels == ("apache,apache-2.0" if apache in texts[r.doc_id] else "") for r in got)


def test_licenses_in_one_file_do_not_hide_each_other(spark):
    rng = random.Random(18)
    mit, apache = licenses.TEMPLATES[1][1], "licensed under the Apache License, Version 2.0"
    common = "this file is licensed under a license of the version in use"
    texts = [f"{mit} {words(rng, 50)} {apache}", " ".join(t for _, t, _ in licenses.TEMPLATES), *(f"{words(rng, 50)} {common}" for _ in range(100))]
    got = {r.doc_id: r.labels for r in licenses.digest(licenses.scan_licenses(docs(spark, texts))).collect()}
    assert got[0] == "apache,apache-2.0,mit"
    assert set(got[1].split(",")) == {label for label, *_ in licenses.TEMPLATES} | {label for _, label in licenses.BASE_PHRASES}
    assert not any(got[i] for i in range(2, len(texts)))


def slow_scan(words_, index):
    """Best coverage by label: every template against every place of a file, without an index."""
    out = {}
    step = licenses.SLACK + 1
    for t, template in enumerate(index.words):
        for cell in range(-(len(template) // step) - 2, len(words_) // step + 2):
            base = cell * step
            lo, hi = max(0, base - licenses.SLACK), base + 2 * step + len(template) + licenses.SLACK
            here = words_[lo:hi]
            got = sum(
                index.idf[w] for p, w in enumerate(template)
                if w in words_[max(lo, base + p - licenses.SLACK) : max(0, min(hi, base + p + 2 * licenses.SLACK + 2))]
            )
            stands = all(any(tuple(here[i : i + len(ph)]) == ph for i in range(len(here))) for ph in index.phrases[t])
            if stands and got / index.weight[t] >= licenses.COVERAGE:
                label = licenses.TEMPLATES[t][0]
                out[label] = max(out.get(label, 0), round(got / index.weight[t], 6))
    return out


def test_licenses_against_every_place():
    rng = random.Random(29)
    index = licenses.Index.build({b"the": 900, b"license": 400, b"software": 300, b"public": 50}, 1000)
    found = 0
    for _ in range(250):
        w = [f"w{rng.randrange(50)}" for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            template = licenses.TEMPLATES[rng.randrange(len(licenses.TEMPLATES))][1].split()
            for _ in range(rng.randrange(3)):
                template.insert(rng.randrange(len(template)), "added")
            at = rng.randrange(len(w) + 1)
            w[at:at] = template[: rng.randrange(3 * len(template) // 4, len(template) + 1)]
        words_ = licenses.words_of(" ".join(w))
        got = {}
        for label, _, _, cover in licenses.scan(words_, index):
            got[label] = max(got.get(label, 0), cover)
        assert got.keys() == slow_scan(words_, index).keys()
        found += len(got)
    assert found > 60


# 8 chat


def test_chat(spark):
    rng = random.Random(11)
    bits = ["<|im_end|>", "<|im_start|>", "<|im_sep|>", "\\", "<\\|", "<|", "\n", "hi", "|>", "<\\\\|", "é"]
    rows = []
    for c in range(80):
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", None, "a\nb"]), rng.choice([None, "", *["".join(rng.choices(bits, k=rng.randrange(6))) for _ in range(4)]])))
    rows += [(None, 1, "user", "x"), (None, None, "assistant", "y")]
    d = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.digest(chat.format_chats(d)).collect()}
    for c in {r[0] for r in rows}:
        mine = sorted(((t is not None, t or 0, role or "", text or "") for k, t, role, text in rows if k == c))
        said = "".join(f"{r}\n{x}\n" for *_, r, x in mine)
        loss = "".join(x for *_, r, x in mine if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256) == (len(mine), hashlib.sha256(said.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_chats(d.limit(0)).count() == 0


def test_adjacent_turns_are_merged(spark):
    d = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")
    r = chat.format_chats(d).first()
    assert r.formatted == "<|im_start|>user\na<|im_sep|>b<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"
    assert [r.formatted[s.start : s.start + s.length] for s in r.loss_spans] == ["c"]


def test_long_conversation(spark):
    """Time grows with the turns, not with their square; spans hold in code points and in bytes."""
    rows = [(1, t, ("user", "assistant", "assistant")[t % 3], f"é turn <| {t}") for t in range(40_000)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    r = chat.digest(chat.format_chats(d)).first()
    loss = "".join(x for *_, role, x in rows if role == "assistant")
    assert (r.n_turns, r.loss_sha256) == (40_000, hashlib.sha256(loss.encode()).hexdigest())
    r = chat.format_chats(d.filter("turn < 30")).first()
    raw = r.formatted.encode()
    for s in r.loss_spans:
        assert r.formatted[s.start : s.start + s.length] == raw[s.byte_start : s.byte_start + s.byte_length].decode()


# 9 sketches


def slow_sketch(text, scale):
    """The kept hashes, from the definition."""
    w = (text or "").lower().split()
    ids = [xxhash.xxh64_intdigest(x.encode(), 42) for x in w]
    found = set()
    for i in range(max(1, len(w) - 4) if w else 0):
        h = 42
        for x in ids[i : i + 5]:
            h = xxhash.xxh64_intdigest(struct.pack("<Q", x), h)
        found.add(h - 2**64 if h >= 2**63 else h)
    return {h for h in found if h < -(2**63) + 2**64 // scale}


def hexed(sketch_):
    return "".join(f"{h % 2**64:016x}" for h in sorted(sketch_))


def likeness(a, b, scale):
    x, y = slow_sketch(a, scale), slow_sketch(b, scale)
    return 1.0 if a == b else len(x & y) / min(len(x), len(y)) if x and y else 0.0


def test_sketch(spark, empty):
    rng = random.Random(12)
    texts = [*AWKWARD, *(words(rng, rng.randrange(1, 600), 5000) for _ in range(60))]
    got = {r.doc_id: r for r in sketch.edited_likeness(docs(spark, texts)).collect()}
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").lower().split()] for i in range(max(1, len(w) - 4))}
    off, scale = [], sketch.SCALE
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        k = len(t) // 4
        edited = t[: len(t) - k] + after[:k]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (hexed(slow_sketch(t, scale)), hexed(slow_sketch(edited, scale)))
        assert got[i].near_edited == pytest.approx(likeness(t, edited, scale))
        assert got[i].near_next == pytest.approx(likeness(t, after, scale))
        a, b = shingles(t), shingles(edited)
        if i >= len(AWKWARD) and min(len(a), len(b)) > 40:
            off.append(abs(got[i].near_edited - len(a & b) / min(len(a), len(b))))
    assert np.mean(off) < 0.08
    assert got[8].fingerprint == got[9].fingerprint and got[0].fingerprint == got[1].fingerprint == ""
    assert sketch.edited_likeness(empty).count() == 0
    one = sketch.edited_likeness(docs(spark, ["alone in the world"])).first()
    assert one.near_next == 1


def test_successors_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(sketch, "BUCKET_ROWS", 7)
    ids = random.Random(13).sample(range(10_000), 500)
    d = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    got = {r.doc_id: r.next for r in sketch.edited_pairs(d).collect()}
    order = sorted(ids)
    assert got == {i: f"text {j}" for i, j in zip(order, [*order[1:], order[0]], strict=True)}


def test_successors_of_repeated_ids(spark, monkeypatch):
    """One id (null, then 5) has most rows; each row still follows exactly one other."""
    monkeypatch.setattr(sketch, "BUCKET_ROWS", 7)
    rows = [(None, f"none {i}") for i in range(100)] + [(5, f"five {i}") for i in range(100)] + [(9, "nine"), (9, "nine"), (2, "two")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert max(r["count"] for r in sketch.with_next(d).groupBy("bucket").count().collect()) < 60
    got = sketch.edited_pairs(d).select("doc_id", "text", "next").collect()
    assert sorted((r.text, r.doc_id or 0) for r in got) == sorted((t, i or 0) for i, t in rows)
    assert sorted(r.next for r in got) == sorted(t for _, t in rows)
    after = {r.text: r.next for r in got}
    assert after["two"].startswith("five") and after["nine"] in ("nine", min((t for i, t in rows if i is None), key=lambda t: spark_hash(t)))


def spark_hash(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - 2**64 if h >= 2**63 else h


def test_sketches_merge(spark):
    a, b = " ".join(f"a{i}" for i in range(900)), " ".join(f"b{i}" for i in range(300))
    r = spark.createDataFrame([(a, b)], "a string, b string").select(
        sketch.merge(sketch.sketch(F.col("a")), sketch.sketch(F.col("b"))).alias("m"), sketch.sketch(F.col("a")).alias("a"), sketch.sketch(F.col("b")).alias("b")
    )
    row = r.first()
    assert set(row.m) == slow_sketch(a, sketch.SCALE) | slow_sketch(b, sketch.SCALE)
    assert r.select(sketch.containment(F.col("m"), F.col("b"))).first()[0] == 1
    assert r.select(sketch.jaccard(F.col("m"), F.col("b"))).first()[0] == len(row.b) / len(row.m)


def test_sketch_native(spark):
    plan = sketch.edited_likeness(docs(spark, ["a", "b"]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 10 language


def test_ngrams_over_chunks(monkeypatch):
    text = ("Ein Satz, 12 -- und  noch einer!  " * 7 + "é中𐐀 ") * 5
    for t in (text, "  " + text, "a", " a ", "12", ""):
        monkeypatch.setattr(langid, "CHUNK", 1 << 18)
        whole = langid.ngram_counts(t)
        for size in (1, 2, 3, 7, 64):
            monkeypatch.setattr(langid, "CHUNK", size)
            part = langid.ngram_counts(t)
            assert (whole is None and part is None) or (whole == part).all()
    shown = " " + " ".join("".join(x.lower() if x.isalpha() else " " for x in text).split()) + " "
    monkeypatch.setattr(langid, "CHUNK", 1 << 18)
    assert langid.ngram_counts(text).sum() == sum(max(0, len(shown) - n) for n in range(3))


def test_language(spark, empty):
    rng = random.Random(14)
    letters = {"en": "the and of in on to ing", "de": "der die und sch ung ein ich", "fr": "le la et les eau tion é"}
    texts, langs = [], []
    for i in range(600):
        lang = ("en", "de", "fr")[i % 3]
        texts.append(" ".join(rng.choice(letters[lang].split()) + rng.choice("aeiou") for _ in range(rng.randrange(3, 40))))
        langs.append(lang)
    d = docs(spark, texts, langs=["en", "de", "fr"])
    model = langid.train(d, ~langid.held_out())
    assert (model.weights == 0).mean() > 0.5 and model.temperature > 0
    got = {r.doc_id: r for r in langid.predict(d, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i].lang_pred == langs[i] for i in held]) > 0.97
    odd = {r.doc_id: r for r in langid.predict(docs(spark, [*AWKWARD, "123 !!", "𐐀𐐁"]), model).collect()}
    assert [odd[i].lang_pred for i in (0, 1, 2, 3, 10)] == ["und"] * 5 and odd[11].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in odd.values())
    assert langid.predict(empty, model).count() == 0
    assert langid.train(empty, F.lit(True)) is None
    assert {r.lang_pred for r in langid.predict(d.limit(3), None).collect()} == {"und"}


# all


def test_repeated_rows_and_missing_ids(spark, tmp_path):
    """Every row counts, also one that repeats another or has no id; columns of any name do no harm."""
    import public_tokenizers

    texts = ["some words of a text", "some words of another text", "same words here", "same words here", "other words", None, ""]
    rows = [(i, t, "en", "a", 0, "x", "y", 1) for i, t in zip((None, None, 1, 1, 1, None, 2), texts, strict=True)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, score string, h long")
    n = len(rows)
    mixed = mixing.mix(d).collect()
    assert len(mixed) == n and sum(r["size"] for r in mixed) == sum(len((t or "").split()) for t in texts)
    pieces = packing.pack(d, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert len(pieces) == n and sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces)
    near = simhash.near_duplicates(d, 3).collect()
    assert len(near) == n and {r.component_id for r in near if r.fp == 0} == {2}
    assert len(simhash.similar_documents(d).collect()) == n and simhash.drop_similar(d).columns == d.columns
    model = toxicity.train(d, spark.createDataFrame([(1, 1), (2, 0), (None, 1)], "doc_id long, toxic int"))
    assert toxicity.classify(d, model).count() == n
    assert licenses.scan_licenses(d).count() == n
    edited = sketch.edited_likeness(d).collect()
    assert len(edited) == n and all(0 <= r.near_next <= 1 for r in edited)
    lang = langid.train(d, F.lit(True))
    assert langid.predict(d, lang).count() == n
    kept = mixing.resample(d)
    assert kept.columns == d.columns and kept.count() > 0
