from __future__ import annotations

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tracelode.llm import leakage as L


def brute(docs, items):
    grams = lambda w: {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
    return sorted({(d, i) for d, t in docs for i, p in items if d is not None and i is not None and grams(L.words(t)) & grams(L.words(p))})


def run(spark, docs, items):
    one = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("passage", F.lit(1))
    two = spark.createDataFrame(items, "item_id long, passage string").withColumn("text", F.lit("clash"))
    return L.leaked_items(one, two)


def corpus(seed=5):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, text(rnd.randrange(5, 60))) for i in range(25)] + [(90, None), (91, ""), (None, text(30))]
    docs = []
    for d in range(120):
        body = text(rnd.randrange(0, 80))
        if d % 3 == 0:
            w = L.words(rnd.choice(items[:25])[1])
            n = rnd.choice([10, 11, 12, 13, 40])
            a = rnd.randrange(0, max(1, len(w) - n))
            body += " ?! " + "\n-_/ ".join(x.upper() for x in w[a : a + n]) + " " + text(9)
        docs.append((d, body))
    return docs + [(500, None), (501, ""), (502, "w1 " * 20000), (None, items[0][1]), docs[0]], items


def test_matches_brute_force(spark, monkeypatch):
    docs, items = corpus()
    want = brute(docs, items)
    found = run(spark, docs, items)
    assert len(want) > 5 and sorted((r.doc_id, r.item_id) for r in found.collect()) == want
    monkeypatch.setattr(L, "CHARS_PER_PASS", 700)
    assert sorted((r.doc_id, r.item_id) for r in run(spark, docs, items).collect()) == want


def _spread(fps, rng, most):
    out = fps.copy()
    for k in range(len(out)):
        for bit in rng.choice(64, k % (most + 2), replace=False):
            out[k] ^= np.uint64(1) << np.uint64(bit)
    return out


def test_blocks_miss_nothing_within_the_radius():
    rng = np.random.default_rng(0)
    index = L.PassageIndex([], False)
    index.fp = rng.integers(0, 2**63, 400, dtype=np.uint64)
    index.blocks = [index._block(low, high) for low, high in L.BLOCKS]
    fps = np.concatenate([_spread(index.fp[:200], rng, L.RADIUS), rng.integers(0, 2**63, 100, dtype=np.uint64)])
    far = lambda i, j: bin(int(fps[i]) ^ int(index.fp[j])).count("1")
    got = set(zip(*(x.tolist() for x in index.equal_fingerprint_windows(fps))))
    want = {(i, j) for i in range(300) for j in range(400) if far(i, j) <= L.RADIUS}
    assert got == want and len(want) >= 150
    fps[:200] = _spread(index.fp[:200], rng, L.NEAR_RADIUS)
    got = set(zip(*(x.tolist() for x in index.near_windows(fps, np.arange(400)))))
    assert got == {(i, j) for i in range(300) for j in range(400) if far(i, j) <= L.NEAR_RADIUS} and len(got) >= 170


def _brute_similarity(a: list[str], b: list[str]) -> float:
    shingles = lambda x: Counter(tuple(x[i : i + 5]) for i in range(len(x) - 4))
    one, two, weigh = shingles(a), shingles(b), lambda s: sum(map(len, s))
    both = sum(min(n, two[s]) * weigh(s) for s, n in one.items())
    either = sum(max(one[s], two[s]) * weigh(s) for s in one.keys() | two.keys())
    return both / either if either else 0.0


def test_similarity_and_empty_tables(spark):
    rnd = random.Random(4)
    bag = lambda w: L.shingles_of(*L.hashed(w))
    for _ in range(50):
        a = [rnd.choice("abc") * rnd.choice([1, 1, 4]) for _ in range(rnd.randrange(5, 40))]
        b = a[: rnd.randrange(5, len(a) + 1)] + ["x"] * rnd.randrange(3)
        assert abs(L.shingle_similarity(bag(a), bag(b)) - _brute_similarity(a, b)) < 1e-12
    docs, items = corpus()
    assert run(spark, [], items).count() == 0 and run(spark, docs, []).count() == 0 and L.near_copies(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")).count() == 0


def test_edited_copies_match_brute_force(spark):
    """At least nine in ten of the pairs that brute force finds come out, and nothing else."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.choice([1, 1, 2, 6, 15])))
    items = [(i, " ".join(word() for _ in range(rnd.randrange(50, 90)))) for i in range(12)]
    docs = []
    for d in range(90):
        w = L.words(items[d % 12][1])
        for _ in range(d % 4):
            w[rnd.randrange(len(w))] = word()
        if d % 5 == 0:
            w.insert(rnd.randrange(len(w)), word())
        docs.append((d, " ".join([word() for _ in range(7)] + w + [word() for _ in range(3)])))
    want = {}
    for d, t in docs:
        for i, p in items:
            w, q = L.words(t), L.words(p)
            best = max((_brute_similarity(w[a : a + len(q)], q) for a in range(len(w) - len(q) + 1)), default=0)
            if best >= L.SIMILARITY:
                want[d, i] = round(best, 9)
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in L.near_copies(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")).collect()}
    assert len(want) > 30 and set(got) <= set(want) and sum(got.get(k) == v for k, v in want.items()) >= 0.9 * len(want)
