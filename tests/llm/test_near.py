import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import near as N
from skein.llm.graph import components


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def roots(nodes, links):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def brute(rows, k):
    sets = {i: shingles(t, k) for i, t in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    found = roots(sets, links)
    return {i: (len(sets[i]), found[i], found[i] == i) for i in sets}


def corpus(seed=1):
    """Copies, groups of near copies around the threshold, chains, and strangers."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, i = [], 0

    def add(words):
        nonlocal i
        rows.append((i, " ".join(words)))
        i += 1

    for size, edits in ((60, 14), (25, 4), (6, 1), (2, 0)):
        base = [r.choice(vocabulary) for _ in range(90)]
        for _ in range(size):
            words = list(base)
            for _ in range(r.randint(0, edits)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            add(words)
    chain = [r.choice(vocabulary) for _ in range(60)]
    for _ in range(12):
        add(chain)
        for _ in range(4):
            chain = list(chain)
            chain[r.randrange(60)] = r.choice(vocabulary)
    for _ in range(30):
        add([r.choice(vocabulary) for _ in range(r.randint(1, 60))])
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [256, 8])
def test_components_against_brute_force(make, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    rows = corpus()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in N.near_duplicates(make(rows), shingle=2).collect()}
    assert got == brute(rows, 2)


def test_estimate_and_registers():
    draw = np.random.default_rng(0)
    a = np.unique(draw.integers(0, 1 << 63, 3000, np.uint64))
    for n, j in ((2700, 0.818), (1500, 0.333)):
        b = np.concatenate([a[:n], draw.integers(0, 1 << 63, 3000 - n, np.uint64)])
        p, q = N.registers([a, np.unique(b)], 1024)
        found = N.estimate(*[np.array([x]) for x in ((p > q).sum(), (p == q).sum(), (p < q).sum())], np.array([3000.0]), np.array([3000.0]))[0]
        assert abs(found - j) < 0.05
    x, y = a[:1000], a[800:2000]
    joint = N.registers([np.union1d(x, y)], 64)[0]
    assert (np.maximum(*N.registers([x, y], 64)) == joint).all()  # mergeable
    assert (N.registers([a[:0]], 8) == 0).all()


def test_graph(spark):
    r = random.Random(3)
    pairs = [(r.randrange(80), r.randrange(80)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(20)] + [(7, 7)]
    got = {x["node"]: x["comp"] for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {n for p in pairs for n in p if p[0] != p[1]}
    assert got == {n: c for n, c in roots(nodes, [p for p in pairs if p[0] != p[1]]).items()}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(odd, none):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in N.near_duplicates(odd, shingle=2).collect()), key=str)
    size = {6: len(shingles(odd.where("doc_id = 6").first()["text"], 2))}
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 4, True), (4, 1, 4, True), (None, 2, None, True), (None, 0, None, True), (5, 0, 5, True), (6, size[6], 6, True)], key=str)
    assert N.near_duplicates(none).count() == 0
    kept = N.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1  # one of two equal rows
    assert kept.where("doc_id = 4").count() == 1 and kept.select("k1").distinct().first()[0] == "own k1"


def test_one_of_each_group_stays(make):
    rows = corpus(5)
    kept = {r["doc_id"] for r in N.drop_near_duplicates(make(rows), shingle=2).collect()}
    found = brute(rows, 2)
    comps = {}
    for i, (_, c, _) in found.items():
        comps.setdefault(c, set()).add(i)
    assert len(kept) == len(comps) and all(len(kept & members) == 1 for members in comps.values())


def test_texts_must_share_their_words(make):
    """Words that plain polynomial hashes take for equal, alone and in short texts."""
    from test_text import twins

    rows = [(k, " ".join([w, *rest])) for k, (w, rest) in enumerate((w, rest) for d in (11, 12, 13) for w in twins(d) for rest in ([], ["x"], ["x", "y"]))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in N.near_duplicates(make(rows), shingle=2).collect()}
    assert got == brute(rows, 2)


def test_large_sets_make_small_blocks(make, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_SHINGLES", 200)
    monkeypatch.setattr("skein.llm.skew.HEAVY", 8)
    rows = corpus(seed=9)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in N.near_duplicates(make(rows), shingle=2).collect()}
    assert got == brute(rows, 2)
