import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import mixing as M


def brute_targets(sizes):
    """Rounds of sharing and cutting, over sources in order."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: M.WEIGHTS[k % 3] for k, s in enumerate(order)}
    full = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        w = sum(weight[s] for s in order if s not in full)
        target = {s: 3 * sizes[s] if s in full else left * weight[s] / w for s in order}
        more = {s for s in order if s not in full and target[s] > 3 * sizes[s]}
        if not more:
            return target
        full |= more


def corpus(n=3000):
    r = np.random.default_rng(3)
    return [(i, "w " * int(r.integers(0, 120)), [None, "a", "b", "é", "z", "hot", "hot", "hot"][i % 8] if i > 20 else "tiny") for i in range(n)]


def test_targets_and_taken(spark, make, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 64)  # several levels of the tree
    monkeypatch.setattr(M, "FAN", 4)
    docs = make(corpus())
    got = M.mix(docs).toPandas()
    assert len(got) == 3000 and (got.taken <= 3 * got["size"]).all() and (got.taken == got.copies * got["size"]).all()
    sizes = {}
    for _, t, s in corpus():
        sizes[s] = sizes.get(s, 0) + len(t.split())
    expected = brute_targets(sizes)
    for source, rows in got.groupby(got.source.fillna("~")):
        source = None if source == "~" else source
        assert rows.target.iloc[0] == pytest.approx(expected[source]) and rows.source_size.iloc[0] == sizes[source]
        assert abs(rows.taken.sum() - expected[source]) <= max(150, 0.02 * expected[source])
        share = expected[source] / sizes[source] if sizes[source] else 0
        live = rows[rows["size"] > 0]
        assert live.copies.between(np.floor(share), np.ceil(share)).all() and abs(live.copies.sum() - share * len(live)) <= 1
    again = M.mix(docs.repartition(7)).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()


def test_pivot():
    total, p = np.zeros(40), np.random.default_rng(0).random(40)
    for k in range(3000):
        out = M.pivot(p, np.random.default_rng(k))
        inner = (out > 0) & (out < 1)
        assert inner.sum() <= 1 and abs(out.sum() - p.sum()) < 1e-9
        total += np.where(inner, out, out)
    assert np.abs(total / 3000 - p).max() < 0.05  # each keeps its expectation


def test_taking(make):
    rows = corpus(300) + [(7, "same words", "a")] * 5
    docs = make(rows)
    mixed, taken = M.mix(docs), M.take(docs)
    assert taken.columns == [*docs.columns, "copy_"]
    assert taken.count() == mixed.agg(F.sum("copies")).first()[0]
    per = {r["doc_id"]: r["n"] for r in mixed.where("doc_id <> 7").groupBy("doc_id").agg(F.sum("copies").alias("n")).where("n > 0").collect()}
    assert {r["doc_id"]: r["count"] for r in taken.where("doc_id <> 7").groupBy("doc_id").count().collect()} == per


def test_odd_rows(odd, none):
    got = M.mix(odd).collect()
    assert len(got) == odd.count() and {r["size"] for r in got if r["doc_id"] in (1, 2, 5)} == {0} and all(r["taken"] == 0 for r in got if not r["size"])
    assert M.mix(none).collect() == [] and M.take(none).count() == 0


def test_many_equal_rows(spark, make, monkeypatch):
    """A third of all rows is one row: their copies differ by one at most, and reruns over other partitions agree."""
    monkeypatch.setattr("skein.llm.skew.HEAVY", 16)
    rows = [(i, f"word {i} " * (1 + i % 7), "ab"[i % 2]) for i in range(400)] + [(9999, "the same words again", "a")] * 200
    seen = []
    for parts in (3, 7):
        docs = make(rows).repartition(parts)
        found = M.mix(docs).collect()
        assert len(found) == 600
        equal = sorted(r["copies"] for r in found if r["doc_id"] == 9999)
        assert len(equal) == 200 and equal[-1] - equal[0] <= 1
        by = {}
        for r in found:
            by.setdefault(r["source"], [0, r["target"]])[0] += r["taken"]
            assert 0 <= r["taken"] <= 3 * r["size"]
        assert all(abs(taken - target) <= 0.02 * target for taken, target in by.values())
        taken = M.take(docs)
        assert taken.count() == sum(r["copies"] for r in found) and taken.where("doc_id = 9999").count() == sum(equal)
        seen.append(sorted((r["doc_id"], r["copies"]) for r in found))
    assert seen[0] == seen[1]
