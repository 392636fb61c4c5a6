import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import ann as A


def table(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return df.withColumns({c: F.lit(1) for c in ("id", "vec", "part", "a", "b", "is_query", "score")})


def exact(x, q, k):
    s = A.cosine(x[q], x)
    order = [i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:k]
    return [(i, s[i]) for i in order]


def test_recall_ties_and_scores(spark, monkeypatch):
    monkeypatch.setattr(A, "CAND_BLOCK", 300)
    monkeypatch.setattr(A, "QUERY_BLOCK", 20)
    g = np.random.default_rng(0)
    centres = g.normal(size=(20, 16))
    x = (centres[g.integers(0, 20, 3000)] + 0.4 * g.normal(size=(3000, 16))).astype(np.float32)
    x[100:400] = x[100]  # one very common vector
    got = {}
    for r in A.nearest(table(spark, [(i, v.tolist()) for i, v in enumerate(x)]), F.col("vec_id") % 50 == 0, probes=3, rows_per_part=256).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    y, hits = x.astype(np.float64), 0
    assert sorted(got) == list(range(0, 3000, 50))
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        best = exact(y, q, 5)
        hits += len({f[1] for f in found} & {b[0] for b in best})
        for _, i, s in found:
            assert s == A.cosine(y[q], y[i : i + 1])[0]
    assert hits / (5 * len(got)) >= 0.9
    assert [f[1] for f in got[150]] == [100, 101, 102, 103, 104] and [f[1] for f in got[100]] == [101, 102, 103, 104, 105]


def clustered(n, seed=4):
    g = np.random.default_rng(seed)
    centres = g.normal(size=(60, 16))
    return (centres[g.integers(0, 60, n)] + 0.25 * g.normal(size=(n, 16))).astype(np.float32)


@pytest.mark.parametrize("n", [1500, 6000])
def test_parts_grow_with_the_rows(spark, monkeypatch, n):
    """Several levels of parts, with recall against brute force."""
    cuts, cut = [], A.cut
    monkeypatch.setattr(A, "cut", lambda df, name: cuts.append(name) or cut(df, name))
    x = clustered(n)
    df = table(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    got = {}
    for r in A.nearest(df, F.col("vec_id") % 50 == 0, probes=4, mass=0.95, sample_rows=1000, rows_per_part=20).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    y = x.astype(np.float64)
    hits = sum(len(got[q] & {i for i, _ in exact(y, q, 5)}) for q in range(0, n, 50))
    assert len(got) == n // 50 and all(len(f) == 5 for f in got.values())
    assert hits / (5 * len(got)) >= 0.9
    assert cuts.count("models") >= 2  # parts of parts


def test_common_vectors_and_repeated_ids(spark):
    """A third of the rows are one vector; ids repeat with other vectors."""
    x = clustered(900)
    x[:300] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(i, x[(i + 7) % 900].tolist()) for i in range(400, 600)] * 2
    got = {}
    for r in A.nearest(table(spark, rows), F.col("vec_id") % 50 == 0, probes=2, mass=0.9, rows_per_part=64).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert all(sorted(r for r, _ in f) == [1, 2, 3, 4, 5] and len({v for _, v in f}) == 5 for f in got.values()) and len(got) == 18
    assert sorted(v for _, v in got[100]) == [0, 1, 2, 3, 4]


def test_extreme_components():
    v = np.random.default_rng(5).normal(size=(4, 6))
    for scale in (1e-300, 1e-160, 1e160, 1e300):
        assert np.allclose(A.cosine(v[0] * scale, v), A.cosine(v[0], v)) and np.isclose(A.cosine(v[0] * scale, v[:1] * scale)[0], 1)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [float("inf"), 1.0]), (8, [1.0, 1.0]), (8, [1.0, 1.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (50, [0.0, -1e-30])]
    got = A.nearest(table(spark, rows), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 1), (0, 2, 8), (0, 3, 50), (50, 1, 0), (50, 2, 1), (50, 3, 8)]
    assert got[0]["score"] == 1.0 and got[1]["score"] == pytest.approx(0.5**0.5)
    assert A.nearest(table(spark, rows).limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_parts_are_balanced():
    x = A._unit(np.random.default_rng(1).normal(size=(512, 8)))
    part = A.balanced_parts(*A.neighbour_graph(x, 8), 512, 3, np.random.default_rng(2))
    assert (np.bincount(part) == 64).all()
    i, j = A.neighbour_graph(x, 8)
    assert (part[i] == part[j]).mean() > 0.3  # random parts: 0.125
