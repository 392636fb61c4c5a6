import numpy as np
import pytest

from skein.operators import neighbors
from skein.queries import QUERIES


@pytest.fixture(scope="module")
def cloud(spark):
    """Groups of 60 and 5 points, then points that are null, short, long or hold a null."""
    rng = np.random.default_rng(5)
    made = [(i, i % 13 // 12, rng.normal(0, 0.3, 3).tolist()) for i in range(65)]
    odd = [(70, 0, None), (71, 0, [0.1, 0.2]), (72, 0, [0.0, 0.0, 0.0, 0.0]), (73, 1, [0.1, None, 0.1]), (74, None, [0.0, 0.0, 0.0])]
    return spark.createDataFrame(made + odd, "pos long, grp int, point array<double>"), made


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def near(found, expected):
    found, expected = ({r[:-1]: r[-1] for r in rs} for rs in (found, expected))
    assert found.keys() == expected.keys()
    assert all(v is None and expected[k] is None or v == pytest.approx(expected[k], abs=1e-12) for k, v in found.items())


@pytest.mark.parametrize("group", (None, "grp"))
@pytest.mark.parametrize("r", (0, 0.4))
def test_radius_of_known_dimensions_is_compiled(cloud, group, r):
    df, made = cloud
    found = neighbors.radius(df, df, r, group=group, dimensions=3)
    at = {i: (g, np.array(p)) for i, g, p in made} | ({} if group else {74: (None, np.zeros(3))})
    expected = [(*([at[i][0]] if group else []), i, j, d) for i in at for j in at if (d := float(np.sqrt(((at[i][1] - at[j][1]) ** 2).sum()))) <= r and (not group or at[i][0] == at[j][0])]
    near(rows(found), expected)
    assert "lambda" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block", (8, 4096))
def test_pairwise_deals_large_groups(cloud, monkeypatch, block):
    df, made = cloud
    monkeypatch.setattr(neighbors, "BLOCK", block)
    found = neighbors.pairwise(df, "grp", dimensions=3)
    assert "lambda" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "SortMergeJoin" in plan
    points = {i: (g, p) for i, g, p in made} | {70: (0, None), 71: (0, None), 72: (0, None), 73: (1, None)}
    apart = lambda p, q: None if p is None or q is None else float(np.sqrt(((np.array(p) - np.array(q)) ** 2).sum()))
    near(rows(found), [(g, i, j, apart(p, q)) for i, (g, p) in points.items() for j, (h, q) in points.items() if g == h])
    by_key = neighbors._dealt(df, "grp", "pos", "a", "b", (large := neighbors._large_groups(df, "grp", "_n"), large)).groupBy("grp", "a", "b").count()
    assert by_key.agg({"count": "max"}).first()[0] <= max(3 * block, 1) and (by_key.count() > 40) == (block == 8)


@pytest.mark.parametrize("block", (8, 4096))
def test_knn_deals_large_groups(spark, cloud, monkeypatch, block):
    _, made = cloud
    monkeypatch.setattr(neighbors, "BLOCK", block)
    df = spark.createDataFrame([(i, g, [round(v, 1) for v in p]) for i, g, p in made], "pos long, grp int, point array<double>")  # ties
    calls = neighbors.knn(df, df, 4, group="grp", loop=False)
    assert dict(calls.dtypes)["rank"] == "int"
    points = {i: (g, p) for i, g, p in map(tuple, df.collect())}
    d2 = lambda p, q: sum((a - b) * (a - b) for a, b in zip(p, q))
    expected = []
    for i, (g, p) in points.items():
        best = sorted((d2(p, q), j) for j, (h, q) in points.items() if h == g and j != i)[:4]
        expected += [(g, i, j, k, float(np.sqrt(d))) for k, (d, j) in enumerate(best)]
    near([(*r[:3], r[4], r[3]) for r in rows(calls)], expected)


def test_types_are_those_of_the_sql(spark, sf):
    assert {n: dict(QUERIES[n](spark, sf).dtypes)["rank"] for n in ("knn_dim0", "knn_dim1_by_label")} == {"knn_dim0": "int", "knn_dim1_by_label": "int"}


def test_distances_are_rounded_as_in_the_sql(spark):
    import duckdb

    from skein.queries import rounded

    values = [0.0, 5e-7, 4.9999999999999994e-7, 0.1234565, float(np.nextafter(0.1234565, 0)), 1.0000005, 2.5, 1e12 + 0.1, 1e300, float("nan"), float("inf"), None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(rounded("x")).collect()]
    assert repr(got) == repr([duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values])


def test_blocks_meet_in_many_partitions(spark, cloud, monkeypatch):
    df = spark.createDataFrame(cloud[1], "pos long, grp int, point array<double>")
    monkeypatch.setattr(neighbors, "BLOCK", 8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert neighbors.knn(df, df, 3).count() == 3 * 65
        assert neighbors.knn(df, df, 3, group="grp").count() == 3 * 65
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
