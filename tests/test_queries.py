import math
import os

import duckdb
import pytest

from skein import api_queries  # noqa: F401  (adds its queries)
from skein.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf, t)}.parquet')")
    return con


def normal(rows):
    one = lambda v: "~" if v is None else ("nan" if math.isnan(v) else f"{v + 0.0:.9g}") if isinstance(v, float) else str(v)
    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    assert got
    if name not in ORACLES:
        return
    found = duck.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    expected = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    assert normal(got) == normal(expected)


def test_flagship_is_one_partial_aggregate(spark, sf):
    plan = QUERIES["sum_of_products"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "partial_sum" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_extendedprice:double>" in plan
