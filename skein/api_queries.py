"""Queries that go through the user's functions (arrays, frames, stores) over the whole star-schema tables.

Positions are the dense keys of orders and events. Orders are the ragged rows: each has the list of its lines,
empty for orders without any.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import api as sk
from skein.errors import RaggedError
from skein.functions import nested as N
from skein.operators import linalg
from skein.plans.array import POS, RaggedArray
from skein.plans.frame import RaggedFrame
from skein.plans.frame import LevelSchema
from skein.queries import nested, query, table
from skein.shared import shared_dir
from skein.sources.store import io_bytes_read, reset_io_bytes_read
from skein.types import BY_NAME, promote_types

F64, I64, TEXT = (BY_NAME[n] for n in ("float64", "int64", "string"))


def lines(spark: SparkSession, d: str, *columns: str) -> list[RaggedArray]:
    """Arrays of lists of the rows of orders."""
    lists = nested(spark, d, *columns).withColumnRenamed("key", POS)
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias(POS))
    kinds = {"part": I64, "supp": I64, "flag": TEXT}
    empty = {c: F.array().cast(f"array<{kinds.get(c, F64).spark.simpleString()}>") for c in columns}
    frame = orders.join(lists, POS, "left").select(POS, *[F.coalesce(c, empty[c]).alias(c) for c in columns])
    token = RaggedArray(frame, columns[0], F64, 1).token
    return [RaggedArray(frame, c, kinds.get(c, F64), 1, token=token) for c in columns]


def flat(spark: SparkSession, d: str, name: str, pos: str, column: str, dtype=F64) -> RaggedArray:
    return RaggedArray(table(spark, d, name).select(F.col(pos).cast("long").alias(POS), F.col(column).alias("v")), "v", dtype, 0)


def prices(spark: SparkSession, d: str) -> RaggedArray:
    return flat(spark, d, "orders", "o_orderkey", "o_totalprice")


def union(spark: SparkSession, d: str) -> RaggedArray:
    """A scalar for orders of one line, a list for the others; orders without lines have an empty list."""
    (qty,) = lines(spark, d, "qty")
    u = F.when(F.size(qty.col) == 1, N.union_scalar(F.get(qty.col, F.lit(0)))).otherwise(N.union_list(qty.col))
    return qty._with(u, depth=1, union=True)


def path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/skein-queries/{name}-{uuid.uuid4().hex}"


def rows_of(a: RaggedArray) -> DataFrame:
    """key and value of a flat array; key, pos (and idx) and value of lists."""
    df = a._plain().withColumnRenamed(POS, "key")
    if a.union:
        df = df.select("key", F.col("v.is_list").alias("is_list"), F.posexplode("v.items").alias("pos", "value"))
        return df.withColumn("pos", F.col("pos").cast("long"))
    names = ["pos", "idx"][: a.depth]
    for k, n in enumerate(names):
        df = df.select("key", *[F.col(m) for m in names[:k]], F.posexplode("v").alias(n, "v")).withColumn(n, F.col(n).cast("long"))
    return df.withColumnRenamed("v", "value")


def one(spark: SparkSession, **values) -> DataFrame:
    """A row of results that come back as Python values."""
    kinds = {bool: "boolean", int: "long", float: "double", str: "string"}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))


ORDERS = "o AS (SELECT o_orderkey AS key, o_totalprice AS price FROM orders)"
SIZES = "n AS (SELECT key, count(*) AS n FROM l GROUP BY key)"
UNION = f"{SIZES}, u AS (SELECT key, n > 1 AS is_list, pos, qty FROM l JOIN n USING (key))"


# construction and conversion
@query("api_array_lists", "SELECT r_regionkey::BIGINT AS key, (row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1)::BIGINT AS pos, n_name AS value FROM region JOIN nation ON n_regionkey = r_regionkey")
def api_array_lists(spark, d):
    found = table(spark, d, "region").join(table(spark, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_regionkey", "n_nationkey", "n_name").collect()  # nations, 25 rows
    by: dict[int, list] = {}
    for r, _, name in sorted(map(tuple, found)):
        by.setdefault(r, []).append(name)
    return rows_of(sk.array([by[r] for r in sorted(by)], sk.string))


@query("api_numpy_round_trip", "SELECT i AS key, j AS pos, (i * 7 + j)::BIGINT AS value FROM range(0, 9) a(i), range(0, 7) b(j)")
def api_numpy_round_trip(spark, d):
    a = sk.from_numpy(np.arange(63).reshape(9, 7))
    return rows_of(sk.from_numpy(sk.to_numpy(a)))


@query("api_rectangular", "SELECT true AS embeddings, (SELECT count(DISTINCT n) = 1 FROM (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)) AS orders")
def api_rectangular(spark, d):
    return one(spark, embeddings=sk.is_rectangular(vectors(spark, d)), orders=sk.is_rectangular(lines(spark, d, "qty")[0]))


@query("api_len", "SELECT count(*) AS n, 'RaggedArray(float64, depth=0)' AS repr FROM orders")
def api_len(spark, d):
    a = prices(spark, d)
    return one(spark, n=len(a), repr=repr(a))


@query("api_copy", f"WITH {ORDERS} SELECT key, CASE WHEN key = 3 THEN -1 ELSE price END::DOUBLE AS changed, price AS kept FROM o")
def api_copy(spark, d):
    a = prices(spark, d)
    kept = a.copy()
    a[3] = -1.0
    return rows_of(a).withColumnRenamed("value", "changed").join(rows_of(kept).withColumnRenamed("value", "kept"), "key")


@query("api_gpu", "SELECT false AS available, true AS none")
def api_gpu(spark, d):
    return one(spark, available=sk.gpu_available(), none=sk.gpu_backend() is None)


# types
_KINDS = [("int", 8), ("int", 16), ("int", 32), ("int", 64), ("uint", 8), ("uint", 16), ("uint", 32), ("uint", 64), ("float", 32), ("float", 64)]
_TYPES = "k AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {b})" for k, b in _KINDS) + ") t(kind, bits))"


@query("api_promote", f"WITH {_TYPES} SELECT a.kind || a.bits AS a, b.kind || b.bits AS b, CASE WHEN a.kind = b.kind THEN a.kind || greatest(a.bits, b.bits) WHEN 'float' IN (a.kind, b.kind) THEN 'float' || CASE WHEN greatest(CASE WHEN a.kind = 'float' THEN a.bits ELSE CASE WHEN a.bits <= 16 THEN 32 ELSE 64 END END, CASE WHEN b.kind = 'float' THEN b.bits ELSE CASE WHEN b.bits <= 16 THEN 32 ELSE 64 END END) = 32 THEN 32 ELSE 64 END WHEN greatest(CASE WHEN a.kind = 'uint' THEN a.bits * 2 ELSE a.bits END, CASE WHEN b.kind = 'uint' THEN b.bits * 2 ELSE b.bits END) > 64 THEN 'float64' ELSE 'int' || greatest(CASE WHEN a.kind = 'uint' THEN a.bits * 2 ELSE a.bits END, CASE WHEN b.kind = 'uint' THEN b.bits * 2 ELSE b.bits END) END AS c FROM k a, k b")
def api_promote(spark, d):
    names = [f"{k}{b}" for k, b in _KINDS]
    return spark.createDataFrame([(a, b, promote_types(a, b).name) for a in names for b in names], "a string, b string, c string")


@query("api_can_cast", f"WITH {_TYPES} SELECT a.kind || a.bits AS a, b.kind || b.bits AS b, CASE WHEN a.kind = b.kind THEN b.bits >= a.bits WHEN a.kind = 'float' THEN false WHEN b.kind = 'float' THEN b.bits > a.bits OR (b.bits = 64 AND a.bits = 64) WHEN b.kind = 'int' THEN b.bits > a.bits ELSE false END AS safe FROM k a, k b")
def api_can_cast(spark, d):
    names = [f"{k}{b}" for k, b in _KINDS]
    return spark.createDataFrame([(a, b, sk.can_cast(a, b)) for a in names for b in names], "a string, b string, safe boolean")


@query("api_inference", "SELECT * FROM (VALUES ('bool', 'bool'), ('int', 'int64'), ('float', 'float64'), ('text', 'string'), ('letter', 'char')) t(given, found)")
def api_inference(spark, d):
    given = {"bool": [True, None], "int": [1, True], "float": [1, 2.5], "text": ["ab", "c" * 2], "letter": ["a", "b"]}
    return spark.createDataFrame([(k, sk.array(v).dtype.name) for k, v in given.items()], "given string, found string")


# selection and assignment
@query("api_rows_backwards", f"WITH {ORDERS}, m AS (SELECT max(key) AS top FROM o) SELECT (top - key) // 3 AS key, price AS value FROM o, m WHERE (top - key) % 3 = 0 AND key > 10")
def api_rows_backwards(spark, d):
    return rows_of(prices(spark, d)[:10:-3])


@query("api_mask", f"WITH {ORDERS} SELECT row_number() OVER (ORDER BY key) - 1 AS key, price AS value FROM o WHERE price > 200000")
def api_mask(spark, d):
    p = prices(spark, d)
    return rows_of(p[sk.greater(p, 200000.0)])


@query("api_flatten_axis0", "SELECT row_number() OVER (ORDER BY key, pos) - 1 AS key, qty AS value FROM l", lines=True)
def api_flatten_axis0(spark, d):
    return rows_of(lines(spark, d, "qty")[0].flatten(dim=0))


@query("api_union_fancy", f"WITH {UNION} SELECT k AS key, is_list, pos, qty AS value FROM u JOIN (VALUES (0, 9), (1, 2), (2, 9), (3, 5)) t(k, i) ON key = i", lines=True)
def api_union_fancy(spark, d):
    return rows_of(union(spark, d)[[9, 2, 9, 5]]).withColumn("key", F.col("key").cast("int"))


@query("api_scalar_coordinate", "SELECT qty AS value FROM l WHERE key = (SELECT min(key) FROM l WHERE pos = 1) AND pos = 1", lines=True)
def api_scalar_coordinate(spark, d):
    (qty,) = lines(spark, d, "qty")
    first = qty.frame.where(F.size(qty.col) > 1).agg(F.min(POS)).first()[0]
    return one(spark, value=qty[first, 1])


@query("api_tuple_of_slices", "SELECT pos AS key, qty AS value FROM l WHERE key = (SELECT min(key) FROM l WHERE key >= 2)", lines=True)
def api_tuple_of_slices(spark, d):
    (qty,) = lines(spark, d, "qty")
    least = qty.frame.where((F.col(POS) >= 2) & (F.size(qty.col) > 0)).agg(F.min(POS)).first()[0]
    return rows_of(qty[2:, least - 2])


@query("api_set_row", f"WITH {ORDERS} SELECT key, CASE key WHEN 4 THEN 1.5 WHEN 8 THEN 2.5 ELSE price END::DOUBLE AS value FROM o")
def api_set_row(spark, d):
    p = prices(spark, d)
    p[4] = 0.0
    p[[8, 4]] = [2.5, 1.5]
    return rows_of(p)


@query("api_set_mask", f"WITH {ORDERS} SELECT key, CASE WHEN price > 200000 THEN 0.0 ELSE price END::DOUBLE AS value FROM o")
def api_set_mask(spark, d):
    p = prices(spark, d)
    p[sk.greater(p, 200000.0)] = 0.0
    return rows_of(p)


@query("api_set_elementwise_mask", "SELECT key, pos, CASE WHEN qty < 10 THEN 10.0 ELSE qty END::DOUBLE AS value FROM l", lines=True)
def api_set_elementwise_mask(spark, d):
    (qty,) = lines(spark, d, "qty")
    qty[sk.less(qty, 10.0)] = 10.0
    return rows_of(qty)


@query("api_set_coordinates", "SELECT key, pos, CASE WHEN pos = 0 AND key IN (SELECT key FROM (SELECT DISTINCT key FROM l ORDER BY key LIMIT 3)) THEN 77.0 ELSE qty END::DOUBLE AS value FROM l", lines=True)
def api_set_coordinates(spark, d):
    (qty,) = lines(spark, d, "qty")
    some = [r[0] for r in qty.frame.where(F.size(qty.col) > 0).select(POS).orderBy(POS).limit(3).collect()]
    qty[some, [0, 0, 0]] = [1.0, 77.0, 77.0]
    qty[some[0], 0] = 77.0
    return rows_of(qty)


# elementwise
@query("api_arithmetic", "SELECT key, pos, qty * price + qty / (disc + 1) - 3 AS value FROM l", lines=True)
def api_arithmetic(spark, d):
    qty, price, disc = lines(spark, d, "qty", "price", "disc")
    return rows_of(qty * price + qty / (disc + 1.0) - 3.0)


@query("api_leaf_with_list", f"WITH {ORDERS} SELECT key, pos, qty * o.price AS value FROM l JOIN o USING (key)", lines=True)
def api_leaf_with_list(spark, d):
    return rows_of(lines(spark, d, "qty")[0] * prices(spark, d))


@query("api_leaf_with_leaf", "SELECT o_orderkey AS key, o_totalprice - o_custkey AS value FROM orders")
def api_leaf_with_leaf(spark, d):
    return rows_of(prices(spark, d) - flat(spark, d, "orders", "o_orderkey", "o_custkey", I64))


@query("api_one_with_list", "SELECT key, pos, qty + (SELECT o_totalprice FROM orders WHERE o_orderkey = 0) AS value FROM l", lines=True)
def api_one_with_list(spark, d):
    return rows_of(lines(spark, d, "qty")[0] + prices(spark, d)[:1])


@query("api_union_times_rows", f"WITH {UNION}, {ORDERS} SELECT key, is_list, pos, qty * o.price AS value FROM u JOIN o USING (key)", lines=True)
def api_union_times_rows(spark, d):
    return rows_of(union(spark, d) * prices(spark, d))


@query("api_string_add", "SELECT o_orderkey AS key, o_orderstatus || o_orderpriority AS value FROM orders")
def api_string_add(spark, d):
    return rows_of(flat(spark, d, "orders", "o_orderkey", "o_orderstatus", TEXT) + flat(spark, d, "orders", "o_orderkey", "o_orderpriority", TEXT))


# reductions of unions, scalars and rows
@query("api_union_reduce_all", f"WITH {UNION} SELECT sum(qty) AS total, round(avg(qty), 8) AS mean, min(qty) AS least, max(qty) AS greatest, max(qty) - min(qty) AS spread FROM u", lines=True)
def api_union_reduce_all(spark, d):
    u = union(spark, d)
    return one(spark, total=u.sum(), mean=round(u.mean(), 8), least=u.min(), greatest=u.max(), spread=u.ptp())


def _filled(u: RaggedArray) -> RaggedArray:
    """Elements that are not empty, by their old positions."""
    return RaggedArray(u.frame.where(F.size(u.col["items"]) > 0), u.column, u.dtype, 1, True)


@query("api_union_reduce_lists", f"WITH {UNION} SELECT key, sum(qty) AS total, round(var_pop(qty), 6) AS var, quantile_cont(qty, 0.5) AS median FROM u GROUP BY key", lines=True)
def api_union_reduce_lists(spark, d):
    u = _filled(union(spark, d))
    named = lambda a, n: rows_of(a).withColumnRenamed("value", n)
    return named(u.sum(dim=-1), "total").join(named(u.var(dim=0), "var").withColumn("var", F.round("var", 6)), "key").join(named(sk.median(u, dim=0), "median"), "key")


@query("api_union_axis_refused", "SELECT 'AxisInvalid' AS code")
def api_union_axis_refused(spark, d):
    try:
        union(spark, d).sum(dim=2)
    except RaggedError as e:
        return one(spark, code=e.code)
    return one(spark, code="none")


@query("api_scalar_statistics", "SELECT round(var_pop(value), 6) AS var, round(stddev_samp(value), 6) AS std, round(quantile_cont(value, 0.25), 6) AS q, round(quantile_cont(value, 0.5), 6) AS median FROM events")
def api_scalar_statistics(spark, d):
    v = flat(spark, d, "events", "event_id", "value")
    return one(spark, var=round(v.var(0), 6), std=round(v.std(0, ddof=1), 6), q=round(sk.quantile(v, 0.25), 6), median=round(sk.median(v), 6))


@query("api_reduce_axis0", "SELECT pos AS key, CASE WHEN count(qty) = (SELECT count(*) FROM orders) THEN sum(qty) END AS value FROM l GROUP BY pos", lines=True)
def api_reduce_axis0(spark, d):
    return rows_of(lines(spark, d, "qty")[0].sum(dim=0))


# sorting
@query("api_sort_rows", f"WITH {ORDERS} SELECT row_number() OVER (ORDER BY price, key) - 1 AS key, price AS value FROM o")
def api_sort_rows(spark, d):
    return rows_of(prices(spark, d).sort())


@query("api_argsort_rows", f"WITH {ORDERS} SELECT row_number() OVER (ORDER BY price, key) - 1 AS key, key AS value FROM o")
def api_argsort_rows(spark, d):
    return rows_of(prices(spark, d).argsort())


@query("api_union_argsort", f"WITH {UNION} SELECT key, is_list, row_number() OVER (PARTITION BY key ORDER BY qty, pos) - 1 AS pos, pos AS value FROM u", lines=True)
def api_union_argsort(spark, d):
    return rows_of(union(spark, d).argsort())


@query("api_arg_extremes", f"WITH {ORDERS} SELECT arg_min(key, (-price, key)) AS greatest, arg_min(key, (price, key)) AS least FROM o")
def api_arg_extremes(spark, d):
    p = prices(spark, d)
    return one(spark, greatest=sk.argmax(p), least=sk.argmin(p))


@query("api_argpartition", "SELECT key, count(*) AS n, sum(pos)::BIGINT AS places FROM l GROUP BY key", lines=True)
def api_argpartition(spark, d):
    (qty,) = lines(spark, d, "qty")
    filled = RaggedArray(qty.frame.where(F.size(qty.col) > 0), "qty", F64, 1)
    found = rows_of(sk.argpartition(filled, 0))
    return found.groupBy("key").agg(F.count("*").alias("n"), F.sum("value").alias("places"))


@query("api_search_sorted", "SELECT key, pos, (SELECT count(*) FROM part WHERE p_retailprice < price) AS value FROM (SELECT key, pos, price / 50 AS price FROM l)", lines=True)
def api_search_sorted(spark, d):
    edges = flat(spark, d, "part", "p_partkey", "p_retailprice")
    return rows_of(sk.search_sorted(edges, lines(spark, d, "price")[0] / 50.0))


@query("api_isin", "SELECT key, pos, part IN (SELECT p_partkey FROM part WHERE p_size > 20) AS value FROM l", lines=True)
def api_isin(spark, d):
    sized = RaggedArray(table(spark, d, "part").where("p_size > 20").select(F.col("p_partkey").alias(POS), F.col("p_partkey").alias("v")), "v", I64, 0)
    return rows_of(sk.isin(lines(spark, d, "part")[0], sized))


@query("api_unique_ordered", "SELECT row_number() OVER (ORDER BY qty) - 1 AS key, qty AS value FROM (SELECT DISTINCT qty FROM l)", lines=True)
def api_unique_ordered(spark, d):
    return rows_of(sk.unique(lines(spark, d, "qty")[0]))


@query("api_unflatten", "SELECT o_custkey AS key, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, o_totalprice AS value FROM orders")
def api_unflatten(spark, d):
    """Orders in the order of their customers, cut into customers by the number of orders each has."""
    orders = table(spark, d, "orders").select(F.col("o_custkey"), F.col("o_orderkey"), F.col("o_totalprice").alias("v"))
    from skein.operators import rows

    flat_ = RaggedArray(rows.ranked(orders, [F.col("o_custkey"), F.col("o_orderkey")], POS).select(POS, "v"), "v", F64, 0)
    counts = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")).join(orders.groupBy("o_custkey").count(), "o_custkey", "left")
    sizes = RaggedArray(counts.select(F.col("o_custkey").alias(POS), F.coalesce("count", F.lit(0)).cast("long").alias("v")), "v", I64, 0)
    return rows_of(flat_.unflatten(sizes))


@query("api_concat_rows", f"WITH {ORDERS} SELECT key, price AS value FROM o UNION ALL SELECT key + (SELECT count(*) FROM o), price * 2 FROM o")
def api_concat_rows(spark, d):
    p = prices(spark, d)
    return rows_of(sk.cat([p, p * 2.0]))


# linear algebra
def vectors(spark: SparkSession, d: str) -> RaggedArray:
    return RaggedArray(table(spark, d, "embeddings").select(F.col("vec_id").alias(POS), F.col("embedding").cast("array<double>").alias("v")), "v", F64, 1)


MATRIX = "WITH e AS (SELECT vec_id AS i, unnest(range(0, 64)) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings) "


@query("api_norm", MATRIX + "SELECT round(sqrt(sum(v * v)), 6) AS value FROM e")
def api_norm(spark, d):
    return one(spark, value=round(sk.norm(vectors(spark, d)), 6))


@query("api_einsum_rows", MATRIX + "SELECT i AS key, round(sum(v), 6) AS value FROM e GROUP BY i")
def api_einsum_rows(spark, d):
    return rows_of(sk.einsum("ij->i", vectors(spark, d))).withColumn("value", F.round("value", 6))


@query("api_tensordot", MATRIX + "SELECT a.j AS key, b.j AS pos, round(sum(a.v * b.v), 5) AS value FROM e a JOIN e b USING (i) GROUP BY 1, 2")
def api_tensordot(spark, d):
    v = vectors(spark, d)
    return rows_of(sk.tensordot(sk.einsum("ij->ji", v), v, 1)).withColumn("value", F.round("value", 5))


_COFACTORS = [(4, 8, 5, 7), (2, 7, 1, 8), (1, 5, 2, 4), (5, 6, 3, 8), (0, 8, 2, 6), (2, 3, 0, 5), (3, 7, 4, 6), (1, 6, 0, 7), (0, 4, 1, 3)]


@query("api_inv_det", "SELECT vec_id AS key, unnest(range(0, 9)) AS pos, unnest([" + ", ".join(f"round(e[{a + 1}] * e[{b + 1}] - e[{c + 1}] * e[{e + 1}], 7) + 0.0" for a, b, c, e in _COFACTORS) + "]) AS value FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)")
def api_inv_det(spark, d):
    """The inverse times the determinant: cofactors."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("x"))
    m = e.select("key", F.array(*[F.slice("x", 1 + 3 * i, 3) for i in range(3)]).alias("m"))
    both = m.select("key", F.flatten(linalg.inv("m")).alias("i"), linalg.det("m").alias("det"))
    return both.select("key", F.posexplode(F.transform("i", lambda x: F.round(x * F.col("det"), 7) + 0.0)).alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))


# frames
def shop(spark: SparkSession, d: str) -> RaggedFrame:
    """order_price by order; item_qty and item_price by item."""
    qty, price = lines(spark, d, "qty", "price")
    frame = qty.frame.join(prices(spark, d)._plain(), POS).select(POS, F.col("v").alias("order_price"), F.col("qty").alias("item_qty"), F.col("price").alias("item_price"))
    return RaggedFrame(frame, {"order_price": (F64, 0, False), "item_qty": (F64, 1, False), "item_price": (F64, 1, False)}, LevelSchema(["order", "item"]))


@query("api_frame_column", "SELECT row_number() OVER (ORDER BY key, pos) - 1 AS key, qty AS value FROM l", lines=True)
def api_frame_column(spark, d):
    return rows_of(shop(spark, d).item_qty)


@query("api_frame_drill_down", "SELECT pos AS key, o_totalprice AS price, qty FROM l JOIN orders ON o_orderkey = key WHERE key = (SELECT min(key) FROM l)", lines=True)
def api_frame_drill_down(spark, d):
    df = shop(spark, d)
    least = df._frame.where(F.size("item_qty") > 0).agg(F.min(POS)).first()[0]
    return df.order[least]._frame.select(F.col(POS).alias("key"), F.col("order_price").alias("price"), F.col("item_qty").alias("qty"))


@query("api_frame_rows", "SELECT o_orderkey - 5 AS key, o_totalprice AS price, o_custkey AS customer FROM orders WHERE o_orderkey >= 5 AND o_orderkey < (SELECT count(*) FROM orders) - 5")
def api_frame_rows(spark, d):
    frame = table(spark, d, "orders").select(F.col("o_orderkey").alias(POS), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("customer"))
    found = RaggedFrame(frame, {"price": (F64, 0, False), "customer": (I64, 0, False)})[5:-5]
    return found._frame.withColumnRenamed(POS, "key")


@query("api_frame_set_column", "SELECT key, pos, qty * price AS value FROM l", lines=True)
def api_frame_set_column(spark, d):
    df = shop(spark, d)
    df["item_cost"] = df["item_qty"] * df["item_price"]
    return rows_of(df["item_cost"])


@query("api_frame_shape", f"WITH {SIZES}, {ORDERS} SELECT key, coalesce(n, 0) AS value, (SELECT count(*) FROM o) AS orders FROM o LEFT JOIN n USING (key)", lines=True)
def api_frame_shape(spark, d):
    df = shop(spark, d)
    return rows_of(df.shape("item")).withColumn("orders", F.lit(df.shape("order")).cast("long"))


@query("api_frame_max", "SELECT (SELECT max(o_totalprice) FROM orders) AS order_price, max(qty) AS item_qty, max(price) AS item_price FROM l", lines=True)
def api_frame_max(spark, d):
    return one(spark, **shop(spark, d).max())


@query("api_frame_to_dict", "SELECT r_regionkey::BIGINT AS key, r_name AS name, length(r_name) AS size FROM region")
def api_frame_to_dict(spark, d):
    names = [r["r_name"] for r in table(spark, d, "region").orderBy("r_regionkey").collect()]  # five regions
    found = sk.dataframe({"name": names, "size": [len(n) for n in names]}).to_dict()
    return spark.createDataFrame([(k, n, s) for k, (n, s) in enumerate(zip(found["name"], found["size"]))], "key long, name string, size long")


# stores
@query("api_store_array", "SELECT key, pos, qty AS value FROM l", lines=True)
def api_store_array(spark, d):
    at = path(spark, "array")
    sk.save(lines(spark, d, "qty")[0], at, chunk_size=256, chunk_dim=1)
    return rows_of(sk.load(at))


@query("api_store_frame", "SELECT key, pos, qty, price FROM l", lines=True)
def api_store_frame(spark, d):
    at = path(spark, "frame")
    sk.save(shop(spark, d), at)
    with sk.open(at, cache="none") as h:
        zipped = h.load()._frame.select(F.col(POS).alias("key"), F.posexplode(F.arrays_zip("item_qty", "item_price")).alias("pos", "x"))
    return zipped.select("key", F.col("pos").cast("long").alias("pos"), F.col("x.item_qty").alias("qty"), F.col("x.item_price").alias("price"))


@query("api_store_slice", f"WITH {ORDERS} SELECT key - 20 AS key, price AS value FROM o WHERE key >= 20 AND key < 900")
def api_store_slice(spark, d):
    at = path(spark, "slice")
    sk.save(prices(spark, d), at)
    return rows_of(sk.load_slice(at, 20, 900))


@query("api_store_append", f"WITH {ORDERS} SELECT key + i * (SELECT count(*) FROM o) AS key, price * (i + 1) AS value FROM o, range(0, 3) t(i)")
def api_store_append(spark, d):
    at, p = path(spark, "append"), prices(spark, d)
    sk.save((p * float(i) for i in (1, 2)), at)
    sk.append(p * 3.0, at)
    return rows_of(sk.load(at))


@query("api_store_handle", "SELECT count(*) AS n, count(*) AS rows, true AS closed, max(o_totalprice) AS greatest FROM orders")
def api_store_handle(spark, d):
    at = path(spark, "handle")
    sk.save(shop(spark, d), at)
    with sk.open(at) as h:
        n, rows, greatest = sk.stored_len(at), h.shape(), h["order_price"].max()
    return one(spark, n=n, rows=rows, closed=h.closed, greatest=greatest)


@query("api_io_counter", "SELECT true AS counted, true AS reset")
def api_io_counter(spark, d):
    at = path(spark, "counted")
    sk.save(shop(spark, d), at)
    reset_io_bytes_read(spark)
    before = io_bytes_read(spark)
    sk.open(at, cache="none")["order_price"].sum()
    return one(spark, counted=io_bytes_read(spark) > 0, reset=before == 0)


@query("api_batches", f"WITH {ORDERS} SELECT key // 4000 AS batch, count(*) AS n, max(price) AS greatest FROM o GROUP BY 1")
def api_batches(spark, d):
    """All batches in one job: one or two a batch would grow with the orders."""
    at = path(spark, "batches")
    sk.save(shop(spark, d), at)
    with sk.open(at, cache="none") as h:
        return h.reduce_batches(4000, greatest=("order_price", "max"))


# random values, by what must hold of any
@query("api_permutation", "SELECT 'place' AS what, event_id::DOUBLE AS x FROM events UNION ALL SELECT 'value', value FROM events")
def api_permutation(spark, d):
    found = sk.rng(4).permutation(flat(spark, d, "events", "event_id", "value"))._plain()
    return found.select(F.lit("place").alias("what"), F.col(POS).cast("double").alias("x")).unionByName(found.select(F.lit("value").alias("what"), F.col("v").alias("x")))


@query("api_permutation_lists", "SELECT key, sum(pos)::BIGINT AS places, sum(qty) AS total, count(*) AS n FROM l GROUP BY key", lines=True)
def api_permutation_lists(spark, d):
    found = rows_of(lines(spark, d, "qty")[0].permutation(dim=1, seed=3))
    return found.groupBy("key").agg(F.sum("pos").alias("places"), F.sum("value").alias("total"), F.count("*").alias("n"))


@query("api_shuffle_in_place", "SELECT value FROM events")
def api_shuffle_in_place(spark, d):
    v = flat(spark, d, "events", "event_id", "value")
    v.shuffle(seed=8)
    return v._plain().select(F.col("v").alias("value"))


@query("api_choice", "SELECT 500 AS n, 500 AS differ, true AS known")
def api_choice(spark, d):
    drawn = flat(spark, d, "events", "event_id", "event_id", I64).choice(500, replace=False, seed=2)._plain()
    events = table(spark, d, "events").select(F.col("event_id").alias("v"))
    return drawn.agg(F.count("*").cast("int").alias("n"), F.count_distinct("v").cast("int").alias("differ")).withColumn("known", F.lit(drawn.join(events, "v", "left_anti").isEmpty()))


@query("api_choice_per_row", f"WITH {SIZES} SELECT key, ceil(n / 2)::BIGINT AS n, true AS own FROM n", lines=True)
def api_choice_per_row(spark, d):
    """Half of each list, rounded up, without repeats: every draw is one of the row's own."""
    (qty,) = lines(spark, d, "qty")
    places = RaggedArray(qty.frame.withColumn("i", N.upto(F.size(qty.col))), "i", I64, 1)
    halves = places.permutation(1, 6)
    taken = halves._plain().select(POS, F.slice("v", 1, F.ceil(F.size("v") / 2).cast("int")).alias("v"), F.size("v").alias("size")).where("size > 0")
    return taken.select(F.col(POS).alias("key"), F.size(F.array_distinct("v")).cast("long").alias("n"), F.forall("v", lambda x: (x >= 0) & (x < F.col("size"))).alias("own"))


@query("api_random_like", f"WITH {SIZES} SELECT key, n, true AS uniform, true AS whole FROM n", lines=True)
def api_random_like(spark, d):
    (qty,) = lines(spark, d, "qn")
    g = sk.rng(9)
    u, i = g.uniform_like(qty, 2.0, 5.0), g.integers_like(qty, 3, 6)
    both = u._plain().join(i._plain().withColumnRenamed("v", "w"), POS).where(F.size("v") > 0)
    return both.select(F.col(POS).alias("key"), F.size("v").cast("long").alias("n"), F.forall("v", lambda x: (x >= 2) & (x < 5)).alias("uniform"), F.forall("w", lambda x: (x >= 3) & (x < 6)).alias("whole"))


@query("api_integers", "SELECT i AS value, true AS often FROM range(10, 16) t(i)")
def api_integers(spark, d):
    drawn = sk.rng(5).integers(10, 16, size=60_000)._plain()
    return drawn.groupBy(F.col("v").alias("value")).agg(F.abs(F.count("*") - 10_000).alias("off")).select("value", (F.col("off") < 500).alias("often"))


@query("api_normal", "SELECT true AS mean, true AS spread, 50000 AS n")
def api_normal(spark, d):
    template = RaggedArray(spark.range(50_000).select(F.col("id").alias(POS), F.lit(0.0).alias("v")), "v", F64, 0)
    v = template.normal_like(3.0, 2.0, seed=1)._plain()
    return v.agg((F.abs(F.avg("v") - 3) < 0.05).alias("mean"), (F.abs(F.stddev("v") - 2) < 0.05).alias("spread"), F.count("*").cast("int").alias("n"))


# compiled transforms
@sk.compile
def _doubled(batch):
    batch = batch * 2.0
    return batch + 1.0


@query("api_compiled", "SELECT key, pos, qty * 2 + 1 AS value FROM l", lines=True)
def api_compiled(spark, d):
    return rows_of(_doubled(lines(spark, d, "qty")[0]))


@query("api_compiled_pipeline", "SELECT key, pos, (qty * 2 + 1) * 2 + 1 AS value FROM l", lines=True)
def api_compiled_pipeline(spark, d):
    return rows_of(sk.compile_pipeline([_doubled, _doubled])(lines(spark, d, "qty")[0]))


@query("api_compile_info", "SELECT true AS fully, 'mul_scalar,add_scalar' AS ops")
def api_compile_info(spark, d):
    found = sk.compile_pipeline_info([_doubled])
    return one(spark, fully=found["fully_compiled"], ops=",".join(found["ops"]))


# streams
@query("api_stream_append", "SELECT 'place' AS what, event_id::DOUBLE AS x FROM events UNION ALL SELECT 'value', value FROM events")
def api_stream_append(spark, d):
    from skein.streaming.append import append_stream

    at = path(spark, "stream")
    table(spark, d, "events").select("event_id", "value").repartition(3).write.parquet(f"{at}/in")
    stream = spark.readStream.schema("event_id long, value double").option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    append_stream(stream, f"{at}/out", ["event_id"], f"{at}/check").awaitTermination()
    found = spark.read.parquet(f"{at}/out")
    return found.select(F.lit("place").alias("what"), F.col(POS).cast("double").alias("x")).unionByName(found.select(F.lit("value").alias("what"), F.col("value").alias("x")))


# errors
@query("api_errors", "SELECT * FROM (VALUES ('cast', 'CastFailed'), ('index', 'IndexOutOfBounds'), ('axis', 'AxisInvalid'), ('column', 'ColumnMissing'), ('store', 'IoFailed'), ('seed', 'ArgumentInvalid'), ('kinds', 'DTypeUnsupported')) t(what, code)")
def api_errors(spark, d):
    p = prices(spark, d)
    tries = {
        "cast": lambda: p.astype("int8"), "index": lambda: p[10**9], "axis": lambda: p.sum(dim=3), "column": lambda: shop(spark, d)["nothing"],
        "store": lambda: sk.load(path(spark, "nothing")), "seed": lambda: p.permutation(), "kinds": lambda: p + flat(spark, d, "orders", "o_orderkey", "o_orderstatus", TEXT),
    }
    found = []
    for what, f in tries.items():
        try:
            f()
            found.append((what, "none"))
        except RaggedError as e:
            found.append((what, e.code))
    return spark.createDataFrame(found, "what string, code string")
