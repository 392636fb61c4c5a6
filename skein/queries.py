"""The library's operators over the star-schema tables, each with the SQL that says the same.

Orders are the ragged rows: an order's lines in the order of (linenumber, partkey, suppkey, price,
ship date) are its list. Results of list operators come back exploded as (key, pos, value).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import guards as G
from skein.functions import nested as N
from skein.operators import hist, linalg, neighbors, random, rows, sets
from skein.types import BY_NAME

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
F64, I64, I32 = BY_NAME["float64"], BY_NAME["int64"], BY_NAME["int32"]

LINES = """l AS (SELECT l_orderkey AS key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS pos,
  l_quantity AS qty, l_extendedprice AS price, l_discount AS disc, l_partkey AS part, l_suppkey AS supp, l_returnflag AS flag, nullif(l_quantity, 13) AS qn,
  CASE WHEN l_quantity = 13 THEN 'nan'::DOUBLE ELSE l_quantity END AS qx FROM lineitem)"""
ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
VALUES = {
    "qty": "l_quantity", "price": "l_extendedprice", "disc": "l_discount", "part": "l_partkey", "supp": "l_suppkey", "flag": "l_returnflag",
    "qn": "nullif(l_quantity, 13D)", "qx": "if(l_quantity = 13, double('NaN'), l_quantity)",
}
POINTS = "pt AS (SELECT vec_id AS pos, label AS grp, list_transform(embedding[1:3], lambda x: x::DOUBLE) AS p FROM embeddings)"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def nested(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """key and the named list columns, one row for each order with lines."""
    taken = [F.expr(VALUES[c]).alias(c) for c in columns]
    whole = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.array_sort(F.collect_list(F.struct(*ORDER, *taken))).alias("x"))
    return whole.select("key", *[F.col("x").getField(c).alias(c) for c in columns])


def flat(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return nested(spark, d, *columns).select("key", F.posexplode(F.arrays_zip(*columns)).alias("pos", "x")).select("key", F.col("pos").cast("long").alias("pos"), *[f"x.{c}" for c in columns])


def out(df: DataFrame, value) -> DataFrame:
    return df.select("key", F.posexplode(value).alias("pos", "value")).select("key", F.col("pos").cast("long").alias("pos"), "value")


def query(name: str, sql: str | None = None, lines: bool = False):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            text = sql.strip()
            ORACLES[name] = f"WITH {LINES}{', ' + text[5:] if text.startswith('WITH ') else ' ' + text}" if lines else text
        return f

    return register


def on_lists(name: str, columns: str, make, value: str) -> None:
    """A query that maps lists; value is the SQL of one element over l."""

    @query(name, f"SELECT key, pos, {value} AS value FROM l", lines=True)
    def run(spark, d):
        return out(nested(spark, d, *columns.split()), make())


def on_rows(name: str, columns: str, make, value: str, having: str = "") -> None:
    """A query with one value for each order; value is an aggregate over its lines."""

    @query(name, f"SELECT key, {value} AS value FROM l GROUP BY key {having}", lines=True)
    def run(spark, d):
        return nested(spark, d, *columns.split()).select("key", make().alias("value"))


def on_aggregate(name: str, make, value: str) -> None:
    """As on_rows, for reductions that don't ask for the order of lines: no list is made."""

    @query(name, f"SELECT key, {value} AS value FROM l GROUP BY key", lines=True)
    def run(spark, d):
        return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(make(lambda c: F.expr(VALUES[c])).alias("value"))


C = F.col
z = lambda a, b, f: N.zip_leaf(C(a), C(b), 1, 1, f)
m = lambda a, f: N.map_leaf(C(a), 1, f)

# elementwise
on_lists("elementwise_add", "qty price", lambda: z("qty", "price", lambda x, y: x + y), "qty + price")
on_lists("elementwise_sub", "qty price", lambda: z("qty", "price", lambda x, y: x - y), "qty - price")
on_lists("elementwise_mul", "qty price", lambda: z("qty", "price", lambda x, y: x * y), "qty * price")
on_lists("elementwise_div", "price disc", lambda: z("price", "disc", G.divide), "CASE WHEN disc = 0 THEN 'inf'::DOUBLE ELSE price / disc END")
on_lists("mod_floor", "part supp", lambda: z("part", "supp", lambda x, y: G.floored_mod(x - 500, y + 1, True)), "(((part - 500) % (supp + 1)) + supp + 1) % (supp + 1)")
on_lists("string_concat", "flag", lambda: z("flag", "flag", lambda x, y: F.concat(x, F.lit("-"), y)), "flag || '-' || flag")
on_lists("scalar_mul", "qty", lambda: m("qty", lambda x: x * 2.5), "qty * 2.5")
on_lists("null_propagates", "qn price", lambda: z("qn", "price", lambda x, y: x + y), "qn + price")
on_lists("broadcast_row_len1", "qty price", lambda: N.zip_leaf(C("qty"), F.slice("price", 1, 1), 1, 1, lambda x, y: x + y), "qty + first_value(price) OVER (PARTITION BY key ORDER BY pos)")
on_lists("cast_wrap_int8", "part", lambda: m("part", lambda x: G.wrap(x, BY_NAME["int8"]).cast("long")), "((part + 128) % 256) - 128")
on_lists("wrap_int32_mul", "part", lambda: m("part", lambda x: G.wrapped(lambda a, b: a * b, x.cast("int"), F.lit(1_000_003), I32).cast("long")), "(((part * 1000003 + 2147483648) % 4294967296) + 4294967296) % 4294967296 - 2147483648")

# unary
on_lists("unary_math", "disc", lambda: m("disc", lambda x: F.round(F.sin(x) + F.cos(x) + F.exp(x) + F.sqrt(x), 6)), "round(sin(disc) + cos(disc) + exp(disc) + sqrt(disc), 6)")
on_lists("unary_log", "disc", lambda: m("disc", lambda x: G.log(x)), "CASE WHEN disc = 0 THEN '-inf'::DOUBLE ELSE ln(disc) END")
on_lists("unary_log_bases", "qty", lambda: m("qty", lambda x: F.round(G.log(x, 2) + G.log(x, 10), 6)), "round(log2(qty) + log10(qty), 6)")
on_lists("unary_tan", "disc", lambda: m("disc", lambda x: F.round(F.tan(x), 6)), "round(tan(disc), 6)")
on_lists("unary_sign_abs", "qty", lambda: m("qty", lambda x: G.unary("sign", x - 25, F64) * 100 + G.unary("abs", x - 25, F64)), "sign(qty - 25)::DOUBLE * 100 + abs(qty - 25)")
on_lists("unary_round_floor_ceil", "qty", lambda: m("qty", lambda x: G.unary("round", x / 4 - 5, F64) + 0.0 + 100 * G.unary("floor", x / 4, F64) + 10000 * G.unary("ceil", x / 4, F64)), "round(qty / 4 - 5) + 0.0 + 100 * floor(qty / 4) + 10000 * ceil(qty / 4)")
on_lists("reciprocal_int", "part", lambda: m("part", lambda x: G.reciprocal(x % 4 - 1, True)), "CASE part % 4 - 1 WHEN 1 THEN 1 WHEN -1 THEN -1 ELSE 0 END::BIGINT")
on_lists("reciprocal_float", "qty", lambda: m("qty", lambda x: G.reciprocal(x, False)), "1 / qty")
on_lists("angle", "qty", lambda: m("qty", lambda x: G.angle(x - 25)), "CASE WHEN qty < 25 THEN pi() ELSE 0.0 END::DOUBLE")

# predicates
for _name, _op in (("equal", "="), ("not_equal", "<>"), ("less", "<"), ("less_equal", "<="), ("greater", ">"), ("greater_equal", ">=")):
    on_lists(f"cmp_{_name}", "qn qx price", lambda n=_name: z("qn", "qx", lambda x, y: G.compare(n, x, y - 1)), f"CASE WHEN qn IS NULL THEN NULL WHEN isnan(qx) THEN {str(_name == 'not_equal').lower()} ELSE qn {_op} qx - 1 END")
on_lists("isnan_isinf_isfinite", "qx disc", lambda: z("qx", "disc", lambda x, y: F.when(G.isnan(x), "nan").when(G.isinf(G.divide(x, y)), "inf").when(G.isfinite(x), "finite")), "CASE WHEN isnan(qx) THEN 'nan' WHEN disc = 0 THEN 'inf' ELSE 'finite' END")
on_lists("logical_and_strict", "qn price", lambda: z("qn", "price", lambda x, y: G.strict(lambda p, q: p & q, x > 25, y > 50000)), "CASE WHEN qn IS NULL THEN NULL ELSE qn > 25 AND price > 50000 END")
on_lists("logical_or_strict", "qn price", lambda: z("qn", "price", lambda x, y: G.strict(lambda p, q: p | q, x > 25, y > 50000)), "CASE WHEN qn IS NULL THEN NULL ELSE qn > 25 OR price > 50000 END")
on_lists("logical_xor_not", "qn price", lambda: z("qn", "price", lambda x, y: ~G.logical_xor(x > 25, y > 50000)), "CASE WHEN qn IS NULL THEN NULL ELSE (qn > 25) = (price > 50000) END")
on_lists("where_select", "qn qty price", lambda: F.zip_with(z("qn", "qty", lambda x, y: F.struct(x.alias("c"), y.alias("x"))), C("price"), lambda s, y: N.where(s["c"] > 25, s["x"], y)), "CASE WHEN qn IS NULL THEN NULL WHEN qn > 25 THEN qty ELSE price END")

# reductions along the list
on_rows("reduce_sum_dim1", "qn", lambda: N.total(C("qn"), "double"), "sum(qn)")
on_aggregate("reduce_mean_dim1", lambda v: F.round(F.avg(v("qn")), 6), "round(avg(qn), 6)")
on_rows("reduce_mean_dim1_lists", "qn", lambda: F.round(N.mean(C("qn")), 6), "round(avg(qn), 6)")
on_rows("reduce_min_dim1", "qx", lambda: N.minimum(C("qx"), True), "CASE WHEN bool_or(isnan(qx)) THEN 'nan'::DOUBLE ELSE min(qx) END")
on_rows("reduce_max_dim1", "qn", lambda: N.maximum(C("qn"), True), "max(qn)")
on_rows("reduce_ptp_dim1", "qn", lambda: N.ptp(C("qn"), True), "max(qn) - min(qn)")
on_rows("reduce_sum_bool", "qty", lambda: N.total(F.transform("qty", lambda x: (x > 25).cast("int")), "long"), "count(*) FILTER (qty > 25)")
on_rows("var_std_ddof0_dim1", "qn", lambda: F.round(N.variance(C("qn")) + F.sqrt(N.variance(C("qn"))), 4), "round(var_pop(qn) + stddev_pop(qn), 4)")
on_rows("var_ddof1_dim1", "qn", lambda: F.round(N.variance(C("qn"), 1), 4), "round(var_samp(qn), 4)")
on_rows("nanvar", "qx", lambda: F.round(N.variance(C("qx"), 0, True), 4), "round(var_pop(CASE WHEN NOT isnan(qx) THEN qx END), 4)")
on_aggregate("quantile_dim1", lambda v: F.round(F.percentile(v("qn"), F.lit(0.3)), 6), "round(quantile_cont(qn, 0.3), 6)")
on_rows("quantile_dim1_lists", "qn", lambda: F.round(N.quantile(C("qn"), 0.3), 6), "round(quantile_cont(qn, 0.3), 6)")
on_rows("median_dim1", "qn", lambda: N.quantile(C("qn"), 0.5), "quantile_cont(qn, 0.5)")
on_rows("nanmedian_dim1", "qx", lambda: N.quantile(C("qx"), 0.5, True), "quantile_cont(CASE WHEN NOT isnan(qx) THEN qx END, 0.5)")
on_rows("shape_dim1", "qn", lambda: F.size("qn").cast("long"), "count(*)")
on_rows("nshape_dim1", "qn", lambda: N.count_present(C("qn")), "count(qn)")
on_rows("argmax_dim1", "qty", lambda: N.argmax(C("qty")), "arg_min(pos, (-qty, pos))")
on_rows("argmin_dim1", "qty", lambda: N.argmin(C("qty")), "arg_min(pos, (qty, pos))")
on_rows("nanargmax", "qx", lambda: N.argmax(C("qx"), True), "arg_min(pos, (-qx, pos)) FILTER (NOT isnan(qx))")
on_rows("nanargmin", "qx", lambda: N.argmin(C("qx"), True), "arg_min(pos, (qx, pos)) FILTER (NOT isnan(qx))")
on_rows("search_sorted_left", "qty", lambda: N.search_sorted(N.sort(C("qty")), F.lit(20.0)), "count(*) FILTER (qty < 20)")
on_rows("search_sorted_right", "qty", lambda: N.search_sorted(N.sort(C("qty")), F.lit(20.0), True), "count(*) FILTER (qty <= 20)")
on_rows("row_dot", "qty disc", lambda: F.round(N.dot(C("qty"), C("disc")), 4), "round(sum(qty * disc), 4)")
on_rows("row_norm", "qty", lambda: F.round(N.norm(C("qty")), 4), "round(sqrt(sum(qty * qty)), 4)")


@query("sum_of_products", "SELECT key, round(sum(qty * price), 2) AS value FROM l GROUP BY key", lines=True)
def sum_of_products(spark, d):
    """The flagship: (a * b).sum(dim=1). As rows it is one aggregate with map-side combine."""
    li = table(spark, d, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("key")).agg(F.round(F.sum(F.col("l_quantity") * F.col("l_extendedprice")), 2).alias("value"))


@query("sum_of_products_lists", "SELECT key, round(sum(qty * price), 2) AS value FROM l GROUP BY key", lines=True)
def sum_of_products_lists(spark, d):
    df = nested(spark, d, "qty", "price")
    return df.select("key", F.round(N.total(z("qty", "price", lambda x, y: x * y), "double"), 2).alias("value"))


# sorting

@query("sort_dim1", "SELECT key, row_number() OVER (PARTITION BY key ORDER BY price) - 1 AS pos, price AS value FROM l", lines=True)
def sort_dim1(spark, d):
    return out(nested(spark, d, "price"), N.sort(C("price")))


@query("argsort_dim1", "SELECT key, row_number() OVER (PARTITION BY key ORDER BY qty, pos) - 1 AS pos, pos AS value FROM l", lines=True)
def argsort_dim1(spark, d):
    return out(nested(spark, d, "qty"), N.argsort(C("qty")))


@query("partition_topk", "SELECT key, pos, value FROM (SELECT key, row_number() OVER (PARTITION BY key ORDER BY price DESC) - 1 AS pos, price AS value FROM l) WHERE pos < 2", lines=True)
def partition_topk(spark, d):
    return out(nested(spark, d, "price"), F.slice(F.reverse(N.partition(C("price"), 0)), 1, 2))


@query("nonzero", "SELECT key, row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS pos, pos AS value FROM l WHERE qty > 25", lines=True)
def nonzero(spark, d):
    return out(nested(spark, d, "qty"), N.nonzero(m("qty", lambda x: x > 25)))


@query("argwhere_rows", "SELECT o_orderkey AS value FROM orders WHERE o_totalprice > 300000")
def argwhere_rows(spark, d):
    return table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_orderkey").alias("value"))


# axis 0
def placed(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Lines with their place in their order: no list is made."""
    from pyspark.sql import Window

    taken = [F.expr(VALUES[c]).alias(c) for c in columns]
    li = table(spark, d, "lineitem")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ORDER)) - 1
    return li.select(F.col("l_orderkey").alias("key"), place.cast("long").alias("pos"), *taken)


@query("reduce_sum_dim0_strict", "SELECT pos, CASE WHEN count(qn) = (SELECT count(DISTINCT key) FROM l) THEN sum(qn) END AS value, max(qn) AS greatest FROM l GROUP BY pos", lines=True)
def reduce_sum_dim0_strict(spark, d):
    """One pass: every order with lines has a first one, so the rows at place 0 tell how many there are."""
    found = placed(spark, d, "qn").groupBy("pos").agg(F.count("qn").alias("n"), F.count("*").alias("rows"), F.sum("qn").alias("value"), F.max("qn").alias("greatest"))
    total = F.max(F.when(F.col("pos") == 0, F.col("rows"))).over(_all_places())
    return found.withColumn("total", total).select("pos", F.when(F.col("n") == F.col("total"), F.col("value")).alias("value"), "greatest")


def _all_places():
    """One group of a row per place: as long as the longest list."""
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))


@query("var_dim0_strict", "SELECT pos, round(CASE WHEN count(qty) = (SELECT count(DISTINCT key) FROM l) THEN var_pop(qty) END, 4) AS value FROM l GROUP BY pos", lines=True)
def var_dim0_strict(spark, d):
    found = placed(spark, d, "qty").groupBy("pos").agg(F.count("qty").alias("n"), F.count("*").alias("rows"), F.var_pop("qty").alias("value"))
    total = F.max(F.when(F.col("pos") == 0, F.col("rows"))).over(_all_places())
    return found.withColumn("total", total).select("pos", F.round(F.when(F.col("n") == F.col("total"), F.col("value")), 4).alias("value"))


@query("reduce_axis0_rows", "SELECT round(sum(value), 2) AS total, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS greatest, round(max(value) - min(value), 2) AS ptp, round(quantile_cont(value, 0.5), 6) AS median FROM events")
def reduce_axis0_rows(spark, d):
    ev = table(spark, d, "events")
    return ev.agg(F.round(F.sum("value"), 2).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("greatest"), F.round(F.max("value") - F.min("value"), 2).alias("ptp"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("median"))


def customers(spark: SparkSession, d: str) -> DataFrame:
    """key and x: an array of orders, each the array of its quantities (empty for orders without lines)."""
    lines = nested(spark, d, "qty").select(F.col("key").alias("o_orderkey"), "qty")
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("key")).join(lines, "o_orderkey", "left")
    lists = F.array_sort(F.collect_list(F.struct("o_orderkey", F.coalesce("qty", F.array().cast("array<double>")).alias("qty"))))
    return orders.groupBy("key").agg(lists.getField("qty").alias("x"))


THREE = """WITH o AS (SELECT o_custkey AS key, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos FROM orders),
q AS (SELECT o.key, o.pos, l.pos AS idx, l.qty FROM o LEFT JOIN l ON l.key = o.o_orderkey)"""


@query("reduce_deep_dim2", THREE + " SELECT key, pos, sum(qty) AS value FROM q GROUP BY key, pos", lines=True)
def reduce_deep_dim2(spark, d):
    """Orders are summed before they are nested: lists only hold what is asked for."""
    sums = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("value"))
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("key")).join(sums, "o_orderkey", "left")
    lists = F.array_sort(F.collect_list(F.struct("o_orderkey", "value")))
    return out(orders.groupBy("key").agg(lists.getField("value").alias("x")), C("x"))


@query("reduce_deep_dim1", THREE + ", c AS (SELECT key, count(DISTINCT pos) AS n FROM q GROUP BY key) SELECT key, idx AS pos, CASE WHEN count(qty) = any_value(n) THEN sum(qty) END AS value FROM q JOIN c USING (key) WHERE idx IS NOT NULL GROUP BY key, idx", lines=True)
def reduce_deep_dim1(spark, d):
    orders = customers(spark, d).select("key", F.posexplode("x").alias("o", "y"), F.size("x").alias("n"))
    lines = orders.select("key", "n", F.posexplode("y").alias("pos", "qty"))
    found = lines.groupBy("key", F.col("pos").cast("long").alias("pos")).agg(F.when(F.count("qty") == F.first("n"), F.sum("qty")).alias("value"))
    return found


@query("reduce_deep_dim0", THREE + ", s AS (SELECT pos, count(*) AS n FROM o GROUP BY pos) SELECT pos, idx, CASE WHEN count(qty) = any_value(n) THEN sum(qty) END AS value FROM q JOIN s USING (pos) WHERE idx IS NOT NULL GROUP BY pos, idx", lines=True)
def reduce_deep_dim0(spark, d):
    lines = customers(spark, d).select(F.col("key").alias("_pos"), F.posexplode("x").alias("pos", "y")).select("_pos", F.col("pos").cast("long").alias("pos"), F.posexplode_outer("y").alias("idx", "qty"))
    return rows.level_axis0(lines.withColumn("idx", F.col("idx").cast("long")), {"value": F.sum("qty")}, "pos", "idx", "qty")


@query("reduce_all", THREE + " SELECT sum(qty) AS total, min(qty) AS least, max(qty) AS greatest FROM q", lines=True)
def reduce_all(spark, d):
    leaves = customers(spark, d).select(F.explode(F.flatten("x")).alias("v"))
    return leaves.agg(F.sum("v").alias("total"), F.min("v").alias("least"), F.max("v").alias("greatest"))


@query("shape_deep", THREE + " SELECT key, pos, count(idx) AS value FROM q GROUP BY key, pos", lines=True)
def shape_deep(spark, d):
    return out(customers(spark, d), F.transform("x", lambda y: F.size(y).cast("long")))


@query("flatten_deep", THREE + " SELECT key, row_number() OVER (PARTITION BY key ORDER BY pos, idx) - 1 AS pos, qty AS value FROM q WHERE idx IS NOT NULL", lines=True)
def flatten_deep(spark, d):
    return out(customers(spark, d), F.flatten("x"))


@query("df_level_peel", THREE + " SELECT key, pos, idx, qty AS value FROM q WHERE idx IS NOT NULL", lines=True)
def df_level_peel(spark, d):
    peeled = customers(spark, d).select("key", F.posexplode("x").alias("pos", "y"))
    return peeled.select("key", F.col("pos").cast("long").alias("pos"), F.posexplode("y").alias("idx", "value")).withColumn("idx", F.col("idx").cast("long"))


@query("df_drill_down", THREE + " SELECT key, idx AS pos, qty AS value FROM q WHERE pos = 1 AND idx IS NOT NULL", lines=True)
def df_drill_down(spark, d):
    return out(customers(spark, d), F.get("x", F.lit(1)))


# indexing and reshaping
@query("slice_rows", "SELECT (o_orderkey - 100) // 3 AS pos, o_totalprice AS value FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 1000 AND (o_orderkey - 100) % 3 = 0")
def slice_rows(spark, d):
    df = table(spark, d, "orders").select(F.col("o_orderkey").alias("_pos"), F.col("o_totalprice").alias("value"))
    return rows.slice_rows(df, 100, 1000, 3).withColumnRenamed("_pos", "pos")


@query("bool_mask_rows", "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_totalprice AS value FROM orders WHERE o_orderstatus = 'F'")
def bool_mask_rows(spark, d):
    df = table(spark, d, "orders").select(F.col("o_orderkey").alias("_pos"), "o_orderstatus", F.col("o_totalprice").alias("value"))
    mask = df.select("_pos", (F.col("o_orderstatus") == "F").alias("keep"))
    return rows.mask_rows(df, mask).select(F.col("_pos").alias("pos"), "value")


@query("fancy_rows", "SELECT k AS pos, o_totalprice AS value FROM orders JOIN (VALUES (0, 7), (1, 3), (2, 7), (3, 42)) t(k, i) ON o_orderkey = i")
def fancy_rows(spark, d):
    df = table(spark, d, "orders").select(F.col("o_orderkey").alias("_pos"), F.col("o_totalprice").alias("value"))
    return rows.fancy_rows(df, [7, 3, 7, 42]).select(F.col("_pos").cast("int").alias("pos"), "value")


@query("fancy_coords", "SELECT key, qty AS value FROM l WHERE pos = 0", lines=True)
def fancy_coords(spark, d):
    return nested(spark, d, "qty").select("key", N.element(C("qty"), 0).alias("value"))


@query("negative_index", "SELECT key, arg_max(qty, pos) AS value FROM l GROUP BY key", lines=True)
def negative_index(spark, d):
    return nested(spark, d, "qty").select("key", N.element(C("qty"), -1).alias("value"))


@query("per_row_select", "WITH n AS (SELECT key, max(pos) AS last FROM l GROUP BY key) SELECT key, 0 AS pos, qty AS value FROM l JOIN n USING (key) WHERE pos = last UNION ALL SELECT key, 1, qty FROM l WHERE pos = 0", lines=True)
def per_row_select(spark, d):
    df = nested(spark, d, "qty")
    return out(df, N.take(C("qty"), F.array(F.lit(-1), F.lit(0)))).withColumn("pos", F.col("pos").cast("int"))


@query("inner_slice", "SELECT key, pos // 2 AS pos, qty AS value FROM l WHERE pos % 2 = 0", lines=True)
def inner_slice(spark, d):
    return out(nested(spark, d, "qty"), N.slice_(C("qty"), None, None, 2))


@query("setitem_mask", "SELECT key, pos, CASE WHEN qty > 25 THEN -1.0 ELSE qty END::DOUBLE AS value FROM l", lines=True)
def setitem_mask(spark, d):
    return out(nested(spark, d, "qty"), m("qty", lambda x: F.when(x > 25, -1.0).otherwise(x)))


@query("setitem_coord", "SELECT key, pos, CASE WHEN pos = 1 THEN 0.0 ELSE qty END::DOUBLE AS value FROM l", lines=True)
def setitem_coord(spark, d):
    return out(nested(spark, d, "qty"), N.put(C("qty"), 1, 0.0))


@query("full_like", "SELECT key, pos, 7 AS value FROM l", lines=True)
def full_like(spark, d):
    return out(nested(spark, d, "qn"), N.full_like(C("qn"), 1, F.lit(7)))


@query("flatten", "SELECT key, pos, qty AS value FROM l", lines=True)
def flatten(spark, d):
    return rows.flatten(nested(spark, d, "qty"), "qty", "key", at="pos").select("key", F.col("pos").cast("long").alias("pos"), F.col("qty").alias("value"))


@query("unflatten", "SELECT key, i AS pos, sum(qty) FILTER ((pos < 1) = (i = 0)) AS value, count(qty) FILTER ((pos < 1) = (i = 0)) AS n FROM l CROSS JOIN range(0, 2) t(i) GROUP BY key, i", lines=True)
def unflatten(spark, d):
    """The first line of each order, and the others."""
    df = nested(spark, d, "qty")
    runs = N.unflatten(C("qty"), F.array(F.lit(1), F.size("qty") - 1))
    each = df.select("key", F.posexplode(runs).alias("pos", "r"))
    return each.select("key", F.col("pos").cast("long").alias("pos"), N.total(C("r"), "double").alias("value"), F.size("r").cast("long").alias("n"))


@query("cat_dim0", "SELECT n_nationkey::BIGINT AS pos, n_name AS value FROM nation UNION ALL SELECT (SELECT count(*) FROM nation) + r_regionkey, r_name FROM region")
def cat_dim0(spark, d):
    a = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("_pos"), F.col("n_name").alias("value"))
    b = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("_pos"), F.col("r_name").alias("value"))
    return rows.concat_rows([a, b]).select(F.col("_pos").alias("pos"), "value")


@query("cat_dim1", "WITH n AS (SELECT key, count(*) AS n FROM l GROUP BY key) SELECT key, pos, qty AS value FROM l UNION ALL SELECT key, pos + n, price FROM l JOIN n USING (key)", lines=True)
def cat_dim1(spark, d):
    return out(nested(spark, d, "qty", "price"), F.concat("qty", "price"))


@query("broadcast_axis0", "SELECT vec_id AS key, i AS pos, embedding[i + 1]::DOUBLE + (SELECT embedding FROM embeddings WHERE vec_id = 0)[i + 1]::DOUBLE AS value FROM embeddings, range(0, 64) t(i)")
def broadcast_axis0(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("x"))
    one = e.where("key = 0").select(F.col("x").alias("y"))
    return out(e.crossJoin(F.broadcast(one)), N.zip_leaf(C("x"), C("y"), 1, 1, lambda x, y: x + y))


# sets
@query("unique", "SELECT DISTINCT l_quantity + 0.0 AS value FROM lineitem")
def unique(spark, d):
    return sets.unique(table(spark, d, "lineitem").select(F.col("l_quantity").alias("value")))


@query("isin", "SELECT key, pos, CASE WHEN qn IS NULL THEN NULL ELSE qn IN (1, 5, 42) END AS value FROM l", lines=True)
def isin(spark, d):
    return out(nested(spark, d, "qn"), m("qn", lambda x: N.isin(x, F.array(F.lit(1.0), F.lit(5.0), F.lit(42.0)))))


@query("isin_join", "SELECT o_orderkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS found FROM orders")
def isin_join(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("value"))
    return sets.isin(orders, table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("value"))).select("o_orderkey", "found")


def _two_sets(spark, d):
    li = table(spark, d, "lineitem")
    return li.where("l_quantity < 30").select(F.col("l_partkey").alias("value")), table(spark, d, "part").where("p_size > 20").select(F.col("p_partkey").alias("value"))


_SETS = "WITH a AS (SELECT DISTINCT l_partkey AS value FROM lineitem WHERE l_quantity < 30), b AS (SELECT DISTINCT p_partkey AS value FROM part WHERE p_size > 20) "


@query("setunion", _SETS + "SELECT value FROM a UNION SELECT value FROM b")
def setunion(spark, d):
    return sets.setunion(*_two_sets(spark, d))


@query("setdiff", _SETS + "SELECT value FROM a EXCEPT SELECT value FROM b")
def setdiff(spark, d):
    return sets.setdiff(*_two_sets(spark, d))


@query("setxor", _SETS + "(SELECT value FROM a EXCEPT SELECT value FROM b) UNION (SELECT value FROM b EXCEPT SELECT value FROM a)")
def setxor(spark, d):
    return sets.setxor(*_two_sets(spark, d))


# histograms
@query("bincount", "SELECT i AS bin, count(p_size) AS count FROM range(0, (SELECT max(p_size) + 1 FROM part)) t(i) LEFT JOIN part ON p_size = i GROUP BY i")
def bincount(spark, d):
    return hist.bincount(table(spark, d, "part"), "p_size")


@query("bincount_weighted", "SELECT i AS bin, round(coalesce(sum(p_retailprice), 0), 2) AS count FROM range(0, 60) t(i) LEFT JOIN part ON p_size = i GROUP BY i")
def bincount_weighted(spark, d):
    return hist.bincount(table(spark, d, "part"), "p_size", "p_retailprice", 60).withColumn("count", F.round("count", 2))


@query("digitize", "SELECT p_partkey AS key, CASE WHEN p_size <= 10 THEN 0 WHEN p_size <= 25 THEN 1 WHEN p_size <= 40 THEN 2 ELSE 3 END::BIGINT AS value FROM part")
def digitize(spark, d):
    bins = F.array(*[F.lit(x) for x in (10.0, 25.0, 40.0)])
    return table(spark, d, "part").select(F.col("p_partkey").alias("key"), N.digitize(F.col("p_size").cast("double"), bins).alias("value"))


@query("histogram", "SELECT i AS bin, 10.0::DOUBLE * i AS low, 10.0::DOUBLE * (i + 1) AS high, count(l_quantity)::DOUBLE AS count FROM range(0, 5) t(i) LEFT JOIN lineitem ON l_quantity >= 10 * i AND (l_quantity < 10 * (i + 1) OR (i = 4 AND l_quantity = 50)) GROUP BY i")
def histogram(spark, d):
    return hist.histogram(table(spark, d, "lineitem"), "l_quantity", 5, (0.0, 50.0))


@query("histogram_density", "SELECT i AS bin, round(count(l_quantity) / (SELECT count(*) FROM lineitem) / 10, 8) AS density FROM range(0, 5) t(i) LEFT JOIN lineitem ON l_quantity >= 10 * i AND (l_quantity < 10 * (i + 1) OR (i = 4 AND l_quantity = 50)) GROUP BY i")
def histogram_density(spark, d):
    return hist.histogram(table(spark, d, "lineitem"), "l_quantity", 5, (0.0, 50.0), density=True).select("bin", F.round("count", 8).alias("density"))


# linear algebra: the embeddings are a matrix
def matrix(spark: SparkSession, d: str, where: str = "true") -> DataFrame:
    e = table(spark, d, "embeddings").where(where).select("vec_id", F.posexplode("embedding").alias("j", "v"))
    return linalg.tensor(e, ["vec_id", "j"], "v")


MATRIX = "WITH e AS (SELECT vec_id AS i, unnest(range(0, 64)) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings) "


@query("dot", MATRIX + "SELECT round(sum(a.v * b.v), 6) AS v FROM e a JOIN e b ON a.i = b.i WHERE a.j = 0 AND b.j = 1")
def dot(spark, d):
    """The first two components of all vectors, as vectors over the rows."""
    a, b = (matrix(spark, d).where(f"i1 = {j}").select("i0", "v") for j in (0, 1))
    return linalg.dot(a, b).select(F.round("v", 6).alias("v"))


def component_sums(spark: SparkSession, d: str) -> DataFrame:
    return linalg.einsum("ij->j", matrix(spark, d))


@query("norm", MATRIX + "SELECT i, round(sqrt(sum(v * v)), 6) AS v FROM e GROUP BY i")
def norm(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.round(N.norm(F.col("embedding").cast("array<double>")), 6).alias("v"))


@query("outer", MATRIX + ", s AS (SELECT j, sum(v) AS v FROM e GROUP BY j) SELECT a.j AS i0, b.j AS i1, round(a.v * b.v, 6) AS v FROM s a, s b")
def outer(spark, d):
    a = component_sums(spark, d)
    return linalg.outer(a, a).withColumn("v", F.round("v", 6))


@query("trace", MATRIX + "SELECT round(sum(v), 6) AS v FROM e WHERE i = j")
def trace(spark, d):
    return linalg.trace(matrix(spark, d)).select(F.round("v", 6).alias("v"))


@query("cross", "SELECT vec_id AS key, unnest(range(0, 3)) AS pos, unnest([round(y * w - z * v, 8), round(z * u - x * w, 8), round(x * v - y * u, 8)]) AS value FROM (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS u, embedding[5]::DOUBLE AS v, embedding[6]::DOUBLE AS w FROM embeddings)")
def cross(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("x"))
    return out(e, N.map_leaf(N.cross(F.slice("x", 1, 3), F.slice("x", 4, 3)), 1, lambda v: F.round(v, 8)))


@query("matmul", MATRIX + "SELECT a.j AS i0, b.j AS i1, round(sum(a.v * b.v), 5) AS v FROM e a JOIN e b ON a.i = b.i GROUP BY 1, 2")
def matmul(spark, d):
    a = matrix(spark, d)
    return linalg.einsum("ij,ik->jk", a, a).withColumn("v", F.round("v", 5))


@query("transpose", MATRIX + "SELECT j AS i0, i AS i1, v FROM e")
def transpose(spark, d):
    return linalg.einsum("ij->ji", matrix(spark, d))


@query("frobenius", MATRIX + "SELECT round(sum(v * v), 5) AS v FROM e")
def frobenius(spark, d):
    a = matrix(spark, d)
    return linalg.einsum("ij,ij->", a, a).select(F.round("v", 5).alias("v"))


@query("einsum_row_sum", MATRIX + "SELECT i AS i0, round(sum(v), 6) AS v FROM e GROUP BY i")
def einsum_row_sum(spark, d):
    return linalg.einsum("ij->i", matrix(spark, d)).withColumn("v", F.round("v", 6))


@query("tensordot", MATRIX + ", s AS (SELECT j, sum(v) AS v FROM e GROUP BY j) SELECT a.i AS i0, round(sum(a.v * b.v), 6) AS v FROM e a JOIN s b ON a.j = b.j GROUP BY a.i")
def tensordot(spark, d):
    return linalg.tensordot(matrix(spark, d), component_sums(spark, d), 1).withColumn("v", F.round("v", 6))


def _square(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("x"))
    return e.select("key", F.array(*[F.slice("x", 1 + 3 * i, 3) for i in range(3)]).alias("m"))


@query("det", "SELECT vec_id AS key, round(e[1] * (e[5] * e[9] - e[6] * e[8]) - e[2] * (e[4] * e[9] - e[6] * e[7]) + e[3] * (e[4] * e[8] - e[5] * e[7]), 8) + 0.0 AS value FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)")
def det(spark, d):
    return _square(spark, d).select("key", (F.round(linalg.det("m"), 8) + 0.0).alias("value"))


@query("inv")
def inv(spark, d):
    return _square(spark, d).select("key", F.transform(linalg.inv("m"), lambda r: F.transform(r, lambda v: F.round(v, 4))).alias("value"))


# neighbours
def points(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("pos"), F.col("label").alias("grp"), F.col("embedding").cast("array<double>").alias("e"))
    return e.select("pos", "grp", F.slice("e", 1, 3).alias("point"))


def rounded(name: str):
    """To 6 digits as the SQL's round does it, on the number times 10**6 and half away from zero; F.round goes by its decimal text, which is slow, too."""
    up = F.col(name) * 1e6
    low = F.floor(up)
    return F.when(up < 2.0**52, (low + F.when(up - low >= 0.5, 1).otherwise(0)) / 1e6).otherwise(F.col(name))


_D2 = "(a.p[1] - b.p[1]) ** 2 + (a.p[2] - b.p[2]) ** 2 + (a.p[3] - b.p[3]) ** 2"


@query("knn_dim0", f"WITH {POINTS} SELECT src, dst, rank, round(sqrt(d2), 6) AS distance FROM (SELECT *, (row_number() OVER (PARTITION BY src ORDER BY d2, dst) - 1)::INTEGER AS rank FROM (SELECT a.pos AS src, b.pos AS dst, {_D2} AS d2 FROM pt a JOIN pt b ON a.pos <> b.pos)) WHERE rank < 4")
def knn_dim0(spark, d):
    p = points(spark, d)
    return neighbors.knn(p, p, 4, loop=False).select("src", "dst", "rank", rounded("distance").alias("distance"))


@query("knn_dim1_by_label", f"WITH {POINTS}, r AS (SELECT grp, row_number() OVER (PARTITION BY grp ORDER BY pos) - 1 AS pos, p FROM pt) SELECT grp, src, dst, rank, round(sqrt(d2), 6) AS distance FROM (SELECT *, (row_number() OVER (PARTITION BY grp, src ORDER BY d2, dst) - 1)::INTEGER AS rank FROM (SELECT a.grp, a.pos AS src, b.pos AS dst, {_D2} AS d2 FROM r a JOIN r b ON a.grp = b.grp)) WHERE rank < 3")
def knn_dim1_by_label(spark, d):
    from pyspark.sql import Window

    p = points(spark, d).withColumn("pos", F.row_number().over(Window.partitionBy("grp").orderBy("pos")) - 1)
    return neighbors.knn(p, p, 3, group="grp").select("grp", "src", "dst", "rank", rounded("distance").alias("distance"))


@query("radius_dim0", f"WITH {POINTS} SELECT a.pos AS src, b.pos AS dst, round(sqrt({_D2}), 6) AS distance FROM pt a JOIN pt b ON {_D2} <= 0.05::DOUBLE * 0.05::DOUBLE")
def radius_dim0(spark, d):
    p = points(spark, d)
    return neighbors.radius(p, p, 0.05, dimensions=3).select("src", "dst", rounded("distance").alias("distance"))


@query("radius_dim1_no_loop", f"WITH {POINTS} SELECT a.grp, a.pos AS src, b.pos AS dst, round(sqrt({_D2}), 6) AS distance FROM pt a JOIN pt b ON a.grp = b.grp AND a.pos <> b.pos AND {_D2} <= 0.1::DOUBLE * 0.1::DOUBLE")
def radius_dim1_no_loop(spark, d):
    p = points(spark, d)
    return neighbors.radius(p, p, 0.1, loop=False, group="grp", dimensions=3).select("grp", "src", "dst", rounded("distance").alias("distance"))


@query("pairwise_dim1", f"WITH {POINTS} SELECT a.grp, a.pos AS src, b.pos AS dst, round(sqrt({_D2}), 6) AS distance FROM pt a JOIN pt b ON a.grp = b.grp")
def pairwise_dim1(spark, d):
    return neighbors.pairwise(points(spark, d), "grp", dimensions=3).withColumn("distance", rounded("distance"))


@query("grid_pool", f"WITH {POINTS}, c AS (SELECT grp, floor((p[1] + 0.5) / 0.25)::BIGINT AS x, floor((p[2] + 0.5) / 0.25)::BIGINT AS y, floor((p[3] + 0.5) / 0.25)::BIGINT AS z FROM pt), s AS (SELECT grp, x + 4 * (y + 4 * z) AS cell FROM c WHERE x BETWEEN 0 AND 3 AND y BETWEEN 0 AND 3 AND z BETWEEN 0 AND 3) SELECT g.grp, i AS cell, count(s.cell)::DOUBLE AS count FROM (SELECT DISTINCT grp FROM pt) g CROSS JOIN range(0, 64) t(i) LEFT JOIN s ON s.grp = g.grp AND s.cell = i GROUP BY ALL")
def grid_pool(spark, d):
    return hist.grid_pool(points(spark, d), "point", ["grp"], (4, 4, 4), (-0.5, -0.5, -0.5), 0.25)


# frames and unions
@query("df_column_subset", "SELECT c_custkey, c_mktsegment FROM customer")
def df_column_subset(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment")


@query("df_renest_assign", "SELECT key, pos, qty * 2 AS value FROM l", lines=True)
def df_renest_assign(spark, d):
    doubled = flat(spark, d, "qty").withColumn("qty", F.col("qty") * 2)
    return out(rows.nest(doubled, "qty", "pos", "key"), C("qty"))


@query("df_max", "SELECT max(qty) AS qty, max(price) AS price FROM l", lines=True)
def df_max(spark, d):
    return nested(spark, d, "qty", "price").agg(F.max(F.array_max("qty")).alias("qty"), F.max(F.array_max("price")).alias("price"))


def unions(spark: SparkSession, d: str) -> DataFrame:
    """A scalar for orders of one line, a list for the others."""
    u = F.when(F.size("qty") == 1, N.union_scalar(F.get("qty", F.lit(0)))).otherwise(N.union_list(C("qty")))
    return nested(spark, d, "qty").select("key", u.alias("u"))


@query("union_scale", "WITH n AS (SELECT key, count(*) AS n FROM l GROUP BY key) SELECT key, n > 1 AS is_list, pos, qty * 2 AS value FROM l JOIN n USING (key)", lines=True)
def union_scale(spark, d):
    df = unions(spark, d).select("key", N.union_map(C("u"), lambda x: x * 2).alias("u"))
    return df.select("key", "u.is_list", F.posexplode("u.items").alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))


@query("union_sum_dim0", "SELECT key, sum(qty) AS value FROM l GROUP BY key", lines=True)
def union_sum_dim0(spark, d):
    return unions(spark, d).select("key", N.union_fold(C("u"), lambda a: N.total(a, "double")).alias("value"))


@query("union_broadcast_add", "WITH n AS (SELECT key, count(*) AS n FROM l GROUP BY key) SELECT key, n > 1 AS is_list, pos, qty + key AS value FROM l JOIN n USING (key)", lines=True)
def union_broadcast_add(spark, d):
    df = unions(spark, d).select("key", N.union_zip(C("u"), N.union_scalar(C("key").cast("double")), lambda x, y: x + y).alias("u"))
    return df.select("key", "u.is_list", F.posexplode("u.items").alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))


# random: no oracle
@query("random_uniform")
def random_uniform(spark, d):
    return table(spark, d, "events").select("event_id", random.uniform(7, "event_id").alias("u"), random.normal(7, "event_id").alias("n"), random.integers(7, 0, 10, "event_id").alias("i"))


@query("random_permutation")
def random_permutation(spark, d):
    return random.permutation(table(spark, d, "events").select(F.col("event_id").alias("_pos"), "value"), 7)


@query("random_choice")
def random_choice(spark, d):
    return random.choice(table(spark, d, "events").select(F.col("event_id").alias("_pos"), "value"), 100, 7)
