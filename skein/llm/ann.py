"""Approximate nearest neighbours over learned partitions.

Rows start in one part. A part with more than twice ``rows_per_part`` rows (the first one always) is learned on a sample of
its own, bounded by ``sample_rows``, in a task: the sample's neighbour graph is cut into up to 64 balanced parts by
recursive bisection (sign-split Fiedler vectors at the median), and a small network learns the part of a vector.
Rows go to their most probable part, and on from there, until parts are small: their number grows with the rows. A
query goes down to the part of its own vector and the most probable parts of every level until they hold ``mass`` of the probability, ``probes``
parts and more than k ids. Within a part, blocks of rows meet blocks of queries, each pair of blocks in one
task, so a part of any size is no single group; scores are exact cosines in double precision,
summed in the order of components, so equal vectors have equal scores.

Nulls: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
null ids and vectors whose length is not the most common one. A repeated id counts
once, by its best score. Ties go to the smaller id. Empty tables give empty results.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.store import cut

SAMPLE_ROWS, ROWS_PER_PART = 6_000, 2_048
#: Bisections of one part: as many as its size asks for, of the first part at least the fewest.
FEWEST, MOST = 3, 6
CHILDREN = 1 << MOST
#: Levels of parts: with 64 parts each, more than any table needs.
DEPTH = 9
CAND_BLOCK, QUERY_BLOCK, ROUTE_BLOCK = 4_096, 1_024, 32_768


@dataclass
class Router:
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def chances(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(x @ self.w1 + self.b1, 0)
        z = h @ self.w2 + self.b2
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def neighbour_graph(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Both ends of the symmetric graph of k nearest neighbours among unit vectors."""
    n = len(x)
    k = min(k, n - 1)
    near = np.empty((n, k), np.int64)
    for a in range(0, n, 1024):
        s = x[a : a + 1024] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        near[a : a + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    i, j = np.repeat(np.arange(n), k), near.ravel()
    return np.concatenate([i, j]), np.concatenate([j, i])


def balanced_parts(i: np.ndarray, j: np.ndarray, n: int, levels: int, draw: np.random.Generator, steps: int = 60) -> np.ndarray:
    """2**levels parts of equal size, each bisection at the median of an approximate Fiedler vector."""
    part = np.zeros(n, np.int64)
    for _ in range(levels):
        inside = part[i] == part[j]
        a, b = i[inside], j[inside]
        degree = np.bincount(a, minlength=n) + 1e-9
        v = draw.normal(size=n)
        sizes = np.bincount(part)
        weight = np.bincount(part, degree)
        for _ in range(steps):  # all parts at once; each is kept orthogonal to its constant vector
            v = 0.5 * v + 0.5 * np.bincount(a, v[b], n) / degree
            v -= (np.bincount(part, v * degree) / weight)[part]
            v /= np.sqrt(np.bincount(part, v * v) + 1e-30)[part]
        order = np.lexsort((v, part))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        part = 2 * part + (rank >= (sizes / 2)[part])
    return part


def learn(x: np.ndarray, levels: int, hidden: int = 96, epochs: int = 40, seed: int = 5) -> Router:
    """x: unit vectors of the sample."""
    draw = np.random.default_rng(seed)
    n, d = x.shape
    parts = 2**levels
    y = balanced_parts(*neighbour_graph(x, 12), n, levels, draw)
    model = [draw.normal(0, np.sqrt(2 / d), (d, hidden)) * 4, np.zeros(hidden), draw.normal(0, np.sqrt(2 / hidden), (hidden, parts)), np.zeros(parts)]
    first, second = [np.zeros_like(m) for m in model], [np.zeros_like(m) for m in model]
    t = 0
    for _ in range(epochs):
        order = draw.permutation(n)
        for a in range(0, n, 128):
            own = order[a : a + 128]
            h = np.maximum(x[own] @ model[0] + model[1], 0)
            z = h @ model[2] + model[3]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(own)), y[own]] -= 1
            p /= len(own)
            back = (p @ model[2].T) * (h > 0)
            t += 1
            for k, g in enumerate((x[own].T @ back, back.sum(0), h.T @ p, p.sum(0))):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model[k] -= 0.003 * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return Router(*model)


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _packed(batches):
    for batch in batches:
        if batch.num_rows:
            v = batch.column("vec")
            flat = v.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            ends = np.cumsum(np.asarray([len(x) for x in v]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("is_query"), pa.array([flat[e - len(x) : e].tobytes() for x, e in zip(v, ends)], pa.binary())], ["id", "is_query", "vec"])


def _fitted(dim: int, sample_rows: int, rows_per_part: int):
    """The router of one part, from the sample rows of least hash."""

    def run(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("h").to_numpy(), kind="stable")[:sample_rows]
        x = _unit(_matrix(rows.column("vec").take(pa.array(order)), dim))
        part, size = rows.column("part")[0].as_py(), rows.column("size")[0].as_py()
        levels = int(np.clip(np.ceil(np.log2(size / rows_per_part)), FEWEST if part == 1 else 1, MOST))
        levels = min(levels, int(np.log2(max(1, len(x) / 16))))
        if not levels:  # too few rows to learn from: the part stays whole
            return pa.table({"part": pa.array([], pa.int64()), "model": pa.array([], pa.binary())})
        model = learn(x, levels)
        return pa.table({"part": pa.array([part], pa.int64()), "model": pa.array([pickle.dumps(model)], pa.binary())})

    return run


def _sent(dim: int):
    """Rows of a part (one block of them) to the most probable of its parts; without a model they stay."""
    schema = pa.schema([("id", pa.int64()), ("is_query", pa.bool_()), ("vec", pa.binary()), ("part", pa.int64())])

    def run(rows: pa.Table, models: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return schema.empty_table()
        child = np.zeros(rows.num_rows, np.int64)
        if models.num_rows:
            router = pickle.loads(models.column("model")[0].as_py())
            for a in range(0, len(child), 8192):
                child[a : a + 8192] = router.chances(_unit(_matrix(rows.column("vec").slice(a, 8192), dim))).argmax(1)
        part = rows.column("part").to_numpy() * CHILDREN + child
        return pa.table([*(rows.column(c).combine_chunks() for c in ("id", "is_query", "vec")), pa.array(part)], schema=schema)

    return run


def _asked(dim: int):
    """Queries of a part to all of its parts, with their chances, and whether rows with the query's vector go there."""
    schema = pa.schema([("id", pa.int64()), ("vec", pa.binary()), ("part", pa.int64()), ("chance", pa.float64()), ("home", pa.bool_())])

    def run(queries: pa.Table, models: pa.Table) -> pa.Table:
        if not queries.num_rows:
            return schema.empty_table()
        part, chance = queries.column("part").to_numpy() * CHILDREN, queries.column("chance").to_numpy()
        if not models.num_rows:
            return pa.table([queries.column("id").combine_chunks(), queries.column("vec").combine_chunks(), pa.array(part), pa.array(chance), queries.column("home").combine_chunks()], schema=schema)
        p = pickle.loads(models.column("model")[0].as_py()).chances(_unit(_matrix(queries.column("vec"), dim)))
        row, child = np.repeat(np.arange(len(p)), p.shape[1]), np.tile(np.arange(p.shape[1]), len(p))
        taken = pa.array(row)
        home = queries.column("home").to_numpy(zero_copy_only=False)[row] & (child == p.argmax(1)[row])
        return pa.table([queries.column(c).combine_chunks().take(taken) for c in ("id", "vec")] + [pa.array(part[row] + child), pa.array(chance[row] * p.ravel()), pa.array(home)], schema=schema)

    return run


def _likeliest(visits: DataFrame, sizes: DataFrame, k: int, probes: int, mass: float) -> DataFrame:
    """Of each query its home and the most probable parts that are not empty, until they hold enough."""
    best = Window.partitionBy("id", "vec").orderBy(F.desc("home"), F.desc("chance"), "part")
    before = best.rowsBetween(Window.unboundedPreceding, -1)
    each = visits.join(sizes.select("part", "ids"), "part").withColumns({"held": F.coalesce(F.sum("chance").over(before), F.lit(0.0)), "met": F.coalesce(F.sum("ids").over(before), F.lit(0)), "nth": F.row_number().over(best)})
    total = F.sum("chance").over(Window.partitionBy("id", "vec"))
    return each.withColumn("total", total).where((F.col("held") < F.lit(mass) * F.col("total")) | (F.col("met") <= k) | (F.col("nth") <= probes)).select("id", "vec", "part", "chance", "home")


def _scaled(x: np.ndarray) -> np.ndarray:
    """x times a power of two, so that no square over- or underflows; products round as before."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1])


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of b with the vector a, every sum from the first component to the last."""
    last = lambda x: np.cumsum(x, axis=-1)[..., -1]
    a, b = _scaled(a), _scaled(b)
    return last(b * a) / (np.sqrt(last(a * a)) * np.sqrt(last(b * b)))


def _best(dim: int, k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return schema.empty_table()
        ids, x = rows.column("id").to_numpy(), _matrix(rows.column("vec"), dim)
        q_ids, q = queries.column("id").to_numpy(), _matrix(queries.column("vec"), dim)
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        heads = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))  # a repeated id is one candidate
        near = _unit(q) @ _unit(x).T
        out = []
        for i in range(len(q)):
            s = near[i].copy()
            s[ids == q_ids[i]] = -np.inf
            best = np.maximum.reduceat(s, heads)
            edge = np.partition(best, len(best) - k)[len(best) - k] if len(best) > k else -np.inf
            chosen = np.flatnonzero((s >= edge - 1e-9) & np.isfinite(s))  # rounding of the fast product is far less
            if len(chosen):
                exact = cosine(q[i], x[chosen])
                order = np.lexsort((ids[chosen], -exact))
                order = order[np.sort(np.unique(ids[chosen][order], return_index=True)[1])][:k]
                out.append((np.full(len(order), q_ids[i]), ids[chosen][order], exact[order]))
        if not out:
            return schema.empty_table()
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], schema=schema)

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, probes: int = 8, mass: float = 0.995, sample_rows: int = SAMPLE_ROWS, rows_per_part: int = ROWS_PER_PART, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows found for each query row."""
    spark = vectors.sparkSession
    raw = vectors.select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("is_query"), F.col(vec_col).cast("array<double>").alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    raw = raw.where(F.col("id").isNotNull() & F.col("vec").isNotNull()).where(fine)
    packed = raw.mapInArrow(_packed, "id long, is_query boolean, vec binary").groupBy("id", "vec").agg(F.max("is_query").alias("is_query"))
    packed = cut(packed.select("id", "is_query", "vec"), "vectors")
    shape = "query_id long, rank int, vec_id long, score double"
    lengths = packed.groupBy(F.octet_length("vec").alias("b")).count().orderBy(F.desc("count"), "b").limit(1).first()
    if lengths is None:
        return spark.createDataFrame([], shape)
    dim = lengths["b"] // 8
    placed = packed.where(F.octet_length("vec") == lengths["b"]).withColumn("part", F.lit(1).cast("long"))
    visits = placed.where("is_query").select("id", "vec").dropDuplicates().withColumns({"part": F.lit(1).cast("long"), "chance": F.lit(1.0), "home": F.lit(True)})
    own = lambda n: F.pmod(F.xxhash64("id", "vec"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    blocks_of = lambda size, block: F.greatest(F.ceil(size / block), F.lit(1)).cast("int")
    depth = 0
    while True:
        sizes = cut(placed.groupBy("part").agg(F.count("*").alias("size"), F.count_distinct("id").alias("ids")), "sizes")
        if depth:  # a part that its own model hardly split holds equal vectors: it is searched in blocks
            above = parents.select((F.col("part") * CHILDREN).alias("first"), F.col("size").alias("above"))
            large = sizes.withColumn("first", F.col("part") - F.pmod("part", F.lit(CHILDREN))).join(above, "first").where((F.col("size") > 2 * rows_per_part) & (F.col("size") < 0.9 * F.col("above")))
        else:
            large = sizes
        if depth == DEPTH or large.isEmpty():
            break
        parents = sizes
        # a bounded sample of every large part, by hash
        hashed = placed.join(large.select("part", "size"), "part").withColumn("h", F.xxhash64("vec", "id"))
        chance = F.shiftrightunsigned("h", 11).cast("double") * F.lit(2.0**-53)
        sampled = hashed.where(chance * F.col("size") <= 1.1 * sample_rows + 64).select("part", "size", "h", "vec")
        models = cut(sampled.groupBy("part").applyInArrow(_fitted(dim, sample_rows, rows_per_part), "part long, model binary"), "models")
        blocks = sizes.select("part", blocks_of(F.col("size"), ROUTE_BLOCK).alias("n"))
        salted = models.join(blocks, "part").select("part", "model", every(F.col("n")).alias("b"))
        rows = placed.join(blocks, "part").withColumn("b", own(F.col("n"))).drop("n")
        moved = cut(rows.groupBy("part", "b").cogroup(salted.groupBy("part", "b")).applyInArrow(_sent(dim), "id long, is_query boolean, vec binary, part long"), "placed")
        asked = cut(visits.groupBy("part").agg(blocks_of(F.count("*"), QUERY_BLOCK).alias("n")), "asked")
        salted = models.join(asked, "part").select("part", "model", every(F.col("n")).alias("b"))
        queries = visits.join(asked, "part").withColumn("b", own(F.col("n"))).drop("n")
        spread = queries.groupBy("part", "b").cogroup(salted.groupBy("part", "b")).applyInArrow(_asked(dim), "id long, vec binary, part long, chance double, home boolean")
        placed = moved
        filled = placed.groupBy("part").agg(F.count_distinct("id").alias("ids"))
        visits = cut(_likeliest(spread, filled, k, probes, mass), "visits")
        depth += 1
    asked = visits.groupBy("part").agg(blocks_of(F.count("*"), QUERY_BLOCK).alias("asked_n"))
    grid = cut(asked.join(sizes.select("part", blocks_of(F.col("size"), CAND_BLOCK).alias("rows_n")), "part"), "grid")
    left = placed.join(grid, "part").select("id", "vec", "part", own(F.col("rows_n")).alias("a"), every(F.col("asked_n")).alias("b"))
    right = visits.join(grid, "part").select("id", "vec", "part", every(F.col("rows_n")).alias("a"), own(F.col("asked_n")).alias("b"))
    found = left.groupBy("part", "a", "b").cogroup(right.groupBy("part", "a", "b")).applyInArrow(_best(dim, k), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL),
n AS (SELECT vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda a, b: a + b)) AS l FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]), lambda a, b: a + b) / (q.l * c.l) AS score
      FROM n q JOIN n c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 AND q.l > 0 AND c.l > 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s) WHERE rank <= 5
"""
