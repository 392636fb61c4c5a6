"""Nearest neighbours and radius search over point clouds.

Points are rows of (pos, point array<double>). k nearest: both clouds are dealt into blocks, each pair of
blocks is one task that keeps k per query, and a last window merges; nothing grows with
queries times points but the arithmetic. Radius: cells of the radius' width make it an equi-join in
low dimensions.
"""

from __future__ import annotations

import functools
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.errors import ArgumentInvalid
from skein.functions.nested import squared_distance

#: Points that one task holds of each side.
BLOCK = 4096
#: Coordinates that make cells: of more, a cell has too many neighbours.
GRID_DIMENSIONS = 3


def _nearest_in_block(k: int):
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("d2", pa.float64())])

    def points(t: pa.Table) -> np.ndarray:
        column = t.column("point").combine_chunks()
        return column.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)

    def run(queries: pa.Table, data: pa.Table) -> pa.Table:
        if not queries.num_rows or not data.num_rows:
            return schema.empty_table()
        q, x = points(queries), points(data)
        src, dst = queries.column("pos").to_numpy(), data.column("pos").to_numpy()
        drop = queries.column("self").to_numpy(zero_copy_only=False)
        order = np.argsort(dst)
        x, dst = x[order], dst[order]
        out = []
        for i in range(len(q)):
            d2 = ((x - q[i]) ** 2).sum(1)
            if drop[i]:
                d2[dst == src[i]] = np.inf
            n = min(k, len(d2))
            edge = np.partition(d2, n - 1)[n - 1]
            near = np.flatnonzero(d2 <= edge)
            near = near[np.isfinite(d2[near])]
            near = near[np.argsort(d2[near], kind="stable")][:n]
            out.append((np.full(len(near), src[i]), dst[near], d2[near]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], schema=schema)

    return run


def knn(queries: DataFrame, data: DataFrame, k: int, loop: bool = True, group: str | None = None, pos: str = "pos", point: str = "point") -> DataFrame:
    """(group,) src, dst, distance and rank (from 0) of the k nearest, by distance, then position.

    With a group, positions are local to it and groups only meet themselves, large ones by blocks, too. loop=False leaves out the
    point of the same position. A cloud of fewer than k points raises.
    """
    if k < 0:
        raise ArgumentInvalid("k must not be negative", f"k is {k}")
    keys = [group] if group else []
    select = lambda df: df.select(*keys, F.col(pos).cast("long").alias("pos"), F.col(point).cast("array<double>").alias("point"))
    sizes = select(data).groupBy(*keys).agg(F.count("*").alias("_n")) if keys else None
    q, x = select(queries).withColumn("self", F.lit(not loop)), select(data)
    if keys:
        large = _large_groups(q, group, "_n"), _large_groups(x, group, "_n")
        own = lambda df: df.withColumn(group, F.col(group).alias(group))  # noqa: E731  # the sides may be one frame
        left, right = own(_dealt(q, group, "pos", "a", "b", large)), own(_dealt(x, group, "pos", "b", "a", large[::-1]))
    else:
        n_q, n_x = max(1, -(-q.count() // BLOCK)), max(1, -(-(total := x.count()) // BLOCK))
        if k > total - (not loop):
            raise ArgumentInvalid("k is larger than the cloud", f"k={k} of {total} points")
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = q.withColumn("a", F.pmod(F.xxhash64("pos"), F.lit(n_q)).cast("int")).withColumn("b", spread(n_x))
        right = x.withColumn("a", spread(n_q)).withColumn("b", F.pmod(F.xxhash64("pos"), F.lit(n_x)).cast("int"))  # one type on both sides, or keys are hashed apart
    by = [*keys, "a", "b"]
    near = _nearest_in_block(max(k, 1))
    if keys:
        kind = dict(q.dtypes)[group]
        plain = near

        def near(key, queries, data):  # noqa: F811
            found = plain(queries, data)
            return found.add_column(0, group, pa.array([key[0].as_py()] * found.num_rows, key[0].type))

        shape = f"{group} {kind}, src long, dst long, d2 double"
    else:
        shape = "src long, dst long, d2 double"
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(near, shape)
    rank = F.row_number().over(Window.partitionBy(*keys, "src").orderBy("d2", "dst")) - 1
    found = found.withColumn("rank", rank).where(F.col("rank") < k)
    if keys:
        enough = F.when(F.col("_n") - int(not loop) < k, F.raise_error(F.lit(f"ArgumentInvalid: k={k} is larger than a group")).cast("int")).otherwise(F.col("rank"))
        found = found.join(sizes, group).withColumn("rank", enough)
    return found.select(*keys, "src", "dst", F.sqrt("d2").alias("distance"), "rank")


def _side(df: DataFrame, keys: list[str], pos: str, point: str, name: str, dimensions: int | None) -> DataFrame:
    """keys, the position as name and the point: of known dimensions a column each (null if it has others), so a pair's code is compiled."""
    p = F.col(point).cast("array<double>")
    if not dimensions:
        return df.select(*keys, F.col(pos).cast("long").alias(name), p.alias(f"{name}_point"))
    fits = lambda c: F.when(F.size(point) == dimensions, c)
    return df.select(*keys, F.col(pos).cast("long").alias(name), *[fits(F.get(p, F.lit(i))).alias(f"{name}_{i}") for i in range(dimensions)])


def _pair_d2(dimensions: int | None) -> Column:
    """The squared distance of a pair of sides, summed from the first coordinate on."""
    if not dimensions:
        return squared_distance(F.col("src_point"), F.col("dst_point"))
    apart = [F.col(f"src_{i}") - F.col(f"dst_{i}") for i in range(dimensions)]
    return functools.reduce(operator.add, [a * a for a in apart])


def radius(queries: DataFrame, data: DataFrame, r: float, loop: bool = True, group: str | None = None, pos: str = "pos", point: str = "point", dimensions: int | None = None) -> DataFrame:
    """(group,) src, dst and distance of all pairs within r, the bound included.

    Points meet only in the 3**d cells around the query's: of all coordinates up to three (pass the dimensions), of the
    first three in more, as points within r are so in each coordinate. Without dimensions groups meet on their key and
    single clouds in one range join.
    """
    if r < 0:
        raise ArgumentInvalid("radius must not be negative", f"r is {r}")
    keys = [group] if group else []
    q, x = (_side(df, keys, pos, point, p, dimensions) for df, p in ((queries, "src"), (data, "dst")))
    on = list(keys)
    if r == 0:
        for i in [f"_{i}" for i in range(dimensions)] if dimensions else ["_point"]:
            q, x = q.withColumn(f"_c{i}", F.col(f"src{i}")), x.withColumn(f"_c{i}", F.col(f"dst{i}"))
            on.append(f"_c{i}")
    if dimensions and r > 0:
        cell = lambda p, i: F.floor(F.col(f"{p}_{i}") / F.lit(float(r)))
        for i in range(min(dimensions, GRID_DIMENSIONS)):
            q = q.withColumn(f"_c{i}", cell("src", i))
            x = x.withColumn(f"_c{i}", F.explode(F.array(*[cell("dst", i) + s for s in (-1, 0, 1)])))
            on.append(f"_c{i}")
    pairs = q.join(x, on) if on else q.crossJoin(x)
    pairs = pairs.withColumn("_d2", _pair_d2(dimensions)).where(F.col("_d2") <= F.lit(float(r) * float(r)))
    if not loop:
        pairs = pairs.where("src <> dst")
    return pairs.select(*keys, "src", "dst", F.sqrt("_d2").alias("distance"))


def _large_groups(df: DataFrame, group: str, name: str) -> DataFrame:
    """Groups of more than BLOCK points, at most one in BLOCK points, and how many blocks they make."""
    return df.groupBy(F.col(group).alias("_g")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name)).where(F.col(name) > 1)


def _dealt(df: DataFrame, group: str, pos: str, mine: str, other: str, large: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Each row in its block of this side (mine), once for each block of the other side; large: blocks of this side's groups and the other's."""
    for n, groups in zip(("_mine", "_other"), large):
        groups = groups.select("_g", F.col(groups.columns[1]).alias(n))
        df = df.join(F.broadcast(groups), F.col(group) == F.col("_g"), "left").drop("_g").withColumn(n, F.coalesce(n, F.lit(1)))
    df = df.withColumn(mine, F.pmod(F.xxhash64(pos), F.col("_mine")).cast("int"))
    return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.col("_other") - 1))).drop("_mine", "_other")


def pairwise(data: DataFrame, group: str, pos: str = "pos", point: str = "point", dimensions: int | None = None) -> DataFrame:
    """group, src, dst, distance of all pairs within a group.

    The result is quadratic in a group's size. Groups of more than BLOCK points are dealt into blocks that meet pairwise, so
    a key holds at most about BLOCK points of a side, however large its group.
    """
    by, tasks = [group, "a", "b"], int(data.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    large = _large_groups(data, group, "_n")
    # a number of tasks that stays: few bytes make many pairs
    dealt = lambda p, mine, other: _dealt(_side(data, [group], pos, point, p, dimensions), group, p, mine, other, (large, large)).repartition(tasks, *by)
    pairs = dealt("src", "a", "b").hint("merge").join(dealt("dst", "b", "a"), by)
    return pairs.select(group, "src", "dst", F.sqrt(_pair_d2(dimensions)).alias("distance"))
