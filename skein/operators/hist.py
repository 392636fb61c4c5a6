"""Counting into bins, dense results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.errors import ArgumentInvalid


def _dense(spark, n: int, counts: DataFrame, key: str, value: str, zero) -> DataFrame:
    return spark.range(n).select(F.col("id").alias(key)).join(counts, key, "left").select(key, F.coalesce(value, F.lit(zero)).alias(value))


def bincount(df: DataFrame, value: str, weight: str | None = None, minlength: int = 0, name: str = "count") -> DataFrame:
    """bin, count for every bin up to the greatest value; negative values raise."""
    checked = F.when(F.col(value) < 0, F.raise_error(F.lit("ArgumentInvalid: bincount takes no negative values")).cast("long")).otherwise(F.col(value).cast("long"))
    counts = df.select(checked.alias("bin"), (F.col(weight).cast("double") if weight else F.lit(1)).alias("w")).where("bin is not null")
    counts = counts.groupBy("bin").agg((F.sum("w") if weight else F.count("*")).alias(name))
    top = counts.agg(F.max("bin")).first()[0]
    n = max(minlength, 0 if top is None else top + 1)
    return _dense(df.sparkSession, n, counts, "bin", name, 0.0 if weight else 0)


def histogram(df: DataFrame, value: str, bins: int = 10, range: tuple[float, float] | None = None, density: bool = False, weight: str | None = None) -> DataFrame:  # noqa: A002
    """bin, low, high and count of equal bins; the last one holds its upper edge; nan is left out."""
    x = F.col(value).cast("double")
    fine = df.where(F.col(value).isNotNull() & ~F.isnan(x))
    low, high = range or fine.agg(F.min(x), F.max(x)).first()
    if low is None or not low < high:
        raise ArgumentInvalid("histogram needs low < high", f"the range is {low} to {high}", "pass range=")
    width = (high - low) / bins
    place = F.least(F.floor((x - F.lit(float(low))) / F.lit(width)), F.lit(bins - 1)).cast("long")
    inside = fine.where((x >= low) & (x <= high)).select(place.alias("bin"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    dense = _dense(df.sparkSession, bins, inside.groupBy("bin").agg(F.sum("w").alias("count")), "bin", "count", 0.0)
    if density:
        whole = inside.agg(F.sum("w")).first()[0] or float("nan")
        dense = dense.withColumn("count", F.col("count") / F.lit(whole * width))
    edge = lambda k: F.lit(float(low)) + k * F.lit(width)
    return dense.select("bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), "count")


def grid_pool(df: DataFrame, point: str | Column, group: Sequence[str], grid_size: tuple[int, int, int], origin=(0.0, 0.0, 0.0), voxel_size: float = 1.0) -> DataFrame:
    """group, cell, count: points of three coordinates counted into voxels, dense for each group."""
    p = F.col(point) if isinstance(point, str) else point
    nx, ny, nz = grid_size
    at = [F.floor((p[i].cast("double") - F.lit(float(origin[i]))) / F.lit(float(voxel_size))).cast("long") for i in (0, 1, 2)]
    inside = (at[0] >= 0) & (at[0] < nx) & (at[1] >= 0) & (at[1] < ny) & (at[2] >= 0) & (at[2] < nz)
    cells = df.select(*group, F.when(inside, at[0] + nx * (at[1] + ny * at[2])).alias("cell"))
    # all cells of all groups as rows of one aggregate: no join
    zero = cells.select(*group).distinct().select(*group, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nx * ny * nz - 1).cast("long"))).alias("cell"), F.lit(0.0).alias("n"))
    seen = cells.where("cell is not null").groupBy(*group, "cell").agg(F.count("*").cast("double").alias("n"))
    return zero.unionByName(seen).groupBy(*group, "cell").agg(F.sum("n").alias("count"))
