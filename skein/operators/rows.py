"""Axis-0 plans: rows with an explicit position column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.errors import IndexInvalid
from skein.shared import cut


#: Positions of one bucket, and buckets at most: what is collected of them is bounded.
WIDTH, MOST_BUCKETS = 1 << 16, 1 << 16


def _before(df: DataFrame, bucket: Column, size: Column, order: Sequence[Column], name: str) -> DataFrame:
    """The sum of size over all rows before, by bucket and then in order within it.

    bucket is a function of the row alone, so the two evaluations of df agree; at most MOST_BUCKETS sums are
    collected and sent back.
    """
    df = df.withColumn("_b", bucket).withColumn("_n", size.cast("long"))
    starts, at = [], 0
    for b, n in df.groupBy("_b").agg(F.sum("_n")).orderBy("_b").collect():
        starts.append((b, at))
        at += n
    if not starts:
        return df.withColumn(name, F.lit(0).cast("long")).drop("_b", "_n")
    offsets = df.sparkSession.createDataFrame(starts, "_b long, _at long")
    upto = F.sum("_n").over(Window.partitionBy("_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("_upto", upto).join(F.broadcast(offsets), "_b").withColumn(name, F.col("_upto") - F.col("_n") + F.col("_at")).drop("_b", "_n", "_at", "_upto")


def running(df: DataFrame, size: Column | int, name: str, pos: str = "_pos") -> DataFrame:
    """The sum of size over the rows of smaller position; positions are distinct and not negative."""
    top = df.agg(F.max(pos)).first()[0]
    width = max(WIDTH, -(-(top or 0) // (MOST_BUCKETS - 1)))
    return _before(df, F.expr(f"`{pos}` div {width}L"), F.lit(size) if isinstance(size, int) else size, [F.col(pos)], name)


def scattered(df: DataFrame, key: Column, ties: Sequence[Column], name: str = "_pos") -> DataFrame:
    """Positions from 0 in the order of a 64-bit hash: its leading bits are the buckets."""
    bits = min(16, (df.count() // WIDTH).bit_length())
    bucket = F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")
    return _before(df, bucket, F.lit(1), [key, *ties], name)


def ranked(df: DataFrame, order: Sequence[Column], name: str = "_pos") -> DataFrame:
    """Positions from 0 in any total order, without a single-task window.

    Rows are dealt by range and written, as the bounds of the ranges are sampled anew whenever a plan runs; then they are
    numbered within their range and moved up by the rows of the ranges before.
    """
    dealt = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id().cast("long")), "ranked")
    return _before(dealt, F.col("_part"), F.lit(1), order, name).drop("_part")


def rerank(df: DataFrame, pos: str = "_pos") -> DataFrame:
    """Close the gaps that a selection left in the positions."""
    return running(df.withColumnRenamed(pos, "_old"), 1, pos, "_old").drop("_old")


def unstacked(df: DataFrame, value: str, pos: str = "_pos") -> DataFrame:
    """pos and value of the elements of a list column, one row after the other; a long list is dealt with its row."""
    size = F.when(F.col(value).isNull(), 0).otherwise(F.size(value))
    placed = running(df.select(pos, value), size, "_first", pos)
    return placed.select("_first", F.posexplode(value).alias("_i", value)).select((F.col("_first") + F.col("_i")).alias(pos), value)


def slice_rows(df: DataFrame, start: int, stop: int, step: int = 1, pos: str = "_pos") -> DataFrame:
    """Rows start, start+step, ... below stop (backwards: above), positions from 0: a filter that reaches the scan."""
    if step == 0:
        raise IndexInvalid("a slice needs a step", "step is 0")
    if step < 0:
        kept = df.where((F.col(pos) <= start) & (F.col(pos) > stop) & ((F.lit(start) - F.col(pos)) % -step == 0))
        return kept.withColumn(pos, ((F.lit(start) - F.col(pos)) / -step).cast("long"))
    kept = df.where((F.col(pos) >= start) & (F.col(pos) < stop))
    if step > 1:
        kept = kept.where((F.col(pos) - start) % step == 0)
    return kept.withColumn(pos, F.floor((F.col(pos) - start) / step).cast("long"))


def mask_rows(df: DataFrame, mask: DataFrame, keep: str = "keep", pos: str = "_pos") -> DataFrame:
    """Rows whose mask (pos, keep) is true."""
    return rerank(df.join(mask.where(F.col(keep)).select(pos), pos, "left_semi"), pos)


def fancy_rows(df: DataFrame, index: Sequence[int], pos: str = "_pos") -> DataFrame:
    """Rows at the given positions, in that order, repeats kept; the index is a Python list."""
    if not len(index):
        return df.limit(0)
    wanted = df.sparkSession.createDataFrame([(k, int(i)) for k, i in enumerate(index)], f"_k long, {pos} long")
    return df.join(wanted, pos).drop(pos).withColumnRenamed("_k", pos)


def concat_rows(frames: Sequence[DataFrame], pos: str = "_pos") -> DataFrame:
    """One frame after the other."""
    out, at = None, 0
    for i, df in enumerate(frames):
        moved = df.withColumn(pos, F.col(pos) + F.lit(at))
        out = moved if out is None else out.unionByName(moved)
        if i + 1 < len(frames):
            at += df.count()
    return out


def align(*frames: DataFrame, pos: str = "_pos") -> DataFrame:
    """Join frames row by row."""
    out = frames[0]
    for other in frames[1:]:
        out = out.join(other, pos)
    return out


def strict_axis0(flat: DataFrame, aggregates: dict[str, Column], at: str, value: str, n_rows: int | Column, by: Sequence[str] = ()) -> DataFrame:
    """Reduce across rows by position: null unless every row has a value there.

    flat holds a row for each (outer row, position); empty positions have none.
    """
    grouped = flat.groupBy(*by, at).agg(F.count(value).alias("_n"), *[c.alias(k) for k, c in aggregates.items()])
    return grouped.select(*by, at, *[F.when(F.col("_n") == n_rows, F.col(k)).alias(k) for k in aggregates])


def level_axis0(flat: DataFrame, aggregates: dict[str, Column], outer_at: str, at: str, value: str, row: str = "_pos") -> DataFrame:
    """Axis 0 of three levels: children that exist at outer_at are stacked, then reduced strictly.

    flat needs a row, with a null position and value, for each empty list.
    """
    stacked = flat.groupBy(outer_at).agg(F.count_distinct(row).alias("_rows"))
    grouped = flat.where(F.col(at).isNotNull()).groupBy(outer_at, at).agg(F.count(value).alias("_n"), *[c.alias(k) for k, c in aggregates.items()])
    return grouped.join(stacked, outer_at).select(outer_at, at, *[F.when(F.col("_n") == F.col("_rows"), F.col(k)).alias(k) for k in aggregates])


def flatten(df: DataFrame, value: str, *keep: str, at: str = "at") -> DataFrame:
    """A row for each element of a list column; empty lists give none."""
    return df.select(*keep, F.posexplode(value).alias(at, value))


def nest(flat: DataFrame, value: str, at: str, *by: str) -> DataFrame:
    """The lists again, elements in order of their position."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(value).alias("v"))))
    return flat.groupBy(*by).agg(pairs.getField("v").alias(value))
