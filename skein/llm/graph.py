"""Connected components as DataFrame joins: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.store import cut


def _is_stars(e: DataFrame) -> bool:
    """Whether every node is either a root or has one edge, to a root."""
    ends = e.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(e.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up > 1 or up = 1 and root = 1").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, comp: the least node that it reaches, for every node with an edge to another.

    Each step keeps at most as many edges as the one before and is cut off in the shared
    folder; a star with any number of points is summed up before it is joined.
    """
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    e = cut(e, "edges")
    while not _is_stars(e):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        e = cut(small.select("x.a", "x.b").where("a <> b").distinct(), "edges")
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
