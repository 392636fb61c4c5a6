"""Mixing sources to target weights by pivotal dependent rounding.

A source's share of all words goes by weight, stops at ``most`` times its size, and the excess is
shared again by weight. Every document of a source then has the same expected number of copies:
a whole part and a fraction. Fractions are rounded by pivots: mass moves between two documents at
random, each keeping its expectation, until one is whole. Documents are paired from the largest to
the smallest, so both have about the same size, words hardly change, and the fraction left of a block
is a small document's. The blocks' rests meet in blocks of ``FAN``, and so on up a tree. The copies
of a source add up to their expectation within one, however many rows it has.
Blocks and their random numbers depend on ids, texts' sizes and sources alone: reruns agree.

Nulls: a null text has size 0, a null source is a source, last in order. Documents of
size 0 take nothing. Rows that are equal in id, source and text are rounded as one, whose copies are dealt to them as
evenly as can be. Empty tables give empty results.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.skew import join_counted
from skein.llm.store import cut, free_name

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK, FAN = 4096, 64


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their place from 0 in a total order; only a count per partition is collected."""
    parts = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranked")
    at, starts = 0, []
    for part, n in parts.groupBy("_part").count().orderBy("_part").collect():
        starts.append((part, at))
        at += n
    starts = rows.sparkSession.createDataFrame(starts, "_part int, _at long")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1 + F.col("_at")
    return parts.join(F.broadcast(starts), "_part").withColumn(name, place.cast("long")).drop("_part", "_at")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes (source, source_size, ...) with each source's target."""
    placed = ranked(sizes, [F.col("source").asc_nulls_last()], "_place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))
    rows = cut(placed.withColumn("weight", weight), "sources")
    size = F.col("source_size").cast("double")
    total = rows.agg(F.coalesce(F.sum(size), F.lit(0.0))).first()[0]
    level, full = 0.0, -1
    while True:
        above = F.col("weight") * level > most * size
        n, taken, left = rows.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, most * size)), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))).first()
        if n == full or not left:
            break
        full, level = n, (total - taken) / left
    return rows.withColumn("target", F.least(F.col("weight") * level, most * size)).drop("_place", "weight")


def pivot(p: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Round p in [0, 1] in one pass; its sum stays and at most one value is left between 0 and 1."""
    p = p.copy()
    coins = draw.random(len(p))
    i = -1
    for j in range(len(p)):
        if not 0 < p[j] < 1:
            continue
        if i < 0:
            i = j
            continue
        both = p[i] + p[j]
        if both <= 1:  # one of them gets all
            winner, loser = (i, j) if coins[j] * both < p[i] else (j, i)
            p[winner], p[loser] = both, 0.0
        else:  # one of them is full
            winner, loser = (i, j) if coins[j] * (2 - both) < 1 - p[j] else (j, i)
            p[winner], p[loser] = 1.0, both - 1
        for k in (i, j):
            p[k] = 0.0 if p[k] < 1e-12 else 1.0 if p[k] > 1 - 1e-12 else p[k]
        i = i if 0 < p[i] < 1 else j if 0 < p[j] < 1 else -1
    return p


def _round(seed: int, level: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "tie", "doc_id"], ascending=False, kind="stable").reset_index(drop=True)
        source = -1 if key[0] is None or key[0] != key[0] else zlib.crc32(str(key[0]).encode())
        draw = np.random.default_rng([seed, level, int(key[1]), source + 1])
        live = rows["size"].to_numpy() > 0
        p = np.where(live, rows["p"].to_numpy(), 0.0)
        p = pivot(p, draw)
        if bool(rows["last"].iloc[0]):  # the root: what is left becomes whole by its own chance
            p = np.where((0 < p) & (p < 1), draw.random(len(p)) < p, p).astype(float)
        return rows.assign(p=p)

    return run


KEY = ["tie", "tie2"]


def _units(docs: DataFrame, weights: tuple[int, ...], most: int, seed: int, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """The sized rows, and for each set of equal rows how many they are (m) and how many copies they take together."""
    key = [F.col(c) for c in (id_col, source_col, text_col)]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(*key).alias("tie"), F.xxhash64(F.lit(7), *key).alias("tie2"))
    rows = cut(rows, "sized")
    units = cut(rows.groupBy(*KEY).agg(F.first("doc_id").alias("doc_id"), F.first("source").alias("source"), F.first("size").alias("size"), F.count("*").alias("m")), "units")
    known = cut(targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count("*").alias("n")), weights, most), "targets")
    known = known.withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0) * F.col("m")
    whole = F.floor(share + 1e-9)
    joined = units.join(known, units["source"].eqNullSafe(known["source"])).select(
        "doc_id", units["source"], "size", "tie", "tie2", "m", "source_size", "target", whole.cast("long").alias("whole"), F.greatest(share - whole, F.lit(0.0)).alias("p"), "blocks", F.pmod("tie2", "blocks").alias("block")
    )
    live, done = joined.withColumn("last", F.col("blocks") == 1), []
    depth, widest = 0, known.agg(F.coalesce(F.max("blocks"), F.lit(1))).first()[0]
    while True:
        step = cut(live.groupBy("source", "block").applyInPandas(_round(seed, depth), live.schema), "rounded")
        if widest <= 1:
            done.append(step)
            break
        rest = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(step.where(~rest))
        depth, widest = depth + 1, -(-widest // FAN)
        up = step.where(rest).withColumns({"block": F.floor(F.col("block") / FAN), "blocks": F.ceil(F.col("blocks") / FAN)})
        live = up.withColumn("last", F.col("blocks") == 1).select(*live.columns)
    out = reduce(DataFrame.unionByName, done)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("p").cast("long")).otherwise(F.lit(0))
    return rows, cut(out.select(*KEY, "m", "source_size", "target", copies.cast("long").alias("together")), "copies")


def _dealt(rows: DataFrame, units: DataFrame) -> DataFrame:
    """rows, which have KEY, with their units' columns and the copies of each: equal rows differ by one at most."""
    n = units.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    several = units.where("m > 1")
    if several.isEmpty():
        return rows.join(units, KEY).withColumn("copies", F.col("together"))
    alone = rows.join(units.where("m = 1"), KEY).withColumn("copies", F.col("together"))
    # equal rows are numbered within their partitions, and moved up by the partitions before
    equal = cut(join_counted(rows, several, KEY, "m", n).withColumn("_u", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_u", 33)), "equal")
    at = [*KEY, "_part"]
    before = Window.partitionBy(*KEY).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = equal.groupBy(*at).agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    nth = F.row_number().over(Window.partitionBy(*at).orderBy("_u")) - 1 + F.col("_start")
    copies = F.floor(F.col("together") / F.col("m")) + F.when(nth < F.col("together") % F.col("m"), 1).otherwise(0)
    return alone.unionByName(equal.join(starts, at).withColumn("copies", copies.cast("long")).drop("_u", "_part", "_start"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken for each row."""
    rows, units = _units(docs, weights, most, seed, id_col, text_col, source_col)
    found = _dealt(rows, units)
    return found.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def take(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of docs, with all its columns, as often as it is taken, and a column
    copy from 0 (with underscores added if docs has one)."""
    _, units = _units(docs, weights, most, seed, id_col, text_col, source_col)
    key = [docs[c] for c in (id_col, source_col, text_col)]
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.xxhash64(*key).alias("tie"), F.xxhash64(F.lit(7), *key).alias("tie2"))
    found = _dealt(rows, units).where("copies > 0")
    return found.select(*[F.col("row")[c].alias(c) for c in docs.columns], F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))).alias(free_name("copy", docs.columns)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
