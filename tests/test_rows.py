"""Positions at a size where ranges, buckets and adaptive plans come into play."""

import pytest
from pyspark.sql import functions as F

from skein import api as sk
from skein.operators import random, rows
from skein.plans.array import RaggedArray
from skein.types import int64

N = 1_200_000


@pytest.fixture(scope="module")
def many(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    return spark.range(N).select(F.col("id").alias("_pos"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("v"))


def dense(df, n, column="_pos"):
    """Whether positions are 0 to n - 1, each once."""
    found = df.agg(F.count("*"), F.count_distinct(column), F.min(column), F.max(column)).first()
    return tuple(found) == (n, n, 0, n - 1)


def test_values_are_ranked(many):
    placed = rows.ranked(many.withColumnRenamed("_pos", "old"), [F.col("v"), F.col("old")])
    assert dense(placed, N)
    moved = placed.select(F.col("_pos") + 1, F.col("v").alias("w")).toDF("_pos", "w")
    assert placed.join(moved, "_pos").where("v < w").isEmpty()


def test_masks_close_gaps(many):
    kept = rows.mask_rows(many, many.select("_pos", (F.col("v") < 300).alias("keep")))
    n = many.where("v < 300").count()
    assert dense(kept, n)
    assert RaggedArray(kept, "v", int64, 0)[n - 1] is not None


def test_permutations_are_whole(many):
    shuffled = random.permutation(many, 5)
    assert dense(shuffled, N) and shuffled.agg(F.sum("v")).first() == many.agg(F.sum("v")).first()


def test_lists_are_unstacked(many):
    lists = many.where("_pos < 200000").select("_pos", F.sequence(F.col("_pos"), F.col("_pos") + F.col("v") % 5).alias("v"))
    flat = rows.unstacked(lists, "v")
    assert dense(flat, lists.agg(F.sum(F.size("v"))).first()[0])
    back = flat.join(flat.select((F.col("_pos") + 1).alias("_pos"), F.col("v").alias("w")), "_pos")
    assert back.where("v <= w and v <> w - 4 and v <> w - 3 and v <> w - 2 and v <> w - 1 and v <> w").isEmpty()


def test_one_long_row(spark):
    """A row with nearly all elements."""
    df = spark.createDataFrame([(0, 1), (1, 50_000), (2, 0), (3, 2)], "_pos long, n int").select("_pos", F.array_repeat("n", F.col("n")).alias("v"))
    assert dense(rows.unstacked(df, "v"), 50_003)


def test_sort_and_unique(many):
    a = RaggedArray(many, "v", int64, 0)
    assert sk.unique(a).to_list() == list(range(1000))
    assert dense(a.sort().frame, N)


def test_batches_of_one_row(spark, tmp_path):
    from skein.streaming.append import append_stream

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(3):
        spark.createDataFrame([(i,)], "k long").write.mode("append").parquet(source)
    append_stream(spark.readStream.schema("k long").option("maxFilesPerTrigger", 1).parquet(source), out, ["k"], str(tmp_path / "check")).awaitTermination(120)
    assert sorted(r["_pos"] for r in spark.read.parquet(out).collect()) == [0, 1, 2]


def test_intermediate_tables_can_be_cleared(spark, many):
    from skein import shared

    rows.ranked(many.limit(10), [F.col("v")]).count()
    made = [p for p in shared._made if "ranked" in p]
    shared.clear(spark)
    assert made and not shared._made
