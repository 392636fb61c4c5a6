"""Set operations on leaf values: distinct, nulls dropped, -0.0 is 0.0.

nan is one value in unique and setunion and equals nothing elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _clean(df: DataFrame, value: str) -> DataFrame:
    kind = dict(df.dtypes)[value]
    column = F.col(value) + F.lit(0).cast(kind) if kind in ("double", "float") else F.col(value)
    return df.select(column.alias(value)).where(F.col(value).isNotNull())


def _is_nan(df: DataFrame, value: str):
    return F.isnan(value) if dict(df.dtypes)[value] in ("double", "float") else F.lit(False)


def unique(df: DataFrame, value: str = "value") -> DataFrame:
    return _clean(df, value).distinct()


def setunion(a: DataFrame, b: DataFrame, value: str = "value") -> DataFrame:
    return _clean(a, value).union(_clean(b, value)).distinct()


def setdiff(a: DataFrame, b: DataFrame, value: str = "value") -> DataFrame:
    """Values of a that b hasn't; a nan of a always stays."""
    right = _clean(b, value)
    return unique(a, value).join(right.where(~_is_nan(right, value)).distinct(), value, "left_anti")


def setxor(a: DataFrame, b: DataFrame, value: str = "value") -> DataFrame:
    """Values that one side has; both nans stay."""
    left, right = unique(a, value).withColumn("_s", F.lit(1)), unique(b, value).withColumn("_s", F.lit(2))
    both = left.unionByName(right)
    nan = _is_nan(both, value)
    once = both.where(~nan).groupBy(value).agg(F.count("*").alias("_n")).where("_n = 1").select(value)
    return once.unionByName(both.where(nan).select(value))


def isin(df: DataFrame, test: DataFrame, value: str = "value", name: str = "found") -> DataFrame:
    """df with a column that tells whether test has the value; null for null, false for nan.

    A left join on the distinct test values: Catalyst broadcasts them if they are few.
    """
    known = _clean(test, value)
    known = known.where(~_is_nan(known, value)).distinct().select(F.col(value).alias("_v"), F.lit(True).alias("_hit"))
    kind = dict(df.dtypes)[value]
    key = df[value] + F.lit(0).cast(kind) if kind in ("double", "float") else df[value]
    joined = df.join(known, key == F.col("_v"), "left")
    return joined.select(*[df[c] for c in df.columns], F.when(df[value].isNotNull(), F.coalesce("_hit", F.lit(False))).alias(name))
