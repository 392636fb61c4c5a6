"""Tensors as rows of indices and a value: contractions are joins and sums.

A tensor is a DataFrame with one long column for each index and a double column ``v``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from skein.errors import ArgumentInvalid


def tensor(df: DataFrame, indices: Sequence[str | Column], value: str | Column) -> DataFrame:
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(*[as_column(c).cast("long").alias(f"i{k}") for k, c in enumerate(indices)], as_column(value).cast("double").alias("v"))


def _parse(subscripts: str, axes: Sequence[int]) -> tuple[list[str], str]:
    """Letters of each operand and of the output; an ellipsis stands for the axes that letters leave over, from the last."""
    left, arrow, out = subscripts.replace(" ", "").partition("->")
    terms = left.split(",")
    if len(terms) != len(axes):
        raise ArgumentInvalid("einsum operands", f"{len(terms)} terms for {len(axes)} operands")
    free = [c for c in "ZYXWVUTSRQPONMLKJIHGFEDCBA" if c not in subscripts]
    over = [n - len(t.replace("...", "")) for t, n in zip(terms, axes)]
    most = max((k for k, t in zip(over, terms) if "..." in t), default=0)
    terms = [t.replace("...", "".join(reversed(free[:k]))) if k >= 0 else t for t, k in zip(terms, over)]
    if bad := [t for t, n in zip(terms, axes) if len(t) != n or not t.isalpha() and t]:
        raise ArgumentInvalid("einsum subscripts", f"{bad[0]!r} doesn't fit its operand")
    spread = "".join(reversed(free[:most]))
    if not arrow:
        letters = "".join(terms)
        out = spread + "".join(sorted(c for c in set(letters) if letters.count(c) == 1 and c not in spread))
    out = out.replace("...", spread)
    if not set(out) <= set("".join(terms)) or len(set(out)) < len(out):
        raise ArgumentInvalid("einsum subscripts", f"{out!r} doesn't follow from {left!r}")
    return terms, out


def einsum(subscripts: str, *operands: DataFrame) -> DataFrame:
    """Columns i0, i1, ... of the output indices and v.

    Repeated letters of a term are a filter, letters that two terms share a join, and letters that the
    output lacks are summed, as early as no later term needs them. An outer product has no key
    to join on; its smaller side is expected to be small and is Catalyst's to broadcast.
    """
    terms, out = _parse(subscripts, [len(df.columns) - 1 for df in operands])

    def named(term: str, df: DataFrame) -> DataFrame:
        first: dict[str, Column] = {}
        for k, c in enumerate(term):
            if c in first:
                df = df.where(first[c] == F.col(f"i{k}"))
            else:
                first[c] = F.col(f"i{k}")
        return df.select(*[col.alias(f"_{c}") for c, col in first.items()], "v")

    def summed(df: DataFrame, needed: set[str]) -> DataFrame:
        keep = [c for c in df.columns if c != "v" and c[1:] in needed]
        return df if len(keep) == len(df.columns) - 1 else df.groupBy(*keep).agg(F.sum("v").alias("v"))

    found = None
    for k, (term, df) in enumerate(zip(terms, operands)):
        later = set("".join(terms[k + 1 :])) | set(out)
        mine = summed(named(term, df), later | set("".join(terms[:k])))
        if found is None:
            found = mine
        else:
            shared = [c for c in found.columns if c != "v" and c in mine.columns]
            right = mine.withColumnRenamed("v", "_w")
            both = found.join(right, shared) if shared else found.crossJoin(right)
            found = both.withColumn("v", F.col("v") * F.col("_w")).drop("_w")
        found = summed(found, later)
    if not out:
        return found.agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("v"))
    return found.groupBy(*[f"_{c}" for c in out]).agg(F.sum("v").alias("v")).select(*[F.col(f"_{c}").alias(f"i{k}") for k, c in enumerate(out)], "v")


def tensordot(a: DataFrame, b: DataFrame, axes: int = 2) -> DataFrame:
    """Sum over the last axes of a and the first of b."""
    na, nb = len(a.columns) - 1, len(b.columns) - 1
    if not 0 <= axes <= min(na, nb):
        raise ArgumentInvalid("tensordot axes", f"{axes} of {na} and {nb}")
    letters = "abcdefghijklmnopqrstuvwxyz"
    left = letters[:na]
    right = left[na - axes :] + letters[na : na + nb - axes]
    return einsum(f"{left},{right}->{left[: na - axes]}{right[axes:]}", a, b)


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    return einsum("ij,jk->ik", a, b)


def dot(a: DataFrame, b: DataFrame) -> DataFrame:
    return einsum("i,i->", a, b)


def outer(a: DataFrame, b: DataFrame) -> DataFrame:
    return einsum("i,j->ij", a, b)


def trace(a: DataFrame) -> DataFrame:
    return einsum("ii->", a)


def norm(a: DataFrame) -> DataFrame:
    return a.agg(F.sqrt(F.coalesce(F.sum(F.col("v") * F.col("v")), F.lit(0.0))).alias("v"))


@pandas_udf(T.DoubleType())
def det(rows: pd.Series) -> pd.Series:
    """Determinant of a matrix that one row holds; singular: 0."""
    return rows.map(lambda m: float(np.linalg.det(np.stack(m).astype(float))) if m is not None else None)


@pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def inv(rows: pd.Series) -> pd.Series:
    """Inverse of a matrix that one row holds; a singular one raises."""
    return rows.map(lambda m: np.linalg.inv(np.stack(m).astype(float)).tolist() if m is not None else None)
