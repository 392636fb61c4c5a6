"""NumPy and tensor libraries; the latter only if they are installed."""

from __future__ import annotations

import importlib

import numpy as np
from pyspark.sql import functions as F

from skein.errors import ArgumentInvalid, ShapeMismatch
from skein.functions import nested as N
from skein.plans.array import RaggedArray
from skein.types import as_dtype


def from_numpy(obj, dtype=None) -> RaggedArray:
    if not isinstance(obj, np.ndarray) or obj.ndim == 0:
        raise ArgumentInvalid("from_numpy takes an array of one axis at least", type(obj).__name__)
    if not obj.flags.c_contiguous:
        raise ArgumentInvalid("from_numpy takes C-contiguous arrays", fix="np.ascontiguousarray")
    return RaggedArray.of(obj.tolist(), dtype or as_dtype(str(obj.dtype)))


def _tensor(obj, dtype) -> RaggedArray:
    for step in ("detach", "cpu"):
        obj = getattr(obj, step)() if hasattr(obj, step) else obj
    if not hasattr(obj, "numpy"):
        raise ArgumentInvalid("not a tensor", type(obj).__name__)
    return from_numpy(np.ascontiguousarray(obj.numpy()), dtype)


def from_torch(obj, dtype=None) -> RaggedArray:
    return _tensor(obj, dtype)


def from_tensorflow(obj, dtype=None) -> RaggedArray:
    return _tensor(obj, dtype)


def is_rectangular(a: RaggedArray) -> bool:
    """Whether every axis has one length and no leaf is null; one aggregate."""
    if a.union:
        return False
    sizes = []
    for k in range(1, a.depth + 1):
        each = F.flatten(F.array(a.col)) if k == 1 else a.col
        x = F.array(F.size(a.col)) if k == 1 else N.flatten_levels(_sizes(each, k), k - 2)
        sizes += [F.min(F.array_min(x)).alias(f"a{k}"), F.max(F.array_max(x)).alias(f"b{k}")]
    leaves = N.flatten_levels(a.col, a.depth - 1) if a.depth else F.array(a.col)
    found = a.frame.agg(*sizes, F.max(F.exists(leaves, lambda x: x.isNull())).alias("nulls")).first()
    return not found["nulls"] and all(found[f"a{k}"] == found[f"b{k}"] for k in range(1, a.depth + 1))


def _sizes(x, k: int):
    return F.transform(x, F.size) if k == 2 else F.transform(x, lambda y: _sizes(y, k - 1))


def to_numpy(a: RaggedArray) -> np.ndarray:
    if not is_rectangular(a):
        raise ShapeMismatch("to_numpy takes rectangular arrays without nulls")
    return np.array(a.to_list(), dtype=a.dtype.name if a.dtype.kind in "biuf" else object)


def to_torch(a: RaggedArray):
    return importlib.import_module("torch").from_numpy(to_numpy(a))


def to_tensorflow(a: RaggedArray):
    return importlib.import_module("tensorflow").convert_to_tensor(to_numpy(a))
