"""The user's functions, by name: ``from skein import api as sk``."""

from __future__ import annotations

import builtins

from pyspark.sql import functions as F

from skein.errors import ArgumentInvalid, LayoutUnsupported
from skein.functions import nested as N
from skein.operators import hist, linalg, random
from skein.operators import neighbors as _near
from skein.operators import rows as _rows
from skein.plans.array import POS, RaggedArray
from skein.plans.compiled import compile, compile_pipeline, compile_pipeline_info  # noqa: A004
from skein.plans.frame import RaggedFrame
from skein.sources.interop import from_numpy, from_tensorflow, from_torch, is_rectangular, to_numpy, to_tensorflow, to_torch
from skein.sources.store import append, clear_path_caches, io_bytes_read, io_cache_stats, load, load_slice, open, reset_io_bytes_read, save, stored_len  # noqa: A004
from skein.types import (
    bool_,
    can_cast,
    char,
    float16,
    float32,
    float64,
    int8,
    int16,
    int32,
    int64,
    promote_types,
    string,
    uint8,
    uint16,
    uint32,
    uint64,
)

__all__ = [
    "append", "bool_", "can_cast", "char", "clear_path_caches", "compile", "compile_pipeline", "compile_pipeline_info", "float16", "float32", "float64", "from_numpy", "from_tensorflow", "from_torch",
    "int8", "int16", "io_bytes_read", "io_cache_stats", "reset_io_bytes_read", "int32", "int64", "is_rectangular", "load", "load_slice", "open", "promote_types", "save", "stored_len", "string", "to_numpy", "to_tensorflow", "to_torch",
    "uint8", "uint16", "uint32", "uint64",
]

array = RaggedArray.of
dataframe = RaggedFrame.of
rng = random.rng


def _binary(name: str):
    def f(a: RaggedArray, b, out=None) -> RaggedArray:
        return a._arithmetic(b, name)

    return f


add, subtract, multiply, divide, mod = map(_binary, ("add", "subtract", "multiply", "divide", "mod"))
remainder = mod


def _unary(name: str):
    return lambda x: x.unary(name)


sin, cos, tan, exp, log, log10, log2, sqrt = map(_unary, ("sin", "cos", "tan", "exp", "log", "log10", "log2", "sqrt"))
abs, sign, floor, ceil, round, reciprocal, angle = map(_unary, ("abs", "sign", "floor", "ceil", "round", "reciprocal", "angle"))  # noqa: A001


def _compare(name: str):
    return lambda a, b: a.compare(b, name)


equal, not_equal, less, less_equal, greater, greater_equal = map(_compare, ("equal", "not_equal", "less", "less_equal", "greater", "greater_equal"))


def _test(name: str):
    return lambda x: x.test(name)


isnan, isinf, isfinite = map(_test, ("isnan", "isinf", "isfinite"))


def _logical(name: str):
    return lambda a, b: a.logical(b, name)


logical_and, logical_or, logical_xor = map(_logical, ("and", "or", "xor"))


def logical_not(a: RaggedArray) -> RaggedArray:
    return a.logical_not()


def _reduce(name: str):
    return lambda x, dim=None: x.reduce(name, dim)


sum, mean, min, max, ptp = map(_reduce, ("sum", "mean", "min", "max", "ptp"))  # noqa: A001


def _spread(name: str, skip_nan: bool):
    return lambda x, dim=0, ddof=0: x.reduce(name, dim, ddof=ddof, skip_nan=skip_nan)


var, std, nanvar, nanstd = _spread("var", False), _spread("std", False), _spread("var", True), _spread("std", True)


def quantile(x: RaggedArray, q: float, dim: int = 0, skip_nan: bool = False):
    if not 0 <= q <= 1:
        raise ArgumentInvalid("q must lie in [0, 1]", str(q))
    return x.reduce("quantile", dim, q=q, skip_nan=skip_nan)


def percentile(x: RaggedArray, q: float, dim: int = 0):
    return quantile(x, q / 100, dim)


def median(x: RaggedArray, dim: int = 0):
    return quantile(x, 0.5, dim)


def nanquantile(x: RaggedArray, q: float, dim: int = 0):
    return quantile(x, q, dim, True)


def nanpercentile(x: RaggedArray, q: float, dim: int = 0):
    return quantile(x, q / 100, dim, True)


def nanmedian(x: RaggedArray, dim: int = 0):
    return quantile(x, 0.5, dim, True)


def sort(x, dim=-1):
    return x.sort(dim)


def argsort(x, dim=-1):
    return x.argsort(dim)


def argmax(x, dim=None):
    return x.argextreme(True, dim)


def argmin(x, dim=None):
    return x.argextreme(False, dim)


def nanargmax(x, dim=None):
    return x.argextreme(True, dim, True)


def nanargmin(x, dim=None):
    return x.argextreme(False, dim, True)


def partition(x, kth, dim=-1):
    return x.partition(kth, dim)


def argpartition(x, kth, dim=-1):
    return x.argpartition(kth, dim)


def search_sorted(x: RaggedArray, v: RaggedArray, right: bool = False) -> RaggedArray:
    """Where v would go in the sorted x, whatever the sizes of both."""
    return v.search_sorted_in(x._leaves_frame(), right)


def nonzero(x: RaggedArray) -> RaggedArray:
    if x.depth or x.union:
        raise LayoutUnsupported("nonzero takes one axis")
    found = x._plain().where(F.col("v").cast("double") != 0).select(F.col(POS).alias("v"))
    return x._from(_rows.running(found, 1, POS, "v"), int64, 0)


def where(cond: RaggedArray, x: RaggedArray | None = None, y: RaggedArray | None = None) -> RaggedArray:
    if x is None:
        return nonzero(cond)
    pairs = x._plain().withColumnRenamed("v", "_x").join(y._plain().withColumnRenamed("v", "_y"), POS).join(cond._plain(), POS)
    return x._from(pairs.withColumn("v", N.where(F.col("v"), F.col("_x"), F.col("_y"))))


def argwhere(cond: RaggedArray) -> RaggedArray:
    return (found := nonzero(cond))._with(F.array(found.col), int64, 1)


def unique(x):
    return x.unique()


def isin(x, test_elements):
    return x.isin(test_elements)


def setunion(a, b):
    return a.setunion(b)


def setdiff(a, b):
    return a.setdiff(b)


def setxor(a, b):
    return a.setxor(b)


def bincount(x: RaggedArray, weights: RaggedArray | None = None, minlength: int = 0) -> RaggedArray:
    df = x._plain()
    if weights is not None:
        df = df.join(weights._plain().withColumnRenamed("v", "w"), POS)
    found = hist.bincount(df, "v", "w" if weights is not None else None, minlength)
    return x._from(found.select(F.col("bin").alias(POS), F.col("count").alias("v")), float64 if weights is not None else int64, 0)


def digitize(x: RaggedArray, bins: RaggedArray, right: bool = False, numpy_edges: bool = False) -> RaggedArray:
    edges = F.array(*[F.lit(float(e)) for e in bins.to_list()])
    return x._map(lambda v: N.digitize(v.cast("double"), edges, right, numpy_edges), int64)


def histogram(x: RaggedArray, bins: int = 10, range=None, density: bool = False, weights: RaggedArray | None = None):  # noqa: A002
    df = x._plain()
    if weights is not None:
        df = df.join(weights._plain().withColumnRenamed("v", "w"), POS)
    found = hist.histogram(df, "v", bins, range, density, "w" if weights is not None else None).cache()
    counts = x._from(found.select(F.col("bin").alias(POS), F.col("count").alias("v")), float64, 0)
    edges = found.select(F.col("bin").alias(POS), F.col("low").alias("v")).union(found.where(F.col("bin") == bins - 1).select(F.col("bin") + 1, "high"))
    return counts, x._from(edges, float64, 0)


def _tensor(x: RaggedArray):
    """A row for each leaf; axes below the first are lists of any depth."""
    if x.union:
        raise LayoutUnsupported("a union is no tensor")
    df, axes = x._plain(), [f"j{k}" for k in builtins.range(x.depth)]
    for k, name in enumerate(axes):
        df = df.select(POS, *axes[:k], F.posexplode("v").alias(name, "v"))
    return linalg.tensor(df, [POS, *axes], "v")


def _array(df, like: RaggedArray, integral: bool):
    axes = len(df.columns) - 1
    to = int64 if integral else float64
    if axes == 0:
        return df.select(F.col("v").cast(to.spark)).first()[0]
    df = df.withColumn("v", F.col("v").cast(to.spark))
    for k in builtins.range(axes - 1, 0, -1):
        df = _rows.nest(df, "v", f"i{k}", *[f"i{j}" for j in builtins.range(k)])
    return like._from(df.select(F.col("i0").alias(POS), "v"), to, axes - 1)


def einsum(subscripts: str, *operands: RaggedArray):
    return _array(linalg.einsum(subscripts, *map(_tensor, operands)), operands[0], all_integral(*operands))


def all_integral(*operands: RaggedArray) -> bool:
    return not [x for x in operands if x.dtype.kind not in "iu"]


def tensordot(a, b, axes: int = 2):
    return _array(linalg.tensordot(_tensor(a), _tensor(b), axes), a, all_integral(a, b))


def dot(a, b):
    return einsum("i,i->", a, b)


inner = dot


def outer(a, b):
    return einsum("i,j->ij", a, b)


def trace(a):
    return einsum("ii->", a)


def norm(a: RaggedArray) -> float:
    return linalg.norm(_tensor(a)).first()[0]


def cross(a: RaggedArray, b: RaggedArray) -> RaggedArray:
    """Rows of three, or two vectors of three."""
    if a.depth == 0:
        x, y = a.to_list(), b.to_list()
        return RaggedArray.of([x[1] * y[2] - x[2] * y[1], x[2] * y[0] - x[0] * y[2], x[0] * y[1] - x[1] * y[0]], a.dtype)
    both, x, y = a._aligned(b)
    return a._from(both.select(POS, N.cross(x, y).alias("v")))


def _one_row(a: RaggedArray):
    return a._plain().agg(F.array_sort(F.collect_list(F.struct(POS, "v"))).getField("v").alias("m"))


def det(a: RaggedArray) -> float:
    return _one_row(a).select(linalg.det("m")).first()[0]


def inv(a: RaggedArray) -> RaggedArray:
    return a._from(_one_row(a).select(F.posexplode(linalg.inv("m")).alias("_i", "v")).withColumn(POS, F.col("_i").cast("long")), float64, 1)


def _cloud(x: RaggedArray, dim: int):
    if dim == 0:
        return x._plain().select(F.col(POS).alias("pos"), F.col("v").alias("point"))
    return x._plain().select(F.col(POS).alias("grp"), F.posexplode("v").alias("pos", "point"))


def _dimensions(points) -> int | None:
    """The length of the points, if all have the same."""
    least, most = points.agg(F.min(F.size("point")), F.max(F.size("point"))).first()
    return most if least == most else None


def neighbors(query: RaggedArray, data: RaggedArray, k: int | None = None, radius: float | None = None, dim: int = 0, loop: bool = True, return_distances: bool = False, gpu: bool = False):
    """Edges [src, dst] by distance, then position; gpu is accepted and ignored."""
    if (k is None) == (radius is None):
        raise ArgumentInvalid("pass k or radius")
    same = query is data or query.token == data.token and query.column == data.column
    keep = loop or not same
    group = "grp" if dim == 1 else None
    q, x = _cloud(query, dim), _cloud(data, dim)
    found = _near.knn(q, x, k, keep, group) if k is not None else _near.radius(q, x, radius, keep, group, dimensions=_dimensions(x))
    keys = ["grp"] if group else []
    pairs = F.array_sort(F.collect_list(F.struct("distance", "dst")))
    each = found.groupBy(*keys, "src").agg(pairs.alias("x"))
    each = q.select(*keys, F.col("pos").cast("long").alias("src")).join(each, [*keys, "src"], "left")
    x = F.coalesce("x", F.array().cast("array<struct<distance:double,dst:bigint>>"))
    each = each.select(*keys, "src", F.transform(x, lambda e: F.array(F.col("src"), e["dst"])).alias("v"), x.getField("distance").alias("d"))
    nest = lambda c: _rows.nest(each.select("grp", "src", F.col(c).alias("v")), "v", "src", "grp").withColumnRenamed("grp", POS) if group else each.select(F.col("src").alias(POS), F.col(c).alias("v"))
    edges = query._from(nest("v"), int64, 2 + dim)
    return (edges, query._from(nest("d"), float64, 1 + dim)) if return_distances else edges


def pairwise_distances(x: RaggedArray, *, dim: int = 1) -> RaggedArray:
    if dim == 1:
        return x._with(N.pairwise_distances(x.col), float64, x.depth)
    one = x._from(_one_row(x).select(F.lit(0).cast("long").alias(POS), F.col("m").alias("v")), depth=2)
    return pairwise_distances(one)[0]


def grid_pool(x: RaggedArray, grid_size, origin=(0.0, 0.0, 0.0), voxel_size: float = 1.0, dim: int = 1) -> RaggedArray:
    group = ["grp"] if dim == 1 else []
    found = hist.grid_pool(_cloud(x, dim), "point", group, tuple(grid_size), origin, voxel_size)
    if dim == 1:
        return x._from(_rows.nest(found, "count", "cell", "grp").select(F.col("grp").alias(POS), F.col("count").alias("v")), float64, 1)
    return x._from(found.select(F.col("cell").alias(POS), F.col("count").alias("v")), float64, 0)


def cat(arrays, dim: int = 0) -> RaggedArray:
    first = arrays[0]
    if dim < 0:
        raise ArgumentInvalid("dim must not be negative", str(dim))
    if {a.dtype for a in arrays} != {first.dtype}:
        raise ArgumentInvalid("cat takes arrays of one dtype", ", ".join(str(a.dtype) for a in arrays))
    if dim == 0:
        if len({(a.depth, a.union) for a in arrays}) > 1:
            arrays = [a.to_union() for a in arrays]
        return arrays[0]._from(_rows.concat_rows([a._plain() for a in arrays]), union=arrays[0].union)
    out = first
    for other in arrays[1:]:
        if len(out) != len(other):
            raise ArgumentInvalid("cat needs equal outer lengths")
        both, a, b = out._aligned(other)
        out = first._from(both.select(POS, _cat(a, b, dim).alias("v")))
    return out


def _cat(a, b, dim: int):
    return F.concat(a, b) if dim == 1 else F.zip_with(a, b, lambda x, y: _cat(x, y, dim - 1))


def full_like(x: RaggedArray, fill_value, dtype=None) -> RaggedArray:
    to = x.dtype if dtype is None else dtype
    return x._map(lambda _: F.lit(fill_value).cast(to.spark), to)


def zeros_like(x, dtype=None):
    if (dtype or x.dtype).kind in "cs":
        raise ArgumentInvalid("zeros_like takes numbers")
    return full_like(x, 0, dtype)


def ones_like(x, dtype=None):
    if (dtype or x.dtype).kind in "cs":
        raise ArgumentInvalid("ones_like takes numbers")
    return full_like(x, 1, dtype)


def gpu_available() -> bool:
    return False


def gpu_backend() -> None:
    return None
