"""RaggedArray: a lazy column of nested lists with a row position.

An array is a DataFrame with ``_pos`` and a value column; depth counts the list levels inside a
row (a one-dimensional array has depth 0). Methods build plans; to_list() and len() run them.
Two arrays of one DataFrame combine as columns of a row, others are joined on the position.
A union array holds scalars and flat lists at axis 0.
"""

from __future__ import annotations

import itertools
import operator
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein import types as D
from skein.errors import ArgumentInvalid, AxisInvalid, BroadcastFailed, CastFailed, DTypeUnsupported, IndexInvalid, IndexOutOfBounds, LayoutUnsupported, ShapeMismatch
from skein.functions import guards as G
from skein.functions import nested as N
from skein.operators import random, rows, sets
from skein.types import DType, as_dtype, can_cast, infer, promote_types

POS = "_pos"


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def _is_list(x) -> bool:
    return isinstance(x, (list, tuple))


def _leaves(x):
    if _is_list(x):
        for y in x:
            yield from _leaves(y)
    else:
        yield x


def _level(x) -> int:
    return 1 + max((_level(y) for y in x), default=0) if _is_list(x) else 0


def _uniform(x, depth: int) -> bool:
    if depth == 0:
        return not _is_list(x)
    return _is_list(x) and all(_uniform(y, depth - 1) for y in x)


def _convert(x, dtype: DType):
    if x is None:
        return None
    if dtype.kind == "f":
        return float(x)
    if dtype.kind in "iu":
        return int(x)
    if dtype.kind == "b":
        return bool(x)
    if dtype.kind == "c" and len(x) != 1:
        raise CastFailed("char holds one character", repr(x))
    return str(x)


def _deep(x, depth: int, dtype: DType):
    return _convert(x, dtype) if depth == 0 else [_deep(y, depth - 1, dtype) for y in x]


def spark_type(dtype: DType, depth: int, union: bool) -> T.DataType:
    if union:
        return T.StructType([T.StructField("is_list", T.BooleanType()), T.StructField("items", T.ArrayType(dtype.spark))])
    out = dtype.spark
    for _ in range(depth):
        out = T.ArrayType(out)
    return out


class RaggedArray:
    def __init__(self, frame: DataFrame, column: str, dtype: DType, depth: int, union: bool = False, token: int | None = None):
        self.frame, self.column, self.dtype, self.depth, self.union = frame, column, dtype, depth, union
        self.token = next(_names) if token is None else token  # arrays with one token have the same rows

    # construction

    @classmethod
    def of(cls, obj, dtype: DType | str | None = None, spark: SparkSession | None = None) -> RaggedArray:
        spark = spark or session()
        items = list(obj) if _is_list(obj) else [obj]
        dtype = as_dtype(dtype) if dtype is not None else infer(_leaves(items))
        union = any(map(_is_list, items)) and not all(map(_is_list, items))
        if union:
            if any(_level(x) > 1 for x in items):
                raise LayoutUnsupported("a union holds scalars and flat lists", "an element is nested deeper")
            data = [(k, (_is_list(x), [_convert(y, dtype) for y in (x if _is_list(x) else [x])])) for k, x in enumerate(items)]
            depth = 1
        else:
            depth = max(map(_level, items), default=0)
            if not all(_uniform(x, depth) or _empty_prefix(x, depth) for x in items):
                raise LayoutUnsupported("inner axes don't mix scalars and lists", "rows differ in depth below axis 0")
            data = [(k, _deep(x, depth, dtype)) for k, x in enumerate(items)]
        shape = T.StructType([T.StructField(POS, T.LongType()), T.StructField("v", spark_type(dtype, depth, union))])
        return cls(spark.createDataFrame(data, shape), "v", dtype, depth, union)

    def _with(self, value: Column, dtype: DType | None = None, depth: int | None = None, union: bool | None = None) -> RaggedArray:
        """A column of the same rows."""
        name = f"v{next(_names)}"
        return RaggedArray(self.frame.withColumn(name, value), name, dtype or self.dtype, self.depth if depth is None else depth, self.union if union is None else union, self.token)

    def _plain(self) -> DataFrame:
        return self.frame.select(POS, F.col(self.column).alias("v"))

    def _from(self, df: DataFrame, dtype: DType | None = None, depth: int | None = None, union: bool = False) -> RaggedArray:
        return RaggedArray(df.select(POS, "v"), "v", dtype or self.dtype, self.depth if depth is None else depth, union)

    @property
    def col(self) -> Column:
        return F.col(self.column)

    # materialising

    def to_list(self) -> list:
        found = [r["v"] for r in self._plain().orderBy(POS).collect()]
        if self.union or self.depth:
            found = [x for x in found if x is not None]  # rows that only longer columns of a frame have
        if self.union:
            found = [list(x["items"]) if x["is_list"] else x["items"][0] for x in found]
        return [_plain_value(x) for x in found]

    def __len__(self) -> int:
        return self.frame.count()

    def __repr__(self) -> str:
        return f"RaggedArray({self.dtype}, depth={self.depth}{', union' if self.union else ''})"

    def copy(self) -> RaggedArray:
        return RaggedArray(self.frame, self.column, self.dtype, self.depth, self.union)

    # elementwise

    def _map(self, f: Callable[[Column], Column], dtype: DType | None = None) -> RaggedArray:
        value = N.union_map(self.col, f) if self.union else N.map_leaf(self.col, self.depth, f)
        return self._with(value, dtype)

    def _aligned(self, other: RaggedArray) -> tuple[DataFrame, Column, Column]:
        if other.frame is self.frame:
            return self.frame, self.col, other.col
        for x, y in ((self, other), (other, self)):
            if y.column != "v" and x.token == y.token and {x.column, y.column} <= set(y.frame.columns):
                return y.frame, self.col, other.col  # y was derived from the rows of x
        left, right = self._plain().withColumnRenamed("v", "_a"), other._plain().withColumnRenamed("v", "_b")
        n, k = len(self), len(other)
        if n == k:
            both = left.join(right, POS)
        elif k == 1:
            both = left.crossJoin(F.broadcast(right.select("_b")))
        elif n == 1:
            both = right.crossJoin(F.broadcast(left.select("_a")))
        else:
            raise BroadcastFailed("axis 0 differs", f"{n} and {k} rows")
        return both, F.col("_a"), F.col("_b")

    def _zip(self, other, f: Callable[[Column, Column], Column], dtype: DType, same: bool = False) -> RaggedArray:
        if not isinstance(other, RaggedArray):
            return self._map(lambda x: f(x, F.lit(other)), dtype)
        both, a, b = self._aligned(other)
        if self.union or other.union:
            lift = lambda x, arr: x if arr.union else N.union_scalar(x) if arr.depth == 0 else N.union_list(x)
            if max(self.depth, other.depth) > 1:
                raise LayoutUnsupported("a union meets flat lists only")
            value, depth, union = N.union_zip(lift(a, self), lift(b, other), f), 1, True
        else:
            value, depth, union = N.zip_leaf(a, b, self.depth, other.depth, f), max(self.depth, other.depth), False
        return RaggedArray(both.select(POS, value.alias("v")), "v", dtype, depth, union)

    def _arithmetic(self, other, name: str) -> RaggedArray:
        theirs = other.dtype if isinstance(other, RaggedArray) else infer([other])
        if not isinstance(other, RaggedArray) and self.dtype.numeric and theirs.numeric and theirs.kind in ("i", self.dtype.kind):
            theirs = self.dtype  # a Python number takes the array's type
        if self.dtype.kind in "cs" or theirs.kind in "cs":
            if name != "add" or not (self.dtype.kind in "cs" and theirs.kind in "cs"):
                raise DTypeUnsupported("strings only concatenate", f"{self.dtype} {name} {theirs}")
            return self._zip(other, lambda x, y: F.concat(x, y), D.string)
        if "b" in (self.dtype.kind, theirs.kind):
            raise DTypeUnsupported("no arithmetic on bool", f"{self.dtype} {name} {theirs}")
        to = promote_types(self.dtype, theirs)
        if name == "divide":
            to = to if to.kind == "f" else D.float64
            return self._zip(other, lambda x, y: G.divide(x, y).cast(to.spark), to)
        if name == "mod":
            return self._zip(other, lambda x, y: G.floored_mod(x.cast(to.spark), y.cast(to.spark), to.kind in "iu").cast(to.spark), to)
        op = {"add": operator.add, "subtract": operator.sub, "multiply": operator.mul}[name]
        if to.kind in "iu":
            return self._zip(other, lambda x, y: G.wrapped(op, x, y, to), to)
        return self._zip(other, lambda x, y: op(x.cast(to.spark), y.cast(to.spark)), to)

    def __add__(self, other):
        return self._arithmetic(other, "add")

    def __sub__(self, other):
        return self._arithmetic(other, "subtract")

    def __mul__(self, other):
        return self._arithmetic(other, "multiply")

    def __truediv__(self, other):
        return self._arithmetic(other, "divide")

    def __mod__(self, other):
        return self._arithmetic(other, "mod")

    def remainder(self, other):
        return self._arithmetic(other, "mod")

    mod_ = remainder

    def unary(self, name: str) -> RaggedArray:
        if not self.dtype.numeric:
            raise DTypeUnsupported(f"{name} takes numbers", str(self.dtype))
        to = D.float64 if name in G.UNARY_FLOAT and self.dtype.kind in "iu" else self.dtype
        return self._map(lambda x: G.unary(name, x, self.dtype), to)

    def compare(self, other: RaggedArray, name: str) -> RaggedArray:
        if isinstance(other, RaggedArray):
            promote_types(self.dtype, other.dtype)
            floating = self.dtype.kind not in "cs"
        else:
            floating = self.dtype.kind not in "cs"
        return self._zip(other, lambda x, y: G.compare(name, x, y, floating), D.bool_)

    def logical(self, other: RaggedArray, name: str) -> RaggedArray:
        if self.dtype.kind != "b" or other.dtype.kind != "b":
            raise DTypeUnsupported("logical functions take bool", f"{self.dtype}, {other.dtype}")
        op = {"and": operator.and_, "or": operator.or_, "xor": operator.ne}[name]
        return self._zip(other, lambda x, y: G.strict(op, x, y), D.bool_)

    def logical_not(self) -> RaggedArray:
        if self.dtype.kind != "b":
            raise DTypeUnsupported("logical functions take bool", str(self.dtype))
        return self._map(lambda x: ~x)

    def test(self, name: str) -> RaggedArray:
        if self.dtype.kind != "f":
            raise DTypeUnsupported(f"{name} takes floats", str(self.dtype))
        return self._map({"isnan": G.isnan, "isinf": G.isinf, "isfinite": G.isfinite}[name], D.bool_)

    def astype(self, dtype: DType | str, casting: str = "safe") -> RaggedArray:
        to = as_dtype(dtype)
        if casting == "promote":
            to = promote_types(self.dtype, to)
        if not can_cast(self.dtype, to, casting):
            raise CastFailed(f"{self.dtype} to {to}", f"not allowed by casting={casting!r}", "pass casting='unsafe'")
        return self._map(lambda x: self._cast(x, to, casting), to)

    def _cast(self, x: Column, to: DType, casting: str) -> Column:
        if to.kind in "iu" and self.dtype.kind == "f":
            bad = F.isnan(x) | (F.abs(x) == float("inf"))
            whole = F.when(bad, F.raise_error(F.lit("CastFailed: nan and infinities have no integer")).cast("decimal(38,0)")).otherwise(F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("decimal(38,0)"))
            return self._ranged(whole, to, casting)
        if to.kind in "iu" and self.dtype.kind in "iu":
            return x.cast(to.spark) if D._safe(self.dtype, to) else self._ranged(x.cast("decimal(38,0)"), to, casting)
        if to.kind == "c" and self.dtype.kind == "s":
            return F.when(F.char_length(x) == 1, x).otherwise(F.when(x.isNotNull(), F.raise_error(F.lit("CastFailed: char holds one character"))))
        if to.kind == "b":
            return x.cast("double") != 0
        return x.cast(to.spark)

    @staticmethod
    def _ranged(x: Column, to: DType, casting: str) -> Column:
        if casting == "unsafe":
            return G.wrap(x, D.int64).cast("long").cast(to.spark) if to == D.int64 else G.wrap(x, to)
        return F.when((x < F.lit(to.low)) | (x > F.lit(str(to.high)).cast("decimal(38,0)")), F.raise_error(F.lit(f"CastFailed: out of range for {to}")).cast(to.spark)).otherwise(x.cast(to.spark))

    # reductions

    def _axis(self, dim: int) -> int:
        found = dim + self.depth + 1 if dim < 0 else dim
        if not 0 <= found <= self.depth:
            raise AxisInvalid("no such axis", f"dim={dim} of {self.depth + 1} axes")
        return found

    def _sum_kind(self) -> DType:
        return D.float64 if self.dtype.kind == "f" else D.int64

    def _reducer(self, name: str, **options) -> tuple[Callable[[Column], Column], Callable[[Column], Column], DType]:
        """On a list, on rows, and the result's type."""
        if self.dtype.kind in "cs":
            raise DTypeUnsupported(f"{name} takes numbers", str(self.dtype))
        floating = self.dtype.kind == "f"
        as_number = (lambda x: x.cast("int")) if self.dtype.kind == "b" else (lambda x: x)
        numbers = (lambda a: F.transform(a, as_number)) if self.dtype.kind == "b" else (lambda a: a)
        low = lambda c: F.when(F.max(F.when(F.isnan(c.cast("double")), 1)) == 1, float("nan")).otherwise(F.min(c)) if floating else F.min(c)
        kind = self._sum_kind()
        ddof, skip, q = options.get("ddof", 0), options.get("skip_nan", False), options.get("q")
        seen = lambda c: F.when(~F.isnan(c.cast("double")), c) if skip else c
        if name == "sum":
            return (lambda a: N.total(numbers(a), kind.spark.simpleString())), (lambda c: F.sum(as_number(c)).cast(kind.spark)), kind
        if name == "mean":
            return (lambda a: N.mean(numbers(a))), (lambda c: F.avg(as_number(c).cast("double"))), D.float64
        if name == "min":
            return (lambda a: N.minimum(a, floating)), low, self.dtype
        if name == "max":
            return (lambda a: N.maximum(a, floating)), F.max, self.dtype
        if name == "ptp":
            return (lambda a: N.ptp(a, floating)), (lambda c: F.max(c) - low(c)), self.dtype
        wide = D.float32 if self.dtype == D.float32 else D.float64
        if name in ("var", "std"):
            root = F.sqrt if name == "std" else (lambda x: x)

            def across(c: Column) -> Column:
                c = seen(c).cast("double")
                n = F.count(c)
                return F.when(n > ddof, root(F.var_pop(c) * n / (n - ddof)))

            return (lambda a: root(N.variance(a, ddof, skip))), across, wide
        if name == "quantile":
            return (lambda a: N.quantile(a, q, skip)), (lambda c: F.percentile(seen(c).cast("double"), F.lit(float(q)))), D.float64
        raise ArgumentInvalid("unknown reduction", name)

    def reduce(self, name: str, dim: int | None = None, **options):
        """Over an axis, or over everything (dim=None: a Python value)."""
        on_list, on_rows, to = self._reducer(name, **options)
        if dim is None or self.depth == 0 and self._axis(dim) == 0:
            return self._leaves_frame().agg(on_rows(F.col("v")).alias("v")).first()[0]
        if self.union:
            if dim not in (0, 1, -1):
                raise AxisInvalid("a union has two axes", f"dim={dim}")
            if name in ("sum", "mean", "min", "max", "ptp"):
                value = N.union_fold(self.col, on_list)
            else:
                value = on_list(self.col["items"])
            return self._with(N.union_scalar(value), to)._scalars()
        axis = self._axis(dim)
        if axis == 0:
            return self._across(on_rows, to)
        inner = self.depth - axis + 1  # list levels from the reduced axis on
        return self._with(_at_level(self.col, axis - 1, lambda x: _axis0_in_row(x, inner, on_list)), to, self.depth - 1)

    def _scalars(self) -> RaggedArray:
        return self._with(F.get(self.col["items"], F.lit(0)), depth=0, union=False)

    def _leaves_frame(self) -> DataFrame:
        if self.union:
            return self.frame.select(F.explode(self.col["items"]).alias("v"))
        if self.depth == 0:
            return self.frame.select(self.col.alias("v"))
        return self.frame.select(F.explode(N.flatten_levels(self.col, self.depth - 1)).alias("v"))

    def _across(self, on_rows: Callable[[Column], Column], to: DType) -> RaggedArray:
        """Axis 0: stacked by position; the last level is strict."""
        df = self._plain()
        path = [f"_p{k}" for k in range(self.depth)]
        for k, p in enumerate(path):
            explode = F.posexplode_outer if k == self.depth - 1 else F.posexplode
            df = df.select(POS, *path[:k], explode("v").alias(p, "v"))
        above = path[:-1]
        stacked = df.groupBy(*above).agg(F.count_distinct(POS).alias("_rows"))
        found = df.where(F.col(path[-1]).isNotNull()).groupBy(*path).agg(F.count("v").alias("_n"), on_rows(F.col("v")).alias("v"))
        found = found.join(stacked, above) if above else found.crossJoin(F.broadcast(stacked))
        found = found.withColumn("v", F.when(F.col("_n") == F.col("_rows"), F.col("v")))
        for k in range(self.depth - 1, 0, -1):
            found = rows.nest(found, "v", path[k], *path[:k])
        return self._from(found.withColumn(POS, F.col(path[0]).cast("long")), to, self.depth - 1)

    # sorting and searching

    def _innermost(self, f: Callable[[Column], Column], dim: int, dtype: DType | None = None, drop: bool = False) -> RaggedArray:
        if self.union:
            return self._with(F.struct(self.col["is_list"].alias("is_list"), f(self.col["items"]).alias("items")), dtype)
        if self._axis(dim) != self.depth:
            raise AxisInvalid("only the innermost axis", f"dim={dim} of {self.depth + 1} axes")
        return self._with(N.map_innermost(self.col, self.depth, f), dtype, self.depth - drop)

    def sort(self, dim: int = -1) -> RaggedArray:
        if self.depth == 0:
            ordered = self._plain().withColumn("v", F.when(F.col("v").isNull(), F.raise_error(F.lit("sort: nulls can't be ordered"))).otherwise(F.col("v")))
            ordered = ordered.withColumnRenamed(POS, "_old")  # equal values are dealt by their old position
            return self._from(rows.ranked(ordered, [F.col("v"), F.col("_old")], POS))
        return self._innermost(N.sort, dim)

    def argsort(self, dim: int = -1) -> RaggedArray:
        if self.depth == 0:
            ordered = rows.ranked(self._plain().withColumnRenamed(POS, "_old"), [F.col("v"), F.col("_old")], POS)
            return self._from(ordered.select(POS, F.col("_old").alias("v")), D.int64)
        return self._innermost(N.argsort, dim, D.int64)

    def argextreme(self, greatest: bool, dim: int | None = None, skip_nan: bool = False):
        if dim is None or self.depth == 0:
            if self.depth > 0 and not self.union:
                raise AxisInvalid("a nested array needs dim=-1")
            df = self._plain() if not self.union else rows.unstacked(self.frame.select(POS, self.col["items"].alias("v")), "v")
            df = df.where(F.col("v").isNotNull())
            nan = F.isnan(F.col("v").cast("double")) if self.dtype.kind == "f" else F.lit(False)
            if skip_nan:
                df = df.where(~nan)
            v = F.col("v").cast("double") if self.dtype.kind == "f" else F.col("v")
            first = df.agg(F.min(F.struct((~nan).alias("n"), (-v if greatest else v).alias("v"), F.col(POS).alias("p"))).alias("x")).select("x.p").first()
            return first[0]
        f = (lambda a: N.argmax(a, skip_nan)) if greatest else (lambda a: N.argmin(a, skip_nan))
        return self._innermost(f, dim, D.int64, True) if not self.union else self._with(N.union_scalar(f(self.col["items"])), D.int64)._scalars()

    def partition(self, kth: int, dim: int = -1) -> RaggedArray:
        return self.sort() if self.depth == 0 else self._innermost(lambda a: N.partition(a, kth), dim)

    def argpartition(self, kth: int, dim: int = -1) -> RaggedArray:
        return self.argsort() if self.depth == 0 else self._innermost(lambda a: N.argpartition(a, kth), dim, D.int64)

    # shape

    def shape(self, dim: int = 0):
        return self._shape(dim, lambda a: F.size(a).cast("long"))

    def nshape(self, dim: int = 0):
        return self._shape(dim, N.count_present)

    nanshape = nshape

    def _shape(self, dim: int, f: Callable[[Column], Column]):
        axis = self._axis(dim)
        if axis == 0:
            return len(self) if f is not N.count_present or self.depth else self.frame.where(self.col.isNotNull()).count()
        if self.union:
            return self._with(f(self.col["items"]), D.int64, 0, False)
        count = f if axis == self.depth else (lambda a: F.size(a).cast("long"))
        return self._with(_at_level(self.col, axis - 1, count), D.int64, axis - 1)

    def flatten(self, dim: int | None = None, but: int | None = None) -> RaggedArray:
        """Remove list axes; default all of them."""
        if self.union:
            return self._from(rows.unstacked(self.frame.select(POS, self.col["items"].alias("v")), "v"), depth=0)
        if self.depth == 0:
            return self
        drop = [self._axis(dim)] if dim is not None else [k for k in range(self.depth) if but is None or k != self._axis(but)]
        if dim is not None and drop[0] == self.depth:
            drop = [self.depth - 1]
        out = self
        for axis in sorted(drop, reverse=True):
            if axis:
                out = out._with(_at_level(out.col, axis - 1, F.flatten), depth=out.depth - 1)
            else:
                out = out._from(rows.unstacked(out._plain(), "v"), depth=out.depth - 1)
        return out

    def unflatten(self, sizes: Sequence, dim: int = 0) -> RaggedArray:
        """Consecutive runs of an axis as lists; sizes is a list, or an array, and nests for dim > 0."""
        given = sizes if isinstance(sizes, RaggedArray) else RaggedArray.of(sizes, D.int64)
        if dim == 0:
            total = given._plain().agg(F.coalesce(F.sum("v"), F.lit(0))).first()[0]
            if total != len(self):
                raise ShapeMismatch("sizes must add up to the rows", f"{total} and {len(self)}")
            runs = rows.running(given._plain(), F.col("v"), "_s").withColumnRenamed(POS, "_r")
            places = runs.select("_r", F.explode(N.upto(F.col("v"))).alias("_i"), "_s")
            places = places.select("_r", (F.col("_s") + F.col("_i")).alias(POS))
            filled = self._plain().join(places, POS).groupBy("_r").agg(F.array_sort(F.collect_list(F.struct(F.col(POS).alias("p"), F.col("v").alias("v")))).alias("x"))
            empty = F.array().cast(T.ArrayType(spark_type(self.dtype, self.depth, self.union)))
            df = runs.select("_r").join(filled, "_r", "left").select(F.col("_r").alias(POS), F.coalesce(F.col("x").getField("v"), empty).alias("v"))
            return self._from(df, depth=self.depth + 1)
        if not 0 < dim <= self.depth or given.depth != dim:
            raise AxisInvalid("unflatten splits an axis by sizes nested as deep", f"dim={dim}, sizes of {given.depth + 1} axes, array of {self.depth + 1}")
        both = self._plain().join(given._plain().withColumnRenamed("v", "_s"), POS)

        def split(x: Column, n: Column, level: int) -> Column:
            return N.unflatten(x, n) if level == 1 else F.zip_with(x, n, lambda y, m: split(y, m, level - 1))

        return self._from(both.withColumn("v", split(F.col("v"), F.col("_s"), dim)), depth=self.depth + 1)

    # selection

    def _checked(self, i: int) -> int:
        n = len(self)
        at = i + n if i < 0 else i
        if not 0 <= at < n:
            raise IndexOutOfBounds("row index", f"{i} of {n} rows")
        return at

    def __getitem__(self, key):
        if isinstance(key, RaggedArray):
            if key.dtype.kind == "b" and key.depth == 0:
                return self._from(rows.mask_rows(self._plain(), key._plain(), "v"), union=self.union)
            key = key.to_list()
        if isinstance(key, int) and not isinstance(key, bool):
            return self._row(key)
        if isinstance(key, slice):
            start, stop, step = key.indices(len(self))
            return self._from(rows.slice_rows(self._plain(), start, stop, step), union=self.union)
        if isinstance(key, tuple):
            return self._coordinates(*key)
        if _is_list(key):
            key = list(key)
            if key and all(isinstance(x, bool) for x in key):
                if len(key) != len(self):
                    raise IndexInvalid("mask length", f"{len(key)} for {len(self)} rows")
                return self._gather([i for i, x in enumerate(key) if x])
            if self.depth and not self.union and len(key) == len(self) and key:
                return self._per_row(key)
            return self._gather([self._checked(i) for i in key])
        raise IndexInvalid("unsupported index", repr(key))

    def _gather(self, index: list[int]) -> RaggedArray:
        return self._from(rows.fancy_rows(self._plain(), index), union=self.union)

    def _row(self, i: int):
        at = self._checked(i)
        one = self.frame.where(F.col(POS) == at)
        if self.union:
            x = one.select(self.col.alias("v")).first()[0]
            return RaggedArray.of(list(x["items"]), self.dtype) if x["is_list"] else x["items"][0]
        if self.depth == 0:
            return one.select(self.col.alias("v")).first()[0]
        flat = one.select(F.posexplode(self.col).alias("_i", "v"))
        return self._from(flat.withColumn(POS, F.col("_i").cast("long")), depth=self.depth - 1)

    def _picks(self, key: list, values: list | None = None) -> DataFrame:
        """A row for each position of key: the indices it stands for (an int, a list or a slice), and a value for each."""
        if not all(isinstance(k, (int, slice, list, tuple)) for k in key):
            raise IndexInvalid("a row takes an int, a list of ints or a slice", repr(key))
        kind = self.dtype.spark.simpleString()
        data = []
        for r, k in enumerate(key):
            at = None if isinstance(k, slice) else [k] if isinstance(k, int) else list(k)
            v = None if values is None else values[r] if _is_list(values[r]) else None
            if v is not None and at is not None and len(v) != len(at):
                raise ShapeMismatch("one value for each selected element", f"{len(v)} for {len(at)}")
            ends = (k.start, k.stop, k.step) if isinstance(k, slice) else (None, None, None)
            one = None if values is None or _is_list(values[r]) else _convert(values[r], self.dtype)
            data.append((r, at, *ends, None if v is None else [_convert(x, self.dtype) for x in v], one))
        return self.frame.sparkSession.createDataFrame(data, f"{POS} long, _x array<long>, _s long, _e long, _t long, _w array<{kind}>, _o {kind}")

    def _per_row(self, key: list) -> RaggedArray:
        both = self._plain().join(self._picks(key), POS)
        at = F.coalesce("_x", N.slice_positions(F.size("v"), F.col("_s"), F.col("_e"), F.col("_t")))
        return self._from(both.withColumn("v", N.take(F.col("v"), at)))

    def _coordinates(self, *parts):
        """Ints and slices apply one after the other to what is left; lists of ints pair up as coordinates."""
        if not parts:
            raise IndexInvalid("an index tuple needs a part")
        if not any(map(_is_list, parts)):
            x = self
            for i in parts:
                if isinstance(x, RaggedArray):
                    x = x[i]
                elif i not in (0, -1):
                    raise IndexOutOfBounds("a scalar has one element", str(i))
            return x
        if any(isinstance(p, slice) for p in parts):
            raise IndexInvalid("slices don't combine with lists of coordinates", repr(parts))
        if len(parts) > (2 if self.union else self.depth + 1):
            raise IndexInvalid("more coordinates than axes", f"{len(parts)} for {self.depth + 1}")
        pairs = self.frame.sparkSession.createDataFrame(self._paired(parts), f"_k long, {POS} long, _c array<long>")
        both = self._plain().join(pairs, POS)
        picked = F.col("v")["items"] if self.union else F.col("v")
        for i in range(len(parts) - 1):
            picked = F.get(N.take(picked, F.array(F.col("_c")[i])), F.lit(0))
        return self._from(both.select(F.col("_k").alias(POS), picked.alias("v")), depth=0 if self.union else self.depth + 1 - len(parts))

    def _paired(self, parts: Sequence) -> list[tuple]:
        """(place, row, inner coordinates) of lists of coordinates; ints are repeated."""
        n = max(len(p) if _is_list(p) else 1 for p in parts)
        columns = [list(p) if _is_list(p) else [p] * n for p in parts]
        if len({len(c) for c in columns}) > 1:
            raise IndexInvalid("coordinates of different lengths", ", ".join(str(len(c)) for c in columns))
        return [(k, self._checked(i), list(rest)) for k, (i, *rest) in enumerate(zip(*columns))]

    def __setitem__(self, key, value) -> None:
        """Rebinds this object to a plan with the new values."""
        if isinstance(key, tuple):
            self._set_coordinates(key, value)
            return
        if isinstance(key, RaggedArray):
            if key.dtype.kind == "b":
                self._set_where(key, value)
                return
            key = key.to_list()
        if isinstance(key, slice):
            key = list(range(*key.indices(len(self))))
        elif _is_list(key) and key and all(isinstance(x, bool) for x in key):
            if len(key) != len(self):
                raise ShapeMismatch("mask length", f"{len(key)} for {len(self)} rows")
            key = [i for i, x in enumerate(key) if x]
        elif _is_list(key) and key and self.depth == 1 and not self.union and len(key) == len(self):
            self._set_per_row(list(key), value)
            return
        at = [self._checked(i) for i in (key if _is_list(key) else [key])]
        if _is_list(value) and _is_list(key) and len(value) != len(at) and (self.depth == 0 or any(map(_is_list, value))):
            raise ShapeMismatch("one value for each selected row", f"{len(value)} for {len(at)}")
        values = list(value) if _is_list(value) and _is_list(key) and len(value) == len(at) else [value] * len(at)
        items = self.to_union() if self.depth == 1 and any(not _is_list(v) for v in values) or self.depth == 0 and any(map(_is_list, values)) else self
        kind = spark_type(items.dtype, items.depth, items.union)
        encode = (lambda v: (_is_list(v), list(v) if _is_list(v) else [v])) if items.union else (lambda v: v)
        shape = T.StructType([T.StructField(POS, T.LongType()), T.StructField("_w", kind), T.StructField("_hit", T.BooleanType())])
        last = dict(zip(at, values))  # the last write wins
        new = items.frame.sparkSession.createDataFrame([(i, encode(v), True) for i, v in last.items()], shape)
        both = items._plain().join(new, POS, "left")
        done = both.withColumn("v", F.when(F.col("_hit"), F.col("_w")).otherwise(F.col("v"))).select(POS, "v")
        self._rebind(done, items.depth, items.union)

    def _rebind(self, df: DataFrame, depth: int | None = None, union: bool | None = None) -> None:
        self.frame, self.column, self.token = df.select(POS, "v"), "v", next(_names)
        self.depth, self.union = self.depth if depth is None else depth, self.union if union is None else union

    def _set_where(self, mask: RaggedArray, value) -> None:
        """Where the mask is true: one value, or, for a mask of rows, one for each of them in turn."""
        if mask.depth:
            done = self._zip(mask, lambda x, m: F.when(m, F.lit(value).cast(self.dtype.spark)).otherwise(x), self.dtype)
            self._rebind(done._plain())
            return
        if len(mask) != len(self):
            raise ShapeMismatch("mask length", f"{len(mask)} for {len(self)} rows")
        hit = rows.running(mask._plain().where("v").select(POS), 1, "_k")
        if _is_list(value) and not (self.depth and not any(map(_is_list, value))):
            if len(value) != (n := hit.count()):
                raise ShapeMismatch("one value for each selected row", f"{len(value)} for {n}")
            kind = T.StructType([T.StructField("_k", T.LongType()), T.StructField("_w", spark_type(self.dtype, self.depth, self.union))])
            hit = hit.join(self.frame.sparkSession.createDataFrame([(k, _deep(v, self.depth, self.dtype)) for k, v in enumerate(value)], kind), "_k")
        else:
            inner = _deep(value, self.depth, self.dtype) if _is_list(value) or not self.depth else None
            if inner is None and self.depth:
                raise ShapeMismatch("a row takes a list", repr(value))
            one = self.frame.sparkSession.createDataFrame([(inner,)], T.StructType([T.StructField("_w", spark_type(self.dtype, self.depth, self.union))]))
            hit = hit.crossJoin(one)  # a single row
        both = self._plain().join(hit.withColumn("_hit", F.lit(True)), POS, "left")
        self._rebind(both.withColumn("v", F.when(F.col("_hit"), F.col("_w")).otherwise(F.col("v"))))

    def _set_per_row(self, key: list, value) -> None:
        values = list(value) if _is_list(value) and len(value) == len(key) else [value] * len(key)
        both = self._plain().join(self._picks(key, values), POS, "left")
        n = F.size("v")
        at = F.coalesce("_x", N.slice_positions(n, F.col("_s"), F.col("_e"), F.col("_t")))
        at = F.transform(at, lambda i: N.position(i, n))
        new = F.coalesce("_w", F.array_repeat("_o", F.size(at)))
        fits = F.when(F.size(new) == F.size(at), F.arrays_zip(at.alias("i"), new.alias("x"))).otherwise(F.raise_error(F.lit("ShapeMismatch: one value for each selected element")))
        self._rebind(both.withColumn("_p", fits).withColumn("v", N.written(F.col("v"), F.col("_p"))))

    def _set_coordinates(self, key: tuple, value) -> None:
        """Leaves at coordinates, at any depth; the last write to a place wins."""
        if any(isinstance(p, slice) for p in key):
            raise IndexInvalid("slices don't combine with assignment by coordinates", repr(key))
        if len(key) != (2 if self.union else self.depth + 1):
            raise IndexInvalid("assignment takes a coordinate for each axis", f"{len(key)} for {self.depth + 1}")
        writes = self._paired(key)
        values = list(value) if _is_list(value) else [value] * len(writes)
        if len(values) != len(writes):
            raise ShapeMismatch("one value for each coordinate", f"{len(values)} for {len(writes)}")
        kind = self.dtype.spark.simpleString()
        data = [(k, r, c, _convert(v, self.dtype)) for (k, r, c), v in zip(writes, values)]
        new = self.frame.sparkSession.createDataFrame(data, f"_k long, {POS} long, _c array<long>, _w {kind}")
        levels = 1 if self.union else self.depth
        if not levels:
            last = new.groupBy(POS).agg(F.max_by("_w", "_k").alias("_w"), F.lit(True).alias("_hit"))
            self._rebind(self._plain().join(last, POS, "left").withColumn("v", F.when(F.col("_hit"), F.col("_w")).otherwise(F.col("v"))))
            return
        # coordinates from the end become places from 0, level by level
        here, path = F.col("v")["items"] if self.union else F.col("v"), []
        for i in range(levels):
            path.append(N.position(F.col("_c")[i], F.size(here)))
            here = F.get(here, path[-1].cast("int"))
        placed = self._plain().join(new, POS).select(POS, "_k", "_w", F.array(*path).alias("_c"))
        if bad := [r[0] for r in placed.select(F.exists("_c", lambda i: i.isNull())).collect() if r[0]]:  # as many as the caller wrote
            raise IndexOutOfBounds("coordinate", f"{len(bad)} of {len(data)} are outside")
        last = placed.groupBy(POS, "_c").agg(F.max_by(F.struct("_w"), "_k").alias("_w"))
        writes_of = last.groupBy(POS).agg(F.map_from_entries(F.collect_list(F.struct("_c", "_w"))).alias("_m"))

        def put(x: Column, level: int, keys: list[Column]) -> Column:
            if level == 0:
                found = F.element_at("_m", F.array(*keys))
                return F.when(found.isNotNull(), found["_w"]).otherwise(x)
            return F.transform(x, lambda y, i: put(y, level - 1, [*keys, i.cast("long")]))

        lists = F.col("v")["items"] if self.union else F.col("v")
        done = F.when(F.col("_m").isNull(), lists).otherwise(put(lists, levels, []))
        v = F.struct(F.col("v")["is_list"].alias("is_list"), done.alias("items")) if self.union else done
        self._rebind(self._plain().join(writes_of, POS, "left").withColumn("v", v))

    def to_union(self) -> RaggedArray:
        if self.union:
            return self
        if self.depth > 1:
            raise LayoutUnsupported("a union holds scalars and flat lists")
        return self._with(N.union_list(self.col) if self.depth else N.union_scalar(self.col), depth=1, union=True)

    # sets over all leaves

    def values(self) -> DataFrame:
        return self._leaves_frame().withColumnRenamed("v", "value")

    def _ordered(self, df: DataFrame, dtype: DType) -> RaggedArray:
        return self._from(rows.ranked(df.select(F.col("value").alias("v")), [F.col("v")], POS), dtype, 0)

    def unique(self) -> RaggedArray:
        return self._ordered(sets.unique(self.values()), self.dtype)

    def _set(self, other: RaggedArray, op) -> RaggedArray:
        to = promote_types(self.dtype, other.dtype)
        a, b = (x.values().select(F.col("value").cast(to.spark).alias("value")) for x in (self, other))
        return self._ordered(op(a, b), to)

    def setunion(self, other):
        return self._set(other, sets.setunion)

    def setdiff(self, other):
        return self._set(other, sets.setdiff)

    def setxor(self, other):
        return self._set(other, sets.setxor)

    def isin(self, test: RaggedArray) -> RaggedArray:
        """A join of the distinct values; each row then looks its own ones up."""
        to = promote_types(self.dtype, test.dtype)
        clean = sets.unique(test.values().select(F.col("value").cast(to.spark).alias("value")))
        if to.kind == "f":
            clean = clean.where(~F.isnan("value"))
        return self._looked_up(clean.withColumn("r", F.lit(True)), to, F.lit(False), D.bool_)

    def _looked_up(self, table: DataFrame, to: DType, default: Column, result: DType) -> RaggedArray:
        """Each leaf's r in table (value of type to, r), or the default; nulls stay null."""
        same = (lambda x: x.cast(to.spark) + F.lit(0).cast(to.spark)) if to.kind == "f" else (lambda x: x.cast(to.spark))
        leaves = self.col["items"] if self.union else F.array(self.col) if self.depth == 0 else N.flatten_levels(self.col, self.depth - 1)
        base = self._plain()
        own = self.frame.select(POS, F.explode(F.array_distinct(F.transform(leaves, same))).alias("value"))
        found = own.join(table, "value").groupBy(POS).agg(F.map_from_entries(F.collect_list(F.struct("value", "r"))).alias("_m"))
        both = base.join(found, POS, "left")
        f = lambda x: F.when(x.isNotNull(), F.coalesce(F.element_at("_m", same(x)), default))
        v = N.union_map(F.col("v"), f) if self.union else N.map_leaf(F.col("v"), self.depth, f)
        return RaggedArray(both.select(POS, v.alias("v")), "v", result, self.depth, self.union)

    def search_sorted_in(self, edges: DataFrame, right: bool = False) -> RaggedArray:
        """How many of the edges (v) lie before each leaf: both sides are ranked together, so neither travels whole."""
        own = sets.unique(self.values()).select(F.col("value").alias("v"), F.lit(0 if right is False else 1).alias("side"), F.lit(0).alias("n"))
        both = edges.select(F.col("v").cast(self.dtype.spark).alias("v"), F.lit(1 if right is False else 0).alias("side"), F.lit(1).alias("n")).where("v is not null").unionByName(own)
        placed = rows.running(rows.ranked(both, [F.col("v"), F.col("side")], POS), F.col("n"), "r")
        return self._looked_up(placed.where("n = 0").select(F.col("v").alias("value"), "r"), self.dtype, F.lit(0).cast("long"), D.int64)

    # random

    def _paths(self, axis: int, f: Callable[[Column, list[Column]], Column]) -> Column:
        """f(list, its place) for every list at axis (from 1)."""

        def go(x: Column, level: int, keys: list[Column]) -> Column:
            return f(x, keys) if level == 1 else F.transform(x, lambda y, i: go(y, level - 1, [*keys, i]))

        return go(self.col, axis, [F.col(POS)])

    def permutation(self, dim: int = 0, seed: int | None = None, rng: random.Generator | None = None) -> RaggedArray:
        s = random.stream(seed, rng)
        if dim == 0:
            return self._from(random.permutation(self._plain(), s), union=self.union)
        if self.union:
            raise AxisInvalid("unions are permuted along axis 0", f"dim={dim}")
        return self._with(self._paths(self._axis(dim), lambda a, keys: random.shuffled(a, s, keys))) if self._axis(dim) else self.permutation(0, s)

    def shuffle(self, dim: int = 0, seed: int | None = None, rng: random.Generator | None = None) -> None:
        """permutation, in place."""
        done = self.permutation(dim, seed, rng)
        self.frame, self.column, self.token = done.frame, done.column, next(_names)

    def choice(self, size, replace: bool = True, dim: int = 0, seed: int | None = None, rng: random.Generator | None = None):
        """size: a number, a share (float, rounded down) or, below axis 0, a list with one for each row. One row of axis 0 comes without the axis."""
        s = random.stream(seed, rng)
        axis = self._axis(dim)
        if axis == 0:
            if _is_list(size):
                if len(size) != 1:
                    raise ArgumentInvalid("axis 0 takes one size", repr(size))
                size = size[0]
            found = self._from(random.choice(self._plain(), size, s, replace), union=self.union)
            return found[0] if found.frame.limit(2).count() == 1 and (size == 1 or isinstance(size, float)) else found
        if self.union:
            raise AxisInvalid("unions are drawn from along axis 0", f"dim={dim}")
        if not _is_list(size):
            return self._with(self._paths(axis, lambda a, keys: random.drawn(a, size, s, keys, replace)))
        if len(size) != len(self):
            raise ShapeMismatch("one size for each row", f"{len(size)} for {len(self)} rows")
        sizes = self.frame.sparkSession.createDataFrame([(r, int(k)) for r, k in enumerate(size)], f"{POS} long, _k int")
        both = self._from(self._plain().join(sizes, POS).select(POS, F.struct("v", "_k").alias("v")))
        value = RaggedArray(both.frame.withColumn("w", F.col("v")["v"]), "w", self.dtype, self.depth)
        return self._from(value.frame.select(POS, value._paths(axis, lambda a, keys: random.drawn(a, F.col("v")["_k"], s, keys, replace)).alias("v")))

    def like(self, kind: str, seed: int | None = None, rng: random.Generator | None = None, low=0.0, high=1.0, dtype: DType | str | None = None) -> RaggedArray:
        """Random values in this structure; nulls are filled."""
        s = random.stream(seed, rng)
        if self.dtype.kind in "cs":
            raise DTypeUnsupported("random values need a numeric template", str(self.dtype))
        if kind == "normal" and high < 0:
            raise ArgumentInvalid("scale must not be negative", str(high))
        if kind != "normal" and not low < high:
            raise ArgumentInvalid("random values need low < high", f"{low} to {high}")
        to = as_dtype(dtype) if dtype is not None else D.int64 if kind == "integers" else self.dtype if self.dtype in (D.float16, D.float32) else D.float64
        if (to.kind in "iu") != (kind == "integers"):
            raise ArgumentInvalid("the dtype doesn't fit the draw", f"{to} for {kind}")

        def draw(*keys: Column) -> Column:
            if kind == "integers":
                return random.integers(s, low, high, *keys).cast(to.spark)
            if kind == "normal":
                return F.lit(float(low)) + F.lit(float(high)) * random.normal(s, *keys)
            return F.lit(float(low)) + F.lit(float(high) - float(low)) * random.uniform(s, *keys)

        def fill(x: Column, depth: int, keys: list[Column]) -> Column:
            return draw(*keys) if depth == 0 else F.transform(x, lambda y, i: fill(y, depth - 1, [*keys, i]))

        if self.union:
            return self._with(F.struct(self.col["is_list"].alias("is_list"), fill(self.col["items"], 1, [F.col(POS)]).alias("items")), to)
        return self._with(fill(self.col, self.depth, [F.col(POS)]).cast(spark_type(to, self.depth, False)), to)

    def uniform_like(self, low: float = 0.0, high: float = 1.0, seed: int | None = None, rng: random.Generator | None = None) -> RaggedArray:
        return self.like("uniform", seed, rng, low, high)

    def random_like(self, seed: int | None = None, rng: random.Generator | None = None) -> RaggedArray:
        return self.like("uniform", seed, rng)

    def normal_like(self, loc: float = 0.0, scale: float = 1.0, seed: int | None = None, rng: random.Generator | None = None) -> RaggedArray:
        return self.like("normal", seed, rng, loc, scale)

    def integers_like(self, low: int, high: int, dtype: DType | str | None = None, seed: int | None = None, rng: random.Generator | None = None) -> RaggedArray:
        return self.like("integers", seed, rng, low, high, dtype)


_names = itertools.count()


def _empty_prefix(x, depth: int) -> bool:
    """Lists that end early because they are empty fit any depth."""
    if depth == 0:
        return not _is_list(x)
    return _is_list(x) and all(_empty_prefix(y, depth - 1) for y in x)


def _plain_value(x):
    return [_plain_value(y) for y in x] if isinstance(x, list) else int(x) if type(x).__name__ == "Decimal" else x


def _at_level(x: Column, level: int, f: Callable[[Column], Column]) -> Column:
    return f(x) if level == 0 else F.transform(x, lambda y: _at_level(y, level - 1, f))


def _axis0_in_row(x: Column, levels: int, f: Callable[[Column], Column]) -> Column:
    """Reduce the outermost axis of an array of so many list levels."""
    if levels == 1:
        return f(x)
    longest = F.coalesce(F.array_max(F.transform(x, F.size)), F.lit(0))
    steps = F.filter(F.sequence(F.lit(0), F.greatest(longest - 1, F.lit(0))), lambda j: j < longest)

    def at(j: Column) -> Column:
        if levels == 2:
            column = F.transform(x, lambda y: F.get(y, j))
            return F.when(~F.exists(column, lambda v: v.isNull()), f(column))
        return _axis0_in_row(F.filter(F.transform(x, lambda y: F.get(y, j)), lambda y: y.isNotNull()), levels - 1, f)

    return F.transform(steps, at)


def _methods() -> None:
    """The short names of reductions, tests and unary functions as methods."""
    for name in ("sum", "mean", "min", "max", "ptp"):
        setattr(RaggedArray, name, lambda self, dim=None, _n=name: self.reduce(_n, dim))
    for name in ("var", "std"):
        setattr(RaggedArray, name, lambda self, dim=None, ddof=0, _n=name: self.reduce(_n, dim, ddof=ddof))
        setattr(RaggedArray, f"nan{name}", lambda self, dim=None, ddof=0, _n=name: self.reduce(_n, dim, ddof=ddof, skip_nan=True))
    for name in ("sin", "cos", "tan", "exp", "log", "log10", "log2", "sqrt", "abs", "sign", "floor", "ceil", "round", "reciprocal", "angle"):
        setattr(RaggedArray, name, lambda self, _n=name: self.unary(_n))
    for name in ("equal", "not_equal", "less", "less_equal", "greater", "greater_equal"):
        setattr(RaggedArray, name, lambda self, other, _n=name: self.compare(other, _n))
    for name in ("isnan", "isinf", "isfinite"):
        setattr(RaggedArray, name, lambda self, _n=name: self.test(_n))
    for name, greatest in (("argmax", True), ("argmin", False)):
        setattr(RaggedArray, name, lambda self, dim=None, _g=greatest: self.argextreme(_g, dim))
        setattr(RaggedArray, f"nan{name}", lambda self, dim=None, _g=greatest: self.argextreme(_g, dim, True))


_methods()
