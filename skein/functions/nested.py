"""Columns over nested arrays: one row holds an axis-0 element, its inner axes are arrays.

depth is the number of list levels inside the row. Everything here stays in the row, so
none of it shuffles; whole plans over long lists are in ``skein.operators.flat``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions import guards

NAN = float("nan")


def map_leaf(x: Column, depth: int, f: Callable[[Column], Column]) -> Column:
    return f(x) if depth == 0 else F.transform(x, lambda y: map_leaf(y, depth - 1, f))


def map_innermost(x: Column, depth: int, f: Callable[[Column], Column]) -> Column:
    """f on every innermost list."""
    return f(x) if depth <= 1 else F.transform(x, lambda y: map_innermost(y, depth - 1, f))


def zip_leaf(a: Column, b: Column, da: int, db: int, f: Callable[[Column, Column], Column]) -> Column:
    """f on aligned leaves; a list of one element meets every element of the other list."""
    if da == 0 and db == 0:
        return f(a, b)
    if da == 0:
        return map_leaf(b, db, lambda y: f(a, y))
    if db == 0:
        return map_leaf(a, da, lambda x: f(x, b))
    bad = F.raise_error(F.concat(F.lit("BroadcastFailed: lists of "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string")))
    same = F.zip_with(a, b, lambda x, y: zip_leaf(x, y, da - 1, db - 1, f))
    one_a = F.transform(b, lambda y: zip_leaf(F.get(a, F.lit(0)), y, da - 1, db - 1, f))
    one_b = F.transform(a, lambda x: zip_leaf(x, F.get(b, F.lit(0)), da - 1, db - 1, f))
    return F.when(F.size(a) == F.size(b), same).when(F.size(a) == 1, one_a).when(F.size(b) == 1, one_b).otherwise(bad)


def present(a: Column) -> Column:
    return F.filter(a, lambda x: x.isNotNull())


def without_nan(a: Column) -> Column:
    return F.filter(a, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")))


def total(a: Column, kind: str) -> Column:
    """Sum of the values that aren't null as kind; null if there are none."""
    return F.aggregate(a, F.lit(None).cast(kind), lambda s, x: F.when(x.isNull(), s).otherwise(F.coalesce(s, F.lit(0).cast(kind)) + x.cast(kind)))


def mean(a: Column) -> Column:
    n = F.size(present(a))
    return F.when(n > 0, total(a, "double") / n.cast("double"))


def _any_nan(a: Column) -> Column:
    return F.exists(present(a), lambda x: F.isnan(x.cast("double")))


def minimum(a: Column, floating: bool) -> Column:
    return F.when(_any_nan(a), NAN).otherwise(F.array_min(a)) if floating else F.array_min(a)


def maximum(a: Column, floating: bool) -> Column:
    return F.array_max(a)  # nan is the greatest


def ptp(a: Column, floating: bool) -> Column:
    return maximum(a, floating) - minimum(a, floating)


def variance(a: Column, ddof: int = 0, skip_nan: bool = False) -> Column:
    """In two passes; null unless there are more values than ddof."""
    a = without_nan(a) if skip_nan else present(a)
    n = F.size(a)
    m = total(a, "double") / n.cast("double")
    squares = F.aggregate(a, F.lit(0.0), lambda s, x: s + (x.cast("double") - m) * (x.cast("double") - m))
    return F.when(n > ddof, squares / (n - ddof).cast("double"))


def quantile(a: Column, q: float, skip_nan: bool = False) -> Column:
    """Linear between order statistics; nan is the greatest; null of no values."""
    s = F.array_sort(without_nan(a) if skip_nan else present(a))
    at = (F.size(s) - 1).cast("double") * F.lit(float(q))
    low = F.floor(at).cast("int")
    x, y = F.get(s, low).cast("double"), F.get(s, F.least(low + 1, F.size(s) - 1)).cast("double")
    part = at - low
    return F.when(F.size(s) > 0, F.when(part == 0, x).otherwise(x + (y - x) * part))


def no_nulls(a: Column, what: str) -> Column:
    return F.when(F.exists(a, lambda x: x.isNull()), F.raise_error(F.lit(f"{what}: nulls can't be ordered"))).otherwise(a)


def sort(a: Column) -> Column:
    return F.array_sort(no_nulls(a, "sort"))


def argsort(a: Column) -> Column:
    pairs = F.transform(no_nulls(a, "argsort"), lambda x, i: F.struct(x.alias("v"), i.cast("long").alias("i")))
    return F.array_sort(pairs).getField("i")


def argmax(a: Column, skip_nan: bool = False) -> Column:
    """First position, from 0, of the greatest value (nan if there is one); null of no values."""
    seen = F.transform(a, lambda x: F.when(F.isnan(x.cast("double")), None).otherwise(x)) if skip_nan else a
    return F.array_position(seen, F.array_max(seen)) - 1


def argmin(a: Column, skip_nan: bool = False, nan_first: bool = False) -> Column:
    """As argmax; nan_first takes nan for the least, else it is the greatest."""
    seen = F.transform(a, lambda x: F.when(F.isnan(x.cast("double")), None).otherwise(x)) if skip_nan else a
    least = F.when(_any_nan(a), NAN).otherwise(F.array_min(seen)) if nan_first and not skip_nan else F.array_min(seen)
    return F.array_position(seen, least) - 1


def partition(a: Column, kth: int) -> Column:
    """Sorted, which is one of the orders that a partition allows."""
    ok = F.size(a) > kth
    return F.when(ok, sort(a)).otherwise(F.raise_error(F.lit(f"ArgumentInvalid: kth={kth} is not below the length of every list")))


def argpartition(a: Column, kth: int) -> Column:
    ok = F.size(a) > kth
    return F.when(ok, argsort(a)).otherwise(F.raise_error(F.lit(f"ArgumentInvalid: kth={kth} is not below the length of every list")))


def search_sorted(edges: Column, v: Column, right: bool = False) -> Column:
    """How many of the sorted edges lie before v."""
    return F.size(F.filter(edges, lambda e: (e <= v) if right else (e < v))).cast("long")


def digitize(x: Column, bins: Column, right: bool = False, numpy_edges: bool = False) -> Column:
    """The bin of x. right=False puts a value on an edge below it, as array libraries for ragged data do;
    numpy_edges=True swaps the two sides. nan is past the last bin."""
    after = right != numpy_edges
    return F.when(x.isNull(), None).when(F.isnan(x), F.size(bins)).otherwise(F.size(F.filter(bins, lambda b: (b <= x) if after else (b < x)))).cast("long")


def nonzero(a: Column) -> Column:
    at = F.transform(a, lambda x, i: F.when(x.cast("boolean"), i.cast("long")))
    return F.filter(at, lambda i: i.isNotNull())


def where(cond: Column, x: Column, y: Column) -> Column:
    return F.when(cond.isNull(), None).when(cond, x).otherwise(y)


def isin(x: Column, test: Column, floating: bool = True) -> Column:
    """nan is in nothing, a null stays null, -0.0 is 0.0."""
    found = F.array_contains(test, x + 0.0 if floating else x)
    found = F.coalesce(found, F.lit(False))
    return F.when(x.isNull(), None).otherwise((found & ~F.isnan(x)) if floating else found)


def distinct_sorted(a: Column, floating: bool) -> Column:
    clean = F.transform(present(a), lambda x: x + 0.0) if floating else present(a)
    return F.array_sort(F.array_distinct(clean))


def take(a: Column, index: Column) -> Column:
    """Elements at positions from 0, negative ones from the end; outside raises."""
    n = F.size(a)

    def one(i: Column) -> Column:
        at = F.when(i < 0, i + n).otherwise(i)
        return F.when((at < 0) | (at >= n), F.raise_error(F.concat(F.lit("IndexOutOfBounds: "), i.cast("string"), F.lit(" in a list of "), n.cast("string")))).otherwise(F.get(a, at.cast("int")))

    return F.transform(index, one)


def position(i: Column, n: Column) -> Column:
    """A place from 0 of an index that may count from the end; null if it is outside."""
    at = F.when(i < 0, i + n).otherwise(i)
    return F.when((at >= 0) & (at < n), at.cast("long"))


def upto(n: Column) -> Column:
    """0 to n - 1."""
    return F.filter(F.sequence(F.lit(0).cast("long"), F.greatest(n.cast("long") - 1, F.lit(0).cast("long"))), lambda i: i < n)


def slice_positions(n: Column, start: Column, stop: Column, step: Column) -> Column:
    """The places of start:stop:step in a list of n; nulls are ends left open."""
    t = F.coalesce(step, F.lit(1))
    back = t < 0
    least, most = F.when(back, -1).otherwise(0), F.when(back, n - 1).otherwise(n)
    bound = lambda x, open_: F.when(x.isNull(), open_).when(x < 0, F.greatest(x + n, least)).otherwise(F.least(x, most)).cast("long")
    a, b = bound(start, F.when(back, n - 1).otherwise(0)), bound(stop, F.when(back, -1).otherwise(n))
    count = F.greatest(F.ceil((b - a) / t), F.lit(0)).cast("long")
    return F.when(t == 0, F.raise_error(F.lit("IndexInvalid: a slice needs a step")).cast("array<bigint>")).otherwise(F.transform(upto(count), lambda i: a + i * t))


def written(a: Column, writes: Column) -> Column:
    """a with the writes {i, x}, places from 0; a null place raises, the last write to a place wins."""

    def one(x: Column, k: Column) -> Column:
        mine = F.filter(writes, lambda w: w["i"] == k)
        return F.when(F.size(mine) > 0, F.element_at(mine, -1)["x"]).otherwise(x)

    outside = F.exists(writes, lambda w: w["i"].isNull())
    return F.when(outside, F.raise_error(F.lit("IndexOutOfBounds: a written element is outside its list"))).when(writes.isNull() | (F.size(writes) == 0), a).otherwise(F.transform(a, one))


def element(a: Column, i: int) -> Column:
    """One element; outside raises."""
    return F.get(take(a, F.array(F.lit(i))), F.lit(0))


def put(a: Column, at: int | Column, value) -> Column:
    value = value if isinstance(value, Column) else F.lit(value)
    return F.transform(a, lambda x, i: F.when(i == at, value).otherwise(x))


def slice_(a: Column, start: int | None, stop: int | None, step: int = 1) -> Column:
    """a[start:stop:step] with Python's rules."""
    n = F.size(a)

    def bound(x, default):
        if x is None:
            return default
        return F.greatest(F.lit(-1 if step < 0 else 0), F.lit(x) + n) if x < 0 else F.least(F.lit(x), n - (1 if step < 0 else 0))

    lo, hi = (bound(start, F.lit(0)), bound(stop, n)) if step > 0 else (bound(start, n - 1), bound(stop, F.lit(-1)))
    count = F.when(hi > lo, F.floor((hi - lo - 1) / step) + 1).otherwise(0) if step > 0 else F.when(lo > hi, F.floor((lo - hi - 1) / -step) + 1).otherwise(0)
    index = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count.cast("int") - 1, F.lit(0))), lambda k: lo + k * step)).otherwise(F.array().cast("array<int>"))
    return F.transform(index, lambda i: F.get(a, i.cast("int")))


def unflatten(a: Column, sizes: Column) -> Column:
    """Consecutive runs of the given sizes, which must add up to the length."""
    ends = F.transform(sizes, lambda s, i: F.aggregate(F.slice(sizes, F.lit(1), i + 1), F.lit(0), lambda t, x: t + x.cast("int")))
    runs = F.zip_with(ends, sizes, lambda e, s: F.slice(a, e - s.cast("int") + 1, s.cast("int")))
    fits = F.aggregate(sizes, F.lit(0), lambda t, x: t + x.cast("int")) == F.size(a)
    return F.when(fits, runs).otherwise(F.raise_error(F.lit("ShapeMismatch: sizes must add up to the length of the list")))


def flatten_levels(x: Column, levels: int) -> Column:
    for _ in range(levels):
        x = F.flatten(x)
    return x


def count_present(a: Column) -> Column:
    return F.size(present(a)).cast("long")


def dot(a: Column, b: Column) -> Column:
    same = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), same).otherwise(F.raise_error(F.lit("ShapeMismatch: vectors of different lengths")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: Column, b: Column) -> Column:
    x, y = (lambda i: F.get(a, F.lit(i))), (lambda i: F.get(b, F.lit(i)))
    turn = lambda i, j: x(i) * y(j) - x(j) * y(i)
    return F.when((F.size(a) == 3) & (F.size(b) == 3), F.array(turn(1, 2), turn(2, 0), turn(0, 1))).otherwise(F.raise_error(F.lit("ShapeMismatch: cross takes vectors of 3")))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def pairwise_distances(points: Column) -> Column:
    return F.transform(points, lambda p: F.transform(points, lambda q: F.sqrt(squared_distance(p, q))))


def full_like(x: Column, depth: int, value: Column) -> Column:
    return map_leaf(x, depth, lambda _: value)


# A union element is struct<is_list: boolean, items: array<T>>: a scalar is a list of one.


def union_scalar(x: Column) -> Column:
    return F.struct(F.lit(False).alias("is_list"), F.array(x).alias("items"))


def union_list(x: Column) -> Column:
    return F.struct(F.lit(True).alias("is_list"), x.alias("items"))


def union_map(u: Column, f: Callable[[Column], Column]) -> Column:
    return F.struct(u["is_list"].alias("is_list"), F.transform(u["items"], f).alias("items"))


def union_zip(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    """Elements of equal structure keep it; after broadcasting a single value is a scalar."""
    items = zip_leaf(a["items"], b["items"], 1, 1, f)
    same = (a["is_list"] == b["is_list"]) & (F.size(a["items"]) == F.size(b["items"]))
    return F.struct(F.when(same, a["is_list"]).otherwise(F.size(items) != 1).alias("is_list"), items.alias("items"))


def union_fold(u: Column, f: Callable[[Column], Column]) -> Column:
    """f over each element's values; an element without values raises."""
    found = f(u["items"])
    return F.when(F.size(present(u["items"])) == 0, F.raise_error(F.lit("ReduceEmpty: an element has no values"))).otherwise(found)
