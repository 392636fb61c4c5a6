"""Random values from hashes of (seed, position): the same for any partitioning and rerun."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.errors import ArgumentInvalid
from skein.operators.rows import scattered


class Generator:
    """A seed and a counter: each draw has numbers of its own. Methods draw for an array, as its own methods do."""

    def __init__(self, seed: int = 0):
        self.seed, self.draws = int(seed), 0

    def next(self) -> int:
        self.draws += 1
        return (self.seed * 1_000_003 + self.draws) & 0x7FFFFFFFFFFFFFFF

    def choice(self, x, size, replace: bool = True, dim: int = 0):
        return x.choice(size, replace, dim, rng=self)

    def permutation(self, x, dim: int = 0):
        return x.permutation(dim, rng=self)

    def shuffle(self, x, dim: int = 0) -> None:
        x.shuffle(dim, rng=self)

    def uniform_like(self, x, low: float = 0.0, high: float = 1.0):
        return x.uniform_like(low, high, rng=self)

    def random_like(self, x):
        return x.random_like(rng=self)

    def normal_like(self, x, loc: float = 0.0, scale: float = 1.0):
        return x.normal_like(loc, scale, rng=self)

    def integers_like(self, x, low: int, high: int, dtype=None):
        return x.integers_like(low, high, dtype, rng=self)

    def integers(self, low: int, high: int, size: int, dtype=None):
        """size whole numbers from low to below high; they are made where they are used."""
        from skein.plans.array import POS, RaggedArray, session
        from skein.types import as_dtype, int64

        to = as_dtype(dtype) if dtype is not None else int64
        if to.kind not in "iu":
            raise ArgumentInvalid("integers needs an integer dtype", str(to))
        drawn = integers(self.next(), low, high, "id").cast(to.spark)
        return RaggedArray(session().range(size).select(F.col("id").alias(POS), drawn.alias("v")), "v", to, 0)


def rng(seed: int = 0) -> Generator:
    return Generator(seed)


def stream(seed: int | None, generator: Generator | None) -> int:
    """A seed gives what the first draw of a generator with it gives."""
    if generator is None:
        if seed is None:
            raise ArgumentInvalid("random functions need a seed", fix="pass seed= or rng=")
        generator = Generator(seed)
    return generator.next()


def shuffled(a: Column, seed: int, keys: Sequence[Column]) -> Column:
    """The elements of a list in the order of their hashes."""
    placed = F.transform(a, lambda x, i: F.struct(F.xxhash64(F.lit(seed), *keys, i).alias("h"), i.alias("i"), x.alias("x")))
    ordered = F.array_sort(F.transform(placed, lambda p: F.struct(p["h"].alias("h"), p["i"].alias("i"))))
    return F.transform(ordered, lambda p: F.get(a, p["i"]))


def drawn(a: Column, size: int | float | Column, seed: int, keys: Sequence[Column], replace: bool) -> Column:
    """size elements of a list (a float: that share, rounded down)."""
    n = F.size(a)
    k = F.floor(n * F.lit(size)).cast("int") if isinstance(size, float) else F.lit(size) if isinstance(size, int) else size
    if not replace:
        return F.when(k <= n, F.slice(shuffled(a, seed, keys), F.lit(1), k)).otherwise(F.raise_error(F.concat(F.lit("ArgumentInvalid: too many draws without replacement: "), k.cast("string"), F.lit(" of "), n.cast("string"))))
    places = F.filter(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))), lambda j: j < k)
    picked = F.transform(places, lambda j: F.get(a, F.floor(uniform(seed, *keys, j) * n).cast("int")))
    return F.when((n > 0) | (k == 0), picked).otherwise(F.raise_error(F.lit("ArgumentInvalid: choice from nothing")))


def uniform(seed: int, *keys: Column | str) -> Column:
    """A double in [0, 1) for each key, with 53 random bits."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11)
    return bits.cast("double") * F.lit(2.0**-53)


def normal(seed: int, *keys: Column | str) -> Column:
    u, v = uniform(seed, F.lit(0), *keys), uniform(seed, F.lit(1), *keys)
    return F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - u)) * F.cos(F.lit(2 * math.pi) * v)


def integers(seed: int, low: int, high: int, *keys: Column | str) -> Column:
    if not low < high:
        raise ArgumentInvalid("integers needs low < high", f"{low} to {high}")
    return (F.floor(uniform(seed, *keys) * F.lit(float(high - low))) + F.lit(low)).cast("long")


def permutation(df: DataFrame, seed: int, pos: str = "_pos") -> DataFrame:
    """Rows in a random order, positions from 0."""
    return scattered(df.withColumnRenamed(pos, "_old"), F.xxhash64(F.lit(seed), F.col("_old")), [F.col("_old")], pos).drop("_old")


def choice(df: DataFrame, size: int | float, seed: int, replace: bool = True, pos: str = "_pos") -> DataFrame:
    """size rows (a float: that share of them), drawn with or without repeats."""
    n = df.count()
    k = int(math.floor(size * n)) if isinstance(size, float) else int(size)
    if not replace:
        if k > n:
            raise ArgumentInvalid("too many draws", f"{k} of {n} rows without replacement")
        return permutation(df, seed, pos).where(F.col(pos) < k)
    if not n:
        raise ArgumentInvalid("choice from nothing", "there are no rows")
    drawn = df.sparkSession.range(k).select(F.col("id").alias("_k"), integers(seed, 0, n, "id").alias(pos))
    return df.join(drawn, pos).drop(pos).withColumnRenamed("_k", pos)
