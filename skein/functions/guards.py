"""Scalar recipes that don't depend on ANSI mode and follow IEEE and NumPy rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.types import DType

NAN, INF = float("nan"), float("inf")


def negative_zero(x: Column) -> Column:
    return F.when(x == 0, x.cast("double").cast("string").startswith("-")).otherwise(False)


def divide(a: Column, b: Column) -> Column:
    """a / b as doubles; by zero: nan or a signed infinity."""
    a, b = a.cast("double"), b.cast("double")
    up = (a > 0) != negative_zero(b)
    zero = F.when((a == 0) | F.isnan(a), NAN).when(up, INF).otherwise(-INF)
    return F.when(a.isNull() | b.isNull(), None).when(b == 0, zero).otherwise(a / F.when(b == 0, 1.0).otherwise(b))


def floored_mod(a: Column, b: Column, integral: bool) -> Column:
    """The sign follows b. Integers: zero raises; floats: nan."""
    if integral:
        b = F.when(b == 0, F.raise_error(F.lit("Modulo by zero")).cast("long")).otherwise(b)
        rest = a % b
        return F.when((rest != 0) & ((rest < 0) != (b < 0)), rest + b).otherwise(rest)
    a, b = a.cast("double"), b.cast("double")
    rest = a % F.when(b == 0, 1.0).otherwise(b)
    signed = F.when(rest == 0, F.when(b < 0, -0.0).otherwise(0.0)).when((rest < 0) != (b < 0), rest + b).otherwise(rest)
    return F.when(a.isNull() | b.isNull(), None).when((b == 0) | F.isnan(a) | F.isnan(b), NAN).otherwise(signed)


def wrap(x: Column, dtype: DType) -> Column:
    """An exact integer (long or decimal) brought into the range of dtype, modulo its size."""
    bits = 8 * dtype.size
    wide = x.cast("decimal(38,0)") if dtype.size == 8 else x.cast("long")
    kind = "decimal(38,0)" if dtype.size == 8 else "long"
    half, full = F.lit(str(-dtype.low)).cast(kind), F.lit(str(1 << bits)).cast(kind)
    return (F.pmod(wide + half, full) - half).cast(dtype.spark)


def wrapped(op, a: Column, b: Column, dtype: DType) -> Column:
    """op (+, -, *) of two integers of dtype, wrapped."""
    kind = "decimal(38,0)" if dtype.size >= 4 else "long"
    return wrap(op(a.cast(kind), b.cast(kind)), dtype)


def log(x: Column, base: float | None = None) -> Column:
    x = x.cast("double")
    fine = F.when(x > 0, x).otherwise(1.0)
    value = F.ln(fine) if base is None else F.log10(fine) if base == 10 else F.log2(fine)
    return F.when(x.isNull(), None).when(F.isnan(x) | (x < 0), NAN).when(x == 0, -INF).otherwise(value)


def reciprocal(x: Column, integral: bool) -> Column:
    if integral:
        return F.when(x.isNull(), None).when(F.abs(x) == 1, x).otherwise(F.lit(0)).cast("long")
    return divide(F.lit(1.0), x)


def angle(x: Column) -> Column:
    x = x.cast("double")
    return F.when(x.isNull(), None).when(F.isnan(x), NAN).when(x < 0, F.pi()).otherwise(0.0)


def _has_nan(a: Column, b: Column) -> Column:
    return F.isnan(a.cast("double")) | F.isnan(b.cast("double"))


def compare(name: str, a: Column, b: Column, floating: bool = True) -> Column:
    """IEEE comparison: nan equals nothing; null if either side is null."""
    plain = {"equal": lambda: a == b, "not_equal": lambda: a != b, "less": lambda: a < b, "less_equal": lambda: a <= b, "greater": lambda: a > b, "greater_equal": lambda: a >= b}[name]()
    if not floating:
        return plain
    return F.when(a.isNull() | b.isNull(), None).when(_has_nan(a, b), name == "not_equal").otherwise(plain)


def strict(op, a: Column, b: Column) -> Column:
    """A logical operator that is null if either side is."""
    return F.when(a.isNull() | b.isNull(), None).otherwise(op(a, b))


def logical_xor(a: Column, b: Column) -> Column:
    return strict(lambda x, y: x != y, a, b)


def isfinite(x: Column) -> Column:
    return F.when(x.isNull(), None).otherwise(~F.isnan(x) & (F.abs(x) < INF))


def isinf(x: Column) -> Column:
    return F.when(x.isNull(), None).otherwise(~F.isnan(x) & (F.abs(x) == INF))


def isnan(x: Column) -> Column:
    return F.when(x.isNull(), None).otherwise(F.isnan(x))


UNARY_FLOAT = {
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "exp": F.exp, "log": log, "log10": lambda x: log(x, 10), "log2": lambda x: log(x, 2),
    "sqrt": lambda x: F.sqrt(x.cast("double")), "angle": angle,
}


def unary(name: str, x: Column, dtype: DType) -> Column:
    """A unary function on a leaf of dtype."""
    integral = dtype.kind in "iu"
    if name in UNARY_FLOAT:
        found = UNARY_FLOAT[name](x.cast("double"))
        return found if integral else found.cast(dtype.spark)
    if name == "abs":
        return wrap(F.abs(x.cast("decimal(38,0)")), dtype) if integral else F.abs(x)
    if name == "sign":
        return F.signum(x.cast("double")).cast(dtype.spark)
    if name == "reciprocal":
        return reciprocal(x, integral).cast(dtype.spark)
    if integral:  # floor, ceil and round
        return x
    if name == "round":  # half away from zero; a decimal scale would overflow on large values
        whole = F.when(x.cast("double") < 0, -1.0).otherwise(1.0) * _floor(F.abs(x.cast("double")) + 0.5)
        return F.when(F.isnan(x) | (F.abs(x) >= 2.0**52), x).otherwise(whole).cast(dtype.spark)
    value = _floor(x.cast("double")) if name == "floor" else -_floor(-x.cast("double"))
    return value.cast(dtype.spark)


def _floor(x: Column) -> Column:
    """floor of a double as a double, also beyond the range of long."""
    large = F.isnan(x) | (F.abs(x) >= 2.0**52)
    return F.when(x.isNull(), None).when(large, x).otherwise(F.floor(F.when(large, 0.0).otherwise(x)).cast("double"))
