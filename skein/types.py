"""Data types, casting rules and promotion.

Spark has no unsigned integers and no 16-bit floats: they live in the next wider type
(uint64 in decimal(20,0)) and keep their range by checks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from skein.errors import ArgumentInvalid, DTypeInferenceFailed


@dataclass(frozen=True)
class DType:
    name: str
    kind: str  # b, i, u, f, c (one character) or s
    size: int

    def __repr__(self) -> str:
        return self.name

    @property
    def numeric(self) -> bool:
        return self.kind in "iuf"

    @property
    def low(self) -> int:
        return -(1 << (8 * self.size - 1)) if self.kind == "i" else 0

    @property
    def high(self) -> int:
        return (1 << (8 * self.size - (self.kind == "i"))) - 1

    @property
    def spark(self) -> T.DataType:
        return _SPARK[self.name]


bool_ = DType("bool", "b", 1)
int8, int16, int32, int64 = (DType(f"int{8 * n}", "i", n) for n in (1, 2, 4, 8))
uint8, uint16, uint32, uint64 = (DType(f"uint{8 * n}", "u", n) for n in (1, 2, 4, 8))
float16, float32, float64 = (DType(f"float{8 * n}", "f", n) for n in (2, 4, 8))
char, string = DType("char", "c", 4), DType("string", "s", 0)
ALL = (bool_, int8, int16, int32, int64, uint8, uint16, uint32, uint64, float16, float32, float64, char, string)
BY_NAME = {t.name: t for t in ALL}

_SPARK = {
    "bool": T.BooleanType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "float16": T.FloatType(), "float32": T.FloatType(), "float64": T.DoubleType(), "char": T.StringType(), "string": T.StringType(),
}

MODES = ("safe", "same_kind", "unsafe", "promote")


def as_dtype(x: DType | str) -> DType:
    if isinstance(x, DType):
        return x
    try:
        return BY_NAME[x]
    except KeyError:
        raise ArgumentInvalid("unknown dtype", f"{x!r} is not one of {', '.join(BY_NAME)}") from None


def _float_for(bits: int) -> int:
    """The least float size that holds integers of so many bits."""
    return 2 if bits <= 11 else 4 if bits <= 24 else 8


def _safe(a: DType, b: DType) -> bool:
    if a == b or a.kind == "b" and b.kind in "biuf":
        return True
    if a.kind in "iu" and b.kind in "iu":
        return b.low <= a.low and a.high <= b.high
    if a.kind in "iu" and b.kind == "f":
        return b.size >= (8 if a.size >= 4 else 2 * a.size)
    if a.kind == b.kind == "f":
        return a.size <= b.size
    return a.kind == "c" and b.kind == "s"


def can_cast(a: DType | str, b: DType | str, casting: str = "safe") -> bool:
    a, b = as_dtype(a), as_dtype(b)
    if casting not in MODES:
        raise ArgumentInvalid("unknown casting mode", f"{casting!r} is not one of {', '.join(MODES)}")
    if _safe(a, b):
        return True
    if "s" in (a.kind, b.kind) or "c" in (a.kind, b.kind):
        return a.kind == "s" and b.kind == "c" and casting in ("same_kind", "unsafe")
    if casting == "unsafe":
        return True
    if casting == "same_kind":  # bool < unsigned < signed < float
        return "buif".index(a.kind) <= "buif".index(b.kind) and b.kind != "b"
    return False


def promote_types(a: DType | str, b: DType | str) -> DType:
    """The least type both cast to safely."""
    a, b = as_dtype(a), as_dtype(b)
    if a == b:
        return a
    if a.kind in "cs" and b.kind in "cs":
        return string
    if a.kind in "cs" or b.kind in "cs":
        raise ArgumentInvalid("no common dtype", f"{a} and {b} have none")
    for t in (bool_, uint8, int8, uint16, int16, uint32, int32, uint64, int64, float16, float32, float64):
        if _safe(a, t) and _safe(b, t):
            return t
    return float64


def infer(leaves) -> DType:
    """From Python values; nulls say nothing."""
    seen = set()
    for x in leaves:
        if x is None:
            continue
        seen.add(bool_ if isinstance(x, bool) else int64 if isinstance(x, int) else float64 if isinstance(x, float) else (char if len(x) == 1 else string) if isinstance(x, str) else type(x))
    if not seen:
        raise DTypeInferenceFailed("no dtype", "all leaves are null", "pass dtype=")
    strange = [x for x in seen if not isinstance(x, DType)]
    if strange:
        raise DTypeInferenceFailed("unsupported value", f"{strange[0].__name__} has no dtype")
    text = {x for x in seen if x.kind in "cs"}
    if text and (len(seen) > 1):
        raise DTypeInferenceFailed("mixed values", "characters, strings and numbers don't mix", "pass dtype=")
    return text.pop() if text else float64 if float64 in seen else int64 if int64 in seen else bool_
