"""RaggedFrame: named ragged columns over one set of rows, with named nesting levels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.errors import ColumnMissing, IndexInvalid, SchemaMismatch, ShapeMismatch
from skein.functions import nested as N
from skein.operators import rows
from skein.plans.array import POS, RaggedArray, session
from skein.types import DType


class LevelSchema:
    """Ordered level names, each with aliases; a column belongs to the first level whose name starts it."""

    def __init__(self, levels: Sequence[str | Sequence[str]]):
        self.levels = [tuple([x] if isinstance(x, str) else x) for x in levels]
        names = [n for level in self.levels for n in level]
        if len(set(names)) < len(names):
            raise SchemaMismatch("level names repeat", ", ".join(names))
        self.level_of = {n: k for k, level in enumerate(self.levels) for n in level}

    def column_level(self, column: str) -> int:
        for k, level in enumerate(self.levels):
            if any(column == n or column.startswith(f"{n}_") for n in level):
                return k
        raise SchemaMismatch("a column needs a level", f"{column!r} starts with none of {', '.join(self.level_of)}")


def _present(name: str) -> str:
    return f"_in_{name}"


class RaggedFrame:
    def __init__(self, frame: DataFrame, kinds: dict[str, tuple[DType, int, bool]], schema: LevelSchema | None = None, peeled: int = 0):
        self._frame, self._kinds, self._schema, self._peeled = frame, kinds, schema, peeled

    @classmethod
    def of(cls, mapping: Mapping, schema: Sequence | None = None, spark: SparkSession | None = None) -> RaggedFrame:
        levels = LevelSchema(schema) if schema is not None else None
        frame, kinds, lengths = None, {}, {}
        for name, values in mapping.items():
            a = values if isinstance(values, RaggedArray) else RaggedArray.of(values, spark=spark or session())
            column = a._plain().withColumnRenamed("v", name)
            frame = column if frame is None else frame.join(column, POS, "full")
            kinds[name] = (a.dtype, a.depth, a.union)
            lengths[name] = len(values)
            if levels and not a.union and a.depth < levels.column_level(name):
                raise SchemaMismatch("a column is not deep enough", f"{name!r} has {a.depth + 1} axes")
        if levels and len(set(lengths.values())) > 1:
            raise ShapeMismatch("columns differ along axis 0")
        for name, n in lengths.items():
            if n < max(lengths.values()):  # a shorter column knows which rows it has
                frame = frame.withColumn(_present(name), F.col(POS) < n)
        return cls(frame, kinds, levels)

    @property
    def columns(self) -> list[str]:
        return list(self._kinds)

    def __len__(self) -> int:
        return self._frame.count()

    def column(self, name: str) -> RaggedArray:
        if name not in self._kinds:
            raise ColumnMissing("no such column", name)
        if _present(name) in self._frame.columns:
            own = rows.rerank(self._frame.where(F.col(_present(name))).select(POS, F.col(name)))
            return RaggedArray(own, name, *self._kinds[name])
        return RaggedArray(self._frame.select(POS, F.col(name)), name, *self._kinds[name])

    def _level(self, name: str) -> int:
        return self._schema.column_level(name) if self._schema else 0

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        if name in self._kinds:
            return self.column(name).flatten()
        if self._schema and name in self._schema.level_of:
            return Level(self, self._schema.level_of[name])
        raise ColumnMissing("no such column or level", name)

    def __setattr__(self, name: str, value) -> None:
        if name.startswith("_"):
            object.__setattr__(self, name, value)
        else:
            self[name] = value

    def __getitem__(self, key):
        if isinstance(key, str):
            return self.column(key)
        if isinstance(key, tuple) and key and all(isinstance(k, str) for k in key):
            missing = [k for k in key if k not in self._kinds]
            if missing:
                raise ColumnMissing("no such column", ", ".join(missing))
            partial = [c for c in map(_present, key) if c in self._frame.columns]
            return RaggedFrame(self._frame.select(POS, *key, *partial), {k: self._kinds[k] for k in key}, self._schema, self._peeled)
        if self._schema:
            return self.at_level(self._peeled, key)
        return RaggedFrame(self._rows(key), self._kinds, None)

    def _rows(self, key) -> DataFrame:
        n = len(self)
        if isinstance(key, slice):
            start, stop, step = key.indices(n)
            return rows.slice_rows(self._frame, start, stop, step)
        key = [key] if isinstance(key, int) and not isinstance(key, bool) else list(key)
        if key and all(isinstance(k, bool) for k in key):
            if len(key) != n:
                raise IndexInvalid("mask length", f"{len(key)} for {n} rows")
            key = [i for i, k in enumerate(key) if k]
        bad = [i for i in key if not -n <= i < n]
        if bad:
            raise IndexInvalid("row index", f"{bad[0]} of {n} rows")
        return rows.fancy_rows(self._frame, [i % n for i in key])

    def at_level(self, level: int, key) -> RaggedFrame:
        """Select at one schema level; an int goes one level down."""
        if isinstance(key, tuple) or key is Ellipsis or isinstance(key, slice) and key == slice(None) or isinstance(key, (list, tuple)) and (not key or any(isinstance(k, (list, tuple)) for k in key)):
            raise IndexInvalid("one selector for one level", repr(key), "pass an int, slice, list of ints or mask")
        if level < self._peeled:
            raise IndexInvalid("that level is already selected")
        if level > self._peeled:
            return self._inner(level, key)
        if not isinstance(key, int) or isinstance(key, bool):
            return RaggedFrame(self._rows(key), self._kinds, self._schema, self._peeled)
        one = rows.fancy_rows(self._frame, [key % max(1, len(self))]) if -len(self) <= key < len(self) else None
        if one is None:
            raise IndexInvalid("row index", f"{key} of {len(self)} rows")
        # columns below this level open up into its rows, the others stay as scalars of every row
        deep = [c for c in self._kinds if not self._kinds[c][2] and self._level(c) > level]
        if not deep:
            return RaggedFrame(one, self._kinds, self._schema, level)
        shallow = [c for c in self._kinds if c not in deep]
        zipped = one.select(*shallow, F.posexplode(F.arrays_zip(*deep)).alias("_i", "_x"))
        out = zipped.select(F.col("_i").cast("long").alias(POS), *shallow, *[F.col("_x")[c].alias(c) for c in deep]).select(POS, *self._kinds)
        kinds = {c: (t, d - (c in deep), u) for c, (t, d, u) in self._kinds.items()}
        return RaggedFrame(out, kinds, self._schema, level + 1)

    def _inner(self, level: int, key) -> RaggedFrame:
        """The same selection in the lists of every row, for columns of that level and below."""
        down = level - self._peeled
        index = key if isinstance(key, slice) else [key] if isinstance(key, int) else [i for i, k in enumerate(key) if k] if all(isinstance(k, bool) for k in key) else list(key)

        def pick(x):
            if isinstance(index, slice):
                return N.slice_(x, index.start, index.stop, index.step or 1)
            return N.take(x, F.array(*[F.lit(i) for i in index]))

        def at(x, k):
            return pick(x) if k == 1 else F.transform(x, lambda y: at(y, k - 1))

        out = self._frame.select(POS, *[at(F.col(c), down).alias(c) if not u and self._level(c) >= level and d >= down else F.col(c) for c, (t, d, u) in self._kinds.items()])
        return RaggedFrame(out, self._kinds, self._schema, self._peeled)

    def __setitem__(self, name: str, value) -> None:
        a = value if isinstance(value, RaggedArray) else RaggedArray.of(value)
        if self._schema and not a.union:
            level = self._schema.column_level(name)
            if a.depth < level - self._peeled:
                raise SchemaMismatch("a column is not deep enough", f"{name!r} has {a.depth + 1} axes")
        new = a._plain().withColumnRenamed("v", "_new")
        both = self._frame.drop(name).join(new, POS, "inner" if self._schema else "full")
        if self._schema and a._plain().count() != len(self):
            raise ShapeMismatch("columns differ along axis 0", name)
        checked = F.col("_new")
        if self._schema and not a.union:
            for other, (_, d, u) in self._kinds.items():
                if other != name and not u and d >= 1 and a.depth >= 1 and self._level(other) >= 1 and self._schema.column_level(name) >= 1:
                    same = F.size("_new") == F.size(other)
                    checked = F.when(same, F.col("_new")).otherwise(F.raise_error(F.lit(f"ShapeMismatch: {name} and {other} differ along axis 1")))
                    break
        self._frame = both.withColumn(name, checked).drop("_new")
        self._kinds = {**self._kinds, name: (a.dtype, a.depth, a.union)}

    def to_dict(self) -> dict[str, list]:
        return {c: self.column(c).to_list() for c in self._kinds}

    def max(self) -> dict:
        """The greatest leaf of each numeric column, in one pass; nan wins."""
        numeric = {c: k for c, k in self._kinds.items() if k[0].numeric}

        def greatest(c: str, depth: int, union: bool, floating: bool):
            if union:
                return N.maximum(F.col(c)["items"], floating)
            return N.maximum(N.flatten_levels(F.col(c), depth - 1), floating) if depth else F.col(c)

        if not numeric:
            return {}
        found = self._frame.agg(*[F.max(greatest(c, d, u, t.kind == "f")).alias(c) for c, (t, d, u) in numeric.items()]).first()
        return {c: found[c] for c in numeric}

    def shape(self, dim: int | str = 0):
        """Entities along a level, relative to the levels already selected."""
        axis = self._schema.level_of[dim] - self._peeled if isinstance(dim, str) else dim
        if axis < 0:
            raise IndexInvalid("that level is already selected", str(dim))
        if axis == 0:
            return len(self)
        for c, (_, d, u) in self._kinds.items():
            if not u and d >= axis and (not self._schema or self._level(c) - self._peeled >= axis):
                return self.column(c).shape(axis)
        raise ShapeMismatch("no column is that deep", str(dim))


class Level:
    """An accessor: attributes are columns with so many outer axes peeled off, [..] selects there."""

    def __init__(self, frame: RaggedFrame, level: int):
        object.__setattr__(self, "_of", frame)
        object.__setattr__(self, "_at", level)

    def __getitem__(self, key) -> RaggedFrame:
        return self._of.at_level(self._at, key)

    def __getattr__(self, name: str):
        frame: RaggedFrame = self._of
        if frame._schema and name in frame._schema.level_of:
            return Level(frame, frame._schema.level_of[name])
        a = frame.column(name)
        for _ in range(self._at - frame._peeled):
            a = a.flatten(dim=0) if a.depth or a.union else a
        return a

    def __setattr__(self, name: str, value) -> None:
        """Takes the column nested from axis 0 or flat at this level; flat values are nested again."""
        frame: RaggedFrame = self._of
        a = value if isinstance(value, RaggedArray) else RaggedArray.of(value)
        down = self._at - frame._peeled
        if down and not a.union and a.depth < frame._schema.column_level(name) - frame._peeled or down and len(a) != len(frame):
            shape = next((frame.column(c) for c, (_, d, u) in frame._kinds.items() if not u and d >= down), None)
            if shape is None:
                raise ShapeMismatch("no column gives the shape", name)
            sizes = [shape.shape(k) for k in range(1, down + 1)]
            for size in reversed(sizes):
                a = a.unflatten(list(_flat(size.to_list())), 0)
        frame[name] = a


def _flat(x):
    for y in x:
        if isinstance(y, list):
            yield from _flat(y)
        else:
            yield y
