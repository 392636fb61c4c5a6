"""Parquet stores of arrays and frames.

Rows are written in ranges of the position, so a slice of positions prunes files and row groups;
types and levels are kept as metadata of the columns.
"""

from __future__ import annotations

import weakref
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.errors import ArgumentInvalid, AxisInvalid, IoFailed
from skein.functions import nested as N
from skein.plans.array import POS, RaggedArray, session
from skein.plans.frame import LevelSchema, RaggedFrame
from skein.types import BY_NAME

#: Chunks that one file holds.
FILE_CHUNKS = 64


def _described(obj: RaggedArray | RaggedFrame) -> DataFrame:
    if isinstance(obj, RaggedArray):
        about = {"kind": "array", "dtype": obj.dtype.name, "depth": obj.depth, "union": obj.union}
        return obj._plain().withMetadata("v", {"ragged": about})
    df = obj._frame
    levels = [list(x) for x in obj._schema.levels] if obj._schema else None
    for c, (t, d, u) in obj._kinds.items():
        df = df.withMetadata(c, {"ragged": {"kind": "frame", "dtype": t.name, "depth": d, "union": u, "levels": [",".join(x) for x in levels] if levels else [], "peeled": obj._peeled}})
    return df


def _rows_per_file(obj, chunk_size: int, chunk_dim: int | str | None) -> int:
    """Rows of a file: FILE_CHUNKS chunks of rows, or as many rows as hold them at the depth chunk_dim."""
    if chunk_size < 1:
        raise ArgumentInvalid("chunk_size must be positive", str(chunk_size))
    most = chunk_size * FILE_CHUNKS
    if isinstance(chunk_dim, str):
        if not isinstance(obj, RaggedFrame) or obj._schema is None or chunk_dim not in obj._schema.level_of:
            raise ArgumentInvalid("no such level", chunk_dim)
        chunk_dim = obj._schema.level_of[chunk_dim]
    if not chunk_dim:
        return most
    kinds = obj._kinds if isinstance(obj, RaggedFrame) else {obj.column: (obj.dtype, obj.depth, obj.union)}
    deep = next((c for c, (_, d, u) in kinds.items() if not u and d >= chunk_dim), None)
    if deep is None:
        raise AxisInvalid("nothing is so deep", f"chunk_dim={chunk_dim}")
    frame = obj._frame if isinstance(obj, RaggedFrame) else obj.frame
    mean = frame.agg(F.avg(F.size(N.flatten_levels(F.col(deep), chunk_dim - 1)))).first()[0] or 1
    return max(1, int(most / max(mean, 1)))


def _write(obj, path: str, rows_per_file: int, mode: str, offset: int = 0) -> None:
    df = _described(obj)
    if offset:
        df = df.withColumn(POS, F.col(POS) + F.lit(offset))
    df.repartitionByRange(POS).sortWithinPartitions(POS).write.mode(mode).option("maxRecordsPerFile", rows_per_file).option("parquet.block.size", 32 << 20).parquet(path)


def save(obj: RaggedArray | RaggedFrame | Iterable, path: str, chunk_size: int = 1024, chunk_dim: int | str | None = None) -> None:
    """One object, or batches that follow each other along axis 0. chunk_dim: the depth, or level, whose elements a chunk counts."""
    if isinstance(obj, (RaggedArray, RaggedFrame)):
        _write(obj, path, _rows_per_file(obj, chunk_size, chunk_dim), "overwrite")
        return
    first = True
    for batch in obj:
        _write(batch, path, _rows_per_file(batch, chunk_size, chunk_dim), "overwrite") if first else append(batch, path, chunk_size, chunk_dim)
        first = False
    if first:
        raise IoFailed("nothing to save", "the generator is empty")


def append(obj: RaggedArray | RaggedFrame, path: str, chunk_size: int = 1024, chunk_dim: int | str | None = None) -> None:
    """New files after the last position; what is there isn't read or written again."""
    _write(obj, path, _rows_per_file(obj, chunk_size, chunk_dim), "append", stored_len(path))


def _read(path: str, spark: SparkSession | None = None) -> DataFrame:
    try:
        return (spark or session()).read.parquet(path)
    except Exception as e:  # the reader's error names the path
        raise IoFailed("can't open a store", str(e).splitlines()[0], path=path) from e


def _object(df: DataFrame) -> RaggedArray | RaggedFrame:
    about = {f.name: f.metadata.get("ragged") for f in df.schema.fields if f.name != POS and not f.name.startswith("_in_")}
    if None in about.values():
        raise IoFailed("not a ragged store", "columns lack their metadata")
    kinds = {c: (BY_NAME[a["dtype"]], int(a["depth"]), bool(a["union"])) for c, a in about.items()}
    first = next(iter(about.values()))
    if first["kind"] == "array":
        return RaggedArray(df, "v", *kinds["v"])
    levels = LevelSchema([tuple(x.split(",")) for x in first["levels"]]) if first["levels"] else None
    return RaggedFrame(df, kinds, levels, int(first["peeled"]))


def load(path: str, spark: SparkSession | None = None) -> RaggedArray | RaggedFrame:
    return _object(_read(path, spark))


def load_slice(path: str, start: int, stop: int, spark: SparkSession | None = None) -> RaggedArray | RaggedFrame:
    """Positions start to stop, counted from 0 again; the filter reaches the Parquet scan."""
    df = _read(path, spark).where((F.col(POS) >= start) & (F.col(POS) < stop))
    moved = F.col(POS) - F.lit(start)
    return _object(df.withColumn(POS, moved))


def stored_len(path: str, spark: SparkSession | None = None) -> int:
    """Rows: positions are dense, so the counts in the files' footers tell; no column is read."""
    return _read(path, spark).count()


def _input_bytes(spark: SparkSession) -> int:
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalInputBytes() for i in range(found.size()))


_counted = {"from": 0}


def io_bytes_read(spark: SparkSession | None = None) -> int:
    """Bytes that tasks read from storage since the last reset."""
    return _input_bytes(spark or session()) - _counted["from"]


def reset_io_bytes_read(spark: SparkSession | None = None) -> None:
    _counted["from"] = _input_bytes(spark or session())


_handles: weakref.WeakSet[OpenFrame] = weakref.WeakSet()


def io_cache_stats() -> dict[str, int]:
    """Columns that open handles keep, and their size as Catalyst estimates it."""
    kept = [n for h in _handles for n in h._kept.values()]
    return {"columns": len(kept), "bytes": sum(n for _, n in kept)}


def clear_path_caches() -> None:
    for h in list(_handles):
        h._drop()


class OpenFrame:
    """A lazy handle: columns and rows are read when used; closed handles raise.

    cache="chunks" keeps columns once they were asked for, as long as their estimated sizes fit chunk_budget_mb;
    "none" keeps nothing.
    """

    def __init__(self, path: str, cache: str = "chunks", chunk_budget_mb: int = 256, spark: SparkSession | None = None):
        if cache not in ("chunks", "none"):
            raise ArgumentInvalid("cache is 'chunks' or 'none'", repr(cache))
        self._path, self._spark, self.closed = path, spark, False
        self._budget, self._kept = (chunk_budget_mb << 20) if cache == "chunks" else 0, {}
        self._object = load(path, spark)
        if not isinstance(self._object, RaggedFrame):
            raise IoFailed("only frames open lazily", fix="use load()", path=path)
        _handles.add(self)

    def _live(self) -> RaggedFrame:
        if self.closed:
            raise IoFailed("the handle is closed", path=self._path)
        return self._object

    def __enter__(self) -> OpenFrame:
        self._live()
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self._drop()
        self.closed = True

    def _drop(self) -> None:
        for column, _ in self._kept.values():
            column.frame.unpersist()
        self._kept.clear()

    def _column(self, name: str) -> RaggedArray:
        if name in self._kept:
            return self._kept[name][0]
        column = self._live().column(name)
        size = int(str(column.frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if size + sum(n for _, n in self._kept.values()) <= self._budget:
            column.frame = column.frame.persist()
            self._kept[name] = (column, size)
        return column

    def shape(self, dim: int | str = 0):
        """Axis 0 from the footers; deeper ones read one column."""
        frame = self._live()
        axis = frame._schema.level_of[dim] if isinstance(dim, str) and frame._schema else dim
        return len(self) if axis == 0 else frame.shape(dim)

    def __len__(self) -> int:
        self._live()
        return stored_len(self._path, self._spark)

    def __getitem__(self, key):
        frame = self._live()
        if isinstance(key, str):
            return self._column(key)
        return frame[key]

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        return getattr(self._live(), name)

    def load(self) -> RaggedFrame:
        return self._live()

    def batches(self, size: int) -> Iterator[RaggedFrame]:
        """Consecutive ranges of rows, each a pruned scan."""
        for start in range(0, len(self), size):
            yield load_slice(self._path, start, start + size, self._spark)

    def reduce_batches(self, size: int, **reductions: tuple[str, str]) -> DataFrame:
        """batch, n and the named (column, reduction) of every range of rows that batches() gives: one scan, however many there are."""
        if size < 1:
            raise ArgumentInvalid("size must be positive", str(size))
        frame, found = self._live(), [F.count("*").alias("n")]
        for name, (column, reduction) in reductions.items():
            value = frame.column(column)
            if value.depth or value.union:
                raise AxisInvalid("batches reduce columns of one axis", column)
            if f"_in_{column}" in frame._frame.columns:
                raise AxisInvalid("batches reduce columns as long as the frame", column)
            found.append(value._reducer(reduction)[1](F.col(column)).alias(name))
        return frame._frame.groupBy(F.expr(f"`{POS}` div {size}L").alias("batch")).agg(*found)


def open(path: str, cache: str = "chunks", chunk_budget_mb: int = 256, spark: SparkSession | None = None) -> OpenFrame:  # noqa: A001
    return OpenFrame(path, cache, chunk_budget_mb, spark)
