"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from skein.shared import shared_dir

_made: list[str] = []


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/skein/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it again: its lineage ends there."""
    spark = df.sparkSession
    path = path or table_path(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """How many tables were cut so far."""
    return len(_made)


def release(spark: SparkSession, since: int, keep: str = "") -> None:
    """Delete the tables cut since a mark but one; frames that read them are void."""
    for path in _made[since:]:
        if path != keep:
            remove(spark, path)
    _made[since:] = [keep] if keep in _made[since:] else []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that nothing will read again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def free_name(name: str, taken: list[str]) -> str:
    """name, with underscores added while a column has it."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name
