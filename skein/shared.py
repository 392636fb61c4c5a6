"""Tables in the folder that driver and executors share: plans that must not be evaluated twice are cut there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from skein.errors import IoFailed

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, on a local master only, a folder of this process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise IoFailed("spark.checkpoint.dir is unset", "executors need a shared folder", "set spark.checkpoint.dir")
        found = _local_dir()
    return found.rstrip("/")


def _local_dir() -> str:
    if not _made or not _made[0].startswith("file:///"):
        _made.insert(0, f"file://{tempfile.mkdtemp(prefix='skein-')}")
    return _made[0]


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written once and read again: whatever reads it sees the same rows in the same partitions."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skein-core/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete the tables that this process cut; frames that still read them are void."""
    for path in _made:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _made.clear()
