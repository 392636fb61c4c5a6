"""Structured Streaming into a ragged store: each micro-batch follows the rows before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql import functions as F

from skein.operators.rows import ranked
from skein.plans.array import POS


def append_stream(stream: DataFrame, path: str, order: list[str], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Rows of each batch in the given order, with positions after those stored by earlier batches.

    A batch lies in a folder of its own that a retry overwrites, so replays add nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        batch = batch.persist()
        at = 0
        if batch_id:
            try:
                before = spark.read.option("basePath", path).parquet(path).where(F.col("batch") < batch_id)
                last = before.agg(F.max(POS)).first()[0]
                at = 0 if last is None else last + 1
            except Exception as e:  # nothing is stored yet
                if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                    raise
        placed = ranked(batch, [F.col(c) for c in order], POS).withColumn(POS, F.col(POS) + F.lit(at))
        placed.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        batch.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
