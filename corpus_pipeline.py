"""The corpus pipeline: documents in, a clean mix out.

STAGES are (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet in the shared folder and read again as the docs of the next one. All but
the last return the columns of documents.

Nulls: a null text is judged by the quality trees like an empty one, has no lines, is a near copy of nothing, holds no item
and is not taken into the mix; a null id is kept, a null source is a source. Texts that are empty from the start stay until mixing. Very long texts
are read whole, in blocks of their own. Repeated rows are judged alike; near-dedup leaves one of them (rows of empty texts
all stay). Columns of any other name travel with their rows. An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import benchmark, lines, mixing, near, quality, store

#: Recurring lines go from every document, however many of its lines they are.
MOST_LINES_DROPPED = 1.0


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality trees reject go."""
    return quality.keep_good(docs, quality.fit_quality(spark.read.parquet(f"{sf_dir}/labels.parquet"), docs))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose template recurs go, and documents that have no word left then: copies; n_chars follows the text."""
    found = lines.dedup_lines(docs, most_dropped=MOST_LINES_DROPPED)
    found = found.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    length = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", length).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near.drop_near_duplicates(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return benchmark.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, numbered by copy."""
    return mixing.take(docs)


STAGES = [("quality", quality_stage), ("lines", lines_stage), ("near", near_stage), ("benchmark", benchmark_stage), ("mixing", mixing_stage)]

#: SQL can't express the first stage, a trained classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = spark.read.parquet(f"{sf_dir}/documents.parquet"), store.mark()
    for name, stage in STAGES:
        path = store.table_path(spark, f"stage-{name}")
        docs = store.cut(stage(spark, docs, sf_dir), f"stage-{name}", path)
        store.release(spark, since, path)  # what the stage cut, and the stage before: nothing reads them again
    return docs
