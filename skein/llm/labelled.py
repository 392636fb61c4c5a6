"""Bounded samples of labelled documents for classifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.store import cut


def held_out(doc_id: Column | str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text, modulo folds, is fold; a null id is held out."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % folds == fold, F.lit(True))


def _known(labels: DataFrame, label_col: str, folds: int, fold: int, id_col: str) -> DataFrame:
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(~held_out("doc_id", folds, fold))
    return known.groupBy("doc_id").agg(F.max("label").alias("label"))


def odds(labels: DataFrame, label_col: str, folds: int, fold: int, id_col: str = "doc_id") -> float:
    """How many ids have label 1 for each that has 0, outside the held-out fold; both plus one."""
    n, ones = _known(labels, label_col, folds, fold, id_col).agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    return (ones + 1) / (n - ones + 1)


def sample(labels: DataFrame, docs: DataFrame, label_col: str, folds: int, fold: int, per_class: tuple[int, int], most_bytes: tuple[int, int] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and label of at most per_class[label] labelled ids outside the held-out fold.

    The ids are those of least hash, and, with most_bytes, the first of these whose texts together have at most
    most_bytes[label] bytes. An id with several labels counts as its greatest, null labels as none, an id
    with several texts as its least. The ids picked are bounded by per_class, so they are broadcast.
    """
    known = _known(labels, label_col, folds, fold, id_col)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = reduce(DataFrame.unionByName, [known.where(F.col("label") == k).orderBy(*order).limit(n) for k, n in enumerate(per_class)])
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    if most_bytes is None:
        return found
    found = cut(found, "sample")
    upto = F.sum(F.octet_length("text")).over(Window.partitionBy("label").orderBy(*order))
    fits = found.select("doc_id", "label", upto.alias("upto")).where(F.col("upto") <= F.element_at(F.array(*map(F.lit, most_bytes)), F.col("label") + 1))
    return found.join(F.broadcast(fits.select("doc_id")), "doc_id")
