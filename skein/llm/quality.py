"""Quality classifier: gradient-boosted trees over statistics of whole documents.

The trees are fitted on a sample of labelled documents, bounded by ``per_class`` rows of each
label; only its statistics reach the driver. Every document is then scored in one scan, the
flattened trees travelling with the function (some ten thousand numbers).

Nulls and empty texts: statistics 0, scored like any other. A null id counts as held out. Without
labels of both kinds every score is the same prior. Repeated rows are scored each. Empty tables
give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.labelled import held_out, odds, sample
from skein.llm.text import blocks, run_hashes, word_bounds
from skein.llm.trees import Forest, fit

PER_CLASS = (10_000, 10_000)
THRESHOLD = 0.7


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_NOT_LINE = _table(b"\n")
_KINDS = {
    "upper": _table(bytes(range(65, 91))),
    "lower": _table(bytes(range(97, 123))),
    "digit": _table(b"0123456789"),
    "stop": _table(b".,;:?"),
    "bang": _table(b"!"),
    "symbol": _table(b"#$%&*@^~<>{}[]\\/=+_"),
    "bar": _table(b"|"),
    "line": _NOT_LINE,
    "high": np.arange(256) >= 0x80,
}
FEATURES = ["bytes", "words", "word_bytes", "word_bytes_sd", "longest", *_KINDS, "distinct_words", "short_words", "capital_words", "marked_words", "lines", "distinct_lines", "line_words", "longest_run"]


def _distinct(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.array([len(np.unique(values[a:b])) for a, b in zip(first[:-1], first[1:])], np.float64)


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text of a block."""
    rows = len(offs) - 1
    n = np.diff(offs).astype(np.float64)
    starts, ends, first = word_bounds(data, offs)
    size = (ends - starts).astype(np.float64)
    words = np.diff(first).astype(np.float64)
    per = np.maximum(words, 1)

    def by_text(values, at):
        sums = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
        return sums[at[1:]] - sums[at[:-1]]

    mean = by_text(size, first) / per
    longest = np.zeros(rows)
    full = np.flatnonzero(words)
    if len(full):
        longest[full] = np.maximum.reduceat(size, first[:-1][full])
    out = [np.log1p(n), np.log1p(words), mean, np.sqrt(np.maximum(by_text(size**2, first) / per - mean**2, 0)), np.log1p(longest)]
    for table in _KINDS.values():
        out.append(by_text(table[data], offs) / np.maximum(n, 1))
    upper = np.concatenate([[0], np.cumsum(_KINDS["upper"][data])])
    lower = np.concatenate([[0], np.cumsum(_KINDS["lower"][data])])
    marked = np.concatenate([[0], np.cumsum(_KINDS["symbol"][data] | _KINDS["bang"][data] | _KINDS["bar"][data])])
    out.append(_distinct(run_hashes(data, starts, ends), first) / per)
    out.append(by_text(size <= 2, first) / per)
    out.append(by_text((upper[ends] - upper[starts] > 1) & (lower[ends] == lower[starts]), first) / per)
    out.append(by_text(marked[ends] > marked[starts], first) / per)
    l_starts, l_ends, l_first = word_bounds(data, offs, _NOT_LINE)
    lines = np.diff(l_first).astype(np.float64)
    out.append(np.log1p(lines))
    out.append(_distinct(run_hashes(data, l_starts, l_ends), l_first) / np.maximum(lines, 1))
    out.append(words / np.maximum(lines, 1))
    same = np.concatenate([[False], (data[1:] == data[:-1]) & (data[1:] != 32)]) if len(data) else np.zeros(0, bool)
    out.append(by_text(same, offs) / np.maximum(n, 1))
    return np.stack(out, 1) if rows else np.zeros((0, len(FEATURES)))


def _features(batches):
    for batch in batches:
        for a, b, data, offs in blocks(batch.column("text")):
            x = statistics(data, offs)
            yield pa.RecordBatch.from_arrays([batch.column("label").slice(a, b - a), pa.array(list(x))], ["label", "x"])


def _scores(forest: Forest):
    def run(batches):
        for batch in batches:
            for a, b, data, offs in blocks(batch.column("text")):
                part = batch.slice(a, b - a).drop_columns(["text"])
                yield part.append_column("score", pa.array(forest.predict(statistics(data, offs))))

    return run


def fit_quality(labels: DataFrame, docs: DataFrame, label_col: str = "quality", folds: int = 4, fold: int = 2, per_class: tuple[int, int] = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Forest:
    """Trees for P(label = 1), moved back to the odds that label has among all labelled."""
    rows = sample(labels, docs, label_col, folds, fold, per_class, None, id_col, text_col).select("label", "text").mapInArrow(_features, "label int, x array<double>").toPandas()
    x = np.array(rows["x"].tolist()) if len(rows) else np.zeros((0, len(FEATURES)))
    order = np.lexsort([*x.T, rows["label"].to_numpy()]) if len(rows) else []  # the same trees whatever the order of rows
    y = rows["label"].to_numpy(np.float64)[order]
    forest = fit(x[order], y)
    forest.start += float(np.log(odds(labels, label_col, folds, fold, id_col)) - np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    return forest


def score_quality(docs: DataFrame, forest: Forest, folds: int = 4, fold: int = 2, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(_scores(forest), f"doc_id {kind}, score double")
    return found.select("doc_id", held_out("doc_id", folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_quality(docs, fit_quality(labels, docs))


def keep_good(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the trees accept, with all their columns."""
    def run(batches):
        for batch in batches:
            for a, b, data, offs in blocks(batch.column(text_col)):
                keep = forest.predict(statistics(data, offs)) >= threshold
                yield batch.slice(a, b - a).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
