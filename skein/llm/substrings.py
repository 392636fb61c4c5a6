"""Substring dedup over a log-structured fingerprint index.

Every window of ``window`` words holds the same content-defined anchor wherever it
starts: the least hash among its runs of ``gram`` words. The index keeps anchors, about
8 in 100 word positions, as immutable runs sorted by hash. A batch of documents adds a
run; joining the runs on the hash finds what repeats, within the batch and against
history, and compaction merges runs level by level. Only windows whose anchor repeats
are then hashed in full, counted, and cut out; anchors lose no equal windows. A window is verified by 128 bits, two
independent hashes of its words from two of each word's bytes, as an index keeps no texts.

An index that is given also keeps the hashes of all windows, as runs of their own, so that a later call cuts
out what repeats there. It is reopened from its path. It holds one window size; a batch that is given
twice repeats itself.

Nulls: a null text has no words; a null id is kept. Texts under ``window`` words lose
nothing. Repeated rows are documents of their own, so each removes the other's windows.
Empty tables give empty results. Other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.skew import join_counted
from skein.llm.store import cut, listed, remove, table_path
from skein.llm.text import blocks, row_of, run_hashes, sliding, window_hashes, word_bounds

GRAM = 12
#: Runs of one level that are merged into one.
FAN = 4


def block_anchors(data: np.ndarray, offs: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and word position of each anchor in a block."""
    starts, ends, first = word_bounds(data, offs)
    row = row_of(first)
    last = first[1:][row]  # the word after each word's text
    at = np.arange(len(starts))
    g = window_hashes(run_hashes(data, starts, ends), gram, 1)
    if len(starts) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    width = window - gram + 1
    least = sliding(g, width)
    valid = at[: len(least)] + window <= last[: len(least)]
    reach = np.where(valid, least, np.uint64(0))
    padded = np.concatenate([np.zeros(width - 1, np.uint64), reach, np.zeros(width - 1, np.uint64)])
    most = sliding(padded, width, np.maximum)[: len(g)]
    live = sliding(np.concatenate([np.zeros(width - 1, bool), valid, np.zeros(width - 1, bool)]), width, np.logical_or)[: len(g)]
    chosen = np.flatnonzero((most == g) & live)
    return g[chosen], row[chosen], chosen - first[:-1][row[chosen]]


def _anchor_rows(window: int, gram: int, keyed: bool):
    def run(batches):
        for batch in batches:
            text = batch.column("text")
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2")] if keyed else None
            for a, _, data, offs in blocks(text):
                h, row, pos = block_anchors(data, offs, window, gram)
                columns = {"h": pa.array(h.view(np.int64))}
                if keyed:
                    columns |= {"k1": pa.array(keys[0][a + row]), "k2": pa.array(keys[1][a + row]), "p": pa.array(pos.astype(np.int32))}
                yield pa.RecordBatch.from_pydict(columns)

    return run


class FingerprintIndex:
    """Sorted immutable runs of (h, n): hashes and how often they occurred.

    A run's folder is named by its number, its level and the runs it was merged from, so the folder is the manifest:
    whole runs are reopened, half-written ones and those that a whole run replaces are not. FAN runs of a level
    are merged into one of the next, so a hash is written once for each level and not with every batch.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, keys: tuple[str, ...] = ("h",)):
        self.spark, self.path, self.keys = spark, path or table_path(spark, "runs"), keys
        there = [x for x in listed(spark, self.path) if x.startswith("run-")]
        whole = [x for x in there if "_SUCCESS" in listed(spark, f"{self.path}/{x}")]
        replaced = {n for x in whole for n in self._replaces(x)}
        self.runs = sorted((x for x in whole if self._number(x) not in replaced), key=self._number)
        for x in there:
            if x not in self.runs:
                remove(spark, f"{self.path}/{x}")
        self._made = 1 + max(map(self._number, there), default=-1)

    @staticmethod
    def _number(run: str) -> int:
        return int(run.split("-")[1])

    @staticmethod
    def _level(run: str) -> int:
        return int(run.split("-")[2])

    @staticmethod
    def _replaces(run: str) -> list[int]:
        return [int(x) for x in run.split("-")[3:]]

    def windows(self, window: int) -> FingerprintIndex:
        """The runs of window hashes, beside those of anchors."""
        name = f"windows-{window}"
        if other := [x for x in listed(self.spark, self.path) if x.startswith("windows-") and x != name]:
            raise ValueError(f"the index at {self.path} holds {other[0]}, not {name}")
        return FingerprintIndex(self.spark, f"{self.path}/{name}", ("w1", "w2"))

    def _write(self, counted: DataFrame, level: int, merged: list[str]) -> None:
        name = "-".join(map(str, ["run", self._made, level, *map(self._number, merged)]))
        self._made += 1
        counted.sortWithinPartitions(*self.keys).write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        self.runs = [x for x in self.runs if x not in merged] + [name]
        for x in merged:
            remove(self.spark, f"{self.path}/{x}")

    def _frame(self, runs: list[str]) -> DataFrame:
        shape = ", ".join(f"{k} long" for k in (*self.keys, "n"))
        if not runs:
            return self.spark.createDataFrame([], shape)
        return self.spark.read.schema(shape).parquet(*[f"{self.path}/{x}" for x in runs])

    def read(self) -> DataFrame:
        """All runs; empty if there are none."""
        return self._frame(self.runs)

    def add(self, hashes: DataFrame) -> None:
        """Append a batch as a run of its own."""
        self._write(hashes.groupBy(*self.keys).agg(F.count("*").alias("n")), 0, [])

    def compact(self) -> None:
        """Merge every FAN runs of a level into one of the next and delete them; frames read from them before are void."""
        level = 0
        while level <= max(map(self._level, self.runs), default=-1):
            while len(own := [x for x in self.runs if self._level(x) == level][:FAN]) == FAN:
                self._write(self._frame(own).groupBy(*self.keys).agg(F.sum("n").alias("n")), level + 1, own)
            level += 1

    def repeated(self) -> DataFrame:
        """Hashes that occurred twice at least, over all runs, and how often."""
        return self.read().groupBy(*self.keys).agg(F.sum("n").alias("n")).where("n > 1")


def _both(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int) -> list[np.ndarray]:
    """Two hashes of every run of window words, from two hashes of every word: a match of both verifies the words."""
    return [window_hashes(run_hashes(data, starts, ends, seed), window, seed) for seed in (2, 3)]


def _all_windows(window: int):
    """Hashes of every window."""

    def run(batches):
        for batch in batches:
            for _, _, data, offs in blocks(batch.column("text")):
                starts, ends, first = word_bounds(data, offs)
                s = np.arange(max(0, len(starts) - window + 1))
                s = s[s + window <= first[1:][row_of(first)[s]]]
                yield pa.RecordBatch.from_pydict({f"w{i + 1}": pa.array(w[s].view(np.int64)) for i, w in enumerate(_both(data, starts, ends, window))})

    return run


def _windows(window: int, gram: int):
    """For the documents of classes with repeated anchors, the windows these anchors may stand for."""

    def run(batches):
        for batch in batches:
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2", "copies")]
            hits = batch.column("hits")
            at, flat = np.asarray(hits.offsets), np.asarray(hits.values)
            for a, b, data, offs in blocks(batch.column("text")):
                starts, ends, first = word_bounds(data, offs)
                if len(starts) < window:
                    continue
                low, high = at[a:b], at[a + 1 : b + 1]
                p = flat[at[a] : at[b]] + first[:-1][np.repeat(np.arange(b - a), high - low)]
                g = window_hashes(run_hashes(data, starts, ends), gram, 1)
                repeated = np.full(len(g), np.iinfo(np.uint64).max)
                repeated[p] = g[p]
                width = window - gram + 1
                s = np.flatnonzero(sliding(g, width) == sliding(repeated, width))
                own = row_of(first)
                s = s[s + window <= first[1:][own[s]]]
                own = own[s]
                w1, w2 = _both(data, starts, ends, window) if len(s) else (np.zeros(0, np.uint64),) * 2
                yield pa.RecordBatch.from_pydict(
                    {
                        "w1": pa.array(w1[s].view(np.int64)),
                        "w2": pa.array(w2[s].view(np.int64)),
                        "k1": pa.array(keys[0][a + own]),
                        "k2": pa.array(keys[1][a + own]),
                        "s": pa.array((s - first[:-1][own]).astype(np.int32)),
                        "copies": pa.array(keys[2][a + own]),
                    }
                )

    return run


def _strip(window: int):
    def run(batches):
        for batch in batches:
            texts, copies, starts = (batch.column(c) for c in ("text", "copies", "starts"))
            out = {"n_words": [], "n_removed": [], "spans": [], "kept": []}
            for i in range(batch.num_rows):
                words = (texts[i].as_py() or "").encode().split()
                n, s = len(words), starts[i].values
                spans = []
                if n >= window and copies[i].as_py() > 1:
                    spans = [(0, n)]
                elif s is not None and len(s):
                    s = np.sort(np.asarray(s))
                    heads = np.flatnonzero(np.diff(s, prepend=s[0] - window - 1) > window)
                    spans = [(int(s[x]), int(s[y - 1]) + window) for x, y in zip(heads, [*heads[1:], len(s)])]
                kept, at = [], 0
                for x, y in spans:
                    kept += words[at:x]
                    at = y
                kept += words[at:]
                out["n_words"].append(n)
                out["n_removed"].append(n - len(kept))
                out["spans"].append([{"start": x, "stop": y} for x, y in spans])
                out["kept"].append(b" ".join(kept).decode())
            spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["spans"], spans), pa.array(out["kept"], pa.string())],
                ["doc_id", "n_words", "n_removed", "spans", "text"],
            )

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, batches: int = 2, index: FingerprintIndex | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, spans (word ranges cut out) and the text that is left.

    Documents enter the index in ``batches`` runs. What repeats in the earlier corpora of an index that is given is
    cut out here, too; results of earlier calls don't change.
    """
    spark = docs.sparkSession
    gram = min(GRAM, window)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(7), "text")})

    history = index.windows(window) if index else None
    index = index or FingerprintIndex(spark)
    for i in range(batches):
        part = rows.where(F.pmod("k2", F.lit(batches)) == i) if batches > 1 else rows
        index.add(part.select("text").mapInArrow(_anchor_rows(window, gram, False), "h long"))
    index.compact()

    anchors = rows.select("text", "k1", "k2").mapInArrow(_anchor_rows(window, gram, True), "h long, k1 long, k2 long, p int")
    repeated = cut(index.repeated(), "repeated")
    most = repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hits = join_counted(anchors, repeated, ["h"], "n", most, "left_semi").groupBy("k1", "k2").agg(F.collect_set("p").alias("hits"))
    classes = rows.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least"))
    classes = cut(classes.join(hits, ["k1", "k2"], "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<int>"))), "classes")

    known = rows.join(classes.where(F.size("hits") > 0), ["k1", "k2"]).where(F.col("doc_id").eqNullSafe(F.col("least")))
    seen = cut(
        known.select("text", "k1", "k2", "copies", "hits").mapInArrow(_windows(window, gram), "w1 long, w2 long, k1 long, k2 long, s int, copies long"),
        "windows",
    )
    counted = seen.groupBy("w1", "w2").agg(F.sum("copies").alias("n"))
    if history:  # a merge join with what earlier batches hold, before this one enters
        past = history.read().select("w1", "w2").distinct().withColumn("past", F.lit(True))
        counted = counted.join(past, ["w1", "w2"], "left")
        twice = cut(counted.where("n > 1 or past").select("w1", "w2", "n"), "twice")
        history.add(rows.select("text").mapInArrow(_all_windows(window), "w1 long, w2 long"))
        history.compact()
    else:
        twice = cut(counted.where("n > 1"), "twice")
    most = twice.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = join_counted(seen.where("copies = 1"), twice, ["w1", "w2"], "n", most, "left_semi").groupBy("k1", "k2").agg(F.collect_set("s").alias("starts"))
    state = classes.select("k1", "k2", "copies").join(found, ["k1", "k2"], "left").where("copies > 1 or starts is not null")
    marked = rows.join(state, ["k1", "k2"], "left").select("doc_id", "text", F.coalesce("copies", F.lit(1)).alias("copies"), "starts")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return marked.mapInArrow(_strip(window), f"doc_id {id_type}, n_words long, n_removed long, spans array<struct<start: long, stop: long>>, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, s, array_to_string(list_slice(w, s, s + 34), ' ') AS seq
        FROM (SELECT r, w, unnest(generate_series(1, len(w) - 34)) AS s FROM d WHERE len(w) >= 35)),
dup AS (SELECT r, s FROM win WHERE seq IN (SELECT seq FROM win GROUP BY seq HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, s + k AS p FROM dup, range(0, 35) t(k)),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT words.r, string_agg(word, ' ' ORDER BY words.p) AS text, count(*) AS n
         FROM words LEFT JOIN gone ON gone.r = words.r AND gone.p = words.p WHERE gone.p IS NULL GROUP BY words.r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
