"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word (letters, digits, non-ASCII bytes; A-Z lower-cased) is the bag of its character n-grams,
bounds included, and itself, each hashed to a row of the embedding table; its vector is their
mean, a window's vector the mean of its words. A softmax over two classes reads a window; a text
scores as its most toxic window, so a few words in a very long text are not averaged away. Training
starts from windows that carry their document's label and goes on with each toxic document's
most toxic windows against all clean windows. Misspellings share most n-grams with the
word they come from.

As the softmax is linear, a row of the table adds one number to a window's logit: scoring
looks up numbers by n-gram and never makes vectors.

The model is fitted on whole documents bounded by ``per_class`` and ``most_bytes``, in one task; the driver only
gets one number for each bucket. Every document is then scored, whole, in one scan. Nulls and empty texts have one
empty window (logit: the bias). A null id counts as held out. Without labels of both kinds every
score is the same prior. Repeated rows are scored each. Empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.labelled import held_out, odds, sample
from skein.llm.text import LOWER, blocks, run_hashes, word_bounds

PER_CLASS, MOST_BYTES = (2_000, 1_200), (8 << 20, 6 << 20)
THRESHOLD = 0.7
BUCKETS, DIM = 1 << 18, 8
RATE, DAMPING, STEP, SHRINK = 30.0, 20.0, 4096, 0.95
GRAMS = (3, 4)
WINDOW, STRIDE = 4, 2
CALIBRATION = 5
#: What a word with one letter wrong keeps of its n-grams; calibration counts toxic documents with that share too.
SPELLING = 0.65

_SPLIT = np.ones(256, bool)
_SPLIT[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


@dataclass
class Model:
    value: np.ndarray  # what each bucket adds to the difference of logits
    bias: float
    scale: float = 1.0
    shift: float = 0.0
    length: float = 0.0  # what the logarithm of the number of windows takes off


def word_grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and word of every n-gram of a block, and each text's first word."""
    rows = len(offs) - 1
    # a separator before each text and two at the end, so that no n-gram spans two texts
    at = offs[:-1] + np.arange(rows)
    text = np.full(len(data) + rows + 2, 32, np.uint8)
    keep = np.ones(len(text), bool)
    keep[at] = False
    keep[-2:] = False
    text[keep] = LOWER[data]
    split = _SPLIT[text]
    text[split] = 32
    starts, ends, first = word_bounds(text, np.append(at, len(text)), _SPLIT)
    word = np.cumsum(~split & np.concatenate([[True], split[:-1]])) - 1  # of the byte; valid where not split
    code = text.astype(np.uint32)
    buckets, words = [run_hashes(text, starts, ends) % np.uint64(BUCKETS)], [np.arange(len(starts))]
    inside = ~split[1:]  # the byte after i
    for n in GRAMS:
        k = len(text) - n + 1
        if k <= 0:
            continue
        valid = inside[:k].copy()
        for j in range(2, n - 1):
            valid &= ~split[j : j + k]
        i = np.flatnonzero(valid)
        h = np.full(len(i), 2166136261 + n, np.uint32)
        for j in range(n):
            h = (h ^ code[i + j]) * np.uint32(16777619)
        h ^= h >> np.uint32(15)
        buckets.append((h % np.uint32(BUCKETS)).astype(np.uint64))
        words.append(word[i + 1])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(words), first


def window_bounds(first: np.ndarray, stride: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and word after the last of each window, and each text's first window."""
    a, b = [], []
    counts = np.empty(len(first) - 1, np.int64)
    for i, (x, y) in enumerate(zip(first[:-1], first[1:])):
        heads = np.arange(x, max(x + 1, y - WINDOW + (stride or STRIDE)), stride or STRIDE)
        a.append(heads)
        b.append(np.minimum(heads + WINDOW, y))
        counts[i] = len(heads)
    return np.concatenate(a), np.concatenate(b), np.concatenate([[0], np.cumsum(counts)])


def text_logits(model: Model, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The calibrated logit of each text, from the greatest of its windows."""
    bucket, word, first = word_grams(data, offs)
    n = int(first[-1])
    each = np.bincount(word, model.value[bucket], n) / np.maximum(np.bincount(word, minlength=n), 1)
    sums = np.concatenate([[0], np.cumsum(each)])
    a, b, at = window_bounds(first)
    logit = (sums[b] - sums[a]) / np.maximum(b - a, 1) + model.bias
    return model.scale * np.maximum.reduceat(logit, at[:-1]) + model.shift - model.length * np.log(np.diff(at))


def _for_calibration(doc_id) -> bool:
    """One sampled document in CALIBRATION is not trained on but calibrates the scores, with all its windows."""
    return crc32(f"calibrate {doc_id}".encode()) % CALIBRATION == 0


class Windows:
    """Training windows side by side: buckets and their weights, and the document, by number, of each window."""

    def __init__(self) -> None:
        self.ids, self.labels, self.parts = [], [], []

    def add(self, ids: list, labels: np.ndarray, data: np.ndarray, offs: np.ndarray) -> None:
        bucket, word, first = word_grams(data, offs)
        order = np.argsort(word, kind="stable")
        bucket, word = bucket[order].astype(np.int32), word[order]
        gram_at = np.searchsorted(word, np.arange(first[-1] + 1))
        a, b, at = window_bounds(first, WINDOW)
        words = np.repeat(np.maximum(b - a, 1), b - a)  # windows follow each other and share no word
        weight = 1 / (np.maximum(np.diff(gram_at), 1) * words)
        doc = np.repeat(np.arange(len(ids)), np.diff(at)) + len(self.ids)
        self.parts.append((bucket, np.repeat(weight, np.diff(gram_at)).astype(np.float32), gram_at[b] - gram_at[a], doc))
        self.ids += ids
        self.labels += labels.tolist()

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        bucket, weight, sizes, doc = (np.concatenate(x) for x in zip(*self.parts))
        self.parts.clear()
        return bucket, weight, np.concatenate([[0], np.cumsum(sizes)]), doc


class _Trainer:
    """Joint training of table and softmax; the two classes' rows of the softmax are w and -w.

    dL/dE[bucket] is a number times w, so one bincount a step carries the whole gradient.
    """

    def __init__(self, bucket: np.ndarray, weight: np.ndarray, at: np.ndarray, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.table = draw.normal(0, 0.01 / np.sqrt(DIM), (BUCKETS, DIM))  # near 0: an n-gram never seen says nothing
        self.w = draw.normal(0, 1, DIM)
        self.bias = 0.0
        self.bucket, self.weight, self.at = bucket, weight, at
        self.seen = np.full(BUCKETS, DAMPING)
        self.draw = draw

    def logits(self) -> np.ndarray:
        value = self.table @ (2 * self.w)
        out = np.empty(len(self.at) - 1)
        for k in range(0, len(out), 8192):  # in parts, as the driver's memory is small
            at = self.at[k : k + 8193]
            own = slice(at[0], at[-1])
            sums = np.concatenate([[0], np.cumsum(value[self.bucket[own]] * self.weight[own])])
            out[k : k + 8192] = sums[at[1:] - at[0]] - sums[at[:-1] - at[0]]
        return out + self.bias

    def epoch(self, windows: np.ndarray, target: np.ndarray, mass: np.ndarray, rate: float) -> None:
        order = self.draw.permutation(len(windows))
        step = min(STEP, max(64, len(order) // 60))  # small samples get as many steps, scaled alike
        for k in range(0, len(order), step):
            part = order[k : k + step]
            own = windows[part]
            sizes = self.at[own + 1] - self.at[own]
            flat = np.repeat(self.at[own] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            bucket, weight, which = self.bucket[flat], self.weight[flat], np.repeat(np.arange(len(part)), sizes)
            value = self.table @ (2 * self.w)
            logit = np.bincount(which, value[bucket] * weight, len(part)) + self.bias
            off = mass[part] * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - target[part])
            pull = np.bincount(bucket, off[which] * weight, BUCKETS) * (STEP / len(part))
            hit = np.flatnonzero(pull)
            pull = pull[hit]
            self.seen[hit] += pull**2  # a rare n-gram moves little
            move = rate * pull / np.sqrt(self.seen[hit])
            gradient_w = 2 * (pull @ self.table[hit]) * (len(part) / STEP)
            self.table[hit] -= np.outer(move, 2 * self.w)
            self.w -= 0.05 * gradient_w / (np.abs(mass[part]).sum() + 1e-9)
            self.bias -= 0.5 * off.sum() / (mass[part].sum() + 1e-9)
        self.table *= SHRINK  # what common words say by chance fades, what toxic words say is learnt again


def _calibrated(best: np.ndarray, windows: np.ndarray, y: np.ndarray, odds_of_one: float) -> tuple[float, float, float]:
    """Platt's scale and shift, and what the logarithm of a text's windows takes off (the greatest of many is large by
    chance), by Newton steps, with the classes weighed to the odds of all labels."""
    mass = np.where(y == 1, odds_of_one / max(y.sum(), 1), 1 / max((1 - y).sum(), 1))
    mass *= len(y) / mass.sum()
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    mean, sd = best.mean(), best.std() + 1e-9
    length = -np.log(windows)
    for columns in ([(best - mean) / sd, np.ones(len(best)), length], [(best - mean) / sd, np.ones(len(best))]):
        z, theta = np.stack(columns, 1), np.zeros(len(columns))
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
            step = np.linalg.solve((z * (mass * p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(len(theta)), z.T @ (mass * (p - target)))
            theta -= np.clip(step, -2, 2)
        if len(theta) == 2 or theta[2] >= 0:  # a longer text is never the likelier for it
            break
    return float(theta[0] / sd), float(theta[1] - theta[0] * mean / sd), float(theta[2]) if len(theta) > 2 else 0.0


def prior(odds_of_one: float) -> Model:
    share = odds_of_one / (1 + odds_of_one)
    return Model(np.zeros(BUCKETS, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))


def train(windows: Windows, odds_of_one: float, rounds: int = 2, epochs: int = 6) -> Model:
    if len(set(windows.labels)) < 2:
        return prior(odds_of_one)
    bucket, weight, at, doc = windows.joined()
    trainer = _Trainer(bucket, weight, at)
    doc_label = np.array(windows.labels, np.float64)
    label = doc_label[doc]
    doc_at = np.searchsorted(doc, np.arange(len(doc_label)))
    aside = np.array([_for_calibration(i) for i in windows.ids])
    if len(set(doc_label[aside])) < 2 or len(set(doc_label[~aside])) < 2:
        aside[:] = False  # too few documents to set some aside
    trained = ~aside[doc]
    toxic, clean = np.flatnonzero((label == 1) & trained), np.flatnonzero((label == 0) & trained)
    chosen = np.concatenate([toxic, clean])
    mass = np.zeros(len(label))
    mass[toxic], mass[clean] = 0.5 * len(chosen) / len(toxic), 0.5 * len(chosen) / len(clean)
    for turn in range(rounds):
        for k in range(epochs):
            trainer.epoch(chosen, label[chosen], mass[chosen], RATE * (1 - (turn * epochs + k) / (rounds * epochs)))
        logit = trainer.logits()
        # each toxic document by its most toxic window and what comes near it; all clean windows
        best = np.maximum.reduceat(logit, doc_at)
        kept = toxic[(logit[toxic] >= best[doc[toxic]] - 1e-9) | (logit[toxic] > np.quantile(logit[clean], 0.999))]
        chosen = np.concatenate([kept, clean])
        mass = np.zeros(len(label))
        mass[kept], mass[clean] = 0.3 * len(chosen) / len(kept), 0.7 * len(chosen) / len(clean)
    best = np.maximum.reduceat(trainer.logits(), doc_at)
    judged = aside if aside.any() else np.ones(len(best), bool)
    y, best = doc_label[judged], best[judged]
    n = np.diff(np.append(doc_at, len(doc)))[judged] * (WINDOW // STRIDE)  # scoring looks at overlapping windows
    misspelt = trainer.bias + SPELLING * (best[y == 1] - trainer.bias)
    fitted = _calibrated(np.concatenate([best, misspelt]), np.concatenate([n, n[y == 1]]), np.concatenate([y, np.ones(len(misspelt))]), odds_of_one)
    return Model((trainer.table @ (2 * trainer.w)).astype(np.float32), float(trainer.bias), *fitted)


def _fitted(odds_of_one: float):
    """One task reads the bounded sample and trains: the driver only gets the model."""

    def run(batches):
        texts = []
        for batch in batches:
            texts += zip(batch.column("doc_id").to_pylist(), batch.column("label").to_pylist(), batch.column("text").to_pylist())
        texts.sort(key=lambda x: str(x[0]))  # the same model whatever the order of rows
        windows = Windows()
        for a in range(0, len(texts), 256):
            ids, labels, text = zip(*texts[a : a + 256])
            for x, y, data, offs in blocks(pa.array(text, pa.large_string())):
                windows.add(list(ids[x:y]), np.array(labels[x:y]), data, offs)
        model = train(windows, odds_of_one)
        yield pa.RecordBatch.from_pydict({"value": pa.array([model.value.tobytes()], pa.binary()), "bias": [model.bias], "scale": [model.scale], "shift": [model.shift], "length": [model.length]})

    return run


def fit_toxicity(labels: DataFrame, docs: DataFrame, label_col: str = "toxic", folds: int = 3, fold: int = 1, per_class: tuple[int, int] = PER_CLASS, most_bytes: tuple[int, int] = MOST_BYTES, id_col: str = "doc_id", text_col: str = "text") -> Model:
    picked = sample(labels, docs, label_col, folds, fold, per_class, most_bytes, id_col, text_col).select("doc_id", "label", "text")
    share = odds(labels, label_col, folds, fold, id_col)
    found = picked.repartition(1).mapInArrow(_fitted(share), "value binary, bias double, scale double, shift double, length double").first()
    return Model(np.frombuffer(found["value"], np.float32), found["bias"], found["scale"], found["shift"], found["length"]) if found else prior(share)


def _scores(model: Model):
    def run(batches):
        for batch in batches:
            for a, b, data, offs in blocks(batch.column("text")):
                part = batch.slice(a, b - a).drop_columns(["text"])
                z = text_logits(model, data, offs)
                yield part.append_column("score", pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30)))))

    return run


def score_toxicity(docs: DataFrame, model: Model, folds: int = 3, fold: int = 1, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(_scores(model), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return found.select("doc_id", held_out("doc_id", folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_toxicity(docs, fit_toxicity(labels, docs))
