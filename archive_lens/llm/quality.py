"""Quality classifier: random Fourier features of document statistics, ridge by normal equations, isotonic calibration.

Statistics (shares of character classes, word and line measures) are taken over each whole text once and kept. The
Gaussian kernel over the standardised statistics is approximated by FEATURES random cosines; each partition of labelled
training rows sums its part of the normal equations, and only sums reach the driver. Scores of the training rows are
binned for the isotonic fit, again as partition sums. All labelled training rows are used.

Defined results: null and empty texts have the statistics of an empty text and get a score like any other. Rows that
repeat a doc_id are each scored. With labels of fewer than two classes (or none) all scores are the mean label (0.5).
Null labels are not learned from. Labels, lang, source and doc_id are not inputs of a score. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .calibration import calibrated, isotonic
from .kernels import Words, buffers, steps
from .sums import total

FEATURES = 256
WIDTH = 0.25
RIDGE = 1e-3
BINS = 1024
SEED = 7

#: Classes of bytes: lower, upper, digit, space, newline, sentence marks, exclamation and question marks, bars, other symbols, quotes and brackets, high bytes, control.
KINDS = 12
_KIND = np.full(256, 8, np.int64)
for _k, _c in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r\x0b\x0c", ".,;:", "!?", "|", "#$%&*@^~`=+<>\\/_", "\"'()[]{}-"]):
    _KIND[[ord(x) for x in _c]] = _k
_KIND[128:] = 10
_KIND[[*range(9), *range(14, 32), 127]] = 11
STATS = KINDS + 9


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of STATS numbers for each document."""
    n = len(offs) - 1
    lens = np.diff(offs)
    kinds = np.bincount(np.repeat(np.arange(n), lens) * KINDS + _KIND[data], minlength=n * KINDS).reshape(n, KINDS)
    w = Words(data, offs)
    words = np.diff(w.first)
    o = np.lexsort((w.hash, w.doc))
    new = np.ones(len(o), bool)
    new[1:] = (w.hash[o][1:] != w.hash[o][:-1]) | (w.doc[o][1:] != w.doc[o][:-1])
    distinct = np.bincount(w.doc[o][new], minlength=n)
    size = (w.end - w.start).astype(float)
    per = np.maximum(words, 1)
    mean = np.bincount(w.doc, size, n) / per
    spread = np.sqrt(np.maximum(np.bincount(w.doc, size**2, n) / per - mean**2, 0))
    tail = _KIND[data[w.end - 1]] if len(w) else np.zeros(0, np.int64)
    odd = np.bincount(w.doc, np.isin(tail, (6, 7, 8)), n) / per
    short = np.bincount(w.doc, size <= 3, n) / per
    same = np.zeros(len(w), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    again = np.bincount(w.doc, same, n) / per
    lines = kinds[:, 4] + 1
    # words at a line's start that start more than one line: repeated lines
    starts = np.zeros(len(w), bool)
    if len(w):
        breaks = np.cumsum(_KIND[data] == 4)
        at = breaks[w.start]
        starts[0] = True
        starts[1:] = (at[1:] != at[:-1]) | (w.doc[1:] != w.doc[:-1])
    i = np.flatnonzero(starts)
    pair = w.hash[i] * np.uint64(3)
    nxt = np.minimum(i + 1, max(len(w) - 1, 0))
    if len(i):
        pair = pair + w.hash[nxt]
    o = np.lexsort((pair, w.doc[i]))
    dup = np.zeros(len(i), bool)
    dup[1:] = (pair[o][1:] == pair[o][:-1]) & (w.doc[i][o][1:] == w.doc[i][o][:-1])
    repeated = np.bincount(w.doc[i][o][dup], minlength=n) / lines
    share = kinds / np.maximum(lens, 1)[:, None]
    return np.column_stack([np.sqrt(share), np.log1p(lens), np.log1p(words), np.log1p(mean), np.log1p(spread), odd, short, again, distinct / per, repeated])


def _stats(batches):
    for batch in batches:
        data, offs = buffers(batch.column("text"))
        for lo, hi, d, o in steps(data, offs):
            x = statistics(d, o)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "stats"])


def _matrix(b) -> np.ndarray:
    return np.frombuffer(b"".join(b.column("stats").to_pylist()), np.float64).reshape(-1, STATS)


class Model:
    def __init__(self, mean: np.ndarray, deviation: np.ndarray, seed: int = SEED, features: int = FEATURES, width: float = WIDTH):
        r = np.random.default_rng(seed)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1)
        self.w, self.b = r.normal(0, width, (len(mean), features)), r.uniform(0, 2 * np.pi, features)
        self.coef, self.knots = np.zeros(features + 1), (np.array([0.0, 1.0]), np.array([0.5, 0.5]))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -8, 8)
        return np.column_stack([np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b)), np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.coef


def _bin(raw: np.ndarray) -> np.ndarray:
    return np.clip(((raw + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)


def fit(stats: DataFrame, labelled: DataFrame) -> Model:
    """stats: stats of all documents; labelled: stats and label (0 or 1) of the training rows."""
    width = STATS
    m = total(stats, lambda b: np.concatenate([[b.num_rows], (x := _matrix(b)).sum(0), (x * x).sum(0)]), 2 * width + 1)
    n = max(m[0], 1)
    mean = m[1 : width + 1] / n
    model = Model(mean, np.sqrt(np.maximum(m[width + 1 :] / n - mean**2, 0)))
    size = FEATURES + 1

    def equations(b):
        z, y = model.features(_matrix(b)), b.column("label").to_numpy().astype(float)
        return np.concatenate([(z.T @ z).reshape(-1), z.T @ y, [len(y), y.sum()]])

    s = total(labelled, equations, size * size + size + 2)
    a, v, (rows, ones) = s[: size * size].reshape(size, size), s[size * size : -2], s[-2:]
    if not 0 < ones < rows:
        p = ones / rows if rows else 0.5
        model.knots = (np.array([0.0, 1.0]), np.array([p, p]))
        return model
    penalty = np.full(size, RIDGE * rows)
    penalty[-1] = 1e-9
    model.coef = np.linalg.solve(a + np.diag(penalty), v)

    def bins(b):
        raw, y = model.raw(_matrix(b)), b.column("label").to_numpy().astype(float)
        k = _bin(raw)
        return np.concatenate([np.bincount(k, raw, BINS), np.bincount(k, y, BINS), np.bincount(k, minlength=BINS)])

    x, y, w = total(labelled, bins, 3 * BINS).reshape(3, BINS)
    k = w > 0
    model.knots = isotonic(x[k] / w[k], y[k] / w[k], w[k])
    return model


def _score(model):
    def run(batches):
        m = model.value
        for b in batches:
            s = calibrated(m.raw(_matrix(b)), m.knots)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    return run


def train(docs: DataFrame, labels: DataFrame, training: Column, label: str = "quality") -> tuple[DataFrame, Model]:
    """(stats of all documents, model), learned from the labelled documents for which `training` (over doc_id) holds."""
    stats = materialize(docs.select("doc_id", "text").mapInArrow(_stats, "doc_id long, stats binary"), "stats")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    labelled = materialize(stats.filter(training).join(known, "doc_id").select("stats", "label"), "labelled")
    return stats, fit(stats, labelled)


def score(stats: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score)."""
    return stats.mapInArrow(_score(stats.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, training: Column, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose score is least or more."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    _, model = train(plain, labels, training)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        m = shared.value
        for b in batches:
            data, offs = buffers(b.column("text"))
            s = np.zeros(b.num_rows)
            for lo, hi, d, o in steps(data, offs):
                s[lo:hi] = calibrated(m.raw(statistics(d, o)), m.knots)
            yield b.filter(pa.array(s >= least))

    return docs.mapInArrow(rows, docs.schema)
