"""Language ID: nearest of several clustered centroids per language, over TF-IDF vectors of character n-grams.

Vectors: bigrams and trigrams of a text's lower-cased letters (UTF-8 bytes; all else is a space), hashed to DIMENSIONS
places, log counts times inverse document frequency, of length 1. Document frequencies and the final centroids are
partition sums over all training documents; only the first guess of the centroids (spherical k-means) is made on a
sample, of about SAMPLE documents per language, chosen by a hash of doc_id. A text further from its
nearest centroid than all but REJECT of that centroid's training documents is marked as rejected; its prediction stays.

Defined results: a null text, and one without a letter, is `und` with score 0; so is every text when there is no
training row. Rows with null lang are not learned from, but predicted. Rows that repeat a doc_id are each predicted. At equal cosine the language
that sorts first wins. lang, source and doc_id are not inputs of a prediction. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import _LOWER, U, buffers, mix, steps
from .sums import total

DIMENSIONS = 4096
CENTROIDS = 4
SAMPLE = 400
REJECT = 0.001
BINS = 1000
#: Documents of which dense vectors are held at once.
ROWS = 256
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def grams(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Counts of hashed n-grams, a row a document."""
    n = len(offs) - 1
    x = _LOWER[data]
    upper = np.zeros(len(x), bool)
    upper[1:] = (x[:-1] == 0xC3) & (x[1:] >= 0x80) & (x[1:] < 0x9F)
    x = np.where(upper, x + 32, x)
    x = np.where(_LETTER[x], x, 32)
    lens = np.diff(offs)
    doc = np.repeat(np.arange(n), lens + 2)
    at = np.arange(len(x)) + 2 * np.repeat(np.arange(n), lens) + 1  # a space on both sides of each text
    y = np.full(len(x) + 2 * n, 32, U)
    y[at] = x
    two = y[:-1] << U(8) | y[1:]
    ok2 = (doc[:-1] == doc[1:]) & (two != 0x2020)
    three = two[:-1] << U(8) | y[2:]
    ok3 = ok2[:-1] & ok2[1:]
    place = lambda g: (mix(g * U(0x9E3779B97F4A7C15)) >> U(40)).astype(np.int64) % DIMENSIONS
    k = np.concatenate([doc[:-1][ok2] * DIMENSIONS + place(two[ok2]), doc[:-2][ok3] * DIMENSIONS + place(three[ok3] | U(1 << 32))])
    return np.bincount(k, minlength=n * DIMENSIONS).reshape(n, DIMENSIONS)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts).astype(np.float32) * idf.astype(np.float32)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def parts(batch):
    """(first, last, counts) over a batch, at most ROWS documents at once."""
    data, offs = buffers(batch.column("text"))
    for lo, hi, d, o in steps(data, offs):
        for a in range(0, hi - lo, ROWS):
            b = min(hi - lo, a + ROWS)
            yield lo + a, lo + b, grams(d[o[a] : o[b]], o[a : b + 1] - o[a])


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


class Model:
    def __init__(self, langs: list[str]):
        self.langs, self.idf = langs, np.ones(DIMENSIONS)
        self.centroids, self.owner = np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, np.int64)
        self.least = np.zeros(0)

    def cosines(self, counts: np.ndarray) -> np.ndarray:
        return vectors(counts, self.idf) @ self.centroids.T


def _kmeans(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; the first centres are those furthest from all before."""
    c = [v.mean(axis=0)]
    while len(c) < min(k, len(v)):
        c.append(v[int(np.argmin((v @ np.array(c).T).max(axis=1)))])
    c = np.array(c)
    for _ in range(rounds):
        own = np.argmax(v @ c.T, axis=1)
        c = np.array([v[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def train(docs: DataFrame, training: Column) -> Model:
    """Learned from doc_id, text and lang of the rows for which `training` holds."""
    rows = docs.filter(training).filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    count = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    model = Model(sorted(count))
    if not count:
        return model
    number = {x: i for i, x in enumerate(model.langs)}
    df = total(rows.select("text"), lambda b: sum(((c > 0).sum(axis=0) for _, _, c in parts(b)), np.zeros(DIMENSIONS)), DIMENSIONS)
    model.idf = np.log((1 + sum(count.values())) / (1 + df)) + 0.1
    share = F.coalesce(*[F.when(F.col("lang") == x, min(1.0, SAMPLE / n)) for x, n in count.items()])
    # by content, whatever partitions the rows are in; rows that repeat are one of the sample; rare languages are taken whole
    chosen = rows.filter(F.pmod(F.xxhash64(F.lit(9), "doc_id", "text"), F.lit(1_000_000)) < share * 1_000_000).dropDuplicates(["doc_id", "text", "lang"])

    def sample(batches):
        for b in batches:
            for lo, hi, c in parts(b):
                yield pa.RecordBatch.from_arrays([b.column("lang")[lo:hi], pa.array([x.astype(np.float16).tobytes() for x in vectors(c, model.idf)], pa.binary())], ["lang", "v"])

    got = sorted(map(tuple, chosen.select("text", "lang").mapInArrow(sample, "lang string, v binary").collect()))  # about SAMPLE a language
    centres, owner = [], []
    for x in model.langs:
        v = np.array([np.frombuffer(v, np.float16) for lang, v in got if lang == x], np.float32).reshape(-1, DIMENSIONS)
        if len(v):
            centres.append(_kmeans(v, CENTROIDS))
            owner += [number[x]] * len(centres[-1])
    model.centroids, model.owner = (np.concatenate(centres) if centres else model.centroids), np.array(owner, np.int64)
    k = len(model.owner)
    if not k:
        return model

    def assign(b):
        """Sums of each centroid's own documents, and histograms of their cosines."""
        out, hist = np.zeros((k, DIMENSIONS)), np.zeros((k, BINS))
        lang = np.array([number[x] for x in b.column("lang").to_pylist()], np.int64)
        for lo, hi, c in parts(b):
            v = vectors(c, model.idf)
            s = np.where(model.owner[None, :] == lang[lo:hi, None], v @ model.centroids.T, -2)
            has = s.max(axis=1) > -2  # the sample held a document of the language
            s, v = s[has], v[has]
            own = s.argmax(axis=1)
            for i in np.unique(own):
                out[i] += v[own == i].sum(axis=0)
            np.add.at(hist, (own, np.clip((s.max(axis=1) * BINS).astype(int), 0, BINS - 1)), 1)
        return np.concatenate([out.reshape(-1), hist.reshape(-1)])

    s = total(rows.select("text", "lang"), assign, k * (DIMENSIONS + BINS))
    sums, hist = s[: k * DIMENSIONS].reshape(k, DIMENSIONS), s[k * DIMENSIONS :].reshape(k, BINS)
    full = hist.sum(axis=1) > 0
    model.centroids[full] = (sums[full] / np.maximum(np.linalg.norm(sums[full], axis=1, keepdims=True), 1e-12)).astype(np.float32)
    share = np.cumsum(hist, axis=1) / np.maximum(hist.sum(axis=1, keepdims=True), 1)
    model.least = (share < REJECT).sum(axis=1) / BINS
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            col = b.column("text")
            for lo, hi, c in parts(b):
                lang, score, far = ["und"] * (hi - lo), np.zeros(hi - lo), np.zeros(hi - lo, bool)
                if len(m.owner):
                    s = m.cosines(c)
                    best = s.argmax(axis=1)
                    score = np.clip(s.max(axis=1).astype(float), 0, 1)
                    far = score < m.least[best]
                    for i, t in enumerate(col[lo:hi].to_pylist()):
                        if has_letter(t):
                            lang[i] = m.langs[m.owner[best[i]]]
                        else:
                            score[i], far[i] = 0, True
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[lo:hi], pa.array(lang), pa.array(score), pa.array(far)], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
