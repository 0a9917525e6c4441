"""Toxicity by compression distance: windows of a text are compressed with a toxic and with an ordinary dictionary.

Both zstandard dictionaries share a base of ordinary text; each ends with what its own class's training text says and the
other's does not (its recurring words, and beginnings of words, of highest contrast in document frequency, best last, where matches are cheapest). With the
same length and base, a window's two compressed lengths differ by what the dictionaries tell of it. A document's largest
savings, and how many windows save more than thresholds calibrated on the ordinary training rows, are calibrated by a logistic fit to a probability
with the labels' own share of toxic rows.

All windows of a whole text count. The dictionaries and the fit are learned from a bounded sample: at most TOXIC and
ORDINARY labelled training rows, those with the smallest hash of doc_id, of any length: terms and features are counted in
the executors, and only terms that recur, sketches, stretches and features come to the driver.
(zstandard's own trainer fills dictionaries with what all text shares, or repeats the same few words in every order; see
the README for its figures, cross-validated inside the training rows.)

Defined results: null, empty and blank texts have one empty window, and a score. Rows that repeat a doc_id are each
scored. Without training rows of both classes every score is the labels' share of toxic rows (0 without any). Null
labels are not learned from. Labels, lang, source and doc_id are not inputs of a score. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

WINDOW, STRIDE = 8, 6
LEVEL = 3
BASE_BYTES, OWN_BYTES = 32 * 1024, 800
TOXIC, ORDINARY = 1500, 3000
#: Least documents that a term of the contrast stands in, least length, least ratio to the documents expected from the
#: other class, least surplus over them in standard deviations.
LEAST_DOCS, LEAST_LENGTH, CONTRAST, SURPRISE = 4, 4, 5.0, 5.0
BEGINNINGS = (4, 5, 6, 7, 8)
#: The least savings that so many of the ordinary training documents reach in any window, at most.
REACHED = (0.3, 0.05, 0.01)
#: Savings are counted up to so many bytes.
MOST = 32
#: Windows compressed in one call.
BATCH = 20_000
#: Letters are kept, in lower case; all else is a space.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def plain(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_PLAIN).split()


def windows(words: list[bytes]) -> list[bytes]:
    return [b" " + b" ".join(words[i : i + WINDOW]) + b" " for i in range(0, max(1, len(words) - WINDOW + STRIDE), STRIDE)]


def terms(words: list[bytes]) -> set[bytes]:
    """The words and word beginnings that a contrast is looked for in."""
    return {b" " + w + b" " for w in words if len(w) >= LEAST_LENGTH} | {b" " + w[:k] for w in words for k in BEGINNINGS if len(w) > k}


def contrast(own: Counter, n_own: int, other: Counter, n_other: int) -> bytes:
    """Terms that recur in the own class's documents and not in the other's, the best (by surplus times length) last; none within another."""
    found = []
    for w, c in own.items():
        expected = n_own * (other[w] + 0.5) / n_other
        surprise = (c - expected) / (expected + 1) ** 0.5
        if c >= LEAST_DOCS and c >= CONTRAST * expected and surprise >= SURPRISE:
            found.append((surprise * len(w), w))
    kept: dict[bytes, int] = {}
    size = 0
    for _, w in sorted(found, reverse=True):
        if size >= OWN_BYTES:
            break
        # a beginning is of use only if it stands for more than the words kept so far
        if w.endswith(b" ") or own[w] > 1.5 * max([c for k, c in kept.items() if k.startswith(w)], default=0):
            kept[w] = own[w]
            size += len(w)
    return b"".join([*kept][::-1])[-OWN_BYTES:]


def low(words: list[bytes]) -> list[int]:
    """Four minwise word triples."""
    h = np.array([zlib.crc32(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))], np.uint64)
    return [int(((h * np.uint64(k)) & np.uint64(0xFFFFFFFF)).min()) for k in (2654435761, 2246822519, 3266489917, 668265263)]


def originals(lows: list[list[int]]) -> list[int]:
    """Numbers of the texts that are no near copies of earlier ones: copies share two of four minwise word triples."""
    seen: set[tuple[int, int]] = set()
    out = []
    for n, x in enumerate(lows):
        if sum(y in seen for y in enumerate(x)) < 2:
            out.append(n)
        seen.update(enumerate(x))
    return out


class Model:
    """Dictionaries and calibration; the compressors are made in each worker."""

    def __init__(self, share: float):
        self.share, self.toxic, self.ordinary = share, None, None
        self.mean = self.deviation = self.coef = None
        self.thresholds: tuple[int, ...] = ()
        self._made = None

    def __getstate__(self):
        return self.__dict__ | {"_made": None}

    def compressors(self):
        if self._made is None:
            import zstandard as z

            def make(d: bytes):
                p = z.ZstdCompressionParameters.from_level(LEVEL, source_size=100, dict_size=len(d), write_content_size=False, write_checksum=False, write_dict_id=False)
                return z.ZstdCompressor(compression_params=p, dict_data=z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT))

            self._made = make(self.ordinary), make(self.toxic)
        return self._made

    def savings(self, parts: list[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves in each window against the ordinary one."""

        def lengths(c):
            got = c.multi_compress_to_buffer(parts)
            return np.fromiter((len(got[i]) for i in range(len(got))), np.int64, len(got))

        a, b = (lengths(c) for c in self.compressors())
        return a - b

    def profiles(self, texts: list[str | None]) -> np.ndarray:
        """For each text: windows by savings (0 and less, 1, ... MOST and more), the three largest, their mean."""
        out, held, counts = [], [], []

        def done():
            d = self.savings(held)
            n = np.array(counts)
            cut = np.cumsum(n) - n
            doc = np.repeat(np.arange(len(n)), n)
            many = np.bincount(doc * (MOST + 1) + np.clip(d, 0, MOST), minlength=len(n) * (MOST + 1)).reshape(-1, MOST + 1)
            d = d[np.lexsort((-d, doc))]
            top = [np.where(n > k, d[np.minimum(cut + k, len(d) - 1)], -5) for k in range(3)]
            out.append(np.column_stack([many, *top, np.bincount(doc, d, len(n)) / n]))
            held.clear()
            counts.clear()

        for t in texts:
            w = windows(plain(t))
            held += w
            counts.append(len(w))
            if len(held) >= BATCH:
                done()
        if held:
            done()
        return np.concatenate(out) if out else np.zeros((0, MOST + 5))

    def features(self, profiles: np.ndarray) -> np.ndarray:
        """The largest savings, their mean, and the windows over each threshold."""
        many, rest = profiles[:, : MOST + 1], profiles[:, MOST + 1 :]
        over = [many[:, t:].sum(axis=1) for t in self.thresholds]
        return np.column_stack([rest, over[0] / np.sqrt(many.sum(axis=1)), *over[1:]])

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.coef is None:
            return np.full(len(texts), self.share)
        z = np.column_stack([(self.features(self.profiles(texts)) - self.mean) / self.deviation, np.ones(len(texts))])
        return 1 / (1 + np.exp(-np.clip(z @ self.coef, -30, 30)))


def _heads(each: int):
    def run(batches):
        for b in batches:
            for d, h, y, t in zip(*(b.column(c).to_pylist() for c in ("doc_id", "hash", "label", "text")), strict=True):
                words = plain(t)
                w = b" ".join(words)
                at = (len(w) - each) // 2 if len(w) > each else 0
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int64()), pa.array([h], pa.int64()), pa.array([y], pa.int32()), pa.array([low(words)], pa.list_(pa.int64())), pa.array([w[at : at + each]], pa.binary())], ["doc_id", "hash", "label", "low", "stretch"])

    return run


def _terms(batches):
    for b in batches:
        for y, t in zip(b.column("label").to_pylist(), b.column("text").to_pylist(), strict=True):
            w = [*terms(plain(t))]
            yield pa.RecordBatch.from_arrays([pa.array([y] * len(w), pa.int32()), pa.array(w, pa.binary())], ["label", "term"])


def fit(rows: DataFrame, share: float) -> Model:
    """Learned from rows (doc_id, hash, label, text)."""
    model = Model(share)
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not n.get(1) or not n.get(0):
        return model
    # a bounded stretch of ordinary training texts in order of a hash, up to the size of the base
    heads = rows.mapInArrow(_heads(max(64, BASE_BYTES // n[0])), "doc_id long, hash long, label int, low array<long>, stretch binary").collect()
    heads.sort(key=lambda r: (r["doc_id"], r["hash"]))
    once = {y: (lambda x: [x[i] for i in originals([r["low"] for r in x])])([r for r in heads if r["label"] == y]) for y in (0, 1)}
    chosen = rows.sparkSession.createDataFrame([(r["doc_id"], r["hash"]) for y in (0, 1) for r in once[y]], "doc_id long, hash long")
    counts = rows.dropDuplicates(["doc_id", "hash"]).join(F.broadcast(chosen), ["doc_id", "hash"]).select("label", "text").mapInArrow(_terms, "label int, term binary").groupBy("term").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("o"))
    # a term in fewer documents of either class is in no contrast
    found = counts.filter((F.col("t") >= LEAST_DOCS) | (F.col("o") >= LEAST_DOCS)).collect()
    t, o = Counter({bytes(r["term"]): r["t"] for r in found}), Counter({bytes(r["term"]): r["o"] for r in found})
    own = contrast(t, len(once[1]), o, len(once[0]))
    other = contrast(o, len(once[0]), t, len(once[1]))
    size = max(len(own), len(other))
    mixed = sorted((r for r in heads if r["label"] == 0), key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["hash"]))
    base = b" ".join(bytes(r["stretch"]) for r in mixed)[:BASE_BYTES]
    model.toxic, model.ordinary = base + own.rjust(size), base + other.rjust(size)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def features(batches):
        for b in batches:
            x = shared.value.profiles(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("hash"), b.column("label"), pa.array(x.tolist(), pa.list_(pa.float64()))], ["doc_id", "hash", "label", "x"])

    got = rows.mapInArrow(features, "doc_id long, hash long, label int, x array<double>").collect()
    got.sort(key=lambda r: (-r["label"], r["doc_id"], r["hash"]))
    x, y = np.array([r["x"] for r in got]), np.array([float(r["label"]) for r in got])
    top = np.clip(x[y == 0, MOST + 1], 0, MOST).astype(int)
    model.thresholds = tuple(next((t for t in range(1, MOST) if (top >= t).mean() <= r), MOST) for r in REACHED)
    x = model.features(x)
    model.mean, model.deviation = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - model.mean) / model.deviation, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    ridge = np.diag([*[0.01 * len(y) / 100] * (len(w) - 1), 1e-9])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge + 1e-9 * np.eye(len(w)), z.T @ (p - y) + ridge @ w)
    # the sample is richer in toxic rows than the labels are
    odds = lambda s: np.log(s / (1 - s))
    w[-1] += odds(min(max(share, 1e-6), 1 - 1e-6)) - odds(n[1] / len(y))
    model.coef = w
    return model


def train(docs: DataFrame, labels: DataFrame, training: Column, label: str = "toxic", most: tuple[int, int] = (TOXIC, ORDINARY)) -> Model:
    """Learned from the labelled documents for which `training` (over doc_id) holds, a bounded sample of them."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("label in (0, 1) and doc_id is not null").filter(training)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    n = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("ones")).first()
    order = F.xxhash64(F.lit(1), "doc_id")
    chosen = known.filter("label = 1").orderBy(order).limit(most[0]).union(known.filter("label = 0").orderBy(order).limit(most[1]))
    # at most sum(most) ids are broadcast
    rows = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "hash", "label", "text")
    return fit(materialize(rows, "training"), n["ones"] / n["n"] if n["n"] else 0.0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            ids, col = b.column("doc_id"), b.column("text")
            for lo in range(0, b.num_rows, 512):
                part = col[lo : lo + 512].to_pylist()
                yield pa.RecordBatch.from_arrays([ids[lo : lo + 512], pa.array(m.score(part))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
