"""LM scoring: marginal likelihood of texts over all segmentations of a subword lattice.

A text is a stream of pieces of an existing vocabulary (with byte pieces for what it lacks) and an end. Its probability
sums over all segmentations of its words by a forward recursion in log space. A piece's weight is a mixture: one part
falls with its score in the vocabulary file, the other (ADAPT) is its expected count over the training tokens under the
file's weights (forward-backward). The chance of an end after a piece is that of the training rows. All logarithms
returned are to base 10.

Distribution: each task sends its distinct words once (with counts over training rows), counts are summed by word, so no
frequent word is a hot key. Texts are dealt to buckets of about BUCKET_BYTES, rows that repeat each by themselves; a
bucket is scored with its own small dictionary. Frequent words stand in nearly all buckets: their counts and likelihoods
are broadcast (at most FREQUENT words of 24 bytes, whatever the corpus, as each is a FREQUENT-th part of the tokens), and
only a bucket's other distinct words fetch theirs by a join on the word. Nothing that grows with the corpus is broadcast
or collected; the vocabulary (a file) is.

Defined results: null and empty texts are the end alone. Repeated rows are each counted and scored. Without training rows
N and V are 0, every count is 0, the pieces keep the file's weights and the end has the chance 1/2. A null doc_id is a
training row. A word of any length and any bytes is scored whole. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import partitions
from .kernels import U, Words, buffers, mix, steps
from .sums import total

#: Words of up to so many bytes are scored in matrices; longer ones one by one.
WIDE = 64
#: Share of the pieces' weights that comes from their expected counts in the training rows; the rest is the file's.
ADAPT = 0.5
#: Bytes of texts of a bucket.
BUCKET_BYTES = 4_000_000
#: A word that is at least the FREQUENT-th part of all tokens is frequent, so there are at most so many.
FREQUENT = 50_000
#: Bytes of a long word whose arcs are held at once.
STRETCH = 4096
START = b"\xe2\x96\x81"
#: Stands for the start mark: no byte of UTF-8.
MARK = b"\xff"


class Lattice:
    """Piece log probabilities and the recursions over them."""

    def __init__(self, path: str, log_p: np.ndarray | None = None):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces: dict[bytes, float] = {}
        for i in range(sp.get_piece_size()):
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i):
                continue
            p = sp.id_to_piece(i).encode()
            # a word begins with one start mark, which counts as its first byte
            p = MARK + p[3:] if p.startswith(START) else p
            if p and START not in p:
                pieces[p] = max(pieces.get(p, -np.inf), sp.get_score(i))
        for b in range(256):
            pieces.setdefault(bytes([b]), -np.inf)
        self.pieces = sorted(pieces)
        self.longest = max(map(len, self.pieces))
        self.byte = _bytes(self.longest)
        hashes = np.array([self._hash(p) for p in self.pieces], U)
        o = np.argsort(hashes)
        self.hashes, self.pieces = hashes[o], [self.pieces[i] for i in o]
        if log_p is None:
            # scores are minus ranks: a piece's first weight falls with its rank, as frequencies of words do
            rank = np.array([-pieces[p] if np.isfinite(pieces[p]) else len(self.pieces) * 4.0 for p in self.pieces])
            weight = 1 / (np.minimum(rank, len(self.pieces) * 4.0) + 3)
            log_p = np.log(weight / weight.sum())
        self.log_p = log_p

    def _hash(self, p: bytes) -> int:
        h = 0
        for k, c in enumerate(p):
            h = (h + int(self.byte[k, c])) & 0xFFFFFFFFFFFFFFFF
        return h

    def _arcs(self, m: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For words as rows of bytes: the piece number of each (word, start, length), -1 if none, and log probabilities."""
        rows, width = m.shape
        number = np.full((rows, width, min(self.longest, width)), -1, np.int32)
        h = np.zeros((rows, width), U)
        for k in range(number.shape[2]):
            live = width - k
            h = h[:, :live] + self.byte[k][m[:, k:]]
            at = np.searchsorted(self.hashes, h)
            at[at == len(self.hashes)] = 0
            ok = (self.hashes[at] == h) & (np.arange(live)[None, :] + k < n[:, None])
            number[:, :live, k] = np.where(ok, at, -1)
        return number, np.where(number >= 0, self.log_p[number], -np.inf)

    def _matrix(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        n = np.array([len(w) + 1 for w in words])
        m = np.zeros((len(words), int(n.max())), np.uint8)
        m[:, 0] = MARK[0]
        for i, w in enumerate(words):
            m[i, 1 : len(w) + 1] = np.frombuffer(w, np.uint8)
        return m, n

    def forward(self, words: list[bytes], backward: bool = False):
        """log probability of each word; with backward also the expected number of each piece in each word's arcs."""
        m, n = self._matrix(words)
        number, lp = self._arcs(m, n)
        rows, width, longest = number.shape
        alpha = np.full((rows, width + 1), -np.inf)
        alpha[:, 0] = 0
        with np.errstate(divide="ignore", invalid="ignore"):
            for j in range(1, width + 1):
                k = np.arange(min(j, longest))
                x = alpha[:, j - 1 - k] + lp[:, j - 1 - k, k]
                top = x.max(axis=1)
                alpha[:, j] = np.where(np.isfinite(top), top + np.log(np.exp(x - np.where(np.isfinite(top), top, 0)[:, None]).sum(axis=1)), -np.inf)
            z = alpha[np.arange(rows), n]
            if not backward:
                return z
            beta = np.full((rows, width + 1 + longest), -np.inf)
            beta[np.arange(rows), n] = 0
            for j in range(width - 1, -1, -1):
                x = lp[:, j, :] + beta[:, j + 1 : j + 1 + longest]
                top = x.max(axis=1)
                own = np.where(np.isfinite(top), top + np.log(np.exp(x - np.where(np.isfinite(top), top, 0)[:, None]).sum(axis=1)), -np.inf)
                beta[:, j] = np.where(j < n, own, beta[:, j])
        return z, number, lp, alpha, beta

    def log_likelihood(self, words: list[bytes]) -> np.ndarray:
        """Natural logarithm of each word's marginal probability."""
        out = np.zeros(len(words))
        for part in _by_length(words):
            if len(words[part[0]]) <= WIDE:
                out[part] = self.forward([words[i] for i in part])
            else:
                for i in part:
                    out[i] = self._long(words[i])
        return out

    def _stretches(self, w: bytes, backward: bool = False):
        """(start, end, numbers, log probabilities) of the arcs that begin in each stretch of a long word."""
        for at in sorted(range(0, len(w), STRETCH), reverse=backward):
            part = np.frombuffer(w[at : at + STRETCH + self.longest], np.uint8)[None, :]
            number, lp = self._arcs(part, np.array([part.shape[1]]))
            yield at, min(len(w), at + STRETCH), number[0], lp[0]

    def _alpha(self, w: bytes) -> np.ndarray:
        alpha = np.full(len(w) + 1, -np.inf)
        alpha[0] = 0
        for at, end, _, lp in self._stretches(w):
            for i in range(at, end):
                k = np.arange(min(lp.shape[1], len(w) - i))
                alpha[i + 1 + k] = np.logaddexp(alpha[i + 1 + k], alpha[i] + lp[i - at, k])
        return alpha

    def _long(self, word: bytes) -> float:
        """The recursion over one long word, in stretches of bounded memory."""
        return float(self._alpha(MARK + word)[-1])

    def _long_expected(self, word: bytes, count: float, out: np.ndarray) -> None:
        """Adds the expected counts over one long word."""
        w = MARK + word
        alpha, beta = self._alpha(w), np.full(len(w) + 1, -np.inf)
        beta[-1] = 0
        for at, end, number, lp in self._stretches(w, backward=True):
            for i in range(end - 1, at - 1, -1):
                k = np.arange(min(lp.shape[1], len(w) - i))
                x = lp[i - at, k] + beta[i + 1 + k]
                beta[i] = np.logaddexp.reduce(x)
                ok = number[i - at, k] >= 0
                np.add.at(out, number[i - at, k][ok], count * np.exp(alpha[i] + x[ok] - alpha[-1]))

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces over words that occur so often."""
        out = np.zeros(len(self.pieces))
        for part in _by_length(words):
            if len(words[part[0]]) > WIDE:
                for i in part:
                    self._long_expected(words[i], float(counts[i]), out)
                continue
            z, number, lp, alpha, beta = self.forward([words[i] for i in part], backward=True)
            width = number.shape[1]
            for k in range(number.shape[2]):
                live = width - k
                with np.errstate(invalid="ignore"):
                    p = np.exp(alpha[:, :live] + lp[:, :live, k] + beta[:, k + 1 : k + 1 + live] - z[:, None])
                ok = number[:, :live, k] >= 0
                np.add.at(out, number[:, :live, k][ok], (p * counts[part][:, None])[ok])
        return out


def _bytes(longest: int) -> np.ndarray:
    """A number for each byte at each place of a piece."""
    return mix((np.arange(256, dtype=np.uint64)[None, :] + (np.arange(longest, dtype=np.uint64)[:, None] << U(8)) + U(1)) * U(0x9E3779B97F4A7C15))


def _by_length(words: list[bytes], most: int = 2048):
    """Numbers of words in groups of like length."""
    n = np.array([len(w) for w in words])
    o = np.argsort(n, kind="stable")
    at = 0
    while at < len(o):
        size = max(1, min(most, 100_000 // (int(n[o[at]]) + 8)))
        if n[o[at]] <= WIDE:
            end = min(at + size, int(np.searchsorted(n[o], WIDE, "right")))
        else:
            end = at + 1
        yield o[at:end]
        at = end


def _words(batches):
    """Distinct words of each task's steps with their number among training rows (c) and among all (every)."""
    held: dict[int, list] = {}

    def out():
        w = list(held.values())
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in w], pa.binary()), pa.array([x[1] for x in w], pa.int64()), pa.array([x[2] for x in w], pa.int64())], ["word", "c", "every"])

    for batch in batches:
        data, offs = buffers(batch.column("text"))
        training = batch.column("training").to_numpy(zero_copy_only=False)
        for lo, hi, d, o in steps(data, offs):
            w = Words(d, o, lower=True)
            h, first, inverse, every = np.unique(w.hash, return_index=True, return_inverse=True, return_counts=True)
            c = np.bincount(inverse.reshape(-1), training[lo:hi][w.doc].astype(float), len(h)).astype(np.int64)
            raw = w.data.tobytes()
            for x, n, m, i in zip(h.tolist(), c.tolist(), every.tolist(), first.tolist(), strict=True):
                if (got := held.get(x)) is not None:
                    got[1] += n
                    got[2] += m
                else:
                    held[x] = [raw[w.start[i] : w.end[i]], n, m]
            if len(held) > 300_000:
                yield out()
    if held:
        yield out()


def _bucket_words(frequent):
    """Distinct words of each bucket that are not frequent, as hashes; rows come sorted by bucket."""

    def out(bucket, held):
        h = np.setdiff1d(np.concatenate(held), frequent.value[0])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), bucket, np.int64)), pa.array(h.view(np.int64))], ["bucket", "hash"])

    def run(batches):
        bucket, held = None, []
        for batch in batches:
            b = batch.column("bucket").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]]))
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if b[i] != bucket and held:
                    yield out(bucket, held)
                    held = []
                bucket = int(b[i])
                data, offs = buffers(batch.column("text").slice(i, j - i))
                for _, _, d, o in steps(data, offs):
                    held.append(np.unique(Words(d, o, lower=True).hash))
        if held:
            yield out(bucket, held)

    return run


def word_hash(col: pa.Array) -> np.ndarray:
    """The kernel's hash of words that stand alone."""
    col = col.cast(pa.large_binary())
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    return Words(np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]).hash


SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def adapted(file: np.ndarray, counts: np.ndarray, ends: int, adapt: float) -> tuple[np.ndarray, float]:
    """(natural log weights of the pieces, of the end): file holds the file's log weights, counts the expected counts."""
    seen = counts.sum()
    weight = np.exp(file)
    if seen:
        weight = (1 - adapt) * weight + adapt * counts / seen
    end = ends / (seen + ends) if ends else 0.5
    return np.log(weight) + np.log1p(-min(end, 0.5)), float(np.log(min(end, 0.5)))


def score(docs: DataFrame, training: Column, vocabulary: str, adapt: float = ADAPT, place: str | None = None) -> tuple[DataFrame, int, int]:
    """((doc_id, n_tokens, n_known, base_score, score), N, V): docs has doc_id and text, training is a boolean over doc_id.

    place: a column of docs that tells rows that repeat apart and stays the same however often docs is computed, such as a
    row's place in its file. Without one docs is written first, and the places are those of what was written.
    """
    spark = docs.sparkSession
    if place is None:
        docs, place = materialize(docs.select("doc_id", "text"), "documents").select("doc_id", "text", F.col("_metadata.row_index").alias("place")), "place"
    lattice = Lattice(vocabulary)
    rows = docs.select("doc_id", "text", training.alias("training"))
    # tasks have summed their own words; the partitions are many, as each word costs time afterwards
    told = rows.select("text", "training").mapInArrow(_words, "word binary, c long, every long").repartition(4 * partitions(spark), "word")
    words = materialize(told.groupBy("word").agg(F.sum("c").alias("c"), F.sum("every").alias("every")), "words")
    size = rows.agg(F.count_if("training").alias("ends"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    ends = size["ends"]
    m = words.agg(F.count_if(F.col("c") > 0).alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum("every"), F.lit(0)).alias("every")).first()
    n, v = m["n"] + ends, m["v"] + (ends > 0)
    shared = spark.sparkContext.broadcast(lattice)

    def expectations(b):
        return shared.value.expected(b.column("word").to_pylist(), b.column("c").to_numpy().astype(float))

    counted = total(words.filter("c > 0"), expectations, len(lattice.pieces))
    log_p, end = adapted(lattice.log_p, counted, ends, adapt)
    model = spark.sparkContext.broadcast(Lattice(vocabulary, log_p))
    end_log = end / np.log(10)

    def lookup(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 20_000):
                part = b.slice(lo, 20_000)
                lp = model.value.log_likelihood(part.column("word").to_pylist()) / np.log(10)
                yield pa.RecordBatch.from_arrays([pa.array(word_hash(part.column("word")).view(np.int64)), part.column("c"), pa.array(lp)], ["hash", "c", "lp"])

    # at most FREQUENT rows
    often = F.col("every") * FREQUENT >= m["every"]
    top = words.filter(often).mapInArrow(lookup, "hash long, c long, lp double").collect()
    top = np.array([r["hash"] for r in top], np.int64).view(U), np.array([float(r["c"]) for r in top]), np.array([r["lp"] for r in top], float)
    frequent = spark.sparkContext.broadcast(top)
    known = words.filter(~often).mapInArrow(lookup, "hash long, c long, lp double")
    buckets = max(4 * partitions(spark), -(-size["bytes"] // BUCKET_BYTES))
    # rows that repeat are dealt apart, in the same way whenever a task is run again
    bucket = F.pmod(F.xxhash64("doc_id", "text", place), F.lit(buckets)).cast("long")
    dealt = docs.select("doc_id", "text", bucket.alias("bucket")).repartition(max(partitions(spark), buckets // 4), "bucket")
    # both readers take all columns of one exchange, so it is made once
    need = dealt.sortWithinPartitions("bucket").mapInArrow(_bucket_words(frequent), "bucket long, hash long")
    own = need.join(known.hint("merge"), "hash").select("bucket", "hash", "c", "lp")
    end_base = np.log10((ends + 1) / (n + v + 1))

    def scored(key, texts: pa.Table, dictionary: pa.Table) -> pa.Table:
        own_words = dictionary.column("hash").to_numpy().view(U), dictionary.column("c").to_numpy().astype(float), dictionary.column("lp").to_numpy()
        h, c, lp = (np.concatenate(x) for x in zip(frequent.value, own_words, strict=True))
        o = np.argsort(h)
        h, c, lp = h[o], c[o], lp[o]
        base = np.log10((c + 1) / (n + v + 1))
        out = []
        for batch in texts.to_batches():
            data, offs = buffers(batch.column("text"))
            for lo, hi, d, off in steps(data, offs):
                w, k = Words(d, off, lower=True), hi - lo
                at = np.searchsorted(h, w.hash)
                if len(w) and not (len(h) and (h[np.minimum(at, len(h) - 1)] == w.hash).all()):
                    raise RuntimeError("a bucket's dictionary lacks a word of its texts")
                tokens = np.bincount(w.doc, minlength=k) + 1
                seen = np.bincount(w.doc, c[at] > 0, k).astype(np.int64) + (ends > 0)
                out.append(pa.table({"doc_id": batch.column("doc_id")[lo:hi], "n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(seen, pa.int64()), "base_score": np.bincount(w.doc, base[at], k) + end_base, "score": np.bincount(w.doc, lp[at], k) + end_log}))
        return pa.concat_tables(out) if out else pa.table({"doc_id": pa.array([], pa.int64()), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})

    return dealt.groupBy("bucket").cogroup(own.groupBy("bucket")).applyInArrow(scored, SCORES), n, v
