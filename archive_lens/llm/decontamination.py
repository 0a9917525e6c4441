"""Benchmark decontamination: every passage queries a BM25 inverted index of test items by block-max WAND.

An item's BM25 impacts are divided by its score for itself, so a passage that holds all of an item scores 1. Postings
are sorted by item and cut into blocks that know their largest impact. For all passages of a step at once, the largest
impacts of whole lists, then of coarse blocks, bound the scores; passages that may reach the threshold go through the
index with the pivoting of block-max WAND, which returns all items above the threshold. A hit is then verified: enough
word trigrams of the item's question and of its answer must stand in the passage (an item is parted at its last
"answer" mark or question mark, else after two thirds of its words).

Passages are overlapping windows of words: each is twice as long as the longest item of the index and starts half of
that after the one before, so every item lies whole in one passage. Document frequencies are counted over all items. The
index is parted into shards of at most about SHARD_ITEMS items and SHARD_CHARS characters, built in executors; one shard is
broadcast at a time and documents are read once for each.

Defined results: null and empty texts and items match nothing; rows that repeat an item_id are items of their own (the
best overlap counts); repeated documents are each reported; a null item_id or doc_id stays null. No items: no hits.
Extra columns are not read.
"""

from __future__ import annotations

import pickle
import re
import uuid
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .kernels import U, Words, buffers, gram_hashes, steps

K1, B = 1.2, 0.75
THRESHOLD = 0.5
OVERLAP = 0.6
GRAM = 3
BLOCK = 8
#: Coarse blocks over all items whose bounds are taken for many passages at once.
COARSE = 64
SHARD_ITEMS = 20_000
#: Characters of items in a shard.
SHARD_CHARS = 16_000_000
ANSWER = re.compile(r"(?i)\banswer\s*:|\?")


def terms(text: str) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return Words(raw, np.array([0, len(raw)]), lower=True, bare=True).hash


def gram_set(h: np.ndarray) -> np.ndarray:
    return np.unique(gram_hashes(h, min(GRAM, len(h)))) if len(h) else np.zeros(0, U)


class Index:
    """The inverted index of some items; df and n over all items."""

    def __init__(self, ids: list, texts: list[str], df: dict[int, int], n: int, mean: float):
        self.ids, self.words = ids, [terms(t) for t in texts]
        self.parts = []
        lists: dict[int, list[tuple[int, float]]] = {}
        for i, (text, w) in enumerate(zip(texts, self.words, strict=True)):
            cut = max((m.end() for m in ANSWER.finditer(text or "")), default=0)
            q = len(terms(text[:cut])) if cut else 0
            if not 0 < q < len(w):
                q = -(-2 * len(w) // 3)
            self.parts.append((gram_set(w[:q]), gram_set(w[q:])))
            t, tf = np.unique(w, return_counts=True)
            d = np.array([df.get(int(x), 1) for x in t], float)
            impact = np.log(1 + (n - d + 0.5) / (d + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean))
            for x, v in zip(t.tolist(), (impact / max(impact.sum(), 1e-12)).tolist(), strict=True):
                lists.setdefault(x, []).append((i, v))
        self.terms = np.array(sorted(lists), U)
        self.items = [np.array([i for i, _ in lists[int(t)]]) for t in self.terms]
        self.impacts = [np.array([v for _, v in lists[int(t)]]) for t in self.terms]
        self.most = np.array([v.max() for v in self.impacts])
        self.block = [np.maximum.reduceat(v, np.arange(0, len(v), BLOCK)) for v in self.impacts]
        self.item_lists, self.impact_lists = [x.tolist() for x in self.items], [x.tolist() for x in self.impacts]
        self.block_lists, self.most_list = [x.tolist() for x in self.block], self.most.tolist()
        self.per = max(1, -(-len(ids) // COARSE))
        self.coarse = np.zeros((len(self.terms), COARSE), np.float32)
        for t, (i, v) in enumerate(zip(self.items, self.impacts, strict=True)):
            np.maximum.at(self.coarse[t], i // self.per, v.astype(np.float32))
        longest = max([len(w) for w in self.words], default=0)
        self.half = max(32, longest)

    def search(self, query: np.ndarray, least: float, alive: np.ndarray | None = None) -> list[tuple[int, float]]:
        """Block-max WAND: all items whose score for the (distinct) term numbers of query is least or more.

        alive tells which coarse blocks of items may hold one; all others are passed over at once.
        """
        items, impacts, block, most, end = self.item_lists, self.impact_lists, self.block_lists, self.most_list, len(self.ids)
        lists = query.tolist()
        at, found, nxt = dict.fromkeys(lists, 0), [], 0
        starts = None if alive is None else [b * self.per for b in np.flatnonzero(alive).tolist()]
        while True:
            if starts is not None:  # to the next block that is alive
                k = bisect_right(starts, nxt) - 1
                if k < 0 or nxt >= starts[k] + self.per:
                    if k + 1 == len(starts):
                        return found
                    nxt = starts[k + 1]
            heads = []
            for t in lists:
                own = items[t]
                j = at[t]
                if j < len(own) and own[j] < nxt:
                    j = at[t] = bisect_left(own, nxt, j)
                if j < len(own):
                    heads.append((own[j], t))
            heads.sort()
            bound, pivot = 0.0, -1
            for k, (i, t) in enumerate(heads):
                bound += most[t]
                if bound >= least:
                    pivot = i
                    while k + 1 < len(heads) and heads[k + 1][0] == pivot:
                        k += 1
                    break
            if pivot < 0:
                return found
            if starts is not None:
                s = bisect_right(starts, pivot) - 1
                if s < 0 or pivot >= starts[s] + self.per:
                    nxt = pivot
                    continue
            # bounds of the blocks that the pivot would stand in
            bound, skip = 0.0, end
            for _, t in heads[: k + 1]:
                own = items[t]
                j = bisect_left(own, pivot, at[t])
                if j < len(own):
                    bound += block[t][j // BLOCK]
                    skip = min(skip, own[min((j // BLOCK + 1) * BLOCK, len(own)) - 1] + 1)
            if bound < least:
                if k + 1 < len(heads):
                    skip = min(skip, heads[k + 1][0])
                nxt = max(skip, pivot + 1)
                continue
            score = 0.0
            for _, t in heads[: k + 1]:
                own = items[t]
                j = at[t] = bisect_left(own, pivot, at[t])
                if j < len(own) and own[j] == pivot:
                    score += impacts[t][j]
            if score >= least:
                found.append((pivot, score))
            nxt = pivot + 1

    def hits(self, w: Words, n: int, least: float, overlap: float) -> dict[tuple[int, int], tuple[float, float, float]]:
        """{(document, item): (score, question overlap, answer overlap)} of the best passages."""
        out: dict[tuple[int, int], tuple[float, float, float]] = {}
        if not len(self.terms) or not len(w):
            return out
        k = np.searchsorted(self.terms, w.hash)
        k[k == len(self.terms)] = 0
        at = np.flatnonzero(self.terms[k] == w.hash)
        counts = np.diff(w.first)
        halves = np.maximum(1, -(-counts // self.half))
        base = np.cumsum(halves) - halves
        doc = np.repeat(np.arange(n), halves)
        start = w.first[doc] + (np.arange(len(doc)) - base[doc]) * self.half
        d = w.doc[at]
        half = base[d] + (at - w.first[d]) // self.half
        key = np.unique(half << 32 | k[at])  # distinct terms of each half passage
        half, term = key >> 32, key & 0xFFFFFFFF
        # a passage is two halves; bounds of halves add up to bounds of passages: first by whole lists, then by blocks
        follows = np.append(doc[1:] == doc[:-1], False)
        whole = np.bincount(half, self.most[term], len(doc))
        whole[follows] += np.bincount(half, self.most[term], len(doc))[1:][follows[:-1]]
        open_ = whole >= least - 1e-6
        open_[1:] |= open_[:-1] & follows[:-1]
        own = open_[half]
        half, term = half[own], term[own]
        bound = np.zeros((len(doc), COARSE), np.float32)
        if len(half):
            cut = np.flatnonzero(np.concatenate([[True], half[1:] != half[:-1]]))
            bound[half[cut]] = np.add.reduceat(self.coarse[term], cut, axis=0)
        second = np.zeros_like(bound)
        second[:-1][follows[:-1]] = bound[1:][follows[:-1]]
        may = np.flatnonzero((bound + second).max(axis=1) >= least - 1e-4)
        first_key = np.searchsorted(half, np.arange(len(doc) + 1))
        end = np.minimum(start + 2 * self.half, w.first[doc + 1])
        for p in may.tolist():
            q = np.unique(term[first_key[p] : first_key[p + 2 if follows[p] else p + 1]])
            alive = self.coarse[q].sum(axis=0) >= least - 1e-4
            if not alive.any():
                continue
            got = self.search(q, least, alive)
            if not got:
                continue
            grams = np.unique(np.concatenate([gram_hashes(w.hash[start[p] : end[p]], g) for g in range(1, GRAM + 1)]))
            for i, s in got:
                share = [float(np.isin(g, grams).mean()) if len(g) else 1.0 for g in self.parts[i]]
                if min(share) >= overlap and (s, *share) > out.get((int(doc[p]), i), (0.0,)):
                    out[int(doc[p]), i] = (s, *share)
        return out


def _counts(batches):
    for b in batches:
        data, offs = buffers(b.column("text"))
        shard = b.column("shard").to_numpy()
        for lo, hi, d, o in steps(data, offs):
            w = Words(d, o, lower=True, bare=True)
            key = np.unique(np.rec.fromarrays([shard[lo:hi][w.doc], w.doc, w.hash.view(np.int64)]))
            yield pa.RecordBatch.from_arrays([pa.array(key["f0"], pa.int64()), pa.array(key["f2"], pa.int64()), pa.array(np.ones(len(key), np.int64))], ["shard", "term", "n"])


def _sizes(batches):
    """Items, characters and words, words as the index takes them."""
    for b in batches:
        data, offs = buffers(b.column("text"))
        words = sum(len(Words(d, o, lower=True, bare=True)) for _, _, d, o in steps(data, offs))
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (b.num_rows, len(data), words)], ["n", "chars", "words"])


def _build(n: int, mean: float):
    """The index of each shard, whose items and document frequencies come together."""

    def build(key, items: pa.Table, df: pa.Table) -> pa.Table:
        held = dict(zip(df.column("term").to_numpy().view(U).tolist(), df.column("df").to_pylist(), strict=True))
        rows = sorted(zip(items.column("item_id").to_pylist(), items.column("text").to_pylist(), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        index = Index([r[0] for r in rows], [r[1] for r in rows], held, n, mean)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "payload": pa.array([pickle.dumps(index)], pa.binary())})

    return build


def indexes(items: DataFrame):
    """(number of shards, shard) of a table (item_id, text), one after another, each as a key and a broadcast.

    Shards are built in executors from bounded numbers of items and characters and stand in the shared folder; the driver
    passes on one at a time.
    """
    spark = items.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    m = items.mapInArrow(_sizes, "n long, chars long, words long").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.sum("words").alias("words")).first()
    if not m["n"]:
        return
    shards = max(-(-m["n"] // SHARD_ITEMS), -(-m["chars"] // SHARD_CHARS))
    numbered = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)))
    told = numbered.mapInArrow(_counts, "shard long, term long, n long")
    df = told.groupBy("term").agg(F.sum("n").alias("df"), F.collect_set("shard").alias("shards"))  # at most `shards` numbers a term
    need = df.select(F.explode("shards").alias("shard"), "term", "df")
    built = numbered.groupBy("shard").cogroup(need.groupBy("shard")).applyInArrow(_build(m["n"], max(m["words"] / m["n"], 1e-9)), "shard long, payload binary")
    held = materialize(built, "index")
    for s in range(shards):
        got = held.filter(F.col("shard") == s).collect()
        if got:
            yield shards, (uuid.uuid4().hex, spark.sparkContext.broadcast(bytes(got[0]["payload"])))


_LOADED: dict = {}


def _loaded(key: str, payload) -> Index:
    """This worker process's copy of the index that it used last."""
    if _LOADED.get("key") != key:
        _LOADED.clear()
        _LOADED.update(key=key, index=pickle.loads(payload.value))
    return _LOADED["index"]


SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def contaminated(docs: DataFrame, items: DataFrame, least: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """A row for each document and the item that it holds."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(index):
        def rows(batches):
            x = _loaded(*index)
            for b in batches:
                data, offs = buffers(b.column("text"))
                ids = b.column("doc_id")
                for lo, hi, d, o in steps(data, offs):
                    got = sorted(x.hits(Words(d, o, lower=True, bare=True), hi - lo, least, overlap).items())
                    if got:
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array([lo + k[0] for k, _ in got])), pa.array([x.ids[k[1]] for k, _ in got], pa.int64())] + [pa.array([v[i] for _, v in got], pa.float64()) for i in range(3)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        return rows

    out = None
    for shards, index in indexes(items):
        found = plain.mapInArrow(run(index), SCHEMA)
        if shards > 1:  # one index at a time in the executors
            found = materialize(found, "hits")
            index[1].destroy()
        out = found if out is None else out.union(found)
    return docs.sparkSession.createDataFrame([], SCHEMA) if out is None else out


def drop_contaminated(docs: DataFrame, items: DataFrame, least: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item."""

    def run(index):
        def rows(batches):
            x = _loaded(*index)
            for b in batches:
                data, offs = buffers(b.column("text"))
                keep = np.ones(b.num_rows, bool)
                for lo, hi, d, o in steps(data, offs):
                    for i, _ in x.hits(Words(d, o, lower=True, bare=True), hi - lo, least, overlap):
                        keep[lo + i] = False
                yield b.filter(pa.array(keep))

        return rows

    for shards, index in indexes(items):
        docs = docs.mapInArrow(run(index), docs.schema)
        if shards > 1:  # one index at a time in the executors
            docs = materialize(docs, "clean")
            index[1].destroy()
    return docs
