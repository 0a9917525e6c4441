"""Substring dedup by recompression: repeated word windows are found through shared grammar symbols.

Each document is recompressed in rounds, as in recompression of grammars: a first round names runs of an equal word, and
every round names pairs (left, right) whose members fall on the two sides of a partition of the alphabet that all
documents share. A name is a hash of what it names, so all tasks name alike and no round needs a global dictionary.
Every symbol carries its context: the words on which its being cut just so depends. Inside two equal windows the
symbols whose context lies in the window are therefore the same. A window is filed under the longest such symbol (ties:
smaller name), whatever surrounds it; windows that share that symbol are compared by a 48-bit hash of their words. As
both must agree, two different windows meet with a chance of 2**-112.

Shuffles: one of packed windows (each task first drops the windows that it has seen, so a passage that a third of all
documents share costs one window a task), one of the word ranges to remove, and the join that brings them to the texts.

Defined results: null or blank text has no words and nothing is removed. Rows with equal doc_id and equal text are one
document, each copy of the row gets the same result; equal doc_id and another text: ordered by a hash of the text. A null
doc_id is smaller than all others. Documents shorter than the window keep all words. Extra columns are passed through
by remove_repeats(); helper columns and results begin with what no column of the input begins with (common.spare).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LEAST, partitions, spare
from .kernels import U, Words, buffers, gram_hashes, mix, steps

ROUNDS = 6
#: Words of windows that a task dedupes at once: bounds its memory.
BLOCK = 1_000_000
#: Longest stretch of one document that is recompressed at once; stretches overlap by a window.
STRETCH = 1_000_000
FAR = 1 << 40
PACKED = "target int, payload binary"
RANGES = "__id long, __hash long, __ranges binary"


def grammar(h: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS):
    """For each round, (name, words, context start, context end) of the symbols that it makes; round 0: words."""
    n = len(h)
    at = np.arange(n)
    sym, size, lo, hi, d = h.copy(), np.ones(n, np.int64), at.copy(), at + 1, doc
    yield sym, size, lo, hi
    for r in range(1, rounds + 1):
        if len(sym) < 2:
            return
        if r == 1:  # runs of one word; a word that is no run depends on both neighbours
            same = (sym[1:] == sym[:-1]) & (d[1:] == d[:-1])
            idx = np.flatnonzero(np.concatenate([[True], ~same]))
            cnt = np.diff(np.append(idx, n))
            starts_doc = np.concatenate([[True], d[1:] != d[:-1]])[idx]
            ends_doc = np.append(starts_doc[1:], True)
            sym = np.where(cnt > 1, mix(sym[idx] * U(3) + cnt.astype(U) * U(0xD6E8FEB86659FD93)), sym[idx])
            lo = np.where(starts_doc, -FAR, idx - 1)
            hi = np.where(ends_doc, FAR, idx + cnt + 1)
            size, d = cnt, d[idx]
            run = cnt > 1
            if run.any():
                yield sym[run], size[run], lo[run], hi[run]
        left = mix(sym + U(r * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF)) >> U(63) == 0
        near = d[1:] == d[:-1]
        merge = np.append(left[:-1] & ~left[1:] & near, False)
        second = np.concatenate([[False], merge[:-1]])
        after, before = np.append(near, False), np.concatenate([[False], near])
        nlo = np.where(before, np.concatenate([[0], lo[:-1]]), -FAR)
        nhi = np.where(after, np.append(hi[1:], 0), FAR)
        lo2 = np.where(left | merge, lo, nlo)
        hi2 = np.where(left, nhi, hi)
        nsym = sym.copy()
        m = np.flatnonzero(merge)
        nsym[m] = mix(mix(sym[m] + U(0xE7037ED1A0B428DB)) + sym[m + 1] * U(0x8EBC6AF09C88C6E3))
        nsize = size.copy()
        nsize[m] += size[m + 1]
        keep = ~second
        sym, size, lo, hi, d, made = nsym[keep], nsize[keep], lo2[keep], hi2[keep], d[keep], merge[keep]
        if made.any():
            yield sym[made], size[made], lo[made], hi[made]


def anchors(h: np.ndarray, doc: np.ndarray, window: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """For each start of a window: the index of the symbol that it is filed under, and all symbols' names."""
    n = len(h)
    best = np.full(n, np.iinfo(np.uint64).max, U)
    names, base = [], 0
    for name, size, lo, hi in grammar(h, doc, rounds):
        ok = (hi - lo <= window) & (lo >= 0) & (hi <= n)
        name, size, lo, hi = name[ok], size[ok], lo[ok], hi[ok]
        if not len(name):
            continue
        prio = ((U(255) - np.minimum(size, 255).astype(U)) << U(56)) | ((mix(name) >> U(32)) << U(24)) | (np.arange(len(name)) + base).astype(U)
        names.append(name)
        base += len(name)
        first, last = np.maximum(hi - window, 0), lo  # of the starts of windows that hold the symbol and its context
        j1 = np.cumsum(np.bincount(first, minlength=n)[:n]) - 1
        j0 = np.zeros(n, np.int64)
        j0[1:] = np.cumsum(np.bincount(last, minlength=n)[:n])[:-1]
        s = np.flatnonzero(j1 >= j0)
        if not len(s):
            continue
        a, b = j0[s], j1[s]
        levels = [prio]
        while 1 << len(levels) <= int((b - a).max()) + 1:
            t, k = levels[-1], 1 << (len(levels) - 1)
            levels.append(np.minimum(t[: len(t) - k], t[k:]) if len(t) > k else t)
        wide = (b - a + 1).astype(np.int64)
        k = np.log2(wide).astype(np.int64)
        got = np.empty(len(s), U)
        for i in range(len(levels)):
            if (q := np.flatnonzero(k == i)).size:
                got[q] = np.minimum(levels[i][a[q]], levels[i][b[q] - (1 << i) + 1])
        best[s] = np.minimum(best[s], got)
    return (best & U(0xFFFFFF)).astype(np.int64), np.concatenate(names) if names else np.zeros(0, U)


def windows(h: np.ndarray, doc: np.ndarray, window: int):
    """(start, symbol index, names, 48-bit hash) of every window that lies in one document."""
    n = len(h)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U)
    s = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
    node, names = anchors(h, doc, window)
    return s, node[s], names, gram_hashes(h, window)[s] >> U(16)


def repeats(name: np.ndarray, wh: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(later, first): which windows have an equal one of smaller order, and which stand for their words."""
    if not len(wh):
        return np.zeros(0, bool), np.zeros(0, bool)
    c = mix(name) ^ (wh * U(0x9E3779B97F4A7C15))
    o = np.lexsort((order, c))
    new = np.ones(len(o), bool)
    new[1:] = (c[o][1:] != c[o][:-1]) | (name[o][1:] != name[o][:-1]) | (wh[o][1:] != wh[o][:-1])
    least = order[o][np.flatnonzero(new)][np.cumsum(new) - 1]
    later, first = np.zeros(len(o), bool), np.zeros(len(o), bool)
    later[o] = order[o] > least
    first[o] = new
    return later, first


def runs(start: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, length) of the runs of consecutive starts over which the given arrays are constant."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.diff(start) != 1
    for x in same:
        cut |= x[1:] != x[:-1]
    i = np.concatenate([[0], np.flatnonzero(cut) + 1])
    return i, np.diff(np.append(i, len(start)))


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(arrays)] + [a.nbytes for a in arrays], np.int64).tobytes(), *(a.tobytes() for a in arrays)])


def _planes(x: np.ndarray, steps: bool = False) -> np.ndarray:
    """Bytes of small numbers by significance (of their steps, if asked), which the shuffle's compression then shortens."""
    x = np.diff(x, prepend=x.dtype.type(0)) if steps else x
    return x.view(np.uint8).reshape(-1, x.itemsize).T.copy()


def _numbers(b: np.ndarray, kind, steps: bool = False) -> np.ndarray:
    size = np.dtype(kind).itemsize
    x = b.reshape(size, -1).T.copy().view(kind).reshape(-1)
    return np.cumsum(x, dtype=kind) if steps else x


def _unpack(b: bytes, *kinds) -> list[np.ndarray]:
    n = int(np.frombuffer(b, np.int64, 1)[0])
    sizes, at, out = np.frombuffer(b, np.int64, n, 8), 8 * (n + 1), []
    for size, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(b, kind, int(size) // np.dtype(kind).itemsize, at))
        at += int(size)
    return out


class _Block:
    """Windows of a task that wait to be deduped and sent."""

    def __init__(self, targets: int, window: int):
        self.targets, self.window = targets, window
        self.clear()

    def clear(self) -> None:
        self.parts, self.size, self.ids, self.hashes, self.docs, self.nodes = [], 0, [], [], 0, 0

    def add(self, ids, hashes, h, doc, at) -> None:
        """Windows of documents whose words are h; at: where the first word stands in its document."""
        s, node, names, wh = windows(h, doc, self.window)
        first = np.searchsorted(doc, np.arange(len(ids)))
        if len(s):
            self.parts.append((doc[s] + self.docs, s - first[doc[s]] + at, names[node], wh, node + self.nodes))
            self.size += len(s)
            self.nodes += len(names)
        self.ids.append(ids)
        self.hashes.append(hashes)
        self.docs += len(ids)

    def send(self):
        if not self.size:
            return self.clear()
        doc, start, name, wh, node = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        ids, hashes = np.concatenate(self.ids), np.concatenate(self.hashes)
        rank = np.empty(len(ids), np.int64)
        o = np.lexsort((hashes, ids))
        new = np.ones(len(o), bool)
        new[1:] = (ids[o][1:] != ids[o][:-1]) | (hashes[o][1:] != hashes[o][:-1])
        rank[o] = np.cumsum(new) - 1  # rows that repeat a document share its rank
        later, first = repeats(name, wh, rank[doc] << 32 | start)
        k = np.flatnonzero(first)
        i, n = runs(start[k], doc[k], node[k])
        head = k[i]
        to = (mix(name[head]) % U(self.targets)).astype(np.int64)
        o = np.argsort(to, kind="stable")
        bounds = np.searchsorted(to[o], np.arange(self.targets + 1))
        low = wh[k].view(np.uint8).reshape(-1, 8)[:, :6]
        where = np.cumsum(n) - n
        j = np.flatnonzero(later)
        li, ln = runs(start[j], doc[j])
        ldoc, lstart = doc[j][li], start[j][li]
        lto = ldoc % self.targets
        for t in range(self.targets):
            p = o[bounds[t] : bounds[t + 1]]
            q = np.flatnonzero(lto == t)
            if not len(p) and not len(q):
                continue
            d, idx = np.unique(np.concatenate([doc[head[p]], ldoc[q]]), return_inverse=True)
            rows = np.repeat(where[p], n[p]) + (np.arange(n[p].sum()) - np.repeat(np.cumsum(n[p]) - n[p], n[p]))
            small = [_planes(x, k) for x, k in ((idx[: len(p)].astype(np.uint32), True), (start[head[p]].astype(np.uint32), False), (n[p].astype(np.uint16), False))]
            more = [_planes(x, k) for x, k in ((idx[len(p) :].astype(np.uint32), True), (lstart[q].astype(np.uint32), False), (ln[q].astype(np.uint32), False))]
            yield t, _pack(ids[d], hashes[d], name[head[p]], *small, low[rows], *more)
        self.clear()


def _find(targets: int, window: int):
    def run(batches):
        block = _Block(targets, window)

        def rows():
            got = list(block.send() or ())
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in got], pa.int32()), pa.array([b for _, b in got], pa.binary())], ["target", "payload"])

        for batch in batches:
            ids, hashes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__id", "__hash"))
            data, offs = buffers(batch.column("text"))
            for lo, hi, d, o in steps(data, offs):
                w = Words(d, o)
                for a in range(0, max(1, len(w)), STRETCH):
                    b = min(len(w), a + STRETCH + window - 1)
                    if a and b - a < window:
                        break
                    first = int(w.doc[a]) if len(w) else 0
                    block.add(ids[lo + first : hi], hashes[lo + first : hi], w.hash[a:b], w.doc[a:b] - first, _offsets(w, a, b, first, window))
                    if block.size >= BLOCK:
                        yield from rows()
        yield from rows()

    return run


def _offsets(w: Words, a: int, b: int, first: int, window: int):
    """Where in their documents the windows' count from: only the first document of a later stretch doesn't start in it."""
    if a == 0 or w.first[first] >= a:
        return 0
    doc = w.doc[a:b] - first
    n = len(doc)
    s = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :]) if n >= window else np.zeros(0, np.int64)
    return np.where(doc[s] == 0, a - int(w.first[first]), 0)


def _decide(table: pa.Table) -> pa.Table:
    parts, base = [], 0
    ids, hashes, known = [], [], []
    for b in table.column("payload").to_pylist():
        i, h, name, doc, start, n, low, ldoc, lstart, ln = _unpack(b, np.int64, np.int64, U, *[np.uint8] * 7)
        doc, start, n = _numbers(doc, np.uint32, True), _numbers(start, np.uint32), _numbers(n, np.uint16)
        ldoc, lstart, ln = _numbers(ldoc, np.uint32, True), _numbers(lstart, np.uint32), _numbers(ln, np.uint32)
        parts.append((name, doc.astype(np.int64) + base, start.astype(np.int64), n.astype(np.int64), low.reshape(-1, 6)))
        known.append((ldoc.astype(np.int64) + base, lstart.astype(np.int64), ln.astype(np.int64)))
        ids.append(i)
        hashes.append(h)
        base += len(i)
    name, doc, start, n, low = (np.concatenate(x) for x in zip(*parts, strict=True))
    ids, hashes = np.concatenate(ids), np.concatenate(hashes)
    key, rank = np.unique(np.rec.fromarrays([ids, hashes]), return_inverse=True)
    rank = rank.reshape(-1)
    _, inverse, count = np.unique(name, return_inverse=True, return_counts=True)
    shared = count[inverse.reshape(-1)] > 1  # the symbol stands elsewhere too
    at = np.repeat(shared, n)
    low, name, doc, start, n = low[at], name[shared], doc[shared], start[shared], n[shared]
    wh = np.zeros((len(low), 8), np.uint8)
    wh[:, :6] = low
    wh = wh.reshape(-1).view(U)
    each = np.repeat(start, n) + (np.arange(len(wh)) - np.repeat(np.cumsum(n) - n, n))
    row = rank[np.repeat(doc, n)]
    later, _ = repeats(np.repeat(name, n), wh, row << 32 | each)
    r, s, c = row[later], each[later], np.ones(int(later.sum()), np.int64)
    for d, a, m in known:
        r, s, c = np.append(r, rank[d]), np.append(s, a), np.append(c, m)
    o = np.lexsort((s, r))
    r, s, c = r[o], s[o], c[o]
    heads, where = np.unique(r, return_index=True)
    where = np.append(where, len(r))
    packed = [np.stack([s[a:b], c[a:b]]).astype(np.int32).tobytes() for a, b in zip(where[:-1], where[1:], strict=True)]
    return pa.table({"__id": pa.array(key["f0"][heads], pa.int64()), "__hash": pa.array(key["f1"][heads], pa.int64()), "__ranges": pa.array(packed, pa.binary())})


def _covered(n: int, ranges, window: int) -> np.ndarray:
    """Which of n words a removed window covers."""
    diff = np.zeros(n + 1, np.int64)
    for b in ranges:
        s, c = np.frombuffer(b, np.int32).reshape(2, -1)
        np.add.at(diff, s, 1)
        np.add.at(diff, np.minimum(s + c + window - 1, n), -1)
    return np.cumsum(diff[:-1]) > 0


def _apply(window: int, p: str):
    def one(text: str | None, ranges):
        words = (text or "").encode().split()
        if ranges is None or not len(ranges):
            return b" ".join(words).decode(), len(words), 0
        gone = _covered(len(words), ranges, window)
        return b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode(), len(words), int(gone.sum())

    def run(frames):
        for f in frames:
            got = [one(t, r) for t, r in zip(f["text"], f[p + "ranges"], strict=True)]
            f = f.drop(columns=[p + "ranges"])
            f[p + "kept"] = pd.array([x[0] for x in got], dtype=object)
            f[p + "n_words"] = np.array([x[1] for x in got], np.int64)
            f[p + "n_removed"] = np.array([x[2] for x in got], np.int64)
            yield f

    return run


def remove_repeats(docs: DataFrame, window: int = 20, targets: int | None = None) -> DataFrame:
    """docs with doc_id and text, and, each after spare(docs), kept (words that stay, joined by a space), n_words, n_removed."""
    targets = targets or 4 * partitions(docs.sparkSession)
    p = spare(docs)
    keyed = docs.withColumn(p + "id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST))).withColumn(p + "hash", F.xxhash64("text"))
    packed = keyed.select(F.col(p + "id").alias("__id"), F.col(p + "hash").alias("__hash"), "text").mapInArrow(_find(targets, window), PACKED)
    ranges = packed.groupBy("target").applyInArrow(_decide, RANGES).groupBy("__id", "__hash").agg(F.collect_list("__ranges").alias(p + "ranges"))
    ranges = ranges.select(F.col("__id").alias(p + "id"), F.col("__hash").alias(p + "hash"), p + "ranges")
    joined = keyed.join(ranges, [p + "id", p + "hash"], "left").select(*[f"`{c}`" for c in docs.columns], p + "ranges")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return joined.mapInPandas(_apply(window, p), f"{kinds}, {p}kept string, {p}n_words long, {p}n_removed long")


def digest(docs: DataFrame, window: int = 20) -> DataFrame:
    """The contract's columns."""
    out = remove_repeats(docs.select("doc_id", "text"), window)
    return out.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"), F.sha2(F.col("__kept").cast("binary"), 256).alias("kept_sha256"))
