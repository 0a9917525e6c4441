"""Approximate nearest neighbours: a forest of hash prefixes.

Every vector gets a long string of hash bits in each of TREES trees (signs of random projections of the vector less the
mean of all vectors). The vectors are dealt to shards by their id; a shard keeps, for each tree, its strings in sorted
order. A query descends in every tree to its longest matching prefix and then ascends in all trees in step, one bit at a
time, until the prefixes' ranges hold budget() different candidates, FACTOR * n ** GROWTH of a shard's n vectors: a share
that falls as shards grow. Candidates are ranked by exact Euclidean distance in double precision on the original vectors;
the shards' best are merged per query.

One exchange deals the vectors and a copy of the queries to every shard, vectors first; a task builds a shard's forest once and then streams the queries
through it, so its memory is that of SHARD_ROWS vectors whatever the number of queries, and no vector passes through the
driver. Equal vectors of a shard are one entry of the index with their smallest ids, so a vector that a third of all rows
share costs one candidate.

The budget is what data without structure needs for a recall over 0.9 (measured in the tests on the queries' own path).

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do those of
another length than the most frequent one (ties: the longer). Rows that repeat a vec_id are one row (the smallest vector);
a null vec_id takes no part. Equal distances: smaller vec_id first. Fewer candidates than k: all of them. Extra columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import partitions
from .sums import total

TREES = 128
BITS = 32
#: Candidates of a query in a shard of n vectors: FACTOR * n ** GROWTH.
FACTOR, GROWTH = 1.3, 0.85
#: Queries whose places in all trees are looked up at once.
BLOCK = 128
SHARD_ROWS = 65_536
#: Vectors that a shard has at least, if there are so many.
LEAST_ROWS = 4096
SEED = 8
HIT = "query_id long, vec_id long, score double"


def usable(df: DataFrame) -> DataFrame:
    """vec_id and embedding (array<double>) of the rows that take part, one for each vec_id."""
    v = F.col("embedding")
    ok = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False)))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class Hashes:
    """The trees' hash functions."""

    def __init__(self, mean: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = SEED):
        self.mean, self.trees, self.bits = mean, trees, bits
        self.planes = np.random.default_rng(seed).normal(size=(len(mean), trees * bits))

    def strings(self, x: np.ndarray) -> np.ndarray:
        """A row of TREES bit strings, as numbers of BITS bits, for each vector."""
        weight = (1 << np.arange(self.bits - 1, -1, -1)).astype(np.int64)
        out = np.empty((len(x), self.trees), np.int64)
        for a in range(0, len(x), 1024):  # bounds the signs' memory
            signs = (x[a : a + 1024] - self.mean) @ self.planes > 0
            out[a : a + 1024] = signs.reshape(-1, self.trees, self.bits) @ weight
        return out


class Forest:
    def __init__(self, ids: np.ndarray, x: np.ndarray, hashes: Hashes, k: int):
        o = np.argsort(ids)
        ids, x = ids[o], x[o]
        _, first, inverse = np.unique(x, axis=0, return_index=True, return_inverse=True)
        inverse = inverse.reshape(-1)
        o = np.argsort(inverse, kind="stable")
        cut = np.searchsorted(inverse[o], np.arange(len(first) + 1))
        self.same = [ids[o[a : min(b, a + k + 1)]] for a, b in zip(cut[:-1], cut[1:], strict=True)]  # a query's own id may be one
        self.x, self.hashes, self.k = x[first], hashes, k
        s = hashes.strings(self.x)
        order = np.argsort(s, axis=0, kind="stable")
        self.sorted = np.asfortranarray(np.take_along_axis(s, order, axis=0))
        self.order = np.asfortranarray(order.astype(np.int32))

    def places(self, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds [query, tree, bits dropped] of the entries that share a query's prefixes of every length."""
        shift = np.arange(self.hashes.bits + 1)
        lo = np.empty((len(strings), self.hashes.trees, len(shift)), np.int32)
        hi = np.empty_like(lo)
        for t in range(self.hashes.trees):
            least = strings[:, t, None] >> shift << shift
            lo[:, t] = np.searchsorted(self.sorted[:, t], least, "left")
            hi[:, t] = np.searchsorted(self.sorted[:, t], least + (1 << shift) - 1, "right")
        return lo, hi

    def candidates(self, lo: np.ndarray, hi: np.ndarray, enough: int) -> np.ndarray:
        """Entries under the longest prefixes of one query's strings, synchronously ascended till there are enough."""
        seen = np.zeros(len(self.x), bool)
        held = (hi - lo).sum(axis=0)
        if held[-1] < enough:
            return np.arange(len(self.x))
        level = int(np.argmax(held >= enough))  # fewer dropped bits can't hold enough
        if level:
            for t in range(self.hashes.trees):
                seen[self.order[lo[t, level - 1] : hi[t, level - 1], t]] = True
        while True:
            for t in range(self.hashes.trees):
                seen[self.order[lo[t, level] : hi[t, level], t]] = True
                if t % 8 == 7 and int(seen.sum()) >= enough:
                    return np.flatnonzero(seen)
            if level == self.hashes.bits:
                return np.flatnonzero(seen)
            level += 1

    def search(self, query_ids: np.ndarray, q: np.ndarray, enough: int):
        """(query, vec_id, distance) of the k nearest found of each query."""
        for a in range(0, len(q), BLOCK):
            lo, hi = self.places(self.hashes.strings(q[a : a + BLOCK]))
            for i in range(len(lo)):
                c = self.candidates(lo[i], hi[i], enough)
                yield self._ranked(int(query_ids[a + i]), q[a + i], c)

    def _ranked(self, own: int, v: np.ndarray, c: np.ndarray):
        d = np.sqrt(((self.x[c] - v) ** 2).sum(axis=1))
        if len(c) > self.k + 1:
            top = np.argpartition(d, self.k)[: self.k + 1]
            keep = np.flatnonzero(d <= d[top].max())
        else:
            keep = np.arange(len(c))
        ids = np.concatenate([self.same[c[j]] for j in keep]) if len(keep) else np.zeros(0, np.int64)
        dist = np.repeat(d[keep], [len(self.same[c[j]]) for j in keep])
        ids, dist = ids[ids != own], dist[ids != own]
        o = np.lexsort((ids, dist))[: self.k]
        return np.full(len(o), own), ids[o], dist[o]


def budget(n: int) -> int:
    return int(np.ceil(FACTOR * n**GROWTH))


def _search(hashes, k: int, width: int):
    """Rows come sorted by shard, vectors before queries."""

    def hits(forest, b):
        got = list(forest.search(b.column("vec_id").to_numpy(), _matrix(b.column("embedding"), width), budget(len(forest.x))))
        a, i, d = (np.concatenate(y) for y in zip(*got, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(i), pa.array(d)], ["query_id", "vec_id", "score"])

    def run(batches):
        shard, ids, x, forest = None, [], [], None
        for b in batches:
            key = b.column("shard").to_numpy() * 2 + b.column("asks").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                part = b.slice(i, j - i)
                if shard != key[i] // 2:
                    shard, ids, x, forest = key[i] // 2, [], [], None
                if key[i] % 2 == 0:
                    ids.append(part.column("vec_id").to_numpy())
                    x.append(_matrix(part.column("embedding"), width))
                elif ids:
                    if forest is None:
                        forest = Forest(np.concatenate(ids), np.concatenate(x), hashes.value, k)
                        x = []
                    yield hits(forest, part)

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, trees: int = TREES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row for which is_query holds."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    sizes = rows.groupBy(F.size("embedding").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("w")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, n = sizes[0]["w"], sizes[0]["n"]
    shards = max(-(-n // SHARD_ROWS), min(partitions(spark), n // LEAST_ROWS), 1)
    held = materialize(rows.filter(F.size("embedding") == width), "vectors")
    sums = total(held.select("embedding"), lambda b: np.append(_matrix(b.column("embedding"), width).sum(axis=0), b.num_rows), width + 1)
    hashes = spark.sparkContext.broadcast(Hashes(sums[:-1] / max(sums[-1], 1), trees))
    own = held.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"), F.lit(False).alias("asks"), "vec_id", "embedding")
    asked = held.filter(is_query).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.lit(True).alias("asks"), "vec_id", "embedding")
    hits = own.union(asked).repartition(shards, "shard").sortWithinPartitions("shard", "asks").mapInArrow(_search(hashes, k, width), HIT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
