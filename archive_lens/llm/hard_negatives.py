"""Hard-negative mining: blocked dense products of anchors with all rows, in two passes.

The anchors are dealt to groups of ANCHOR_BYTES of matrix on average (by a hash of their id). One group after the other is
broadcast: its size is bounded whatever the table's, and the number of groups grows with the number of anchors. Each
task takes its rows in tiles and multiplies them with the group's tiles:

* pass 1 keeps each anchor's best rows of the same label, tile after tile, and emits the best of the task; the best of
  the tasks are merged per anchor;
* pass 2 gets the positives with the anchors and keeps, for each of them, the best rows of other labels whose score lies
  in the positive's window; these are merged per anchor and positive.

Both results are mergeable (the best of the best), so a lost task is done again and nothing else. A task emits at most
k rows for each anchor (and positive); tasks take TASK_ROWS rows or more where the table is large, so these rows are few
against the products. The work is anchors x rows, as asked.

Components are floored multiples of 1 / scale. A product in float64 is exact in whatever order it is summed where both
rows' squared lengths are below 2^53 (by Cauchy's inequality no partial sum reaches 2^53); tiles with longer rows are
multiplied in 64-bit integers, exact to 2^63.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part; nor do rows of
another length than the most frequent one (ties: the longer), as they have no product, and rows whose floored vector has a
squared length of 2^62 or more, whose products need not fit a long. Rows that repeat an id are one row (of the smallest
label, then the smallest vector). Equal scores: smaller id first. Positives without any row in their window have no
result rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import partitions

POSITIVES, NEGATIVES = 5, 3
SCALE = 256
ANCHOR_BYTES = 1 << 23
TASK_ROWS = 1 << 18
#: Rows of a tile of anchors, of a tile of candidates.
TILE = 512, 4096
EXACT, LONGEST = 2.0**53, 2.0**62
NONE = -(1 << 62)
POSITIVE = "anchor_id long, positive_id long, positive_score long"
NEGATIVE = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def usable(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and the floored vector (array<double>) of the rows that take part, one for each vec_id."""
    v = F.col("v")
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter("vec_id is not null and label is not null and v is not null and size(v) > 0").filter(fine)
    rows = rows.withColumn("v", F.transform(v, lambda x: F.floor(x * scale).cast("double")))
    rows = rows.filter(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x) < LONGEST)
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")


def _matrix(col, width: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def product(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of rows as 64-bit integers, or as exact float64."""
    if max((a * a).sum(axis=1).max(initial=0), (c * c).sum(axis=1).max(initial=0)) < EXACT:
        return a @ c.T
    return a.astype(np.int64) @ c.astype(np.int64).T


def best(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each owner: highest score, then smallest id; by owner and in that order."""
    order = np.lexsort((ids, -score, owner))
    own = owner[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
    nth = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
    return order[nth < k]


class Kept:
    """The k best (score, id) of each of n owners, so far."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.ids = k, np.full((n, k), NONE), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, owner: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """owner, score and id of what may be better than the last one kept."""
        last, last_id = self.score[owner, -1], self.ids[owner, -1]
        better = (score > last) | ((score == last) & (ids < last_id))
        owner, score, ids = owner[better], score[better], ids[better]
        if not len(owner):
            return
        touched = np.unique(owner)
        held = np.repeat(touched, self.k)
        o = np.concatenate([held, owner])
        s, i = np.concatenate([self.score[touched].ravel(), score]), np.concatenate([self.ids[touched].ravel(), ids])
        at = best(o, s, i, self.k)
        self.score[touched], self.ids[touched] = s[at].reshape(-1, self.k), i[at].reshape(-1, self.k)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        owner, nth = np.nonzero(self.score != NONE)
        return owner, self.score[owner, nth], self.ids[owner, nth]


def _tiles(batches, width: int):
    for b in batches:
        ids, label, v = b.column("vec_id").to_numpy(), b.column("label").to_numpy(), _matrix(b.column("v"), width)
        for i in range(0, len(ids), TILE[1]):
            yield ids[i : i + TILE[1]], label[i : i + TILE[1]], v[i : i + TILE[1]]


def _positives(group, k: int, width: int):
    def run(batches):
        ids, label, v = group.value
        kept = Kept(len(ids), k)
        for cid, clabel, c in _tiles(batches, width):
            for i in range(0, len(ids), TILE[0]):
                part = slice(i, i + TILE[0])
                s = product(v[part], c)
                ok = (label[part, None] == clabel) & (ids[part, None] != cid) & (s >= kept.score[part, -1:])
                a, j = np.nonzero(ok)
                kept.add(a + i, s[a, j].astype(np.int64), cid[j])
        a, s, p = kept.rows()
        yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(p), pa.array(s)], ["anchor_id", "positive_id", "positive_score"])

    return run


def windows(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest integer n with 50 p <= 100 n <= 95 p, without leaving 64 bits."""
    return -((-p) // 2), p // 20 * 19 + p % 20 * 19 // 20


def _negatives(group, pairs, k: int, width: int):
    def run(batches):
        ids, label, v = group.value
        anchor, positive, score = pairs.value  # by anchor
        low, high = windows(score)
        kept = Kept(len(anchor), k)
        first = np.searchsorted(anchor, np.arange(0, len(ids) + TILE[0], TILE[0]))
        for cid, clabel, c in _tiles(batches, width):
            for t, i in enumerate(range(0, len(ids), TILE[0])):
                lo, hi = first[t], first[t + 1]
                if lo == hi:
                    continue
                s = product(v[i : i + TILE[0]], c)
                own = anchor[lo:hi] - i
                differs = label[i : i + TILE[0], None] != clabel
                # one positive of each anchor at a time, so that a mask is no larger than the tile
                nth = np.arange(hi - lo) - np.searchsorted(own, own)
                for r in range(int(nth.max()) + 1):
                    w = np.flatnonzero(nth == r)
                    mine = s[own[w]] if len(w) < len(s) else s
                    least = np.maximum(low[lo + w], kept.score[lo + w, -1])
                    a, j = np.nonzero((mine >= least[:, None]) & (mine <= high[lo + w][:, None]) & (differs[own[w]] if len(w) < len(s) else differs))
                    kept.add(lo + w[a], mine[a, j].astype(np.int64), cid[j])
        o, s, n = kept.rows()
        cols = [ids[anchor[o]], positive[o], score[o], n, s]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return run


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, scale: int = SCALE, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows for which is_anchor holds."""
    spark = rows.sparkSession
    held = materialize(usable(rows, scale), "vectors")
    sizes = held.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n"), F.count_if(is_anchor).alias("anchors")).orderBy(F.desc("n"), F.desc("w")).limit(1).collect()
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not sizes or not sizes[0]["anchors"]:
        return spark.createDataFrame([], result)
    width, n = sizes[0]["w"], sizes[0]["n"]
    groups = -(-sizes[0]["anchors"] * width * 8 // anchor_bytes)
    same = held.filter(F.size("v") == width)
    dealt = materialize(same.repartition(max(partitions(spark), n // TASK_ROWS), "vec_id"), "candidates")
    found = None
    for g in range(groups):
        own = same.filter(is_anchor & (F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == g)).toArrow().sort_by("vec_id")  # one group: bounded
        if not own.num_rows:
            continue
        ids = own.column("vec_id").to_numpy()
        group = spark.sparkContext.broadcast((ids, own.column("label").to_numpy(), _matrix(own.column("v").combine_chunks(), width)))
        by = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
        each = dealt.mapInArrow(_positives(group, positives, width), POSITIVE)
        few = each.withColumn("n", F.row_number().over(by)).filter(F.col("n") <= positives).drop("n").toArrow().sort_by([("anchor_id", "ascending"), ("positive_id", "ascending")])  # at most `positives` an anchor
        at, positive, score = (few.column(c).to_numpy() for c in ("anchor_id", "positive_id", "positive_score"))
        pairs = spark.sparkContext.broadcast((np.searchsorted(ids, at), positive, score))
        by = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
        each = dealt.mapInArrow(_negatives(group, pairs, negatives, width), NEGATIVE)
        out = each.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= negatives)
        out = materialize(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
        group.unpersist()
        pairs.unpersist()
        found = out if found is None else found.unionByName(out)
    return found if found is not None else spark.createDataFrame([], result)
