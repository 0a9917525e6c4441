"""Near-dedup: a chosen-path set similarity join over distinct shingle sets, links confirmed on full sets.

Sets: the distinct shingles of lower-cased words; one signature of minwise tokens per document (COORDINATES of them).
Documents with the same set form a class, of which only one representative is joined on. Each of TREES independent
trees starts its nodes from another minwise token; a larger node than LEAF classes is branched by another
token, selected by a hash of its path, a smaller one is compared exhaustively by one-byte sketches of the signatures, in
order of set size, so that only sizes that can reach the threshold meet. What agrees there to within 4.5 standard
deviations of the threshold forms clusters; a node or group passes on one row per class (its least partner), never its pairs.

All pairs of a cluster are then compared on the full sets of its texts, by products of incidence matrices. A cluster of
more than BLOCK classes is cut into blocks and every two blocks meet in one task. In one of more than PAIRWISE classes only
pairs are left out that other confirmed links join already: rounds compare its most central classes with all others, and
at last what is outside the cluster's largest component so far is compared with everything. Nothing is capped or dropped.
Confirmed links are joined into components.

Recall: a pair of similarity s stays together to depth k with probability s**k per tree. Trees are no deeper than the
depth at which a pair at the threshold is missed by all of them with probability MISS (7 at 0.85, 5 at 0.8, by 24 trees);
a node that is still large there is one cluster as it stands. The sketch misses one pair in 10**5 at the threshold.

Defined results: null, empty and blank texts have the empty set, link with nothing and are their own component; a text
with fewer words than a shingle has its whole word sequence as one shingle. Equal sets link. A row is known by its doc_id
and a hash of its text: rows that repeat a doc_id are each placed by their own text, and of a component the texts of the
least doc_id and hash are kept. A null doc_id counts as smaller than all others and is returned as null. Classes are known
by a 64-bit hash of their set. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, release
from .common import LEAST, spare
from .graph import components, labels
from .kernels import U, Words, buffers, gram_hashes, mix, steps

TREES = 24
COORDINATES = 128
LEAF = 2048
#: Share of pairs at the threshold that all trees together may miss.
MISS = 1e-4
#: Edges of leaves that a task holds before it reduces them.
PENDING = 300_000
#: Classes of a cluster whose full sets are compared in one task.
BLOCK = 384
#: Classes of a cluster up to which all its blocks meet, whatever links are confirmed.
PAIRWISE = 4096
#: About so many signatures of a cluster are looked at for its most frequent tokens.
SAMPLE = 512
SEEDS = mix((np.arange(COORDINATES, dtype=np.uint64) + U(1)) * U(0x9E3779B97F4A7C15)) | U(1)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle hash), distinct, in order of both."""
    w = Words(data, offs, lower=True)
    counts = np.diff(w.first)
    doc, h = np.zeros(0, np.int64), np.zeros(0, U)
    if len(w) >= k:
        at = np.flatnonzero(w.doc[: len(w) - k + 1] == w.doc[k - 1 :])
        doc, h = w.doc[at], gram_hashes(w.hash, k)[at]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        sums = np.array([int(mix(w.hash[w.first[d] : w.first[d + 1]] * U(2 * k + 1) + np.arange(counts[d]).astype(U)).sum()) & 0xFFFFFFFFFFFFFFFF for d in short], U)
        doc, h = np.concatenate([doc, short]), np.concatenate([h, mix(sums ^ U(0x5851F42D4C957F2D))])
    o = np.lexsort((h, doc))
    doc, h = doc[o], h[o]
    new = np.ones(len(o), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


def _sign(k: int):
    def run(batches):
        for batch in batches:
            ids, hashes = batch.column("__id"), batch.column("__hash")
            data, offs = buffers(batch.column("text"))
            for lo, hi, d, o in steps(data, offs):
                doc, h = shingle_sets(d, o, k)
                n = np.bincount(doc, minlength=hi - lo)
                sig = np.zeros((hi - lo, COORDINATES), np.uint32)
                h1, h2 = np.zeros(hi - lo, U), np.zeros(hi - lo, U)
                if len(doc):
                    full = np.flatnonzero(n)
                    at = np.searchsorted(doc, full)
                    for c, seed in enumerate(SEEDS):
                        sig[full, c] = (np.minimum.reduceat(h * seed, at) >> U(32)).astype(np.uint32)
                    h1[full] = np.add.reduceat(mix(h + U(0x2127599BF4325C37)), at)
                    h2[full] = np.add.reduceat(mix(h ^ U(0x880355F21E6D1965)), at)
                yield pa.RecordBatch.from_arrays([ids[lo:hi], hashes[lo:hi], pa.array(n, pa.int64()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array([x.tobytes() for x in sig], pa.binary())], ["__id", "__hash", "n", "h1", "h2", "sig"])

    return run


def _matrix(col, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), kind).reshape(-1, width)


def _roots(trees: int):
    def run(batches):
        for b in batches:
            sig, n = _matrix(b.column("sig"), np.uint32, COORDINATES), b.num_rows
            node = np.concatenate([mix(sig[:, t].astype(U) + (U(t + 1) << U(32))) for t in range(trees)]) if n else np.zeros(0, U)
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), pa.array(np.tile(b.column("rep").to_numpy(), trees))], ["node", "rep"])

    return run


def _branch(batches):
    """Children of nodes: by the class's minwise token at the coordinate that a hash of the path selects."""
    for b in batches:
        sig, node = _matrix(b.column("sig"), np.uint32, COORDINATES), b.column("node").to_numpy().view(U)
        c = (mix(node + U(11)) % U(COORDINATES)).astype(np.int64)
        child = mix(node * U(0xD6E8FEB86659FD93) + (c.astype(U) << U(40)) + sig[np.arange(b.num_rows), c].astype(U))
        yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), b.column("rep")], ["node", "rep"])


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def _edges(rep: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Each node but the first of its component, with that first one."""
    lab = labels(len(rep), a, b)
    k = np.flatnonzero(lab != np.arange(len(rep)))
    return pa.RecordBatch.from_arrays([pa.array(rep[lab[k]], pa.int64()), pa.array(rep[k], pa.int64())], ["a", "b"])


def _leaves(least: float, num: int, den: int):
    """Clusters of each leaf by sketches. Rows come sorted by node and set size."""

    def links(node, rep, n, sig):
        cut = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1], [True]]))
        last = np.repeat(cut[1:], np.diff(cut))
        at, x, y, held = np.arange(len(node)), [], [], 0
        step = 1
        while True:
            at = at[at + step < last[at]]
            at = at[den * n[at] >= num * n[at + step]]  # sizes only grow apart
            if not len(at):
                break
            for p in range(0, len(at), 16384):
                q = at[p : p + 16384]
                q = q[_agree(sig[q], sig[q + step]) >= least]
                x.append(q)
                y.append(q + step)
                held += len(q)
                if held > PENDING:  # what is connected stays so by fewer edges
                    lab = labels(len(node), np.concatenate(x), np.concatenate(y))
                    k = np.flatnonzero(lab != np.arange(len(node)))
                    x, y, held = [k], [lab[k]], 0
            step += 1
        if x and sum(map(len, x)):
            yield _edges(rep, np.concatenate(x), np.concatenate(y))

    def run(batches):
        node, rep, n, sig = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, COORDINATES), np.uint8)
        for x in batches:
            node = np.concatenate([node, x.column("node").to_numpy()])
            rep = np.concatenate([rep, x.column("rep").to_numpy()])
            n = np.concatenate([n, x.column("n").to_numpy()])
            sig = np.concatenate([sig, _matrix(x.column("sketch"), np.uint8, COORDINATES)])
            done = int(np.searchsorted(node, node[-1])) if len(node) else 0
            if done:
                yield from links(node[:done], rep[:done], n[:done], sig[:done])
                node, rep, n, sig = node[done:], rep[done:], n[done:], sig[done:]
        if len(node):
            yield from links(node, rep, n, sig)

    return run


def _sketch(batches):
    """One byte of each minwise token."""
    for b in batches:
        sig = _matrix(b.column("sig"), np.uint32, COORDINATES)
        low = (mix(sig.astype(U)) >> U(56)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("n"), pa.array([x.tobytes() for x in low], pa.binary())], ["rep", "n", "sketch"])


def full_links(doc: np.ndarray, h: np.ndarray, count: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a < b) of sets with den * intersection >= num * union; the sets are the rows (doc, h)."""
    n = np.bincount(doc, minlength=count)
    _, col, df = np.unique(h, return_inverse=True, return_counts=True)
    own = df[col.reshape(-1)] > 1
    doc, col = doc[own], np.unique(col.reshape(-1)[own], return_inverse=True)[1].reshape(-1)
    both = np.zeros((count, count), np.float32)
    o = np.argsort(col, kind="stable")
    doc, col = doc[o], col[o]
    for first in range(0, int(col[-1]) + 1 if len(col) else 0, 2048):
        i, j = np.searchsorted(col, (first, first + 2048))
        m = np.zeros((count, 2048), np.float32)
        m[doc[i:j], col[i:j] - first] = 1
        both += m @ m.T
    a, b = [], []
    for i in np.flatnonzero(n).tolist():  # row by row: no matrix beside the one of intersections
        row = both[i, i + 1 :].astype(np.float64)
        j = np.flatnonzero((den * row >= num * (n[i] + n[i + 1 :] - row)) & (n[i + 1 :] > 0)) + i + 1
        a.append(np.full(len(j), i))
        b.append(j)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _confirm(k: int, num: int, den: int):
    """Confirmed links of each group, whose rows come together."""

    def links(rep, texts):
        col = pa.array(texts, pa.large_string())
        data, offs = buffers(col)
        doc, h = [], []
        for lo, _, d, o in steps(data, offs):
            x, y = shingle_sets(d, o, k)
            doc.append(x + lo)
            h.append(y)
        a, b = full_links(np.concatenate(doc), np.concatenate(h), len(rep), num, den)
        if len(a):
            yield _edges(np.array(rep, np.int64), a, b)

    def run(batches):
        key, rep, texts = None, [], []
        for x in batches:
            for g, i, j, r, t in zip(*(x.column(c).to_pylist() for c in ("g", "i", "j", "rep", "text")), strict=True):
                if (g, i, j) != key:
                    if len(rep) > 1:
                        yield from links(rep, texts)
                    key, rep, texts = (g, i, j), [], []
                rep.append(r)
                texts.append(t)
        if len(rep) > 1:
            yield from links(rep, texts)

    return run


def _modes(rows: pa.Table) -> pa.Table:
    """The most frequent token of a group at each coordinate."""
    sig = _matrix(rows.column("sig"), np.uint32, COORDINATES)
    out = np.zeros(COORDINATES, np.uint32)
    for c in range(COORDINATES):
        token, n = np.unique(sig[:, c], return_counts=True)
        out[c] = token[n.argmax()]
    return pa.table({"g": rows.column("g").slice(0, 1), "modes": pa.array([out.tobytes()], pa.binary())})


def _central(batches):
    """At how many coordinates each class has its group's most frequent token."""
    for b in batches:
        score = (_matrix(b.column("sig"), np.uint32, COORDINATES) == _matrix(b.column("modes"), np.uint32, COORDINATES)).sum(axis=1)
        yield pa.RecordBatch.from_arrays([b.column("g"), b.column("rep"), pa.array(score, pa.int64())], ["g", "rep", "score"])


def deepest(s: float, trees: int) -> int:
    """The depth to which trees may go: a pair of similarity s parts in all of them with probability MISS at most."""
    k = 1
    while s < 1 and (1 - s ** (k + 1)) ** trees <= MISS:
        k += 1
    return k


def row_key(docs: DataFrame) -> tuple[Column, Column]:
    """What a row is known by: doc_id (a null one as LEAST) and a hash of its text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("__id"), F.xxhash64(F.col("text").cast("string"), F.col("text").isNull()).alias("__hash")


class _Join:
    """The state of one join: classes, leaves, clusters."""

    def __init__(self, docs: DataFrame, k: int, num: int, den: int, trees: int):
        self.k, self.num, self.den, self.trees = k, num, den, trees
        s = num / den
        self.least = max(0.0, s - 4.5 * (s * (1 - s) / COORDINATES) ** 0.5)
        self.deepest = deepest(s, trees)
        self.docs = docs.select(*row_key(docs), F.col("text").cast("string").alias("text"))
        self.signed = materialize(self.docs.mapInArrow(_sign(k), "__id long, __hash long, n long, h1 long, h2 long, sig binary"), "signatures")
        full = self.signed.filter("n > 0")
        # each class by a key of its set (rep), with its least row
        self.classes = materialize(full.groupBy("h1", "h2", "n").agg(F.min(F.struct("__id", "__hash")).alias("least")).select(F.col("h1").alias("rep"), "h2", "n", "least.*"), "classes")
        own = full.join(self.classes.select(F.col("rep").alias("h1"), "h2", "n", "__id", "__hash").hint("merge"), ["h1", "h2", "n", "__id", "__hash"])
        self.ids = materialize(own.select(F.col("h1").alias("rep"), "n", "sig").dropDuplicates(["rep"]), "ids")
        self.sketches = materialize(self.ids.mapInArrow(_sketch, "rep long, n long, sketch binary"), "sketches")

    def leaf_links(self, small: DataFrame) -> DataFrame:
        rows = small.join(self.sketches.hint("merge"), "rep").select("node", "rep", "n", "sketch")
        return rows.repartition("node").sortWithinPartitions("node", "n").mapInArrow(_leaves(self.least, self.num, self.den), "a long, b long")

    def blocks(self, groups: DataFrame) -> DataFrame:
        """(g, i, j, rep) of groups (g, rep) of any size: every two blocks of a group meet."""
        size = groups.groupBy("g").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks"))
        x = groups.join(size.hint("merge"), "g").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
        x = x.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        return x.filter("blocks < 3 or own <> other").select("g", F.when(F.col("blocks") < 3, 0).otherwise(F.least("own", "other")).alias("i"), F.when(F.col("blocks") < 3, 0).otherwise(F.greatest("own", "other")).alias("j"), "rep").distinct()

    def confirm(self, met: DataFrame) -> DataFrame:
        """Links of full sets among the classes that meet in one (g, i, j)."""
        texts = met.join(self.texts.hint("merge"), "rep").select("g", "i", "j", "rep", "text")
        return texts.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(_confirm(self.k, self.num, self.den), "a long, b long")

    def central(self, groups: DataFrame) -> DataFrame:
        """(g, rep) of the BLOCK classes of each group that hold the most of its most frequent tokens."""
        rows = groups.join(self.ids.hint("merge"), "rep").select("g", "rep", "sig")
        every = groups.groupBy("g").agg(F.ceil(F.count("*") / F.lit(SAMPLE)).alias("every"))
        modes = rows.join(every, "g").filter(F.pmod(F.xxhash64(F.lit(7), "rep"), F.col("every")) == 0).select("g", "sig").groupBy("g").applyInArrow(_modes, "g long, modes binary")
        scored = rows.join(modes, "g").mapInArrow(_central, "g long, rep long, score long")
        rank = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("score"), "rep"))
        return scored.withColumn("rank", rank).filter(F.col("rank") <= BLOCK).select("g", "rep")

    def large_links(self, members: DataFrame) -> DataFrame:
        """Links of full sets that give the same components as all links within the groups (g, rep) do."""
        sizes = materialize(members.groupBy("g").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks")), "sizes")
        links, pivots, rest, before = None, None, members, members.count()
        while True:
            new = materialize(self.central(rest), "pivots")
            others = members.join(new, ["g", "rep"], "left_anti").join(sizes, "g").select("g", F.lit(0).cast("long").alias("i"), (F.pmod(F.xxhash64("rep"), F.col("blocks")) + 1).alias("j"), "rep")
            each = new.join(sizes, "g").select("g", F.lit(0).cast("long").alias("i"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("blocks"))).alias("j"), "rep")
            found = materialize(self.confirm(others.union(each)), "confirmed")
            links, pivots = (links.union(found), pivots.union(new)) if links is not None else (found, new)
            at = members.join(components(links).withColumnRenamed("node", "rep"), "rep", "left").select("g", "rep", F.coalesce("component", "rep").alias("c"))
            most = at.groupBy("g", "c").agg(F.count("*").alias("n")).groupBy("g").agg(F.max(F.struct("n", "c")).alias("most")).select("g", F.col("most.c").alias("most"))
            # pivots have met all others
            open_ = members.join(pivots, ["g", "rep"], "left_anti")
            rest = materialize(at.join(most, "g").filter("c <> most").select("g", "rep").join(pivots, ["g", "rep"], "left_anti"), "rest")
            n = rest.count()
            if not n:
                return links
            if n <= BLOCK or 2 * n > before:
                break
            before = n
        # every block of the rest meets every block of the rest and of the other classes
        parts = materialize(rest.groupBy("g").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("q")).join(sizes, "g"), "parts")
        a = rest.join(parts, "g").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("q"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q") + F.col("blocks") - 1))).filter("own <> other")
        b = open_.join(rest, ["g", "rep"], "left_anti").join(parts, "g").withColumn("own", F.col("q") + F.pmod(F.xxhash64("rep"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q") - 1)))
        met = a.union(b.select(a.columns)).select("g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep")
        return links.union(self.confirm(met))

    def run(self) -> DataFrame:
        nodes, depth, found = self.ids.mapInArrow(_roots(self.trees), "node long, rep long"), 1, []
        while True:
            sizes = nodes.groupBy("node").agg(F.count("*").alias("size"), F.min("rep").alias("pivot")).filter("size > 1")
            held = materialize(nodes.join(sizes.hint("merge"), "node"), "nodes")
            found.append(self.leaf_links(held.filter(F.col("size") <= LEAF).select("node", "rep")))
            large = held.filter(F.col("size") > LEAF)
            if not large.limit(1).count():
                break
            if depth == self.deepest:
                found.append(large.select(F.col("pivot").alias("a"), F.col("rep").alias("b")))
                break
            nodes = large.join(self.ids.hint("merge"), "rep").select("node", "rep", "sig").mapInArrow(_branch, "node long, rep long")
            depth += 1
        all_found = found[0]
        for x in found[1:]:
            all_found = all_found.union(x)
        cluster = components(all_found)
        sizes = cluster.groupBy("component").agg(F.count("*").alias("size"))
        cluster = materialize(cluster.join(sizes.hint("merge"), "component").select(F.col("node").alias("rep"), F.col("component").alias("g"), (F.col("size") > PAIRWISE).alias("giant")), "clusters")
        own = cluster.join(self.classes.hint("merge"), "rep").select("rep", "__id", "__hash")
        self.texts = materialize(self.docs.hint("merge").join(own, ["__id", "__hash"]).groupBy("rep").agg(F.min("text").alias("text")), "texts")
        links = self.confirm(self.blocks(cluster.filter("not giant").select("g", "rep")))
        if cluster.filter("giant").limit(1).count():
            links = links.union(self.large_links(materialize(cluster.filter("giant").select("g", "rep"), "giants")))
        return components(links)


def _placed(docs: DataFrame, k: int, num: int, den: int, trees: int) -> DataFrame:
    """(__id, __hash, n, c, kept) of each row: c is the least doc_id of its component, whose least row is kept."""
    join = _Join(docs, k, num, den, trees)
    comp = join.run().withColumnRenamed("node", "rep")
    at = materialize(join.classes.join(comp.hint("merge"), "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component"), "placed")
    least = at.groupBy("c").agg(F.min(F.struct("__id", "__hash")).alias("least"))
    classes = at.join(least.hint("merge"), "c").select(F.col("rep").alias("h1"), "h2", "n", "least")
    out = join.signed.select("__id", "__hash", "n", "h1", "h2").join(classes.hint("merge"), ["h1", "h2", "n"], "left")
    own = F.struct("__id", "__hash")
    return out.select("__id", "__hash", "n", F.coalesce("least", own).alias("least")).select("__id", "__hash", "n", F.col("least.__id").alias("c"), (own == F.col("least")).alias("kept"))


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, trees: int = TREES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row; linked: den * intersection >= num * union of k-word sets.

    kept tells whether doc_id is component_id: rows that share the least doc_id of a component are all kept, whatever their
    texts. keep_one() is for one row of each component.
    """
    real = lambda x: F.when(F.col(x) != LEAST, F.col(x))
    return _placed(docs, k, num, den, trees).select(real("__id").alias("doc_id"), F.col("n").alias("n_shingles"), real("c").alias("component_id"), (F.col("__id") == F.col("c")).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, trees: int = TREES) -> DataFrame:
    """One row of docs of each component, with all its columns."""
    p = spare(docs)
    kept = _placed(docs, k, num, den, trees).filter("kept").select(F.col("__id").alias(p + "id"), F.col("__hash").alias(p + "hash")).distinct()
    key = [c.alias(p + n) for c, n in zip(row_key(docs), ("id", "hash"), strict=True)]
    rows = docs.select("*", *key).join(kept.hint("merge"), [p + "id", p + "hash"], "left_semi")
    return rows.dropDuplicates([p + "id", p + "hash"]).select(*[f"`{c}`" for c in docs.columns])
