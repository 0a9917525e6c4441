"""Conversation prefix trie by partition refinement.

A conversation is a row of two arrays of turn hashes (128 bits of role and text) and one of word counts; texts are read
once. All conversations begin in one class, the root. A round splits each active class by its members' next turns: a
class of depth d is known by the chain of its members' first d turn hashes, so splitting is one aggregation by that name
with partial sums, whatever share of all conversations one class holds, and no conversation meets another. Rounds take 1,
2, 4, 8, ... turns at once, so their number grows with the logarithm of the longest shared beginning. A conversation that
is alone in its class is retired: its tail is emitted as a unary chain and it takes part in no further round.

Folding back: each node's own value ((members - 1) x words of its last text; one leaf if it has no children) stands at its
smallest member, whose own nodes are a tail of its path. A sum from the end of the path gives what the conversation adds
to each of its prefixes, and an aggregation by the prefixes' names adds up conversations. The digest of the members that
end at a node is fed from sorted rows, one id at a time.

Defined results: turns are ordered by turn (null first), then role, then text; null role or text is empty; equal rows are
turns of their own. Rows with a null conv_id take no part. Conversations without turns are members of the root alone. No
conversations: no nodes, not even the root. Other columns are not read. One task takes the turns of a conversation
one after the other, and holds its hashes; the ids of one node's ends pass through one task, without being held.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .kernels import C1, U, mix

SEQUENCE = "conv_id long, a array<long>, b array<long>, w array<long>"
NAMES = "conv_id long, depth int, x long, y long, px long, py long, words long, ended boolean"
NOTHING = hashlib.sha256(b"").hexdigest()
#: The root's name.
ROOT = 0


def turn_hash(role: str, text: str) -> tuple[int, int]:
    """128 bits of role and text, neither of which can run into the other."""
    r = role.encode()
    h = xxhash.xxh3_128_digest(len(r).to_bytes(8, "little") + r + text.encode())
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def _sequences(batches):
    """Rows sorted by conversation and turn become one row a conversation."""
    conv, turns, out, held = None, [], [], 0

    def table():
        lists = [[c, *map(list, zip(*t, strict=True))] if t else [c, [], [], []] for c, t in out]
        cols = list(zip(*lists, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in cols[1:])], ["conv_id", "a", "b", "w"])

    for batch in batches:
        for c, r, t in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text")), strict=True):
            if c != conv:
                if conv is not None:
                    out.append((conv, turns))
                    held += len(turns)
                    if held > 100_000:
                        yield table()
                        out, held = [], 0
                conv, turns = c, []
            turns.append((*turn_hash(r, t), len(t.encode().split())))  # bytes: white space of ASCII alone
    if conv is not None:
        out.append((conv, turns))
    if out:
        yield table()


def sequences(chats: DataFrame) -> DataFrame:
    """(conv_id, a, b, w) of (conv_id, turn, role, text): hashes and word counts of each conversation's turns in order."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = chats.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text")).filter("conv_id is not null")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_sequences, SEQUENCE)


def _lists(batch, name: str) -> tuple[np.ndarray, np.ndarray]:
    col = batch.column(name)
    return col.flatten().to_numpy(), np.concatenate([[0], np.cumsum(col.value_lengths().to_numpy())]).astype(np.int64)


def _chain(batch, turns: int):
    """For 1 to turns: (rows that are as long, their names before, their names after)."""
    (a, at), (b, _) = _lists(batch, "a"), _lists(batch, "b")
    x, y = batch.column("x").to_numpy().view(U).copy(), batch.column("y").to_numpy().view(U).copy()
    size = np.diff(at)
    for j in range(min(turns, int(size.max(initial=0)))):
        rows = np.flatnonzero(size > j)
        px, py = x[rows], y[rows]
        x[rows] = mix(px * C1 + a[at[rows] + j].view(U) + U(1))
        y[rows] = mix(py * C1 + mix(b[at[rows] + j].view(U) + U(1)))
        yield j, rows, (px, py), (x[rows], y[rows]), at, size
    yield None, None, None, (x, y), at, size


def _split(depth: int, turns: int):
    """The names of each conversation's next classes."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, (w, _) = batch.column("conv_id").to_numpy(), _lists(batch, "w")
            for j, rows, before, after, at, size in _chain(batch, turns):
                if j is not None:
                    cols = [pa.array(conv[rows]), pa.array(np.full(len(rows), depth + j + 1, np.int32)), *(pa.array(v.view(np.int64)) for v in (*after, *before)), pa.array(w[at[rows] + j]), pa.array(size[rows] == j + 1)]
                    yield pa.RecordBatch.from_arrays(cols, ["conv_id", "depth", "x", "y", "px", "py", "words", "ended"])

    return run


def _advance(turns: int):
    """Conversations at the end of a round: their class's name, and the turns that are left."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                *_, (_, _, _, (x, y), _, _) = _chain(batch, turns)
                yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), *(batch.column(c) for c in "abw")], ["conv_id", "x", "y", "a", "b", "w"])

    return run


def _ends(batches):
    """Rows sorted by name and conv_id: the digest of each name's ids."""
    now, digest = None, None
    told = lambda n, d: pa.RecordBatch.from_pylist([{"x": n[0], "y": n[1], "ends_sha256": d.hexdigest()}])
    for batch in batches:
        done = []
        for x, y, c in zip(*(batch.column(n).to_pylist() for n in ("x", "y", "conv_id")), strict=True):
            if (x, y) == now:
                digest.update(b",%d" % c)
            else:
                if now is not None:
                    done.append((*now, digest.hexdigest()))
                now, digest = (x, y), hashlib.sha256(b"%d" % c)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*done, strict=True)], ["x", "y", "ends_sha256"])
    if now is not None:
        yield told(now, digest)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def refine(seqs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(names of every active conversation's classes, classes of two members or more, where each conversation is alone).

    The last has conv_id, the depth of its first class of its own, that class's parent's name, and the length.
    """
    active = seqs.select("conv_id", F.lit(ROOT).cast("long").alias("x"), F.lit(ROOT).cast("long").alias("y"), "a", "b", "w").filter("size(a) > 0")
    depth, turns, names, classes, alone = 0, 1, [], [], []
    while True:
        told = materialize(active.mapInArrow(_split(depth, turns), NAMES), "names")
        by = told.groupBy("x", "y").agg(F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.count_if("ended").alias("n_ended"), F.min("words").alias("words"), F.min("px").alias("px"), F.min("py").alias("py"))
        found = materialize(by, "classes")
        single = found.filter("n = 1").groupBy("conv_id").agg(F.min(F.struct("depth", "px", "py")).alias("single"))
        after = materialize(active.join(single.hint("merge"), "conv_id", "left").filter(F.col("single").isNotNull() | (F.size("a") > turns)), "refined")
        names.append(told)
        classes.append(found.filter("n > 1"))
        alone.append(after.filter("single is not null").select("conv_id", "single.*", (F.size("a") + depth).alias("length")))
        rest = after.filter("single is null").drop("single")
        if not rest.limit(1).count():
            return _union(names), _union(classes), _union(alone)
        left = rest.mapInArrow(_advance(turns), "conv_id long, x long, y long, a array<long>, b array<long>, w array<long>")
        cut = [F.slice(c, turns + 1, F.greatest(F.size(c) - turns, F.lit(0))).alias(c) for c in "abw"]
        active = left.select("conv_id", "x", "y", *cut)
        depth, turns = depth + turns, 2 * turns


def trie(seqs: DataFrame) -> DataFrame:
    """The nodes of the trie of (conv_id, a, b, w): conv_id, depth, parent_conv_id and the counts, sums and digest."""
    seqs = materialize(seqs, "sequences")
    whole = seqs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")).first()
    names, shared, alone = refine(seqs)
    zero, root = F.lit(0).cast("long"), F.lit(ROOT).cast("long")
    # each node's own value, at its smallest member; the first node of a unary chain stands for the chain's leaf
    leaf = F.when(F.col("n") == F.col("n_ended"), 1).otherwise(0).cast("long")
    own = shared.select("conv_id", "depth", ((F.col("n") - 1) * F.col("words")).alias("value"), leaf.alias("leaf")).union(alone.select("conv_id", "depth", zero, F.lit(1).cast("long")))
    own = materialize(own, "own")
    # what each conversation adds to its prefixes: the sum of its own nodes from there on
    path = names.select("conv_id", "depth", "x", "y", zero.alias("value"), zero.alias("leaf")).union(own.select("conv_id", "depth", F.lit(None).cast("long"), F.lit(None).cast("long"), "value", "leaf"))
    up = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    adds = path.select("x", "y", F.sum("value").over(up).alias("saved"), F.sum("leaf").over(up).alias("leaves")).filter("x is not null and (saved > 0 or leaves > 0)")
    ended = names.filter("ended").select("x", "y", "conv_id").union(seqs.filter("size(a) = 0").select(root, root, "conv_id"))
    ends = ended.repartition("x", "y").sortWithinPartitions("x", "y", "conv_id").mapInArrow(_ends, "x long, y long, ends_sha256 string")
    # sums by name: the node itself, its children, what conversations add, the digest
    top = seqs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")).filter("n > 0")
    row = lambda x, y, node=F.lit(None), children=zero, saved=zero, leaves=zero, sha=F.lit(None).cast("string"): [x.alias("x"), y.alias("y"), node.cast("struct<depth:int,conv_id:long,n:long,px:long,py:long>").alias("node"), children.alias("children"), saved.alias("saved"), leaves.alias("leaves"), sha.alias("ends_sha256")]
    c = F.col
    parts = [
        shared.select(*row(c("x"), c("y"), node=F.struct("depth", "conv_id", "n", "px", "py"))),
        top.select(*row(root, root, node=F.struct(F.lit(0), c("conv_id"), c("n"), F.lit(None).cast("long"), F.lit(None).cast("long")))),
        shared.select("px", "py").union(alone.select("px", "py")).select(*row(c("px"), c("py"), children=F.lit(1).cast("long"))),
        adds.select(*row(c("x"), c("y"), saved=c("saved"), leaves=c("leaves"))),
        own.select(*row(root, root, saved=c("value"), leaves=c("leaf"))),
        materialize(ends, "ends").select(*row(c("x"), c("y"), sha=c("ends_sha256"))),
    ]
    sums = _union(parts).groupBy("x", "y").agg(F.max("node").alias("node"), *[F.sum(k).alias(k) for k in ("children", "saved", "leaves")], F.max("ends_sha256").alias("ends_sha256"))
    nodes = materialize(sums.filter("node is not null").select("x", "y", "node.*", "children", "saved", "leaves", "ends_sha256"), "nodes")
    # parents of nodes and of the first nodes of unary chains; the root's id is known
    some = nodes.select("conv_id", "depth", "px", "py", "n", "children", "saved", "leaves", "ends_sha256", F.lit(None).cast("int").alias("length"))
    some = some.union(alone.select("conv_id", "depth", "px", "py", F.lit(1).cast("long"), zero, zero, F.lit(1).cast("long"), F.lit(None).cast("string"), "length"))
    known = nodes.select(c("x").alias("px"), c("y").alias("py"), c("conv_id").alias("up"))
    placed = some.filter("depth > 1").join(known.hint("merge"), ["px", "py"], "left").drop("px", "py").unionByName(some.filter("depth <= 1").drop("px", "py").withColumn("up", F.when(c("depth") == 1, F.lit(whole["conv_id"])).cast("long")))
    lone, last = c("length").isNotNull(), c("at") == c("length")
    each = placed.withColumn("at", F.explode(F.sequence("depth", F.coalesce("length", "depth"))))
    return each.select(
        "conv_id", c("at").cast("long").alias("depth"), F.when(lone & (c("at") > c("depth")), c("conv_id")).otherwise(c("up")).alias("parent_conv_id"), c("n").alias("n_convs"),
        F.when(lone, F.when(last, 0).otherwise(1)).otherwise(c("children")).cast("long").alias("n_children"), F.greatest("leaves", F.lit(1)).cast("long").alias("n_leaves"), c("saved").alias("saved_tokens"),
        F.when(lone & last, F.sha2(c("conv_id").cast("string"), 256)).otherwise(F.coalesce("ends_sha256", F.lit(NOTHING))).alias("ends_sha256"),
    )


def with_heads(seqs: DataFrame, every: int, heads: int) -> DataFrame:
    """Sequences whose first h turns are those of conversation conv_id - conv_id % every; h: crc32 of the id as text modulo heads."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % every
    first = seqs.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), *[F.slice(c, 1, heads - 1).alias("head_" + c) for c in "abw"])
    x = seqs.withColumn("base", base).join(first.hint("merge"), "base", "left").withColumn("h", h)
    new = lambda c: F.concat(F.slice(F.coalesce("head_" + c, F.array().cast("array<long>")), F.lit(1), F.col("h")), F.slice(c, F.col("h") + 1, F.greatest(F.size(c) - F.col("h"), F.lit(0))))
    return x.select("conv_id", *[new(c).alias(c) for c in "abw"])
