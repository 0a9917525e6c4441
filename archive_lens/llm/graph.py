"""Connected components of a link table by contraction: Spark rounds of one exchange each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, release
from .kernels import U, mix

#: Links that a task contracts at once: bounds its memory.
CHUNK = 1_000_000
ROWS = "done boolean, node long, p long"


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of n nodes is connected with by the edges (a, b)."""
    lab = np.arange(n)
    while True:
        m = np.minimum(lab[a], lab[b])
        new = lab.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def contract(a: np.ndarray, b: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of all nodes of the edges: a root is the first of its nodes in an order that the seed shuffles."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    o = np.argsort(mix(nodes.view(U) + U(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)))
    place = np.empty(len(o), np.int64)
    place[o] = np.arange(len(o))
    at = place[at.reshape(-1)]
    nodes = nodes[o]
    return nodes, nodes[labels(len(nodes), at[: len(a)], at[len(a) :])]


def _rows(done: bool, node: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(node), done)), pa.array(node, pa.int64()), pa.array(p, pa.int64())], ["done", "node", "p"])


def _begin(batches):
    a, b, held = [], [], 0
    for x in batches:
        a.append(x.column("a").to_numpy())
        b.append(x.column("b").to_numpy())
        held += x.num_rows
        if held > CHUNK:
            yield _rows(False, *contract(np.concatenate(a), np.concatenate(b), 0))
            a, b, held = [], [], 0
    if held:
        yield _rows(False, *contract(np.concatenate(a), np.concatenate(b), 0))


def _round(seed: int):
    """From (node, root) of all tasks, sorted by node: what is done, and the contracted rest.

    A node that is nowhere a root (its own root) is done: it points to one of its roots, and its roots are linked with
    each other. All other nodes are linked with their roots and go on.
    """

    def split(node, p):
        cut = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        group = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(node))))
        root = np.bincount(group, p == node) > 0
        first = p[cut]
        fresh = ~root
        other = fresh[group] & (p != first[group])
        goes = root[group] & (p != node)
        return (node[cut][fresh], first[fresh]), (np.concatenate([p[other], node[goes]]), np.concatenate([first[group][other], p[goes]]))

    def run(batches):
        node, p, a, b, held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], [], 0
        for x in batches:
            node, p = np.concatenate([node, x.column("node").to_numpy()]), np.concatenate([p, x.column("p").to_numpy()])
            end = int(np.searchsorted(node, node[-1])) if len(node) else 0
            if end:
                done, rest = split(node[:end], p[:end])
                node, p = node[end:], p[end:]
                yield _rows(True, *done)
                a.append(rest[0])
                b.append(rest[1])
                held += len(rest[0])
                if held > CHUNK:
                    yield _rows(False, *contract(np.concatenate(a), np.concatenate(b), seed))
                    a, b, held = [], [], 0
        if len(node):
            done, rest = split(node, p)
            yield _rows(True, *done)
            a.append(rest[0])
            b.append(rest[1])
            held += len(rest[0])
        if held:
            yield _rows(False, *contract(np.concatenate(a), np.concatenate(b), seed))

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that the links (a, b) lead to. Nodes without links are left out.

    Every task contracts its own links to stars, so a hub costs one row a task; stars are dealt by their nodes, where a
    node that is no star's centre is done for good. The centres are drawn anew in every round, so whatever the numbering a
    fixed share of the nodes is done in each and the number of rounds grows with the logarithm of the largest component.
    At last the pointers of the rounds are followed from the last to the first. Every round is a table in the shared
    folder: a lost executor costs one round at most.
    """
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    links = materialize(links, "links")  # what makes links and what contracts them are no two Python workers of one task
    told = materialize(links.mapInArrow(_begin, ROWS), "contracted")
    release(links)
    rounds = [told]
    while told.filter("not done").limit(1).count():
        active = told.filter("not done").select("node", "p").repartition("node").sortWithinPartitions("node")
        told = materialize(active.mapInArrow(_round(len(rounds)), ROWS), "contracted")
        rounds.append(told)
    below = None
    for told in reversed(rounds[1:]):  # what a round's nodes point to is done in a later one, or is a component's root
        own = told.filter("done").select("node", F.col("p").alias("root"))
        if below is not None:
            known = below.select(F.col("node").alias("root"), F.col("root").alias("top")).hint("merge")
            own = below.union(own.join(known, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
        last, below = below, materialize(own, "pointers")
        for x in (told, last):
            if x is not None:
                release(x)
    release(rounds[0])
    if below is None:
        return links.sparkSession.createDataFrame([], "node long, component long")
    # the root is no node of the pointers: one row more a component
    least = below.groupBy("root").agg(F.least(F.min("node"), F.col("root")).alias("component"))
    out = materialize(below.join(least.hint("merge"), "root").select("node", "component").union(least.select(F.col("root").alias("node"), "component")), "components")
    release(below)
    return out
