"""Execution of plans on a file system that all workers mount: the only module with side effects.

A plan is written before anything is done. Copies and renames are steps of their own: each goes through a temporary
neighbour, so a repeated task does no harm. Pages and markers are written in two jobs: the first stages every page beside
its place, under a name that the plan gives it, the second puts them in their places. If the first fails, what it staged
is removed and no page has changed; no place ever holds half a page.
"""

from __future__ import annotations

import os
import shutil
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

STAGED = ("rewrite", "marker")
COUNTS = ("written", "skipped")


def _staged_at(dst: str, plan: str) -> str:
    return f"{dst}.{plan}.staged"


def _stage(dst: str, text: str, plan: str) -> None:
    os.makedirs(os.path.dirname(dst), exist_ok=True)
    tmp = f"{dst}.{uuid.uuid4().hex}.tmp"
    try:
        with open(tmp, "w", encoding="utf-8", newline="") as f:
            f.write(text)
        os.replace(tmp, _staged_at(dst, plan))
    except BaseException:
        if os.path.exists(tmp):
            os.remove(tmp)
        raise


def _copy(src: str, dst: str, overwrite: bool) -> bool:
    """Whether src was copied: a file that is there stays as it is unless it may be overwritten."""
    if not overwrite and os.path.isfile(dst):
        return False
    os.makedirs(os.path.dirname(dst), exist_ok=True)
    tmp = f"{dst}.{uuid.uuid4().hex}.tmp"
    shutil.copy2(src, tmp)
    os.replace(tmp, dst)
    return True


def step(action: str, src: str | None, dst: str, overwrite: bool = True) -> tuple[str, int, int]:
    """(outcome, files written, files that were there and stayed)."""
    try:
        if action == "copy":
            done = _copy(src, dst, overwrite)
            return ("done", 1, 0) if done else ("skipped", 0, 1)
        if action == "copy_tree":
            done = [_copy(os.path.join(at, x), os.path.join(dst, os.path.relpath(os.path.join(at, x), src)), overwrite) for at, _, names in os.walk(src) for x in names]
            return "done", sum(done), len(done) - sum(done)
        if action == "rename":
            if os.path.exists(src) or not os.path.exists(dst):
                os.rename(src, dst)
            return "done", 0, 0
        return f"unknown action {action}", 0, 0
    except OSError as e:
        return f"failed: {e.strerror}", 0, 0


def _told(batch: pa.RecordBatch, names: list[str], outcomes: list[tuple[str, int, int]]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64())
    new = [pa.array(x, k) for x, k in zip(zip(*outcomes, strict=True), kinds, strict=True)] if outcomes else [pa.array([], k) for k in kinds]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *new], [*names, "outcome", *COUNTS])


def _run(names: list[str], overwrite: bool):
    def run(batches):
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("action", "src", "dst")]
            yield _told(b, names, [step(*x, overwrite) for x in zip(*cols, strict=True)])

    return run


def _stage_all(names: list[str], plan: str):
    def run(batches):
        for b in batches:
            out = []
            for dst, text in zip(b.column("dst").to_pylist(), b.column("payload").to_pylist(), strict=True):
                try:
                    _stage(dst, text, plan)
                    out.append(("staged", 1, 0))
                except OSError as e:
                    out.append((f"failed: {e.strerror}", 0, 0))
            yield _told(b, names, out)

    return run


def _publish(names: list[str], plan: str):
    def run(batches):
        for b in batches:
            out = []
            for dst, was, n in zip(*(b.column(c).to_pylist() for c in ("dst", "outcome", "written")), strict=True):
                try:
                    if was == "staged" and os.path.exists(_staged_at(dst, plan)):  # a task that runs again finds it done
                        os.replace(_staged_at(dst, plan), dst)
                    out.append(("done" if was == "staged" else was, n, 0))
                except OSError as e:
                    out.append((f"failed: {e.strerror}", 0, 0))
            yield _told(b, names, out)

    return run


def _discard(plan: str):
    def run(batches):
        for b in batches:
            gone = 0
            for dst in b.column("dst").to_pylist():
                if os.path.exists(_staged_at(dst, plan)):
                    os.remove(_staged_at(dst, plan))
                    gone += 1
            yield pa.RecordBatch.from_arrays([pa.array([gone])], ["gone"])

    return run


def execute(plan: DataFrame, dry_run: bool = True, overwrite: bool = True) -> DataFrame:
    """The plan's columns without payload, with the outcome of every step and the files that it wrote and skipped.

    By rank, each rank done before the next. Dry: the plan as it would run. overwrite: whether copies replace files that are
    there. A step that the file system refuses has that as its outcome and hinders no other.
    """
    names = [c for c in plan.columns if c not in ("rank", "payload", "src")]
    zero = [F.lit(0).cast("long").alias(c) for c in COUNTS]
    if dry_run:
        return plan.select(*names, F.lit("planned").alias("outcome"), *zero)
    held = materialize(plan, "plan")  # steps change what a plan was made from: it is never computed again
    name = uuid.uuid4().hex
    schema = ", ".join(f"{c} {held.schema[c].dataType.simpleString()}" for c in names) + ", outcome string, written long, skipped long"
    out = None
    for r in sorted(x["rank"] for x in held.select("rank").distinct().collect()):  # the few ranks of a plan
        own = held.filter(F.col("rank") == r)
        files = own.filter(F.col("action").isin(*STAGED))
        done = [own.filter(~F.col("action").isin(*STAGED)).mapInArrow(_run(names, overwrite), schema)]
        if files.limit(1).count():
            try:
                staged = materialize(files.mapInArrow(_stage_all(names, name), schema), "staged")
            except Exception:
                files.select("dst").mapInArrow(_discard(name), "gone long").agg(F.sum("gone")).collect()
                raise
            done.append(staged.mapInArrow(_publish(names, name), schema))
        for x in done:
            x = materialize(x, "outcomes")
            out = x if out is None else out.unionByName(x)
    return out if out is not None else plan.select(*names, F.lit("planned").alias("outcome"), *zero)


def statistics(outcomes: DataFrame, scanned: DataFrame | None = None, by: str = "chat") -> DataFrame:
    """What was done, by chat: pages scanned and rewritten, references rewritten, files copied, skipped and failed.

    outcomes: of execute(), of a plan with the columns `by` and rewrites; scanned: (by) of every page that was looked at.
    """
    ok = F.col("outcome").isin("done", "planned")
    page, copy = F.col("action") == "rewrite", F.col("action").isin("copy", "copy_tree")
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    each = [F.count_if(page & ok).alias("pages_rewritten"), n(F.when(page & ok, F.col("rewrites"))).alias("references_rewritten"), n(F.when(copy, F.col("written"))).alias("files_copied"), n(F.when(copy, F.col("skipped"))).alias("files_skipped"), F.count_if(F.col("outcome").startswith("failed")).alias("failed")]
    done = outcomes.groupBy(by).agg(*each)
    if scanned is None:
        return done
    seen = scanned.groupBy(by).agg(F.count("*").alias("pages_scanned"))
    return seen.join(done, by, "full").na.fill(0).withColumn("pages_unchanged", F.col("pages_scanned") - F.col("pages_rewritten"))
