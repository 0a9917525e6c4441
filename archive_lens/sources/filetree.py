"""A folder tree as a table, bodies of files, and whether paths exist.

A Python data source lists a tree, also with hidden names, which Spark's own file sources skip. It opens no file: bodies
are a step of their own (bodies()), asked for by those who need them, for the files that they need. Folders are on a file
system that all workers mount.
"""

from __future__ import annotations

import json
import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, dir string, name string, ext string, is_dir boolean, size bigint, depth int"
NAMES = ["path", "dir", "name", "ext", "is_dir", "size", "depth"]
#: Folders that are listed, at most, while the partitions are planned, and partitions that are planned for.
PLANNED, TASKS = 2000, 64
#: Bytes of bodies for a task, and for a batch.
TASK_BYTES, BATCH_BYTES = 32 << 20, 8 << 20


class _Part(InputPartition):
    def __init__(self, folders: list[str], deep: bool, top: bool = False):
        self.folders, self.deep, self.top = folders, deep, top


class FileTreeReader(DataSourceReader):
    """Levels of the tree are listed until one has folders enough for all tasks; each task walks its share of them.

    The option `where` has tests (column, test, value ...) that all rows must pass: =, in, starts and ends. Where paths must
    begin with something, no other subtree is entered.
    """

    def __init__(self, options):
        self.root = os.path.abspath(options["path"])
        self.tasks, self.planned = int(options.get("tasks", TASKS)), int(options.get("planned", PLANNED))
        self.tests = [(name, test, values) for name, test, *values in json.loads(options.get("where", "[]"))]
        if bad := [t for t in self.tests if t[0] not in NAMES or t[1] not in ("=", "in", "starts", "ends")]:
            raise ValueError(f"unknown test: {bad[0]}")

    def _enter(self, folder: str) -> bool:
        """Whether anything below a folder can pass the tests."""
        return all(any(folder.startswith(v) or v.startswith(folder) for v in values) for name, test, values in self.tests if name == "path" and test != "ends")

    def _wanted(self, row: tuple) -> bool:
        for name, test, values in self.tests:
            x = row[NAMES.index(name)]
            if x is None or not (x in values if test in ("=", "in") else x.startswith(tuple(values)) if test == "starts" else x.endswith(tuple(values))):
                return False
        return True

    def partitions(self):
        listed, level = [], [self.root]
        while level and len(level) < 4 * self.tasks and len(listed) + len(level) <= self.planned:
            listed += level
            level = [e.path for d in level for e in self._scan(d) if e.is_dir(follow_symlinks=False) and self._enter(e.path)]
        deal = lambda xs, n: [xs[k::n] for k in range(min(n, len(xs)))]
        shallow = [_Part(x, False) for x in deal(listed, self.tasks)]
        shallow[0].top = True
        return shallow + [_Part(x, True) for x in deal(sorted(level), 4 * self.tasks)]

    @staticmethod
    def _scan(folder: str):
        try:
            with os.scandir(folder) as it:
                yield from it
        except OSError:
            return

    def read(self, part):
        if part.top and self._wanted(row := self._row(self.root)):
            yield row
        left = list(part.folders)
        while left:
            for e in self._scan(left.pop()):
                if part.deep and e.is_dir(follow_symlinks=False) and self._enter(e.path):
                    left.append(e.path)
                if self._wanted(row := self._row(e.path)):
                    yield row

    @staticmethod
    def _row(path: str):
        name, is_dir = os.path.basename(path), os.path.isdir(path)
        try:
            size = os.stat(path).st_size
        except OSError:
            size = None
        return path, os.path.dirname(path), name, os.path.splitext(name)[1].lower().lstrip("."), is_dir, size, len([p for p in path.split("/") if p])


class FileTree(DataSource):
    """`spark.read.format("filetree").load(folder)`: a row for the folder and for all that lies below it."""

    @classmethod
    def name(cls):
        return "filetree"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FileTreeReader(self.options)


def files(spark: SparkSession, root: str, where: tuple[tuple, ...] = (), **options) -> DataFrame:
    """The rows of a folder's tree that pass all tests of `where`."""
    spark.dataSource.register(FileTree)
    return spark.read.format("filetree").option("where", json.dumps(where)).options(**options).load(root)


def _bodies(most: int | None):
    def run(batches):
        for b in batches:
            rows, texts, held = [], [], 0

            def table():
                got = b.take(pa.array(rows, pa.int64()))
                return pa.RecordBatch.from_arrays([*got.columns, pa.array(texts, pa.string())], [*b.schema.names, "text"])

            for k, path in enumerate(b.column("file").to_pylist()):
                try:
                    with open(path, "rb") as f:
                        texts.append(f.read(-1 if most is None else most).decode("utf-8", "ignore"))
                except OSError:
                    continue  # gone since it was listed
                rows.append(k)
                held += len(texts[-1])
                if held > BATCH_BYTES:
                    yield table()
                    rows, texts, held = [], [], 0
            if rows:
                yield table()

    return run


def bodies(files: DataFrame, *keep: str, most: int | None = None) -> DataFrame:
    """(file, *keep, text) of files (path, size, is_dir): UTF-8 without the bytes that are none, the first `most` bytes only if given.

    Files are dealt to tasks by a hash of their path, in as many tasks as their bytes need; a file is read by one task.
    """
    rows = files.filter(~F.col("is_dir")).select(F.col("path").alias("file"), *keep, "size")
    size = F.col("size") if most is None else F.least("size", F.lit(most))
    total = rows.agg(F.sum(size).alias("bytes"), F.count("*").alias("n")).first()
    tasks = max(1, min(total["n"], max(-(-(total["bytes"] or 0) // TASK_BYTES), rows.sparkSession.sparkContext.defaultParallelism)))
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("file", *keep))
    return rows.drop("size").repartition(tasks, "file").mapInArrow(_bodies(most), f"{schema}, text string")


def _exist(batches):
    for b in batches:
        yield b.filter(pa.array([os.path.exists(p) for p in b.column("path").to_pylist()], pa.bool_()))


def existing(paths: DataFrame, path: Column) -> DataFrame:
    """(path) of the distinct paths that exist: files and folders, links followed. Probed by the executors."""
    distinct = paths.select(path.alias("path")).filter("path is not null").distinct()
    return distinct.repartition(int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path").mapInArrow(_exist, "path string")
