"""SQLite tables, read only; all values are text.

One database: a Python data source with columns found at run time (read()). Many of them, as a folder may hold: executors
probe what tables they have (probe()) and read ranges of row ids of one table of all databases at once (scan()), so neither
the plan nor the driver's work grows with their number. Databases are on a file system that all workers mount.
"""

from __future__ import annotations

import json
import os
import sqlite3
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

#: Row ids of a partition, and the bytes that a row takes at least: sparse ids are no reason for more partitions.
ROWS, ROW_BYTES = 1_000_000, 4
#: Bytes of databases for a task, and rows of a batch.
TASK_BYTES, BATCH = 64 << 20, 10_000
TABLES = "path string, table string, columns array<string>, cuts array<long>, bytes long"
COMPARED = ("=", ">", ">=", "<", "<=")


def _open(path: str) -> sqlite3.Connection:
    con = sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)
    con.text_factory = lambda x: x.decode("utf-8", "replace")
    return con


def _name(x: str) -> str:
    return '"' + x.replace('"', '""') + '"'


def columns(path: str, table: str) -> list[str]:
    con = _open(path)
    try:
        return _columns(con, table)
    finally:
        con.close()


def _columns(con: sqlite3.Connection, table: str) -> list[str]:
    return [r[1] for r in con.execute(f"pragma table_info({_name(table)})")]


def _cuts(con: sqlite3.Connection, table: str, size: int, rows: int, parts: int = 0) -> list[int]:
    """The row ids at which a table's ranges meet: `parts` ranges, else one for every `rows` rows that it may have."""
    try:
        lo, hi = con.execute(f"select min(rowid), max(rowid) from {_name(table)}").fetchone()
    except sqlite3.Error:  # a table without row ids
        return []
    if not isinstance(lo, int) or not isinstance(hi, int):
        return []
    span = hi - lo + 1
    n = min(span, parts or -(-min(span, size // ROW_BYTES) // rows))
    return [lo + span * k // n for k in range(1, n)]


class _Range(InputPartition):
    def __init__(self, lo: int | None, hi: int | None):
        self.lo, self.hi = lo, hi


def condition(column: str, test: str, *values: str) -> tuple[str, list]:
    """SQL of a test of a column, as text, and its arguments: null, not null, = > >= < <= (one value), in, starts (one value).

    Strings are compared byte by byte, as Spark compares them.
    """
    text = f"cast({_name(column)} as text)"
    if test in ("null", "not null"):
        return f"{_name(column)} is {test}", []
    if test in COMPARED:
        return f"{text} {test} ?", list(values)
    if test == "in":
        return f"{text} in ({', '.join('?' for _ in values)})", list(values)
    if test == "starts":
        return f"substr({text}, 1, ?) = ?", [len(values[0]), values[0]]
    raise ValueError(f"unknown test: {test}")


def _ask(table: str, what: list[str], tests: list[str], args: list, lo: int | None, hi: int | None) -> tuple[str, list]:
    ends = [(t, x) for t, x in (("rowid >= ?", lo), ("rowid < ?", hi)) if x is not None]
    tests, args = [t for t, _ in ends] + tests, [x for _, x in ends] + args
    return f"select {', '.join(what) or 'null'} from {_name(table)}" + (" where " + " and ".join(tests) if tests else ""), args


class SqliteReader(DataSourceReader):
    """Partitions are ranges of row ids: as many as asked for (`partitions`), else one for every ROWS of the table.

    The tests of the option `where` are part of what the database is asked. They are an option and not left to Spark's
    filter pushdown, which keeps the filters of one use of a DataFrame for its other uses in the same query.
    """

    def __init__(self, options, schema):
        self.path, self.table = options["path"], options["table"]
        self.parts, self.rows = int(options.get("partitions", "0")), int(options.get("rows", ROWS))
        self.names = [f.name for f in schema.fields]
        tests = [condition(*t) for t in json.loads(options.get("where", "[]"))]
        self.where, self.args = [t for t, _ in tests], [a for _, args in tests for a in args]

    def partitions(self):
        con = _open(self.path)
        try:
            cuts = _cuts(con, self.table, os.path.getsize(self.path), self.rows, self.parts)
        finally:
            con.close()
        return [_Range(a, b) for a, b in zip([None, *cuts], [*cuts, None], strict=True)]

    def query(self, part: _Range) -> tuple[str, list]:
        """What a partition asks the database."""
        return _ask(self.table, [f"cast({_name(n)} as text)" for n in self.names], self.where, self.args, part.lo, part.hi)

    def read(self, part):
        con = _open(self.path)
        try:
            yield from con.execute(*self.query(part))
        finally:
            con.close()


class Sqlite(DataSource):
    """`spark.read.format("sqlite_table").option("table", name).load(path)`; a schema that is given reads its columns alone."""

    @classmethod
    def name(cls):
        return "sqlite_table"

    def schema(self):
        return StructType([StructField(c, StringType()) for c in columns(self.options["path"], self.options["table"])])

    def reader(self, schema):
        return SqliteReader(self.options, schema)


def read(spark: SparkSession, path: str, table: str, *only: str, where: tuple[tuple[str, ...], ...] = (), **options) -> DataFrame:
    """A table's columns, or those of `only` that it has, of the rows that pass all tests of `where` (see condition())."""
    spark.dataSource.register(Sqlite)
    source = spark.read.format("sqlite_table").option("table", table).option("where", json.dumps(where)).options(**options)
    if only:
        source = source.schema(StructType([StructField(c, StringType()) for c in columns(path, table) if c in only]))
    return source.load(path)


def _probe(rows: int):
    def run(batches):
        for b in batches:
            found = []
            for path in b.column("path").to_pylist():
                try:
                    size, con = os.path.getsize(path), _open(path)
                except (OSError, sqlite3.Error):
                    continue  # gone since it was listed
                try:
                    for (t,) in con.execute("select name from sqlite_master where type = 'table' order by name").fetchall():
                        found.append((path, t, _columns(con, t), _cuts(con, t, size, rows), size))
                except sqlite3.Error:
                    found = [x for x in found if x[0] != path]  # no database, or a broken one
                finally:
                    con.close()
            cols = list(zip(*found, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], ["path", "table", "columns", "cuts", "bytes"])

    return run


def probe(paths: DataFrame, rows: int = ROWS) -> DataFrame:
    """(path, table, columns, cuts, bytes) of every table of the databases among the distinct paths (path); cuts are the row
    ids at which a table's ranges meet. What is no database, or can't be read, has no rows."""
    tasks = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return paths.select("path").filter("path is not null").distinct().repartition(tasks, "path").mapInArrow(_probe(rows), TABLES)


def _scan(where: tuple[tuple[str, ...], ...]):
    def table(path, rows):
        return pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array(rows, pa.list_(pa.string()))], ["path", "values"])

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                have = {c.lower() for c in r["columns"]}
                if any(t[0].lower() not in have and t[1] != "null" for t in where):
                    continue
                tests = [condition(*t) for t in where if t[0].lower() in have]
                what = [f"cast({_name(n)} as text)" if n.lower() in have else "null" for n in r["wanted"]]
                con = _open(r["path"])
                try:
                    cursor = con.execute(*_ask(r["table"], what, [t for t, _ in tests], [a for _, args in tests for a in args], r["lo"], r["hi"]))
                    while rows := cursor.fetchmany(BATCH):
                        yield table(r["path"], rows)
                finally:
                    con.close()

    return run


def scan(found: DataFrame, table: str, wanted: Column, where: tuple[tuple[str, ...], ...] = ()) -> DataFrame:
    """(path, values) of a table's rows in all databases of found, a stored result of probe(): values are those of the
    columns that `wanted` lists, an array that may differ by database, in its order.

    A column that a database's table lacks is null there. Only rows that pass all tests of `where` (see condition()) leave
    a database. Ranges are dealt to as many tasks as the databases' bytes need; a task holds BATCH rows of one at a time.
    """
    spark = found.sparkSession
    k = F.col("k")
    cut = lambda n: F.try_element_at(F.col("cuts"), n)
    held = found.filter(F.col("table") == table)
    total = held.agg(F.sum(F.size("cuts") + 1).alias("n"), F.sum("bytes").alias("bytes")).first()
    if not total["n"]:
        return spark.createDataFrame([], "path string, values array<string>")
    tasks = min(total["n"], max(-(-total["bytes"] // TASK_BYTES), spark.sparkContext.defaultParallelism))
    ranges = held.withColumn("k", F.explode(F.sequence(F.lit(0), F.size("cuts")))).select("path", "table", "columns", wanted.alias("wanted"), F.when(k > 0, cut(F.greatest(k, F.lit(1)))).alias("lo"), cut(k + 1).alias("hi"))
    return ranges.repartition(tasks, "path", "lo").mapInArrow(_scan(where), "path string, values array<string>")
