"""Session helpers: the settings the engine expects and one place for shared intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "archive_lens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and skew handling on."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one is set only where none is configured (tests, local runs)."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("archive_lens.shared.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="archive_lens_")
        spark.conf.set("archive_lens.shared.dir", at)
    return at.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, so lost executors cost only a reread."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _HELD.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._held_at = path
    return out


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for files that are no tables; the folder must be mounted, as files need one."""
    at = urlparse(shared_dir(spark))
    if at.scheme not in ("", "file"):
        raise ValueError(f"no mounted folder: {at.geturl()}")
    path = f"{at.path}/{name}-{uuid.uuid4().hex}"
    _HELD.append("file://" + path)
    return path


_HELD: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(df: DataFrame) -> None:
    """Delete a table made by materialize() that nothing reads any more."""
    path = df._held_at
    _HELD.remove(path)
    _delete(df.sparkSession, path)


def release_all(spark: SparkSession) -> None:
    """Delete all tables of materialize(): for callers that have written their results."""
    while _HELD:
        _delete(spark, _HELD.pop())
