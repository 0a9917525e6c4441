"""What the queries share: tables, folds and widths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, modulo: int) -> Column:
    """crc32 of the id as text, modulo; a null id is fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulo, F.lit(0))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(df: DataFrame) -> DataFrame:
    """doc_id and text alone: what an operator reads, whatever other columns there are."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def spare(df: DataFrame) -> str:
    """A beginning of column names that none of df's has."""
    p = "__"
    while any(c.lower().startswith(p) for c in df.columns):
        p += "_"
    return p
