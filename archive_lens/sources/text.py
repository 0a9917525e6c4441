"""Lines of texts as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lines(texts: DataFrame) -> DataFrame:
    """(file, line_no from 1, line) of (file, text), other columns kept; all three kinds of line ends part lines, the last empty line is none."""
    parts = F.split(F.regexp_replace("text", r"(\r\n|\r|\n)\z", ""), r"\r\n|\r|\n")
    other = [c for c in texts.columns if c not in ("file", "text")]
    return texts.filter(F.col("text") != "").select("file", *other, F.posexplode(parts).alias("n", "line")).select("file", (F.col("n") + 1).alias("line_no"), "line", *other)
