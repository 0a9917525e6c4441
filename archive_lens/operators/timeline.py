"""Message counts and first/last times of pages, chats and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scalars as S
from .refs import all_groups


def page_events(lines: DataFrame) -> DataFrame:
    """(file, line_no, marks, day, times): what each line of (file, line_no, line) tells; times are of the messages.

    A day stands on the line after a details mark. A date that is none ends its page: the line it stands on still counts
    its marks and the times before it.
    """
    per_file = Window.partitionBy("file").orderBy("line_no")
    mark = lambda m: (F.length("line") - F.length(F.replace("line", F.lit(m)))) / F.lit(len(m))
    number = lambda c: F.nullif(c, F.lit("")).try_cast("int")
    stamps = F.transform(all_groups(F.col("line"), K.TIMESTAMP, *range(1, 9)), lambda m: S.message_time(*[number(m[f"g{i}"]) for i in range(8)]))
    x = lines.select("file", "line_no", (mark(K.MESSAGE_MARK) - mark(K.SEPARATOR_MARK)).cast("long").alias("marks"), F.lag(F.col("line").contains(K.DETAILS_MARK)).over(per_file).alias("after"), F.when(F.col("line").contains("pull_right date details"), stamps).otherwise(F.array().cast("array<timestamp>")).alias("times"), "line")
    x = x.withColumn("day", F.when(F.col("after"), S.day_separator(F.col("line")))).drop("line", "after")
    bad = F.when(F.exists("times", lambda t: t.isNull()), F.col("line_no"))
    x = x.withColumn("stop", F.min(bad).over(Window.partitionBy("file"))).filter(F.col("stop").isNull() | (F.col("line_no") <= F.col("stop")))
    first_bad = F.transform("times", lambda t: t.isNull())
    before = F.when(F.col("line_no") == F.col("stop"), F.slice("times", 1, F.greatest(F.array_position(first_bad, True).cast("int") - 1, F.lit(0)))).otherwise(F.col("times"))
    return x.withColumn("times", before).drop("stop")


def page_sums(events: DataFrame) -> DataFrame:
    """One row per file of page_events()."""
    return events.groupBy("file").agg(F.sum("marks").alias("messages"), F.min(F.array_min("times")).alias("first"), F.max(F.array_max("times")).alias("last"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def chat_timeline(pages: DataFrame, *chat: str) -> DataFrame:
    """Per chat of page_sums() with chat columns: messages, first, last, their files, basis; of equal times the first file's."""
    has = F.col("first").isNotNull()
    g = pages.groupBy(*chat).agg(
        F.sum("messages").alias("messages"), F.min("first").alias("t0"), F.max("last").alias("t1"),
        F.min(F.when(has, F.struct("first", "file"))).alias("a"), F.min(F.when(has, F.struct((-F.unix_micros("last")).alias("k"), "file"))).alias("b"),
        F.min("first_day").alias("d0"), F.max("last_day").alias("d1"),
    )
    timed = F.col("t0").isNotNull()
    basis = F.when(timed, "message_timestamps").when(F.col("d0").isNotNull(), "day_separators")
    return g.select(*chat, "messages", F.when(timed, F.col("t0")).otherwise(F.col("d0")).alias("first"), F.when(timed, F.col("t1")).otherwise(F.col("d1")).alias("last"), F.col("a.file").alias("first_source"), F.col("b.file").alias("last_source"), basis.alias("basis"))


def export_rollup(chats: DataFrame, *export: str) -> DataFrame:
    """Per export of chat_timeline(): chats, messages, the range of the chats' ranges and the winning chats' sources."""
    first, last = F.struct("first", "chat", "first_source"), F.struct((-F.unix_micros("last")).alias("k"), "chat", "last_source")
    g = chats.groupBy(*export).agg(
        F.count("*").alias("chats"), F.sum("messages").alias("messages"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.min(F.when(F.col("first").isNotNull(), first)).alias("a"), F.min(F.when(F.col("last").isNotNull(), last)).alias("b"),
        F.bool_or(F.col("basis") == "message_timestamps").alias("timed"), F.min(F.when(F.col("basis").isNotNull(), F.struct("chat", "basis"))).alias("c"),
    )
    return g.select(*export, "chats", "messages", "first", "last", F.col("a.first_source").alias("first_source"), F.col("b.last_source").alias("last_source"), F.when(F.col("timed"), "message_timestamps").otherwise(F.col("c.basis")).alias("basis"))
