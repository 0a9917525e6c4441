"""Folder trees as relations: discovery of exports, ancestors, sizes, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scalars as S
from ..session import materialize


#: Paths below a folder from which on it is no key of a join.
CROWDED = 100_000


def ancestor_pairs(df: DataFrame, path: str = "path") -> DataFrame:
    """df with one row for each folder above path (column ancestor): hierarchies become equi-joins."""
    return df.withColumn("ancestor", F.explode(S.ancestors(F.col(path))))


def dir_sizes(files: DataFrame, include_dirs: bool = True) -> DataFrame:
    """(dir, bytes) of each folder with all that lies below it; sizes are summed per folder first."""
    own = files.filter(F.lit(include_dirs) | ~F.col("is_dir")).select(F.when(F.col("is_dir"), F.col("path")).otherwise(F.col("dir")).alias("at"), "size")
    own = own.groupBy("at").agg(F.sum("size").alias("size"))
    up = own.select(F.explode(F.concat(F.array("at"), S.ancestors(F.col("at")))).alias("dir"), "size")
    return up.groupBy("dir").agg(F.sum("size").alias("bytes"))


def told_sizes(lines: DataFrame) -> DataFrame:
    """(dir, bytes) of the lines (line) of a size listing: a number, perhaps with a unit, white space, a path to the end.

    Other lines tell nothing. A slash at a path's end is none of it; of a folder told twice the larger size counts.
    """
    form = r"^\s*(\d+(?:\.\d+)?[A-Za-z]*)\s+(/.*?)/*\s*$"
    told = lines.select(F.regexp_extract("line", form, 2).alias("dir"), S.parse_bytes(F.regexp_extract("line", form, 1)).alias("bytes"))
    return told.filter("dir <> '' and bytes is not null").groupBy("dir").agg(F.max("bytes").alias("bytes"))


def only_children(files: DataFrame) -> DataFrame:
    """(path) of the folders beside which nothing lies in the folder above; hidden entries don't count, nor are they only children."""
    seen = files.filter(~F.col("name").startswith("."))
    alone = seen.groupBy("dir").agg(F.count("*").alias("n"), F.bool_and("is_dir").alias("folders"), F.min("path").alias("path"))
    return alone.filter("n = 1 and folders").select("path")


def chain_sizes(paths: DataFrame, told: DataFrame, files: DataFrame) -> DataFrame:
    """(path, bytes, own) of paths: a told size (own), or that of the nearest folder above that has one, if each folder
    on the way down is an only child: then both hold the same. Else null."""
    up = paths.select("path", F.explode(F.concat(F.array("path"), S.ancestors(F.col("path")))).alias("at")).withColumn("level", S.depth(F.col("at")))
    alone = only_children(files).select(F.col("path").alias("at"), F.lit(True).alias("alone"))
    up = up.join(told.withColumnRenamed("dir", "at"), "at", "left").join(alone, "at", "left")
    nearest = up.groupBy("path").agg(
        F.max(F.when(F.col("bytes").isNotNull(), F.col("level"))).alias("from"), F.max(F.when(F.col("alone").isNull(), F.col("level"))).alias("beside"),
        F.max_by("bytes", F.when(F.col("bytes").isNotNull(), F.col("level"))).alias("bytes"),
    )
    chained = F.col("beside").isNull() | (F.col("beside") <= F.col("from"))
    return nearest.select("path", F.when(chained, F.col("bytes")).alias("bytes"), F.coalesce(F.col("from") == S.depth(F.col("path")), F.lit(False)).alias("own"))


def best_sizes(paths: DataFrame, told: DataFrame, files: DataFrame) -> DataFrame:
    """(path, bytes, basis): a listing's size of each of the distinct paths (told), one that follows from it (chain), or the sum of what lies in it (sum)."""
    summed = dir_sizes(files).select(F.col("dir").alias("path"), F.col("bytes").alias("sum"))
    both = chain_sizes(paths, told, files).join(summed, "path", "left")
    basis = F.when(F.col("bytes").isNotNull(), F.when(F.col("own"), "told").otherwise("chain")).when(F.col("sum").isNotNull(), "sum")
    return both.select("path", F.coalesce("bytes", "sum").alias("bytes"), basis.alias("basis"))


def crowded(paths: DataFrame, most: int) -> DataFrame:
    """(ancestor) of the folders with more than `most` of the paths below them: few, as a path has only so many folders."""
    own = paths.groupBy(S.dirname(F.col("path")).alias("at")).agg(F.count("*").alias("n"))
    up = own.select(F.explode(F.concat(F.array("at"), S.ancestors(F.col("at")))).alias("ancestor"), "n")
    return up.groupBy("ancestor").agg(F.sum("n").alias("n")).filter(F.col("n") > most).select("ancestor")


def roots_above(paths: DataFrame, roots: DataFrame, most: int = CROWDED) -> DataFrame:
    """(path, ancestor) of the distinct paths and each of the distinct roots (path) above them.

    Folders that very many paths lie below would be rows of one task: whether they are roots is told to all tasks, so none of
    them is a key of the join.
    """
    known = roots.select(F.col("path").alias("root"))
    crowd = crowded(paths, most)
    crowd = crowd.join(known, F.col("ancestor") == F.col("root"), "left").select("ancestor", F.col("root").isNotNull().alias("is_root"))
    up = ancestor_pairs(paths.select("path")).join(F.broadcast(crowd), "ancestor", "left").filter(F.coalesce("is_root", F.lit(True)))
    key = F.when(F.col("is_root"), F.concat(F.lit("\0"), "path")).otherwise(F.col("ancestor"))
    both = up.withColumn("key", key).join(known, F.col("key") == F.col("root"), "left")
    return both.filter(F.col("is_root") | F.col("root").isNotNull()).select("path", "ancestor")


def nearest_ancestor(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, parent): the longest proper ancestor of each path that is a root; null without one."""
    best = roots_above(paths, roots).groupBy("path").agg(F.max_by("ancestor", F.length("ancestor")).alias("parent"))
    return paths.select("path").join(best, "path", "left")


def outside_of(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """The paths that lie below none of the roots."""
    return paths.join(roots_above(paths, roots).select("path").distinct(), "path", "left_anti")


def canonical_databases(dbs: DataFrame) -> DataFrame:
    """Databases without those whose folder has a canonical one (in the hidden backup folder) below it."""
    canonical = F.col("path").contains(f"/{K.CANONICAL_DIR}/")
    over = ancestor_pairs(dbs.filter(canonical).select("path")).select(F.col("ancestor").alias("dir")).distinct()
    rest = dbs.filter(~canonical).withColumn("dir", S.dirname(F.col("path"))).join(over, "dir", "left_anti").select(*dbs.columns)
    return dbs.filter(canonical).unionByName(rest)


def named(files: DataFrame, *names: str) -> DataFrame:
    return files.filter(~F.col("is_dir") & F.col("name").isin(*names))


def html_files(files: DataFrame) -> DataFrame:
    return files.filter(~F.col("is_dir") & F.lower("name").endswith(".html"))


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df in order, with n from 1: ranges of the order are numbered by themselves, each from the end of those before it."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = materialize(df.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = held.groupBy("__range").agg(F.count("*").alias("__rows"))  # a row a range
    before = sizes.select("__range", F.sum("__rows").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    n = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) + F.coalesce("__before", F.lit(0))
    return held.join(F.broadcast(before), "__range").withColumn("n", n.cast("long")).drop("__range", "__before").orderBy(*order)


def chat_roots(files: DataFrame) -> DataFrame:
    """Folders with a message page."""
    return files.filter(~F.col("is_dir") & F.col("name").rlike(r"^messages.*\.html$")).select(F.col("dir").alias("path")).distinct()


def result_jsons(files: DataFrame) -> DataFrame:
    return named(files, *K.RESULT_NAMES).select("path").orderBy("path")


def html_export_roots(files: DataFrame) -> DataFrame:
    """(path, kind, has_chats) of each folder that is an HTML export; one pass over the inventory by folder."""
    is_file, is_dir = ~F.col("is_dir"), F.col("is_dir")
    has = lambda c: F.bool_or(c)
    d = files.groupBy(F.col("dir").alias("path")).agg(
        has(is_file & (F.col("name") == K.MULTI_ROOT_NAME)).alias("multi"), has(is_file & (F.col("name") == K.SINGLE_ROOT_NAME)).alias("page"), has(is_dir & (F.col("name") == "css")).alias("css"),
        has(is_dir & (F.col("name") == "js")).alias("js"), has(is_dir & (F.col("name") == "chats")).alias("has_chats"), has(is_file & F.col("name").rlike(K.MARKER_PATTERN)).alias("marked"),
    )
    single = F.col("page") & F.col("css") & F.col("js")
    kind = F.when(F.col("multi"), "html_multi_chat_export").when(single & F.col("marked"), "html_single_chat_export_converted").when(single, "html_single_chat_export")
    return d.select("path", kind.alias("kind"), "has_chats").filter("kind is not null")


def backups(files: DataFrame) -> DataFrame:
    """(path) of the folders that hold an export of any kind, each once."""
    return html_export_roots(files).select("path").union(named(files, *K.RESULT_NAMES, K.DATABASE_NAME).select(F.col("dir").alias("path"))).distinct()


def message_pages(files: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, kind, chat, path): pages of each export: of its own chat folders, or its own folder if it is a single chat."""
    pages = files.filter(~F.col("is_dir") & F.col("name").rlike(r"^messages.*\.html$")).select("path", "dir")
    single = roots.filter("kind <> 'html_multi_chat_export'").join(pages.withColumnRenamed("path", "page"), F.col("path") == F.col("dir")).select(F.col("path").alias("root"), "kind", F.lit("").alias("chat"), F.col("page").alias("path"))
    at = pages.withColumn("root", F.nullif(F.regexp_extract("dir", r"^(.*)/chats/chat_[^/]*$", 1), F.lit(""))).withColumn("chat", F.element_at(F.split("dir", "/"), -1))
    multi = at.join(roots.filter("kind = 'html_multi_chat_export'").select(F.col("path").alias("root"), "kind"), "root").select("root", "kind", "chat", "path")
    return multi.unionByName(single)


def chat_folder_counts(files: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, chats) of multi-chat exports; null where there is no chats folder."""
    folders = files.filter(F.col("is_dir") & F.col("name").startswith("chat_") & F.col("dir").endswith("/chats")).select(S.dirname(F.col("dir")).alias("path"), F.col("path").alias("chat"))
    multi = roots.filter("kind = 'html_multi_chat_export'")
    return multi.join(folders, "path", "left").groupBy("path", "has_chats").agg(F.count("chat").alias("n")).select("path", F.when(F.col("has_chats"), F.col("n")).alias("chats"))


def media_file_counts(files: DataFrame, under: DataFrame | None = None) -> DataFrame:
    """(media_files, chat_local_files) below the media folders of every folder with a message page; by root if given roots (path)."""
    roots = chat_roots(files)
    if under is not None:
        roots = nearest_ancestor(roots.select(F.concat("path", F.lit("/x")).alias("path")), under).filter("parent is not null").select(F.substring("path", F.lit(1), F.length("path") - 2).alias("path"), F.col("parent").alias("root"))
    folder = F.element_at(F.split("ancestor", "/"), -1)
    up = ancestor_pairs(files.filter(~F.col("is_dir")).select("path")).withColumn("folder", folder).filter(F.col("folder").isin(*K.CHAT_LOCAL_DIRS, "media"))
    own = up.withColumn("at", S.dirname(F.col("ancestor"))).join(roots.withColumnRenamed("path", "at"), "at")
    counts = [F.count_if(F.col("folder") == "media").alias("media_files"), F.count_if(F.col("folder") != "media").alias("chat_local_files")]
    if under is None:
        return own.agg(*counts)
    return under.select(F.col("path").alias("root")).join(own.groupBy("root").agg(*counts), "root", "left").na.fill(0)
