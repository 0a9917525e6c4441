"""The engine's entry points over a folder: discover, check links, repair, split, fix, rename, backfill."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import constants as K
from .functions import scalars as S
from .operators import refs as R
from .operators import reports as P
from .operators import resolve
from .operators import timeline as T
from .operators import tree
from .plans import rewrites
from .session import materialize
from .sources import filetree, json_pieces, sqlite
from .sources.text import lines

#: What a title is looked for in: 64 Ki characters of at most four bytes.
HEAD_BYTES = 4 << 16


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """What lies in a folder, listed once: a table that all steps of a call read. No file is opened."""
    return materialize(filetree.files(spark, os.path.abspath(root)), "inventory")


def html(files: DataFrame) -> DataFrame:
    return files.filter(~F.col("is_dir") & F.lower("name").endswith(".html"))


def json_part(files: DataFrame, inspect: bool = True) -> DataFrame:
    found = tree.named(files, *K.RESULT_NAMES)
    if inspect:
        return P.range_reports(P.json_item_ranges(found, json_pieces.items(json_pieces.cut(found))))
    return P.as_report(found.select(F.col("dir").alias("export_root"), F.col("path").alias("result_json"), F.lit("json").alias("fmt"), F.lit("unknown").alias("kind"), S.export_date(F.col("path")).alias("inferred_export_date")))


def sniff(spark: SparkSession, root: str) -> DataFrame:
    """(path, kind, keys) of the JSON exports below a folder, from the beginning of each file alone."""
    return json_pieces.sniff(tree.named(inventory(spark, root), *K.RESULT_NAMES))


def html_part(files: DataFrame, inspect: bool = True) -> DataFrame:
    """Reports of HTML exports. Without inspection bodies are not read: only chat folders are counted."""
    roots = tree.html_export_roots(files)
    counts = tree.chat_folder_counts(files, roots).select(F.col("path").alias("root"), "chats")
    base = roots.select(F.col("path").alias("root"), "kind").join(counts, "root", "left").withColumn("chats", F.when(F.col("kind") == "html_multi_chat_export", F.col("chats")).otherwise(F.lit(1)))
    if not inspect:
        return P.as_report(base.select(F.col("root").alias("export_root"), F.lit("html").alias("fmt"), "kind", S.export_date(F.col("root")).alias("inferred_export_date"), F.col("chats").alias("chats_backed_up")))
    pages = tree.message_pages(files, roots)
    body = filetree.bodies(files.join(pages.select("path").distinct(), "path", "left_semi"))
    sums = T.page_sums(T.page_events(lines(body))).join(pages.select(F.col("path").alias("file"), "root", "chat"), "file")
    chats = T.chat_timeline(sums, "root", "chat")
    first = pages.filter(S.basename(F.col("path")) == K.SINGLE_ROOT_NAME).select(F.col("path").alias("file"), "root", "chat")
    heads = filetree.bodies(files.join(first.select(F.col("file").alias("path")), "path", "left_semi"), most=HEAD_BYTES)
    titles = heads.join(first, "file").select("root", "chat", S.page_title(F.col("text")).alias("title"))
    named = chats.join(titles, ["root", "chat"], "left").withColumn("name", F.coalesce("title", F.when(F.col("chat") != "", F.col("chat")).otherwise(S.basename(F.col("root")))))
    summary = F.struct("chat", F.struct("name", F.col("messages").alias("messages_backed_up"), P.iso("first").alias("first_message_utc"), P.iso("last").alias("last_message_utc")).alias("s"))
    lists = named.groupBy("root").agg(F.array_sort(F.collect_list(summary)).alias("s")).select("root", F.transform("s", lambda x: x["s"]).alias("chat_summaries"))
    up = T.export_rollup(chats, "root").drop("chats")
    out = base.join(up, "root", "left").join(lists, "root", "left")
    return P.as_report(out.select(F.col("root").alias("export_root"), F.lit("html").alias("fmt"), "kind", S.export_date(F.col("root")).alias("inferred_export_date"), F.col("chats").alias("chats_backed_up"), F.coalesce("messages", F.lit(0)).alias("messages_backed_up"), P.iso("first").alias("first_message_utc"), P.iso("last").alias("last_message_utc"), F.col("first_source").alias("first_message_source"), F.col("last_source").alias("last_message_source"), F.col("basis").alias("date_range_basis"), "chat_summaries"))


def databases(files: DataFrame) -> DataFrame:
    """The tables (sqlite.probe()) of the databases that have those of a backup, probed once by the executors."""
    found = materialize(sqlite.probe(tree.named(files, K.DATABASE_NAME)), "databases")
    return found.join(P.with_tables(found), "path", "left_semi")


def _names(found: DataFrame, table: str) -> DataFrame:
    return P.scanned_names(sqlite.scan(found, table, F.concat(F.array(F.lit("id")), P.pick_name_columns(F.col("columns")))))


def sqlite_part(files: DataFrame, inspect: bool = True, dedupe: bool = False) -> DataFrame:
    """A report per database that has the three tables; messages are read once, whatever the number of databases."""
    if dedupe:
        files = files.join(tree.canonical_databases(tree.named(files, K.DATABASE_NAME).select("path")), "path", "left_semi")
    found = databases(files)
    paths = found.select("path").distinct()
    if not inspect:
        return P.sqlite_reports(paths)
    cols = ("source_type", "source_id", "time")
    told = sqlite.scan(found, "messages", F.array(*map(F.lit, cols))).select("path", *[F.col("values")[k].alias(c) for k, c in enumerate(cols)])
    return P.sqlite_reports(paths, materialize(P.source_sums(told, "path"), "sources"), _names(found, "users"), _names(found, "chats"))


def discover(spark: SparkSession, root: str, inspect: bool = True, sizes: bool = True, dedupe: bool = False, listing: str | None = None) -> DataFrame:
    """All backups below a folder: the report's columns and bytes. listing: a file of sizes and absolute paths, as disk usage
    tools write it, whose sizes go before those of the inventory."""
    files = inventory(spark, root)
    found = json_part(files, inspect).unionByName(html_part(files, inspect)).unionByName(sqlite_part(files, inspect, dedupe))
    if not sizes:
        return found.withColumn("bytes", F.lit(None).cast("long"))
    if listing:
        told = tree.told_sizes(spark.read.text(os.path.abspath(listing)).withColumnRenamed("value", "line"))
        best = tree.best_sizes(found.select(F.col("export_root").alias("path")).distinct(), told, files)
        return found.join(best.select(F.col("path").alias("export_root"), "bytes"), "export_root", "left")
    return found.join(tree.dir_sizes(files).withColumnRenamed("dir", "export_root"), "export_root", "left")


def chat_path(file):
    """The path of the chat's folder that a file lies in."""
    return F.nullif(F.regexp_extract(file, r"^(.*/chats/chat_\d+)(?:/|$)", 1), F.lit(""))


def dialogs(files: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, id, name): names of dialogs from the databases below each root; users before chats, the first database first."""
    found = databases(files)
    above = tree.ancestor_pairs(found.select("path").distinct()).join(roots.select(F.col("path").alias("ancestor")), "ancestor").select("path", F.col("ancestor").alias("root"))
    named = _names(found, "users").withColumn("k", F.lit(0)).union(_names(found, "chats").withColumn("k", F.lit(1)))
    return named.join(above, "path").groupBy("root", "id").agg(F.min_by("name", F.struct("path", "k")).alias("name"))


def check_roots(spark: SparkSession, files: DataFrame, roots: DataFrame, top: str, scope: str = "all", schemes: list[str] | None = None, allow_outside: bool = False, fail_fast: bool = False, most_missing: int = 200, most_schemes: int = 200, legacy: bool = False) -> dict[str, DataFrame]:
    """The link checks of all roots (path) at once: every page counts for the deepest root that holds it.

    files: the inventory of the folder top, which holds the roots. All results have the column root: counters (one row a
    root, also of those without pages), missing and schemes (the first of each, with their chats' names), leftovers (the
    first of each), buckets, media. Bodies are read once; what is kept of them are the lines that can hold a reference.
    """
    pages = html(files)
    owner = tree.nearest_ancestor(pages, roots).filter("parent is not null").select("path", F.col("parent").alias("root"))
    pages = pages.join(owner, "path")
    hot = materialize(R.keyword_lines(lines(filetree.bodies(pages, "root"))), "keyword_lines")
    refs = R.classified(R.all_refs(hot), F.col("root"), legacy)
    known = files
    if allow_outside:  # the inventory holds nothing of what lies beyond its folder
        known = files.select("path").union(materialize(filetree.existing(resolve.beyond(refs, top), F.col("target")), "outside"))
    out = resolve.link_status(refs, known, F.col("root"), scope, allow_outside)
    multi = files.filter((F.col("name") == K.MULTI_ROOT_NAME) | (F.col("is_dir") & (F.col("name") == "chats"))).select(F.col("dir").alias("root")).distinct()
    left = R.leftovers(hot).join(multi, "root", "left_anti")
    out = materialize(resolve.fail_fast(out, left, "root") if fail_fast else out, "checked")
    bad = out.filter(F.col("status").isin("missing", "outside"))
    counts = resolve.counters(out, left, "root")
    seen = pages.groupBy("root").agg(F.count("*").alias("html_files_scanned"))
    every = roots.select(F.col("path").alias("root")).join(counts, "root", "left").join(seen, "root", "left").na.fill(0)
    first = pages.filter(F.col("name") == K.SINGLE_ROOT_NAME).withColumn("chat_id", chat_path(F.col("path"))).filter("chat_id is not null")
    titles = filetree.bodies(first, "chat_id", most=HEAD_BYTES).groupBy("chat_id").agg(F.min_by(S.page_title(F.col("text")), "file").alias("name"))
    few = R.first_of_each(bad, ["root", "status"], most_missing).select("root", "status", "n", "file", "line_no", "attr", "url", "resolved_path", "note")
    order = Window.partitionBy("root").orderBy("file", "line_no", "idx")
    return {
        "counters": every,
        "missing": P.with_chat_names(few, titles, dialogs(files, roots), chat_path),
        "schemes": R.first_of_each(R.with_scheme(refs, schemes or []), ["root"], most_schemes).select("root", "n", "file", "line_no", "attr", "url"),
        "leftovers": left.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most_missing).drop("n"),
        "buckets": R.bucket_counts(out, "root"),
        "media": tree.media_file_counts(files, roots),
    }


def check_links(spark: SparkSession, root: str, **options) -> dict[str, DataFrame]:
    """check_roots() of one folder as a whole, without the column root."""
    root = os.path.abspath(root)
    got = check_roots(spark, inventory(spark, root), spark.createDataFrame([(root,)], "path string"), root, **options)
    return {k: x.drop("root") for k, x in got.items()}


def check_each(spark: SparkSession, root: str, **options) -> dict[str, DataFrame]:
    """check_roots() of the backups found below root, each by itself; of root as a whole if there is one at most."""
    root = os.path.abspath(root)
    files = inventory(spark, root)
    found = materialize(tree.backups(files), "backups")
    if found.limit(2).count() < 2:
        found = spark.createDataFrame([(root,)], "path string")
    return check_roots(spark, files, found, root, **options)


def repair_links(spark: SparkSession, root: str) -> DataFrame:
    """The plan that repairs references with an unescaped `#`."""
    root = os.path.abspath(root)
    files = inventory(spark, root)
    return rewrites.repair_plan(filetree.bodies(html(files)), files, root)


def split(spark: SparkSession, root: str, out: str | None = None, only: list[str] | None = None, created: str = "") -> DataFrame:
    """The plan that splits a multi-chat export. ValueError if it is none, FileExistsError if the output exists."""
    root = os.path.abspath(root)
    out = os.path.abspath(out or root + "_split")
    if not os.path.isfile(os.path.join(root, K.MULTI_ROOT_NAME)) or not os.path.isdir(os.path.join(root, "chats")):
        raise ValueError(f"no multi-chat export: {root}")
    if os.path.exists(out):
        raise FileExistsError(out)
    files = inventory(spark, root)
    chat = F.nullif(F.regexp_extract(S.relative_path(F.lit(root), F.col("path")), r"^chats/(chat_[^/]*)/messages[^/]*\.html$", 1), F.lit(""))
    pages = filetree.bodies(files.withColumn("chat_id", chat).filter("chat_id is not null"), "chat_id")
    return rewrites.split_plan(files, pages, lines(pages.select("file", "text")), root, out, created, only)


def split_pages(own: DataFrame) -> DataFrame:
    """(chat, path, ...) of the message pages of an older split: every folder that holds one is a chat."""
    return html(own).filter(F.col("name").startswith("messages")).withColumn("chat", F.col("dir"))


def fix_split(spark: SparkSession, single_root: str, multi_root: str) -> DataFrame:
    """The plan that fixes all chats of an older split in place: copies to media/ and rewritten pages, by chat.

    What it did is told by sinks.statistics() of its outcomes, with split_pages() as the pages that were scanned.
    """
    single_root, multi_root = os.path.abspath(single_root), os.path.abspath(multi_root)
    own = inventory(spark, single_root)
    files = own.unionByName(inventory(spark, multi_root)).dropDuplicates(["path"])
    body = filetree.bodies(split_pages(own))
    fixes = materialize(rewrites.fix_in_place(lines(body), files, multi_root), "fixes")
    chat = S.dirname(F.col("file")).alias("chat")
    copies = fixes.filter("copy_from is not null").select(F.lit(1).alias("rank"), F.lit("copy").alias("action"), F.col("copy_from").alias("src"), F.col("copy_to").alias("dst"), F.lit(None).cast("string").alias("payload"), chat, F.lit(0).cast("long").alias("rewrites")).distinct()
    pages = rewrites.rewritten(body, fixes, narrow=True).select(F.lit(2).alias("rank"), F.lit("rewrite").alias("action"), F.col("file").alias("src"), F.col("file").alias("dst"), F.col("new_text").alias("payload"), chat, F.col("rewrites"))
    return copies.unionByName(pages)


def rename_ranges(spark: SparkSession, root: str, which: str = "all") -> DataFrame:
    """The plan that renames the range folders of a split (root/chat/range) to their pages' true range."""
    root = os.path.abspath(root)
    files = inventory(spark, root)
    pages = files.filter(~F.col("is_dir") & F.col("name").rlike(r"^messages.*\.html$") & (S.depth(F.col("dir")) == len([p for p in root.split("/") if p]) + 2))
    sums = T.page_sums(T.page_events(lines(filetree.bodies(pages)))).withColumn("path", S.dirname(F.col("file")))
    return rewrites.rename_plan(T.chat_timeline(sums, "path").select("path", "first", "last"), files.filter("is_dir"), which)


def backfill_markers(spark: SparkSession, root: str, created: str = "") -> DataFrame:
    root = os.path.abspath(root)
    return rewrites.backfill_plan(inventory(spark, root), created, root)
