"""Export reports: JSON, HTML and SQLite sources brought to one shape, and how reports are grouped and ordered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scalars as S
from ..session import materialize
from . import tree

SUMMARY = "struct<name:string,messages_backed_up:bigint,first_message_utc:string,last_message_utc:string>"
REPORT = {
    "export_root": "string", "result_json": "string", "fmt": "string", "kind": "string", "top_level_keys": "array<string>", "inferred_export_date": "string", "chats_backed_up": "bigint",
    "messages_backed_up": "bigint", "first_message_utc": "string", "last_message_utc": "string", "first_message_source": "string", "last_message_source": "string", "date_range_basis": "string", "chat_summaries": f"array<{SUMMARY}>",
}


def as_report(df: DataFrame) -> DataFrame:
    """df with the report's columns, missing ones null."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in REPORT.items()])


def iso(c: str):
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def json_chats(exports: DataFrame) -> DataFrame:
    """(path, kind, keys, pos, name, id, messages) of (path, text): one row a chat, by its place in the list.

    Null and non-object elements are dropped. `chats.list` makes a multi-chat export, else a list of `messages` a single one.
    """
    message = "array<struct<id:string,date:string,date_unixtime:string>>"
    shape = f"struct<chats:struct<list:array<struct<id:string,name:string,title:string,messages:{message}>>>,messages:{message},name:string,id:string>"
    x = exports.select("path", F.from_json("text", shape).alias("j"), F.array_sort(F.json_object_keys("text")).alias("keys"))
    multi, single = F.col("j.chats.list").isNotNull(), F.col("j.messages").isNotNull()
    kind = F.when(multi, "multi_chat_export").when(single, "single_chat_export").otherwise("unknown")
    one = F.array(F.struct(F.col("j.id").alias("id"), F.col("j.name").alias("name"), F.lit(None).cast("string").alias("title"), F.col("j.messages").alias("messages")))
    chats = F.when(multi, F.filter("j.chats.list", lambda c: c.isNotNull())).when(single, one)
    return x.select("path", kind.alias("kind"), "keys", F.posexplode_outer(chats).alias("pos", "c")).select("path", "kind", "keys", "pos", S.chat_name(F.col("c.name"), F.col("c.title"), F.col("c.id")).alias("name"), F.col("c.id").alias("id"), F.filter("c.messages", lambda m: m.isNotNull()).alias("messages"))


def json_chat_ranges(chats: DataFrame) -> DataFrame:
    """json_chats() with n, first, last: both date fields of every message widen a chat's range."""
    times = F.filter(F.flatten(F.transform("messages", lambda m: F.array(S.parse_unixtime(m["date_unixtime"]), S.parse_iso(m["date"])))), lambda t: t.isNotNull())
    return chats.withColumn("n", F.when(F.col("pos").isNotNull(), F.coalesce(F.size("messages"), F.lit(0)).cast("long"))).withColumn("first", F.array_min(times)).withColumn("last", F.array_max(times)).drop("messages")


def json_item_ranges(files: DataFrame, items: DataFrame) -> DataFrame:
    """What json_chat_ranges() tells, from the items of files (path) that were read in pieces; pos is a chat's offset.

    Counts and ranges are summed where the pieces were read, so a chat of any size is no hot key. Differences by design: of
    a member that an object names twice the last counts, but the messages of both lists do; a broken file tells what stands
    before the break.
    """
    whole = items.filter(F.col("kind").isin("object", "single", "multi", "root")).groupBy("path").agg(F.bool_or(F.col("kind") == "multi").alias("multi"), F.bool_or(F.col("kind") == "single").alias("single"), F.array_sort(F.collect_set(F.when(F.col("kind") == "root", F.col("key")))).alias("keys"))
    kind = F.when(F.col("multi"), "multi_chat_export").when(F.col("single"), "single_chat_export").otherwise("unknown")
    exports = files.select("path").join(whole, "path", "left").select("path", kind.alias("kind"), "keys")
    unix, iso_date = S.parse_unixtime(F.col("date_unixtime")), S.parse_iso(F.col("date"))
    sums = items.filter("kind = 'message'").groupBy("path", "owner").agg(F.count("*").alias("n"), F.min(F.least(unix, iso_date)).alias("first"), F.max(F.greatest(unix, iso_date)).alias("last"))
    told = lambda k: F.max_by(F.when(F.col("key") == k, F.col("id")), F.when(F.col("key") == k, F.col("at"))).alias(k)
    named = items.filter(F.col("kind").isin("member", "root")).groupBy("path", "owner").agg(told("id"), told("name"), told("title"))
    chats = items.filter("kind = 'chat'").select("path", F.col("at").alias("owner"), F.lit("multi_chat_export").alias("kind"))
    chats = chats.union(items.filter("kind = 'single'").select("path", F.lit(-1).cast("long"), F.lit("single_chat_export")).distinct())
    chats = chats.join(named, ["path", "owner"], "left").join(sums, ["path", "owner"], "left")
    name = S.chat_name(F.col("name"), F.when(F.col("kind") == "multi_chat_export", F.col("title")), F.col("id"))
    chats = chats.select("path", "kind", F.col("owner").alias("pos"), name.alias("name"), "id", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "first", "last")
    return exports.join(chats, ["path", "kind"], "left").select("path", "kind", "keys", "pos", F.when(F.col("pos").isNotNull(), F.col("name")).alias("name"), "id", "n", "first", "last")


def json_reports(exports: DataFrame) -> DataFrame:
    return range_reports(json_chat_ranges(json_chats(exports)))


def range_reports(c: DataFrame) -> DataFrame:
    """A report for each path of json_chat_ranges() or json_item_ranges()."""
    summary = F.struct("pos", F.struct(F.col("name").alias("name"), F.col("n").alias("messages_backed_up"), iso("first").alias("first_message_utc"), iso("last").alias("last_message_utc")).alias("s"))
    g = c.groupBy("path", "kind", "keys").agg(F.count("pos").alias("chats"), F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), summary))).alias("s"))
    known = F.col("kind") != "unknown"
    return as_report(g.select(S.dirname(F.col("path")).alias("export_root"), F.col("path").alias("result_json"), F.lit("json").alias("fmt"), "kind", F.col("keys").alias("top_level_keys"), S.export_date(F.col("path")).alias("inferred_export_date"), F.when(known, F.col("chats")).alias("chats_backed_up"), F.when(known, F.col("n")).alias("messages_backed_up"), iso("first").alias("first_message_utc"), iso("last").alias("last_message_utc"), F.when(F.col("first").isNotNull(), F.col("path")).alias("first_message_source"), F.when(F.col("last").isNotNull(), F.col("path")).alias("last_message_source"), F.when(F.col("first").isNotNull(), "message_timestamps").alias("date_range_basis"), F.transform("s", lambda x: x["s"]).alias("chat_summaries")))


def source_sums(messages: DataFrame, *by: str) -> DataFrame:
    """(*by, source_type, source_id, msgs, first, last): messages by source, those without one too."""
    t = S.parse_unixtime(F.col("time"))
    return messages.groupBy(*by, "source_type", "source_id").agg(F.count("*").alias("msgs"), F.min(t).alias("first"), F.max(t).alias("last"))


def source_groups(sums: DataFrame) -> DataFrame:
    """source_sums() most first. Null sources are left out; a source id that is no number too."""
    g = sums.filter("source_type is not null and source_id is not null")
    return g.withColumn("source_id", F.col("source_id").try_cast("long")).filter("source_id is not null").orderBy(F.desc("msgs"), "source_type", "source_id")


def global_range(sums: DataFrame, *by: str) -> DataFrame:
    """(*by, messages, first, last) of source_sums()."""
    return sums.groupBy(*by).agg(F.coalesce(F.sum("msgs"), F.lit(0)).cast("long").alias("messages"), F.min("first").alias("first"), F.max("last").alias("last"))


def pick_name_columns(columns: Column) -> Column:
    """Of an array of columns those that name a row: `name`, else first and last name, else the first of the other known ones."""
    name, first, last, *others = map(F.lit, K.NAME_COLUMNS)
    has = lambda c: F.array_contains(columns, c)
    both = F.filter(F.array(first, last), has)
    return F.when(has(name), F.array(name)).when(F.size(both) > 0, both).otherwise(F.slice(F.filter(F.array(*others), has), 1, 1))


def _whole_name(parts: Column) -> Column:
    """The parts of a name that are not blank, joined by a space; null if there are none."""
    return F.nullif(F.array_join(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""), " "), F.lit(""))


def names(table: DataFrame) -> DataFrame:
    """(id, name) of a users or chats table."""
    have = F.array(*map(F.lit, table.columns))
    row = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in table.columns if c in K.NAME_COLUMNS])
    parts = F.transform(F.filter(row, lambda x: F.array_contains(pick_name_columns(have), x["c"])), lambda x: x["v"]) if set(table.columns) & set(K.NAME_COLUMNS) else F.lit(None).cast("array<string>")
    return table.select(F.col("id").cast("long").alias("id"), _whole_name(parts).alias("name"))


def scanned_names(rows: DataFrame) -> DataFrame:
    """(path, id, name) of rows (path, values) whose values are an id and the parts of a name; of an id's names the least."""
    x = rows.select("path", F.col("values")[0].try_cast("long").alias("id"), _whole_name(F.slice("values", 2, F.size("values"))).alias("name"))
    return x.filter("id is not null and name is not null").groupBy("path", "id").agg(F.min("name").alias("name"))


def named_groups(groups: DataFrame, users: DataFrame, chats: DataFrame, *by: str) -> DataFrame:
    """groups with name: of the user (*by, id, name) for dialogs, of the chat for groups, else `type:id`."""
    key = [*by, "source_id"]
    u, c = (x.select(*by, F.col("id").alias("source_id"), F.col("name").alias(n)) for x, n in ((users, "u"), (chats, "c")))
    own = F.when(F.col("source_type") == "dialog", F.col("u")).when(F.col("source_type") == "group", F.col("c"))
    return groups.join(u, key, "left").join(c, key, "left").withColumn("name", F.coalesce(own, F.concat_ws(":", "source_type", F.col("source_id").cast("string")))).drop("u", "c")


def sqlite_reports(paths: DataFrame, sums: DataFrame | None = None, users: DataFrame | None = None, chats: DataFrame | None = None) -> DataFrame:
    """A report for each database (path) from its source_sums() and scanned_names(); without them it is not inspected."""
    head = paths.select("path", S.dirname(F.col("path")).alias("export_root"), F.col("path").alias("result_json"), F.lit("sqlite").alias("fmt"), F.lit("sqlite_unofficial_backup").alias("kind"), S.export_date(F.col("path")).alias("inferred_export_date"))
    if sums is None:
        return as_report(head)
    groups = named_groups(source_groups(sums), users, chats, "path")
    summary = F.struct((-F.col("msgs")).alias("k"), F.struct("name", F.col("msgs").alias("messages_backed_up"), iso("first").alias("first_message_utc"), iso("last").alias("last_message_utc")).alias("s"))
    lists = groups.groupBy("path").agg(F.count("*").alias("chats_backed_up"), F.array_sort(F.collect_list(summary)).alias("s")).select("path", "chats_backed_up", F.transform("s", lambda x: x["s"]).alias("chat_summaries"))
    whole = global_range(sums, "path").select("path", "messages", iso("first").alias("first_message_utc"), iso("last").alias("last_message_utc"))
    out = head.join(whole, "path", "left").join(lists, "path", "left").withColumn("messages_backed_up", F.coalesce("messages", F.lit(0)))
    return as_report(out.withColumns({"first_message_source": F.col("path"), "last_message_source": F.col("path"), "date_range_basis": F.lit("message_timestamps")}))


def first_names(*tables: DataFrame) -> DataFrame:
    """(id, name) of all ids, from the first of the tables that names them."""
    each = [names(t).filter("name is not null").withColumn("k", F.lit(k)) for k, t in enumerate(tables)]
    rows = each[0]
    for x in each[1:]:
        rows = rows.unionByName(x)
    return rows.groupBy("id").agg(F.min_by("name", F.struct("k", "name")).alias("name"))


def first_name_found(wanted: DataFrame, *tables: DataFrame) -> DataFrame:
    """(id, name) of the wanted ids, from the first of the tables that names them."""
    ids = wanted.select("id").distinct()
    return wanted.join(first_names(*tables).join(ids, "id", "left_semi"), "id", "left")


def with_chat_names(rows: DataFrame, titles: DataFrame, dialogs: DataFrame, folder=S.chat_folder) -> DataFrame:
    """rows (file) with name: the title of the file's chat folder (chat_id, name), else of its dialog (id, name).

    Joined to the few rows that are shown, so names are looked up for those alone.
    """
    x = rows.withColumn("chat_id", folder(F.col("file"))).withColumn("id", S.dialog_id(F.col("file")))
    by = ["root", "id"] if "root" in dialogs.columns else ["id"]
    x = x.join(titles.select("chat_id", F.col("name").alias("t")), "chat_id", "left").join(dialogs.select(*by, F.col("name").alias("d")), by, "left")
    return x.withColumn("name", F.coalesce("t", "d")).select(*rows.columns, "name")


def collection_mode(reports: DataFrame, root: str) -> DataFrame:
    """Whether reports are shown by chat folder: five or more, all single chats, all two or more folders deep."""
    deep = S.depth(F.col("export_root")) - F.lit(len([p for p in root.split("/") if p])) >= 2
    return reports.agg((F.count("*") >= 5).alias("many"), F.bool_and(F.col("kind").startswith("html_single_chat_export") & deep).alias("all")).select((F.col("many") & F.coalesce("all", F.lit(False))).alias("collection"))


def last_by_root(reports: DataFrame) -> DataFrame:
    """One report a folder: SQLite over HTML over JSON."""
    rank = F.when(F.col("fmt") == "json", 0).when(F.col("fmt") == "html", 1).otherwise(2)
    cols = reports.columns
    return reports.groupBy("export_root").agg(F.max_by(F.struct(*cols), F.struct(rank, "result_json")).alias("r")).select("r.*")


def nested_order(reports: DataFrame, top: str) -> DataFrame:
    """One report a folder (the last wins) with parent, level, label and n: the order of display, from 1.

    Each report comes behind the one that its folder lies in; among siblings the most messages come first (unknown counts
    last), then the label, which is the path below the parent. The order of a tree is the order of the keys of all folders
    on the way down, so it is one sort, whatever the depth.
    """
    one = last_by_root(reports).withColumnRenamed("export_root", "path")
    up = tree.nearest_ancestor(one, one)
    base = F.coalesce("parent", F.lit(top.rstrip("/") or "/"))
    one = one.join(up, "path").withColumn("label", F.when(S.is_within(base, F.col("path")), S.relative_path(base, F.col("path"))).otherwise(F.col("path")))
    key = F.struct(-F.coalesce("messages_backed_up", F.lit(-1).cast("long")), F.col("label"))
    held = materialize(one.withColumn("own", key), "nodes")
    way = held.select("path", F.explode(F.concat(F.array("path"), S.ancestors(F.col("path")))).alias("at")).join(held.select(F.col("path").alias("at"), "own"), "at")
    keys = way.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(F.length("at").alias("l"), "own"))).alias("w")).select("path", F.transform("w", lambda x: x["own"]).alias("key"))
    placed = tree.numbered(held.drop("own").join(keys, "path").withColumn("level", F.size("key") - 1), "key")
    return placed.withColumnRenamed("path", "export_root").drop("key")


def collection_order(reports: DataFrame, top: str) -> DataFrame:
    """All reports with chat (the folder below top), label, first (the chat's main export) and n: the order of display.

    Chats come by the most messages of any of their exports, then by name; within a chat the main export comes first.
    """
    parts = F.split(S.relative_path(F.lit(top.rstrip("/") or "/"), F.col("export_root")), "/")
    sub = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 2, F.size(parts)), " ")).otherwise(S.basename(F.col("export_root")))
    x = primary_exports(reports.withColumn("chat", F.element_at(parts, 1)).withColumn("label", sub), "chat", "label")
    x = x.withColumn("first", F.col("n") == 1).withColumn("within", F.col("n")).withColumn("less", -F.coalesce("most", F.lit(-1)))
    return tree.numbered(x.drop("n"), "less", "chat", "within").drop("less", "within", "most")


def primary_exports(reports: DataFrame, chat: str = "chat", sub: str = "sub") -> DataFrame:
    """reports with n (1: the chat's main export) and the chat's most messages; chats in order of display."""
    w = Window.partitionBy(chat).orderBy(F.desc_nulls_last("messages_backed_up"), sub)
    most = F.max("messages_backed_up").over(Window.partitionBy(chat))
    return reports.withColumn("n", F.row_number().over(w)).withColumn("most", most)


def dedupe_names(chats: DataFrame) -> DataFrame:
    """(chat_id, base) with dst: the first chat of a name keeps it, the others get their id."""
    n = F.row_number().over(Window.partitionBy("base").orderBy("chat_id"))
    return chats.withColumn("dst", F.when(n == 1, F.col("base")).otherwise(F.format_string("%s (%s)", "base", "chat_id")))


def with_tables(tables: DataFrame) -> DataFrame:
    """(path) of the databases that have all tables of a backup, of (path, table)."""
    needed = tables.filter(F.col("table").isin(*K.REQUIRED_TABLES)).select("path", "table").distinct()
    return needed.groupBy("path").agg(F.count("*").alias("n")).filter(F.col("n") == len(K.REQUIRED_TABLES)).select("path")
