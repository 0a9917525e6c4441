"""Rewrite and copy plans as DataFrames; nothing here touches a file (see sinks.py).

A plan row: rank (order of execution), action (copy, copy_tree, rewrite, marker, rename), src, dst, payload.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import constants as K
from ..functions import scalars as S
from ..functions.udfs import html_unescape, url_quote, url_unquote
from ..operators import refs as R
from ..operators import resolve
from ..sources.text import lines as line_rows

#: Folders of an export that every chat of a split gets.
ASSETS = ("css", "js", "images", "profile_pictures")
PLAN = ["rank", "action", "src", "dst", "payload"]

def _python(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace("(?iU)", "(?i)"))


_WIDE, _NARROW, _SRCSET, _CSS = map(_python, (K.ATTRIBUTE, K.ATTRIBUTE_REWRITE, K.SRCSET, K.CSS))
CHANGE = ["line_no", "pass", "idx", "sub", "new"]


def changed(text: str, new: dict[tuple[int, int, int], str], narrow: bool) -> str:
    """text with the references at (pass, idx, sub) replaced, found as the generators of operators/refs.py find them."""
    spans = []
    for k, m in enumerate((_NARROW if narrow else _WIDE).finditer(text)):
        if (0, k, 0) in new:
            spans.append((*m.span(3), new[0, k, 0]))
    for k, m in enumerate(_SRCSET.finditer(text)):
        bits = [b for b in (p.split() for p in m[2].split(",")) if b]
        if any((1, k, i) in new for i in range(len(bits))):
            spans.append((*m.span(2), ", ".join(" ".join([new.get((1, k, i), b[0]), *b[1:]]) for i, b in enumerate(bits))))
    for k, m in enumerate(_CSS.finditer(text)):
        if (2, k, 0) in new:
            spans.append((*m.span(2), new[2, k, 0]))
    out, at = [], 0
    for a, b, x in sorted(spans, key=lambda s: s[:2]):
        if a >= at:  # an attribute's url that holds a css url stays whole
            out += [text[at:a], x]
            at = b
    return "".join([*out, text[at:]])


def apply_changes(texts: Column, changes: Column, narrow: bool) -> Column:
    """Each text with its changes (a list of CHANGE) made where they stand; line_no 0: places count over the whole text."""

    @F.pandas_udf(StringType())
    def apply(texts: pd.Series, changes: pd.Series) -> pd.Series:
        def one(text, each):
            if text is None or each is None or not len(each):
                return text
            by_line: dict[int, dict] = {}
            for c in each:
                by_line.setdefault(c["line_no"], {})[c["pass"], c["idx"], c["sub"]] = c["new"]
            if 0 in by_line:
                return changed(text, by_line[0], narrow)
            parts = re.split(r"(\r\n|\r|\n)", text)  # lines and their ends in turn
            for n, new in by_line.items():
                parts[2 * (n - 1)] = changed(parts[2 * (n - 1)], new, narrow)
            return "".join(parts)

        return pd.Series([one(t, c) for t, c in zip(texts, changes, strict=True)])

    return apply(texts, changes)


def relative_to(here: Column, target: Column) -> Column:
    """target as seen from the folder here, both absolute."""
    a, b = (F.filter(F.split(x, "/"), lambda p: p != "") for x in (here, target))
    same = F.size(F.filter(F.sequence(F.lit(1), F.least(F.size(a), F.size(b))), lambda i: (i >= 1) & (F.slice(a, 1, i) == F.slice(b, 1, i))))
    same = F.when((F.size(a) == 0) | (F.size(b) == 0), 0).otherwise(same)
    up = F.array_repeat(F.lit(".."), F.size(a) - same)
    return F.array_join(F.concat(up, F.slice(b, same + 1, F.greatest(F.size(b), F.lit(1)))), "/")


def repair_links(texts: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """(file, url, new) of references whose raw `#` is part of an existing file's name."""
    root = root.rstrip("/")
    # a `#` may be written as an entity; other references don't go through Python
    refs = R.refs_whole(texts).filter(~S.is_skipped(F.col("url")) & F.col("url").rlike("[#&]"))
    raw = S.strip(F.substring_index(S.strip(html_unescape(F.col("url"))), "?", 1))
    # a row of its own: tests of a plain column would be moved below it, and entities read by two workers a task
    x = refs.withColumn("raw", F.explode(F.array(raw))).filter(F.col("raw").contains("#") & ~F.lower("raw").contains("%23"))
    here = S.dirname(F.col("file"))
    x = x.withColumn("target", S.norm_join(here, F.col("raw"))).filter(S.is_within(F.lit(root), F.col("target")))
    hit = x.join(files.filter(~F.col("is_dir")).select(F.col("path").alias("target")).distinct(), "target", "left_semi")
    return hit.withColumn("new", url_quote(relative_to(here, F.col("target")))).filter("new <> url").select("file", "line_no", "pass", "idx", "sub", "url", "new")


def rewritten(texts: DataFrame, changes: DataFrame, narrow: bool = False) -> DataFrame:
    """(file, text, new_text, rewrites) of the files that the changes (file and CHANGE) alter.

    narrow: places count over href and src alone, as rewriting of lines has it.
    """
    maps = changes.groupBy("file").agg(F.collect_list(F.struct(*CHANGE)).alias("m"), F.count("*").alias("rewrites"))
    out = texts.join(maps, "file").withColumn("new_text", apply_changes(F.col("text"), F.col("m"), narrow))
    return out.filter("new_text <> text").select("file", "text", "new_text", "rewrites")


def repair_plan(texts: DataFrame, files: DataFrame, root: str) -> DataFrame:
    out = rewritten(texts, repair_links(texts, files, root))
    return out.select(F.lit(1).alias("rank"), F.lit("rewrite").alias("action"), F.col("file").alias("src"), F.col("file").alias("dst"), F.col("new_text").alias("payload"))


def standalone(text: Column, chat: Column) -> Column:
    """A chat's page with its links to shared assets made local."""
    for a, b in K.STANDALONE:
        text = F.replace(text, F.lit(a), F.lit(b))
    for up in ("../../", "../"):
        text = F.when(chat != "", F.replace(text, F.concat(F.lit(up + "chats/"), chat, F.lit("/")), F.lit(""))).otherwise(text)
    return text


def hot_lines(lines: DataFrame) -> DataFrame:
    """Lines that rewriting looks at: the words stand there in lower case, without a space before the equals sign."""
    return lines.filter(F.col("line").contains("href=") | F.col("line").contains("src=") | F.col("line").contains("url("))


def localize(lines: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """(file, url, target, shared, new) of the references in a chat's pages: shared files to media/, its own to a safe path."""
    root = root.rstrip("/")
    hot = hot_lines(R.style_context(lines))
    refs = R.attribute_refs(hot, K.ATTRIBUTE_REWRITE).unionByName(R.css_refs(hot))
    x = resolve.resolve_in_export(refs, files, root)
    chat = S.dirname(F.col("file"))
    own = S.is_within(chat, F.col("target"))
    rel = F.when(own, S.relative_path(chat, F.col("target"))).otherwise(S.relative_path(F.lit(root), F.col("target")))
    new = F.when(own, url_quote(rel)).otherwise(F.concat(F.lit("media/"), url_quote(rel)))
    return x.select("file", "line_no", "pass", "idx", "sub", "url", "target", (~own).alias("shared"), new.alias("new"))


def split_names(pages: DataFrame) -> DataFrame:
    """(chat_id, title, base, dst) of (chat_id, text of the first page)."""
    from ..operators.reports import dedupe_names

    named = pages.select("chat_id", F.coalesce(S.page_title(F.col("text")), F.col("chat_id")).alias("title"))
    return dedupe_names(named.withColumn("base", S.sanitize_name(F.col("title"))))


def split_plan(files: DataFrame, pages: DataFrame, lines: DataFrame, root: str, out: str, created: str, only: list[str] | None = None) -> DataFrame:
    """All steps that turn a multi-chat export into single-chat ones.

    files: the inventory; pages: (chat_id, file, text) of all message pages; lines: their lines. Copies come first, then
    rewritten pages, then markers.
    """
    from ..operators import timeline as T

    root, out = root.rstrip("/"), out.rstrip("/")
    if only:
        pages = pages.filter(F.col("chat_id").isin(*only))
        lines = lines.join(pages.select("file"), "file", "left_semi")
    names = split_names(pages.filter(S.basename(F.col("file")) == K.SINGLE_ROOT_NAME).select("chat_id", "text"))
    sums = T.page_sums(T.page_events(lines)).join(pages.select("file", "chat_id"), "file")
    ranges = T.chat_timeline(sums, "chat_id").select("chat_id", S.range_label(F.col("first"), F.col("last")).alias("label"))
    chats = names.join(ranges, "chat_id").withColumn("dst_root", F.concat(F.lit(out + "/"), F.col("dst"), F.lit("/"), F.col("label")))
    below = files.filter(~F.col("is_dir")).withColumn("chat_id", F.nullif(F.regexp_extract(S.relative_path(F.lit(root), F.col("path")), r"^chats/(chat_[^/]*)/", 1), F.lit("")))
    own = below.filter("chat_id is not null").join(chats, "chat_id")
    inside = F.substring(F.col("path"), F.length(F.concat(F.lit(root + "/chats/"), F.col("chat_id"))) + 2, 1 << 20)
    own = own.select(F.lit(0).alias("rank"), F.lit("copy").alias("action"), F.col("path").alias("src"), F.concat("dst_root", F.lit("/"), inside).alias("dst"), F.lit(None).cast("string").alias("payload"))
    # one step a chat and folder of shared assets (four names at most)
    tops = below.select(F.element_at(F.split(S.relative_path(F.lit(root), F.col("path")), "/"), 1).alias("top")).distinct()
    assets = chats.select("dst_root", F.explode(F.array(*map(F.lit, ASSETS))).alias("top")).join(tops, "top", "left_semi")
    assets = assets.select(F.lit(1).alias("rank"), F.lit("copy_tree").alias("action"), F.concat(F.lit(root + "/"), "top").alias("src"), F.concat("dst_root", F.lit("/"), "top").alias("dst"), F.lit(None).cast("string").alias("payload"))
    moves = localize(lines, files, root).join(pages.select("file", "chat_id"), "file").join(chats.select("chat_id", "dst_root"), "chat_id")
    media = moves.filter("shared").select("dst_root", "target").distinct().select(F.lit(2).alias("rank"), F.lit("copy").alias("action"), F.col("target").alias("src"), F.concat("dst_root", F.lit("/media/"), S.relative_path(F.lit(root), F.col("target"))).alias("dst"), F.lit(None).cast("string").alias("payload"))
    text = pages.select("file", "chat_id", standalone(F.col("text"), F.col("chat_id")).alias("text"))
    # references of the pages as the standalone step leaves them; shared files only if the pages named them before it
    after = localize(line_rows(text.select("file", "text")), files, root).join(pages.select("file", "chat_id"), "file")
    known = moves.filter("shared").select("chat_id", "target").distinct()
    after = after.filter("not shared").unionByName(after.filter("shared").join(known, ["chat_id", "target"], "left_semi").select(after.columns))
    maps = after.groupBy("file").agg(F.collect_list(F.struct(*CHANGE)).alias("m"))
    page = text.join(maps, "file", "left").join(chats.select("chat_id", "dst_root"), "chat_id")
    page = page.select(F.lit(3).alias("rank"), F.lit("rewrite").alias("action"), F.col("file").alias("src"), F.concat("dst_root", F.lit("/"), S.basename(F.col("file"))).alias("dst"), apply_changes(F.col("text"), F.col("m"), True).alias("payload"))
    mark = marker_plan(chats.select("dst_root", "chat_id"), root, created)
    return own.unionByName(assets).unionByName(media).unionByName(page).unionByName(mark)


def marker_plan(chats: DataFrame, root: str, created: str) -> DataFrame:
    """Marker files of (dst_root, chat_id)."""
    payload = F.to_json(F.struct(F.lit("archive_lens").alias("tool"), F.lit("html_single_chat_export_converted").alias("kind"), F.struct(F.lit("html_multi_chat_export").alias("kind"), F.lit(root).alias("export_root"), F.col("chat_id")).alias("converted_from"), F.lit(created).alias("created_utc")))
    return chats.select(F.lit(4).alias("rank"), F.lit("marker").alias("action"), F.lit(None).cast("string").alias("src"), F.concat("dst_root", F.lit("/" + K.MARKER_NAME)).alias("dst"), payload.alias("payload"))


def fix_in_place(lines: DataFrame, files: DataFrame, multi_root: str) -> DataFrame:
    """(file, url, new, copy_from, copy_to): leftover links into the multi-chat export become media/ copies, other links with
    `%` or `#` to existing files of the chat are quoted anew. A page's chat is the folder that it lies in.

    Looked up once for each reference (in a folder), however many places name it.
    """
    multi_root = multi_root.rstrip("/")
    hot = hot_lines(R.style_context(lines))
    refs = R.attribute_refs(hot, K.ATTRIBUTE_REWRITE).unionByName(R.css_refs(hot)).filter(~S.is_skipped(F.col("url"))).withColumn("here", S.dirname(F.col("file")))
    only = files.filter(~F.col("is_dir"))
    place = ["file", *resolve.KEY[1:], "url"]
    tail = F.regexp_replace(S.strip(F.substring_index(S.strip(html_unescape(F.col("url"))), "?", 1)), r"^(?:\.\./)+", "")
    cut = S.strip(F.substring_index(tail, "#", 1))
    paths = F.array_distinct(F.transform(F.filter(F.array(tail, url_unquote(tail), cut, url_unquote(cut)), lambda v: v != ""), lambda v: S.norm_join(F.lit(multi_root), v)))
    left = refs.filter(F.col("url").contains("chats/chat_"))
    hit = resolve.lookup(left.select("url").distinct(), ["url"], paths, only).filter("hit")
    rel = S.relative_path(F.lit(multi_root), F.col("target"))
    a = left.join(hit, "url").select(*place, F.concat(F.lit("media/"), url_quote(rel)).alias("new"), F.col("target").alias("copy_from"), F.concat("here", F.lit("/media/"), rel).alias("copy_to"))
    odd = refs.filter(~F.col("url").contains("chats/chat_") & F.col("url").rlike("[%#]"))
    hit = resolve.lookup_in_export(odd.select("here", "url").distinct(), only, inside=True)
    b = odd.join(hit, ["here", "url"]).select(*place, url_quote(relative_to(F.col("here"), F.col("target"))).alias("new"), F.lit(None).cast("string").alias("copy_from"), F.lit(None).cast("string").alias("copy_to"))
    return a.unionByName(b)


def rename_plan(folders: DataFrame, existing: DataFrame, which: str = "all") -> DataFrame:
    """(src, dst, action) for range folders (path, first, last): renamed to their true range, unless that exists or is equal.

    which: all, unknown (names with `unknown` only), or odd (names that are no range).
    """
    name = S.basename(F.col("path"))
    is_range = name.rlike(r"^(?:\d{4}-\d{2}-\d{2}T\d{2}-\d{2}-\d{2}Z|unknown)__(?:\d{4}-\d{2}-\d{2}T\d{2}-\d{2}-\d{2}Z|unknown)$")
    wanted = F.lit(True) if which == "all" else name.contains("unknown") if which == "unknown" else ~is_range
    dst = F.concat(S.dirname(F.col("path")), F.lit("/"), S.range_label(F.col("first"), F.col("last")))
    x = folders.filter(wanted).select(F.col("path").alias("src"), dst.alias("dst")).filter("src <> dst")
    return x.join(existing.select(F.col("path").alias("dst")), "dst", "left_anti").select(F.lit(1).alias("rank"), F.lit("rename").alias("action"), "src", "dst", F.lit(None).cast("string").alias("payload"))


def backfill_plan(files: DataFrame, created: str, root: str) -> DataFrame:
    """Markers for the range folders of a split (root/chat/range) that look like single-chat exports and have none."""
    from ..operators.tree import html_export_roots

    roots = html_export_roots(files).filter("kind = 'html_single_chat_export'")
    is_range = S.basename(F.col("path")).rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}-\d{2}-\d{2}Z__\d{4}-\d{2}-\d{2}T\d{2}-\d{2}-\d{2}Z$") & (S.dirname(S.dirname(F.col("path"))) == root.rstrip("/"))
    chat = S.basename(S.dirname(F.col("path")))
    payload = F.to_json(F.struct(F.lit("archive_lens").alias("tool"), F.lit("html_single_chat_export_converted").alias("kind"), chat.alias("chat_name"), F.struct(F.lit("html_multi_chat_export").alias("kind"), F.lit(None).cast("string").alias("export_root"), F.lit(None).cast("string").alias("chat_id")).alias("converted_from"), F.lit(created).alias("created_utc"), F.lit("backfilled").alias("note")), {"ignoreNullFields": "false"})
    return roots.filter(is_range).select(F.lit(1).alias("rank"), F.lit("marker").alias("action"), F.lit(None).cast("string").alias("src"), F.concat("path", F.lit("/" + K.MARKER_NAME)).alias("dst"), payload.alias("payload"))
