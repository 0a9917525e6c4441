"""References of HTML pages: generators, style context, classes and buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scalars as S

REFS = ["file", "line_no", "pass", "idx", "sub", "attr", "url", "in_css"]


def all_groups(text: Column, pattern: str, *groups: int) -> Column:
    """One struct for each match, with the given groups as g0, g1, ..."""
    found = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{i}") for i, g in enumerate(groups)]
    return F.arrays_zip(*found)


def style_context(lines: DataFrame) -> DataFrame:
    """lines with in_css: inside a style block (which ends after the line that closes it) or on a line with a style attribute.

    One window over a file's lines; a file's lines are the unit of the format.
    """
    low = F.lower("line")
    opens, closes = low.contains("<style"), low.contains("</style")
    event = F.when(closes, 0).when(opens, 1)
    before = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    held = F.coalesce(F.last(event, ignorenulls=True).over(before), F.lit(0)) == 1
    return lines.withColumn("in_css", opens | held | low.contains('style="') | low.contains("style='"))


REF = "array<struct<pass:int,idx:int,sub:int,attr:string,url:string>>"


def _ref(kind: int, idx: Column, sub: Column, attr: Column, url: Column) -> Column:
    return F.struct(F.lit(kind).alias("pass"), idx.cast("int").alias("idx"), sub.cast("int").alias("sub"), attr.alias("attr"), url.alias("url"))


def attribute_array(text: Column, pattern: str = K.ATTRIBUTE) -> Column:
    return F.transform(all_groups(text, pattern, 1, 3), lambda m, i: _ref(0, i, F.lit(0), F.lower(m["g0"]), m["g1"])).cast(REF)


def srcset_array(text: Column) -> Column:
    """Each first word of a srcset's parts between commas."""
    urls = lambda v: F.filter(F.transform(F.split(v, ","), lambda x: F.element_at(F.split(S.strip(x), r"(?U)\s+"), 1)), lambda x: x != "")
    return F.flatten(F.transform(all_groups(text, K.SRCSET, 2), lambda m, i: F.transform(urls(m["g0"]), lambda u, k: _ref(1, i, k, F.lit("srcset"), u)))).cast(REF)


def css_array(text: Column) -> Column:
    return F.transform(all_groups(text, K.CSS, 2), lambda m, i: _ref(2, i, F.lit(0), F.lit("css-url"), m["g0"])).cast(REF)


def exploded(lines: DataFrame, *arrays: Column) -> DataFrame:
    """One row a reference; all generators share one pass over the lines. Other columns are kept."""
    other = [c for c in lines.columns if c not in ("file", "line_no", "line", "in_css")]
    return lines.select("file", "line_no", "in_css", *other, F.explode(F.concat(*arrays)).alias("r")).select("file", "line_no", "r.*", "in_css", *other).select(*REFS, *other)


def attribute_refs(lines: DataFrame, pattern: str = K.ATTRIBUTE) -> DataFrame:
    return exploded(lines, attribute_array(F.col("line"), pattern))


def css_refs(lines: DataFrame) -> DataFrame:
    return exploded(lines, css_array(F.col("line")))


def all_refs(lines: DataFrame) -> DataFrame:
    line = F.col("line")
    return exploded(lines, attribute_array(line), srcset_array(line), css_array(line))


def keyword_lines(lines: DataFrame) -> DataFrame:
    """The lines that can hold a reference, with in_css."""
    return style_context(lines).filter(F.lower("line").rlike(r"href|src|poster|srcset|url\("))


def refs_by_line(lines: DataFrame) -> DataFrame:
    """All references of (file, line_no, line); lines without any keyword are dropped before the expressions run."""
    return all_refs(keyword_lines(lines))


def refs_whole(texts: DataFrame) -> DataFrame:
    """References of whole texts (file, text), which may span lines."""
    return all_refs(texts.select("file", F.lit(0).alias("line_no"), F.col("text").alias("line"), F.lit(True).alias("in_css")))


def leftovers(lines: DataFrame) -> DataFrame:
    """References of message pages that still lead into another chat of a multi-chat export."""
    pages = lines.filter(S.basename(F.col("file")).startswith("messages"))
    other = [c for c in lines.columns if c not in ("file", "line_no", "line", "in_css")]
    found = pages.select("file", "line_no", *other, F.posexplode(all_groups(F.col("line"), K.LEFTOVER, 1, 3)).alias("idx", "m"))
    return found.select("file", "line_no", "idx", F.lower("m.g0").alias("attr"), F.col("m.g1").alias("url"), *other)


def classified(refs: DataFrame, root: str | Column, legacy: bool = False) -> DataFrame:
    """refs with path, skipped, media, media_class, cross_chat, bucket. root: a folder, or the column that names each row's.

    legacy: as an older checker has it; nothing is taken for a web host or a bare file name, only a path's head makes its
    media class, and css references outside css are of no class.
    """
    url, path = F.col("url"), F.col("path")
    rel = S.relative_path(F.lit(root.rstrip("/")) if isinstance(root, str) else root, F.col("file"))
    out = refs.withColumn("path", S.url_path(url)).withColumn("skipped", S.is_skipped(url))
    out = out.withColumn("media", S.is_media(url, path)).withColumn("media_class", F.when(F.col("media"), S.media_class(url, path)))
    if legacy:
        head = F.try_element_at(S.segments(path), F.lit(1))
        simple = F.when(head == "media", "shared").when(head.isin(*K.CHAT_LOCAL_DIRS), "chat_local")
        out = out.withColumn("media_class", F.when(F.col("media") & ((F.col("pass") < 2) | F.col("in_css")), simple))
    web = F.lit(False) if legacy else ~F.col("skipped") & (S.is_host(path) | S.is_bare_file(path))
    out = out.withColumn("web", web)
    target, source = S.target_chat(url, path), S.source_chat(rel)
    out = out.withColumn("cross_chat", F.coalesce(target != source, F.lit(False)))
    bucket = F.when(F.col("skipped") | F.col("web"), "non_local").when(F.col("cross_chat"), "cross_chat").when(F.col("media_class") == "shared", "media_shared").when(F.col("media_class") == "chat_local", "media_chat_local").otherwise("other_local")
    return out.withColumn("bucket", bucket)


def with_scheme(refs: DataFrame, schemes: list[str]) -> DataFrame:
    """Attribute and srcset references that start with one of the schemes (`tg` or `tg:`)."""
    heads = [s.strip().lower().rstrip(":") + ":" for s in schemes if s.strip()]
    u = F.lower(S.strip(F.col("url")))
    hit = F.lit(False)
    for h in heads:
        hit = hit | u.startswith(h)
    return refs.filter((F.col("pass") < 2) & hit)


def first_of_each(rows: DataFrame, category: str | list[str], most: int) -> DataFrame:
    """The first rows of each category in page order (Spark limits the groups before it sorts them)."""
    order = Window.partitionBy(category).orderBy("file", "line_no", "pass", "idx", "sub")
    return rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most)


def bucket_counts(refs: DataFrame, *by: str) -> DataFrame:
    return refs.groupBy(*by, "bucket").agg(F.count("*").alias("refs"))
