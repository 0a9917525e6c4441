"""References against an inventory of files: prioritized lookup by equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scalars as S
from ..functions.udfs import html_unescape, url_unquote

KEY = ["file", "line_no", "pass", "idx", "sub"]


def lookup(rows: DataFrame, key: list[str], paths: Column, files: DataFrame) -> DataFrame:
    """(key, target, hit): for an array of absolute paths, the first that files (path) holds, else the first of all.

    rows has each key once: what names the paths (a folder and a reference), not every place that does.
    """
    each = rows.select(*key, F.posexplode(paths).alias("pos", "target"))
    known = files.select(F.col("path").alias("target"), F.lit(True).alias("found")).distinct()
    best = each.join(known, "target", "left").groupBy(*key).agg(F.min(F.struct(F.col("found").isNull().alias("missing"), "pos", "target")).alias("best"))
    return best.select(*key, F.col("best.target").alias("target"), (~F.col("best.missing")).alias("hit"))


def targets(refs: DataFrame) -> DataFrame:
    """Classified refs with t0 and t1: the absolute paths that they may mean, as it stands and decoded; null if there is none."""
    here = S.dirname(F.col("file"))
    paths = F.transform(S.candidates(F.col("path")), lambda c: S.norm_join(here, c))
    x = refs.withColumn("paths", F.when(~F.col("skipped") & (F.col("path") != ""), paths))
    return x.withColumn("t0", F.try_element_at("paths", F.lit(1))).withColumn("t1", F.try_element_at("paths", F.lit(2))).drop("paths")


def beyond(refs: DataFrame, *roots: str) -> DataFrame:
    """(target): the distinct paths of refs that lie in none of the folders: those that no inventory of them holds."""
    x = targets(refs).select(F.explode(F.array("t0", "t1")).alias("target")).filter("target is not null")
    for r in roots:
        x = x.filter(~S.is_within(F.lit(r.rstrip("/") or "/"), F.col("target")))
    return x.distinct()


def link_status(refs: DataFrame, files: DataFrame, root: str | Column, scope: str = "all", allow_outside: bool = False) -> DataFrame:
    """Classified refs with resolved_path, note and status (skipped, outside, ok or missing).

    A row keeps its two paths and meets the inventory twice, by equi-joins; it is neither exploded nor joined with itself.
    A row without a path is dealt by its page, so that such rows are no hot key. files must hold what exists: with
    allow_outside also the paths of beyond() that do.
    """
    root = F.lit(root.rstrip("/") or "/") if isinstance(root, str) else root
    known = files.select(F.col("path").alias("known")).distinct()
    spare = F.concat(F.lit("\0"), F.col("file"))
    out = targets(refs).withColumn("k0", F.coalesce("t0", spare)).withColumn("k1", F.coalesce("t1", spare))
    for k in ("0", "1"):
        out = out.join(known.withColumn("hit" + k, F.lit(True)), F.col("k" + k) == F.col("known"), "left").drop("known")
    out = out.withColumn("hit", F.coalesce("hit0", "hit1", F.lit(False))).withColumn("target", F.when(F.col("hit0").isNull() & F.col("hit1"), F.col("t1")).otherwise(F.col("t0")))
    css_off = (F.col("pass") == 2) & ~F.col("in_css")
    out_of_scope = ~F.col("media") if scope == "media" else F.lit(False)
    none = F.col("target").isNull() | (~F.col("hit") & F.col("web"))
    within = S.is_within(root, F.col("target"))
    absolute = F.col("path").startswith("/")
    note = F.nullif(F.concat_ws(",", F.when(absolute, "absolute"), F.when(~within, "outside-root")), F.lit(""))
    outside = F.lit(False) if allow_outside else ~within
    status = F.when(css_off | out_of_scope | none, "skipped").when(outside, "outside").when(F.col("hit"), "ok").otherwise("missing")
    gone = status == "skipped"
    return out.withColumn("status", status).withColumn("note", F.when(~gone, note)).withColumn("resolved_path", F.when(~gone, F.col("target"))).select(*refs.columns, "status", "note", "resolved_path")


def counters(resolved: DataFrame, leftovers: DataFrame | None = None, *by: str) -> DataFrame:
    """The link check's counts: one row, or one for each value of by; leftovers (by) are counted beside the references."""
    s = F.col("status")
    n = lambda c: F.count_if(c)
    ref = s.isNotNull()
    each = [n(ref).alias("total")] + [n(s == x).alias(x) for x in ("skipped", "ok", "missing", "outside")]
    for kind in ("shared", "chat_local"):
        each += [n(F.col("media_class") == kind).alias(f"media_{kind}"), n((F.col("media_class") == kind) & (s == "ok")).alias(f"media_{kind}_ok")]
    each += [n(F.col("cross_chat")).alias("cross_chat"), n(F.col("cross_chat") & (s == "ok")).alias("cross_chat_ok")]
    each += [n(F.col("bucket") == b).alias(f"bucket_{b}") for b in ("non_local", "cross_chat", "media_shared", "media_chat_local", "other_local")]
    rows = resolved.select(*by, "status", "media_class", "cross_chat", "bucket")
    if leftovers is not None:
        rows = rows.unionByName(leftovers.select(*by), allowMissingColumns=True) if by else rows.unionByName(leftovers.select(F.lit(None).cast("string").alias("status")), allowMissingColumns=True)
    return rows.groupBy(*by).agg(*each, n(~ref).alias("leftover"))


def fail_fast(resolved: DataFrame, leftovers: DataFrame | None = None, *by: str) -> DataFrame:
    """The refs of the files up to and with the first (in path order, of each value of by) that has a problem or a leftover of a split (file)."""
    bad = resolved.filter(F.col("status").isin("missing", "outside")).select(*by, "file")
    bad = (bad if leftovers is None else bad.union(leftovers.select(*by, "file"))).groupBy(*by).agg(F.min("file").alias("first_bad"))
    both = resolved.join(bad, list(by), "left") if by else resolved.crossJoin(F.broadcast(bad))
    return both.filter(F.col("first_bad").isNull() | (F.col("file") <= F.col("first_bad"))).select(*resolved.columns)


def spellings(rows: DataFrame) -> DataFrame:
    """rows (here, url) with one row for each way to read a reference in an export, by preference (pos): whole and without
    its fragment, as it stands and decoded once and twice. at: the path that it names seen from here; bare: a name alone,
    which may also stand for a file in one of the folders of a chat's media."""
    u = S.strip(F.substring_index(S.strip(html_unescape(F.col("url"))), "?", 1))
    cut = S.strip(F.substring_index(u, "#", 1))
    once = [url_unquote(x) for x in (u, cut)]
    variants = F.array_distinct(F.array(u, once[0], url_unquote(once[0]), cut, once[1], url_unquote(once[1])))
    v = F.col("variant")
    each = rows.select("here", "url", F.posexplode(variants).alias("pos", "variant")).filter(v != "")
    return each.select("here", "url", "pos", S.norm_join(F.col("here"), v).alias("at"), (~v.rlike(r"[/\\]") & ~v.startswith(".")).alias("bare"))


def export_places(files: DataFrame) -> DataFrame:
    """(at, rank) of files (path): the paths by which they may be meant. A file is meant by its own (rank 0); one in a folder of
    a chat's media also by a bare name in the folder above, where the first of these folders (its number) goes first."""
    folders = sorted(K.CHAT_LOCAL_DIRS)
    end = F.substring_index("path", "/", -2)  # a folder and a name
    rank = F.array_position(F.array(*map(F.lit, folders)), F.substring_index(end, "/", 1)).cast("int")
    above = F.concat(F.substring(F.col("path"), F.lit(1), F.length("path") - F.length(end)), F.substring_index(end, "/", -1))
    own = F.struct(F.col("path").alias("at"), F.lit(0).alias("rank"))
    both = F.when(rank > 0, F.array(own, F.struct(above.alias("at"), rank.alias("rank")))).otherwise(F.array(own))
    return files.select("path").select(F.inline(both)).groupBy("at").agg(F.min("rank").alias("rank"))


def lookup_in_export(rows: DataFrame, files: DataFrame, inside: bool = False) -> DataFrame:
    """(here, url, target) of the distinct rows (here, url) that name a file: the first that a spelling means, in its own place
    or, a bare name, in the first folder of media that holds it. inside: spellings that lead out of here don't count.

    A spelling is one row of the join and a file two at most, however many folders of media there are.
    """
    each = spellings(rows)
    if inside:
        each = each.filter(S.is_within(F.col("here"), F.col("at")))
    hit = each.join(export_places(files), "at").filter((F.col("rank") == 0) | F.col("bare"))
    cut = F.length("at") - F.length(F.substring_index("at", "/", -1))  # up to and with the last slash
    folder = F.try_element_at(F.array(*map(F.lit, sorted(K.CHAT_LOCAL_DIRS))), F.col("rank"))
    moved = F.concat(F.substring(F.col("at"), F.lit(1), cut), folder, F.lit("/"), F.substring_index("at", "/", -1))
    target = F.when(F.col("rank") == 0, F.col("at")).otherwise(moved)
    best = hit.select("here", "url", F.struct("pos", target.alias("target")).alias("x")).groupBy("here", "url").agg(F.min("x").alias("x"))
    return best.select("here", "url", "x.target")


def resolve_in_export(refs: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """refs with target: the file under root that each means, rows without one left out; none in folders that are copied as a whole.

    Looked up once for each folder and reference, however many places name it.
    """
    root = root.rstrip("/")
    rows = refs.filter(~S.is_skipped(F.col("url"))).withColumn("here", S.dirname(F.col("file")))
    top = F.element_at(F.split(S.relative_path(F.lit(root), F.col("path")), "/"), 1)
    usable = files.filter(~F.col("is_dir") & S.is_within(F.lit(root), F.col("path")) & ~top.isin(*K.SKIP_SHARED_DIRS))
    return rows.join(lookup_in_export(rows.select("here", "url").distinct(), usable), ["here", "url"]).select(*refs.columns, "target")
