"""Scalar functions over columns, all of built-in expressions but for the UDFs of udfs.py."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .udfs import html_unescape, url_unquote


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(K.WHITE_SPACE))


# Times.


def parse_iso(c: Column) -> Column:
    """ISO date and time, naive ones as UTC; null if it is none (a bare year is none)."""
    t = F.trim(c)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), t.try_cast("timestamp"))


def parse_unixtime(c: Column) -> Column:
    """Whole seconds since 1970; null for anything else."""
    return F.timestamp_seconds(F.trim(c.cast("string")).try_cast("long"))


def dir_time(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd'T'HH-mm-ss'Z'"), F.lit("unknown"))


def display_time(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("?"))


def range_label(first: Column, last: Column) -> Column:
    return F.concat_ws("__", dir_time(first), dir_time(last))


def export_date(path: Column) -> Column:
    """The date of an export folder anywhere in a path, as text; null if there is none or it is not a date."""
    part = lambda i: F.regexp_extract(path, K.EXPORT_DATE, i)
    return F.date_format(F.try_to_date(F.concat_ws("-", part(3), part(2), part(1)), "yyyy-MM-dd"), "yyyy-MM-dd")


def day_separator(line: Column) -> Column:
    """Midnight of a line like `10 October 2018`; null if it is none."""
    t = strip(line)
    month = reduce(lambda a, b: a.when(F.regexp_extract(t, K.DAY, 2) == b[1], b[0]), enumerate(K.MONTHS, 1), F.when(F.lit(False), 0))
    number = lambda i: F.nullif(F.regexp_extract(t, K.DAY, i), F.lit("")).try_cast("int")
    return F.try_make_timestamp(number(3), month, number(1), F.lit(0), F.lit(0), F.lit(0), F.lit("UTC"))


def message_time(day, month, year, hour, minute, second, zone_hour, zone_minute) -> Column:
    """A page's timestamp in UTC. The zone's minutes take the sign of its hours as a number (so `-00:30` adds 30)."""
    h, m = F.coalesce(zone_hour, F.lit(0)), F.coalesce(zone_minute, F.lit(0))
    shift = h * 60 + F.when(h >= 0, m).otherwise(-m)
    shift = F.when(F.abs(shift) < 24 * 60, shift).otherwise(0)
    return F.try_make_timestamp(year, month, day, hour, minute, second.cast("int"), F.lit("UTC")) - F.make_dt_interval(F.lit(0), F.lit(0), shift, F.lit(0))


# Paths and references.


def segments(path: Column) -> Column:
    """Parts of a path without empty ones, `.` and `..`."""
    return F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: ~x.isin("", ".", ".."))


def strip_dots(path: Column) -> Column:
    return F.array_join(segments(path), "/")


def norm_join(base: Column, rel: Column) -> Column:
    """The normal absolute path of rel seen from the absolute folder base."""
    whole = F.when(rel.startswith("/"), rel).otherwise(F.concat(base, F.lit("/"), rel))
    fold = F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    normal = whole.startswith("/") & ~whole.rlike(r"/\.{0,2}(?:/|\z)")  # nothing to fold
    return F.when(normal, whole).otherwise(F.concat(F.lit("/"), F.array_join(fold, "/")))


def ancestors(path: Column) -> Column:
    """All folders above an absolute path, the root of the file system last."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    up = F.transform(F.sequence(F.greatest(F.size(parts) - 1, F.lit(0)), F.lit(0), F.lit(-1)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))
    return F.when(F.size(parts) > 0, up).otherwise(F.array().cast("array<string>"))


def dirname(path: Column) -> Column:
    d = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(d == "", "/").otherwise(d)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def depth(path: Column) -> Column:
    return F.size(F.filter(F.split(path, "/"), lambda x: x != ""))


def is_within(parent: Column, child: Column) -> Column:
    return (parent == child) | (parent == "/") | child.startswith(F.concat(parent, F.lit("/")))


def relative_path(parent: Column, child: Column) -> Column:
    """child below parent; `.` if they are the same."""
    return F.when(parent == child, ".").otherwise(F.substring(child, F.length(parent) + 2, F.length(child)))


def url_path(url: Column) -> Column:
    """The file path that a reference names: entities read, fragment and query cut."""
    u = strip(html_unescape(url))
    return strip(F.substring_index(F.substring_index(u, "#", 1), "?", 1))


def candidates(path: Column) -> Column:
    """The path as it stands, then percent-decoded."""
    return F.array_distinct(F.filter(F.array(path, url_unquote(path)), lambda x: x != ""))


def is_skipped(url: Column) -> Column:
    """Empty, a fragment, or of any scheme."""
    u = strip(url)
    return (u == "") | u.startswith("#") | u.rlike(K.SCHEME)


def is_ipv4(host: Column) -> Column:
    p = F.split(host, r"\.")
    return (F.size(p) == 4) & F.forall(p, lambda x: x.rlike(r"^\d{1,3}$") & (F.coalesce(x.try_cast("int"), F.lit(999)) <= 255))


def _bare(path: Column) -> Column:
    return (path != "") & ~path.rlike(r"^[./#]")


def is_host(path: Column) -> Column:
    """A reference (as url_path gives it) that looks like a web host."""
    host = F.trim(F.substring_index(path, "/", 1))
    tld = F.lower(F.element_at(F.split(host, r"\."), -1))
    named = host.rlike(r"(?U)^[\w.-]+$") & ~tld.isin(*K.FILE_EXTENSIONS) & tld.rlike("^[a-z]{2,24}$")
    return _bare(path) & ~path.rlike(r"[\\ ]") & host.contains(".") & (is_ipv4(host) | named)


def is_bare_file(path: Column) -> Column:
    """One path segment with a known extension."""
    ext = F.lower(F.element_at(F.split(path, r"\."), -1))
    return _bare(path) & ~path.rlike(r"[/\\]") & path.contains(".") & ext.isin(*K.FILE_EXTENSIONS)


def media_class(url: Column, path: Column) -> Column:
    """`shared`, `chat_local` or null, from the folders that a reference names."""
    p = segments(path)
    at = lambda i: F.try_element_at(p, F.lit(i))
    local = lambda c: c.isin(*K.CHAT_LOCAL_DIRS)
    in_chat = (F.size(p) >= 3) & (at(1) == "chats") & at(2).rlike(r"^chat_\d+$")
    kind = F.when(at(1) == "media", "shared").when(local(at(1)), "chat_local").when(in_chat & (at(3) == "media"), "shared").when(F.arrays_overlap(p, F.array(*map(F.lit, K.CHAT_LOCAL_DIRS))), "chat_local")
    return F.when(~is_skipped(url), kind)


def is_media(url: Column, path: Column) -> Column:
    return ~is_skipped(url) & F.arrays_overlap(segments(path), F.array(*map(F.lit, K.MEDIA_DIRS)))


def target_chat(url: Column, path: Column) -> Column:
    return F.when(~is_skipped(url), F.nullif(F.regexp_extract(strip_dots(path), r"^chats/chat_(\d+)(?:/|$)", 1), F.lit("")))


def source_chat(rel: Column) -> Column:
    return F.nullif(F.regexp_extract(rel, r"(?:^|/)chats/chat_(\d+)(?:/|$)", 1), F.lit(""))


def chat_folder(rel: Column) -> Column:
    return F.nullif(F.regexp_extract(rel, r"(?:^|/)chats/(chat_\d+)(?:/|$)", 1), F.lit(""))


def dialog_id(rel: Column) -> Column:
    return F.nullif(F.regexp_extract(rel, r"(?:^|/)files/dialogs/chat_(\d+)_p\d+\.html$", 1), F.lit("")).try_cast("long")


# Names and sizes.


def sanitize_name(name: Column, longest: int = 120) -> Column:
    """A folder name: separators become `_`, control characters go, white space is one space, no dots or spaces at the end."""
    s = F.regexp_replace(F.regexp_replace(strip(name), r"[/\\]", "_"), r"[\x00-\x1f\x7f]+", "")
    s = strip(F.regexp_replace(s, r"(?U)\s+", " "))
    s = F.regexp_replace(F.when(s == "", "unknown_chat").otherwise(s), r"[ .]+$", "")
    s = F.when(F.length(s) > longest, F.regexp_replace(F.substring(s, 1, longest), r"[ .]+$", "")).otherwise(s)
    return F.when(s == "", "unknown_chat").otherwise(s)


def page_title(text: Column, first: int | None = 65536, unescape=html_unescape, blank: str = K.WHITE_SPACE) -> Column:
    """The chat's title in the first 64 Ki characters of a page; null without one. unescape reads its entities, blank is what is
    taken off its ends."""
    head = text if first is None else F.substring(text, 1, first)
    raw = F.regexp_replace(F.regexp_extract(head, K.TITLE, 1), "<[^>]+>", "")
    return F.nullif(F.btrim(unescape(raw), F.lit(blank)), F.lit(""))


def xml_unescape(c: Column) -> Column:
    """The entities of angle brackets and ampersands alone, as they are written in full."""
    for entity, x in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(x))
    return c


def chat_name(name: Column, title: Column, chat_id: Column) -> Column:
    blank = lambda c: F.nullif(strip(c), F.lit(""))
    return F.coalesce(blank(name), blank(title), F.concat(F.lit("chat_"), chat_id.cast("string")), F.lit("unknown_chat"))


def format_bytes(n: Column) -> Column:
    """Bytes with a binary unit, to three figures; halves round to even; null stays null."""
    v, out = n.cast("double"), None
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB", "PiB"), 1):
        x = v / float(1024**k)
        text = F.when(x >= 100, F.format_string("%.0f", F.bround(x, 0))).when(x >= 10, F.format_string("%.1f", F.bround(x, 1))).otherwise(F.format_string("%.2f", F.bround(x, 2)))
        text = F.concat(text, F.lit(unit))
        last = unit == "PiB"
        out = F.when(v < 1024, F.concat(n.cast("long").cast("string"), F.lit("B"))) if out is None else out
        out = out.otherwise(text) if last else out.when(v < float(1024 ** (k + 1)), text)
    return F.when(n.isNotNull(), out)


def parse_bytes(c: Column) -> Column:
    """Bytes of text like `1234`, `1.5MiB`, `1K` (1024) or `1KB` (1000); null if it is none."""
    s = strip(c)
    num, unit = F.regexp_extract(s, r"^(\d+(?:\.\d+)?)([A-Za-z]+)$", 1), F.regexp_extract(s, r"^(\d+(?:\.\d+)?)([A-Za-z]+)$", 2)
    table = F.create_map(*[F.lit(x) for kv in K.UNITS.items() for x in kv])
    factor = F.coalesce(F.try_element_at(table, unit), F.try_element_at(table, F.initcap(unit)))
    return F.when(s.rlike(r"^\d+$"), s.try_cast("long")).when(num != "", F.floor(num.try_cast("double") * factor).cast("long"))
