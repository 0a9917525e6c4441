"""Command line: python -m archive_lens.cli PATH [action]. Exit codes: 0 fine, 1 problems or nothing found, 2 usage, 3 cannot split."""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import datetime, timezone

from pyspark.sql import functions as F

from . import engine
from .functions import scalars as S
from .operators import reports as P
from .plans import sinks
from .session import get_session


SINGLE = ("html_single_chat_export", "html_single_chat_export_converted", "single_chat_export")


def shown(v) -> str:
    return "?" if v is None else str(v)


def report_line(r, left: str) -> str:
    """One report; a range only for a single chat, whose messages have one."""
    when = lambda t: t.replace("+00:00", "Z") if t else "?"
    span = f" range:{when(r['first_message_utc'])} → {when(r['last_message_utc'])}" if r["kind"] in SINGLE else ""
    return f"{left} {r['fmt']} chats:{shown(r['chats_backed_up'])} messages:{shown(r['messages_backed_up'])} size on disk: {shown(r['size'])} {r['kind']}{span}"


def summary_lines(r, indent: str) -> list[str]:
    """A report's chats, most messages first."""
    stamp = lambda t: t[:19].replace(":", "-") + "Z" if t else "unknown"
    each = sorted(r["chat_summaries"] or [], key=lambda c: (-1 * (-1 if c["messages_backed_up"] is None else c["messages_backed_up"]), c["name"] or ""))
    return [f"{indent}  {c['name']} {stamp(c['first_message_utc'])}__{stamp(c['last_message_utc'])} messages:{shown(c['messages_backed_up'])}" for c in each]


def show_reports(df, root: str) -> list[str]:
    """Lines of text: by chat folder for a collection of single chats, else nested as the folders are."""
    root = os.path.abspath(root)
    df = df.withColumn("size", S.format_bytes(F.col("bytes")))
    collection = P.collection_mode(df, root).first()["collection"]
    rows = (P.collection_order if collection else P.nested_order)(df, root).orderBy("n").collect()  # a line for each backup that the user sees
    out = [f"Export root: {root}", ""]
    for r in rows:
        if collection:
            out += [report_line(r, f"{r['chat']} {r['label']}" if r["first"] else f"      {r['label']}"), *summary_lines(r, "")]
        else:
            indent, label = "  " * r["level"], os.path.basename(r["export_root"]) if r["label"] == "." else r["label"].replace("/", " ")
            out += [report_line(r, indent + label), *summary_lines(r, indent)]
    return out


def main(argv: list[str] | None = None) -> int:
    a = argparse.ArgumentParser(prog="archive_lens")
    a.add_argument("path")
    for flag in ("json", "no-inspect", "no-sizes", "dedupe-unofficial-sqlite", "check-links", "check-allow-outside-root", "check-fail-fast", "check-legacy", "repair-html-links", "split-multi-html", "rename-ranges", "backfill-meta", "apply", "overwrite"):
        a.add_argument(f"--{flag}", action="store_true")
    a.add_argument("--check-scope", choices=("all", "media"), default="all")
    a.add_argument("--check-schemes", default="")
    a.add_argument("--check-max-missing", type=int, default=200)
    a.add_argument("--check-max-schemes", type=int, default=200)
    a.add_argument("--sizes-from")
    a.add_argument("--split-out")
    a.add_argument("--split-chat", action="append")
    a.add_argument("--fix-split-from")
    a.add_argument("--rename", choices=("all", "unknown", "odd"), default="all")
    o = a.parse_args(argv)
    if not os.path.isdir(o.path):
        print(f"no such folder: {o.path}", file=sys.stderr)
        return 2
    spark = get_session("archive_lens", os.environ.get("SPARK_MASTER", "local[*]"))
    now = datetime.now(timezone.utc).isoformat()
    plan = None
    if o.check_links:
        options = {"scope": o.check_scope, "schemes": o.check_schemes.split(","), "allow_outside": o.check_allow_outside_root, "fail_fast": o.check_fail_fast, "most_missing": o.check_max_missing, "most_schemes": o.check_max_schemes, "legacy": o.check_legacy}
        # text is by backup, JSON of the folder as a whole
        got = engine.check_links(spark, o.path, **options) if o.json else engine.check_each(spark, o.path, **options)
        told: dict[str, dict] = {}
        for name, df in got.items():  # a row a backup, and the first few of each kind
            for r in df.collect():
                told.setdefault(r["root"] if not o.json else o.path, {}).setdefault(name, []).append({k: v for k, v in r.asDict().items() if k != "root"})
        failed = False
        for root in sorted(told, key=lambda p: (p.count("/"), p)):
            x = told[root]
            counts = x["counters"][0] | x.get("media", [{}])[0]
            failed |= bool(counts["missing"] or counts["outside"] or counts["leftover"])
            bad = sorted(x.get("missing", []), key=lambda r: (r["status"], r["n"]))
            if o.json:
                print(json.dumps({"counters": counts, "missing": bad} | {k: x.get(k, []) for k in ("schemes", "leftovers", "buckets")}, indent=2))
            else:
                print("\n".join([root, *(f"  {k}: {v}" for k, v in counts.items()), *(f"  {r['status']} {r['file']}:{r['line_no']} {r['url']} {r['name'] or ''}" for r in bad), *(f"  leftover {r['file']}:{r['line_no']} {r['url']}" for r in x.get("leftovers", []))]))
        return int(failed)
    if o.repair_html_links:
        plan = engine.repair_links(spark, o.path)
    elif o.split_multi_html:
        try:
            plan = engine.split(spark, o.path, o.split_out, o.split_chat, now)
        except (ValueError, FileExistsError) as e:
            print(e, file=sys.stderr)
            return 3
    elif o.fix_split_from:
        if not os.path.isdir(os.path.join(o.fix_split_from, "chats")):
            print(f"no multi-chat export: {o.fix_split_from}", file=sys.stderr)
            return 2
        done = sinks.execute(engine.fix_split(spark, o.path, o.fix_split_from), not o.apply, o.overwrite)
        each = sinks.statistics(done, engine.split_pages(engine.inventory(spark, o.path)).select("chat")).orderBy("chat").collect()  # a row a chat
        for r in each:
            print(r["chat"], *(f"{k}={v}" for k, v in r.asDict().items() if k != "chat"))
        if not each:
            print("no chats found", file=sys.stderr)
        return int(not each)
    elif o.rename_ranges:
        plan = engine.rename_ranges(spark, o.path, o.rename)
    elif o.backfill_meta:
        plan = engine.backfill_markers(spark, o.path, now)
    if plan is not None:
        for r in sinks.execute(plan, dry_run=not o.apply).groupBy("action", "outcome").count().orderBy("action", "outcome").collect():
            print(r["action"], r["outcome"], r["count"])
        return 0
    df = engine.discover(spark, o.path, not o.no_inspect, not o.no_sizes, o.dedupe_unofficial_sqlite, o.sizes_from).cache()
    if not df.limit(1).count():
        print("no exports found", file=sys.stderr)
        return 1
    if o.json:
        print("[" + ",\n".join(r["j"] for r in df.drop("bytes").select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).collect()) + "]")
    else:
        print("\n".join(show_reports(df, o.path)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
