"""End to end over folders: the golden fixtures of pages, exports, repairs and splits."""

import json
import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from archive_lens import engine
from archive_lens.operators import timeline as T
from archive_lens.plans import sinks
from archive_lens.sources.text import lines

PAGE = """<div class="text bold">
Alice &amp; Bob
</div>
<div class="message service" id="message-1">
<div class="body details">
10 October 2018
</div>
<div class="message default clearfix" id="message1">
<div class="pull_right date details" title="10.10.2018 19:32:23 UTC+01:00">
<div class="message default clearfix joined" id="message2">
<div class="pull_right date details" title="11.10.2018 00:10:00 UTC-03:30">
"""
STAMP = '<div class="pull_right date details" title="'


def put(root, path, text=""):
    p = root / path
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text) if isinstance(text, str) else p.write_bytes(text)


def chat(spark, text):
    sums = T.page_sums(T.page_events(lines(spark.createDataFrame([("/p.html", text)], "file string, text string"))))
    f = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c)
    return tuple(T.chat_timeline(sums.withColumn("chat", F.lit("x")), "chat").select("messages", f("first"), f("last"), "first_source", "basis").first())


def test_timeline(spark):
    assert chat(spark, PAGE) == (2, "2018-10-10T18:32:23", "2018-10-11T03:40:00", "/p.html", "message_timestamps")


def test_day_separators(spark):
    text = "\n".join(x for x in PAGE.split("\n") if "pull_right" not in x)
    assert chat(spark, text) == (2, "2018-10-10T00:00:00", "2018-10-10T00:00:00", None, "day_separators")


def test_bad_date_ends_the_page(spark):
    text = PAGE.replace('<div class="message default clearfix joined"', STAMP + '31.02.2018 10:00:00">\n<div class="message default clearfix joined"')
    assert chat(spark, text)[:3] == (1, "2018-10-10T18:32:23", "2018-10-10T18:32:23")


def test_minutes_take_the_hours_sign(spark):
    assert chat(spark, STAMP + '10.10.2018 10:00:00 UTC-00:30">')[1] == "2018-10-10T09:30:00"


def test_check_links(spark, tmp_path):
    put(tmp_path, "chats/chat_001/photos/a.jpg")
    put(tmp_path, "chats/chat_001/messages.html", """<a href="photos/a.jpg">
<a href="../../chats/chat_002/files/x.pdf">
<a href="https://t.me/x">
<a href="weather.com">
<a href="src.zip">
<img srcset="photos/a.jpg 1x, photos/b.jpg 2x">
<style>.x{background:url(photos/c.jpg)}</style>
<p>url(photos/d.jpg)</p>
<a href="#top">
""")
    got = engine.check_links(spark, str(tmp_path))
    c = got["counters"].first().asDict()
    assert [c[k] for k in ("total", "ok", "missing", "outside", "skipped", "leftover")] == [10, 2, 3, 0, 5, 0]
    assert [c["bucket_" + k] for k in ("non_local", "cross_chat", "media_shared", "media_chat_local", "other_local")] == [4, 1, 0, 5, 0]
    assert (c["media_chat_local"], c["media_chat_local_ok"], c["cross_chat"], c["cross_chat_ok"]) == (6, 2, 1, 0)
    assert [r["url"] for r in got["missing"].orderBy("n").collect()] == ["../../chats/chat_002/files/x.pdf", "photos/b.jpg", "photos/c.jpg"]


    old = engine.check_links(spark, str(tmp_path), legacy=True)["counters"].first()
    assert (old["missing"], old["media_chat_local"]) == (5, 4)


def test_check_each_backup(spark, tmp_path):
    put(tmp_path, "a/export_results.html", '<a href="b.html">')
    put(tmp_path, "a/chats/chat_001/messages.html", PAGE + '<a href="photos/no.jpg">')
    put(tmp_path, "a/j/result.json", "{}")
    put(tmp_path, "a/j/x.html", '<a href="gone.pdf/x">')
    got = engine.check_each(spark, str(tmp_path))
    assert {os.path.relpath(r["root"], tmp_path): (r["total"], r["html_files_scanned"], r["missing"]) for r in got["counters"].collect()} == {"a": (2, 2, 1), "a/j": (1, 1, 1)}
    missing = {os.path.relpath(r["root"], tmp_path): r for r in got["missing"].collect()}
    assert (missing["a"]["name"], missing["a"]["url"], missing["a/j"]["url"]) == ("Alice & Bob", "photos/no.jpg", "gone.pdf/x")


def test_one_check_of_all_backups_equals_checks_of_each(spark, tmp_path):
    """A deeper backup's pages are not its parent's; leftovers, names and limits are each backup's own."""
    for k in range(3):
        at = f"b{k}"
        put(tmp_path, f"{at}/messages.html", PAGE + f'<a href="photos/{k}.jpg"><a href="photos/no.jpg"><a href="../../chats/chat_002/x.pdf"><a href="tg://x">')
        put(tmp_path, f"{at}/photos/{k}.jpg")
        for d in ("css", "js"):
            (tmp_path / at / d).mkdir()
    put(tmp_path, "b1/in/result.json", "{}")
    put(tmp_path, "b1/in/y.html", '<a href="photos/z.pdf"><a href="../messages.html">')
    database(tmp_path / "b2/d/database.sqlite")
    options = {"schemes": ["tg"], "most_missing": 1}
    got = engine.check_each(spark, str(tmp_path), **options)
    rows = lambda df: sorted((tuple(r[c] for c in sorted(r.asDict()) if c != "root") for r in df.collect()), key=str)
    roots = {r["root"] for r in got["counters"].collect()}
    assert {os.path.relpath(r, tmp_path) for r in roots} == {"b0", "b1", "b1/in", "b2", "b2/d"}
    for at in ("b0", "b2"):
        root = str(tmp_path / at)
        alone = engine.check_links(spark, root, **options)
        for k in ("counters", "missing", "schemes", "leftovers", "buckets"):
            assert rows(got[k].filter(F.col("root") == root)) == rows(alone[k]), (at, k)
    inner = got["counters"].filter(F.col("root") == str(tmp_path / "b1/in")).first()
    assert (inner["total"], inner["ok"], inner["missing"], inner["outside"]) == (2, 0, 1, 1)
    outer = got["counters"].filter(F.col("root") == str(tmp_path / "b1")).first()
    assert (outer["html_files_scanned"], outer["total"], outer["leftover"]) == (1, 4, 1)
    fast = engine.check_each(spark, str(tmp_path), fail_fast=True)["counters"]
    assert fast.count() == 5


def test_what_lies_outside_the_root_is_probed(spark, tmp_path):
    put(tmp_path, "out.txt")
    put(tmp_path, "with space.txt")
    (tmp_path / "folder").mkdir()
    put(tmp_path, "r/in/a.html", '<a href="../../out.txt"><a href="../../with%20space.txt"><a href="../../folder"><a href="../../gone.txt"><a href="../b.html"><a href="/etc/hosts">')
    put(tmp_path, "r/b.html")
    root = str(tmp_path / "r")
    c = engine.check_links(spark, root)["counters"].first()
    assert (c["ok"], c["missing"], c["outside"]) == (1, 0, 5)
    got = engine.check_links(spark, root, allow_outside=True)
    c = got["counters"].first()
    assert (c["ok"], c["missing"], c["outside"]) == (5, 1, 0)
    assert [(r["url"], r["note"]) for r in got["missing"].collect()] == [("../../gone.txt", "outside-root")]


def test_streams(spark, tmp_path):
    from archive_lens.streaming.timeline import running_ranges, windowed_counts

    src = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(src)
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    for name, df in (("ranges", running_ranges(stream)), ("counts", windowed_counts(stream))):
        q = df.writeStream.outputMode("complete").format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    want = {tuple(r) for r in running_ranges(batch).collect()}
    assert {tuple(r) for r in spark.sql("select * from ranges").collect()} == want
    assert spark.sql("select sum(messages) as n from counts").first()["n"] == batch.count()


def test_json_report(spark, tmp_path):
    put(tmp_path, "j/result.json", json.dumps({"chats": {"list": [
        {"name": "A", "id": 1, "messages": [{"id": 1, "date": "2018-10-09T21:32:23", "date_unixtime": "1539113543"}]},
        {"title": "B", "id": 2, "messages": []}, {"id": 3, "messages": [{"date": "bad"}]}]}, "left_chats": {"list": []}}))
    r = engine.discover(spark, str(tmp_path)).first()
    assert (r["kind"], r["top_level_keys"], r["chats_backed_up"], r["messages_backed_up"]) == ("multi_chat_export", ["chats", "left_chats"], 3, 2)
    assert (r["first_message_utc"], r["last_message_utc"]) == ("2018-10-09T19:32:23+00:00", "2018-10-09T21:32:23+00:00")
    assert (r["first_message_source"], r["date_range_basis"]) == (str(tmp_path / "j/result.json"), "message_timestamps")
    assert [(c["name"], c["messages_backed_up"], c["first_message_utc"] is None) for c in r["chat_summaries"]] == [("A", 1, False), ("B", 0, True), ("chat_3", 1, True)]


def database(path):
    path.parent.mkdir(parents=True, exist_ok=True)
    con = sqlite3.connect(path)
    con.executescript("""create table messages(source_type, source_id, time); create table users(id, first_name, last_name); create table chats(id, name);
        insert into messages values ('dialog', 5, 1539113543), ('group', 6, 1539113999), (null, 6, 1), ('dialog', 5, 1539113600); insert into users values (5, 'Ann', null);""")
    con.commit()
    con.close()


def test_discover_tree(spark, tmp_path):
    put(tmp_path, "m/export_results.html")
    put(tmp_path, "m/chats/chat_001/messages.html", PAGE)
    for at, mark in (("m/chats/alex", False), ("s", True)):
        put(tmp_path, f"{at}/messages.html", PAGE)
        (tmp_path / at / "css").mkdir()
        (tmp_path / at / "js").mkdir()
        if mark:
            put(tmp_path, f"{at}/.archive_lens_export_meta.json", "{}")
    database(tmp_path / "u/database.sqlite")
    database(tmp_path / "u/.telegram_backup/acc/database.sqlite")
    got = {os.path.relpath(r["export_root"], tmp_path): r for r in engine.discover(spark, str(tmp_path)).collect()}
    assert {k: r["kind"] for k, r in got.items()} == {"m": "html_multi_chat_export", "m/chats/alex": "html_single_chat_export", "s": "html_single_chat_export_converted", "u": "sqlite_unofficial_backup", "u/.telegram_backup/acc": "sqlite_unofficial_backup"}
    assert (got["m"]["chats_backed_up"], got["m"]["messages_backed_up"], got["m"]["chat_summaries"][0]["name"]) == (1, 2, "Alice & Bob")
    u = got["u"]
    assert (u["messages_backed_up"], u["first_message_utc"], u["last_message_utc"], u["chats_backed_up"]) == (4, "1970-01-01T00:00:01+00:00", "2018-10-09T19:39:59+00:00", 2)
    assert [(c["name"], c["messages_backed_up"]) for c in u["chat_summaries"]] == [("Ann", 2), ("group:6", 1)]
    assert got["s"]["bytes"] > len(PAGE)
    only = {os.path.relpath(r["export_root"], tmp_path) for r in engine.discover(spark, str(tmp_path), inspect=False, sizes=False, dedupe=True).filter("fmt = 'sqlite'").collect()}
    assert only == {"u/.telegram_backup/acc"}


def run(capsys, *argv):
    from archive_lens import cli

    code = cli.main([str(x) for x in argv])
    return code, capsys.readouterr().out


def test_nested_reports_are_shown_as_folders_are(spark, tmp_path, capsys):
    put(tmp_path, "m/export_results.html")
    put(tmp_path, "m/chats/chat_001/messages.html", PAGE)
    put(tmp_path, "m/in/result.json", '{"messages": [{"id": 1}], "name": "J"}')
    for d in ("css", "js"):
        (tmp_path / "z" / d).mkdir(parents=True)
    put(tmp_path, "z/messages.html", PAGE + PAGE)
    code, out = run(capsys, tmp_path, "--no-sizes")
    assert code == 0 and out.splitlines() == [
        f"Export root: {tmp_path}", "",
        "z html chats:1 messages:4 size on disk: ? html_single_chat_export range:2018-10-10T18:32:23Z → 2018-10-11T03:40:00Z", "  Alice & Bob 2018-10-10T18-32-23Z__2018-10-11T03-40-00Z messages:4",
        "m html chats:1 messages:2 size on disk: ? html_multi_chat_export", "  Alice & Bob 2018-10-10T18-32-23Z__2018-10-11T03-40-00Z messages:2",
        "  in json chats:1 messages:1 size on disk: ? single_chat_export range:? → ?", "    J unknown__unknown messages:1",
    ]


def test_collections_are_shown_by_chat(spark, tmp_path, capsys):
    for chat, sub, n in (("Ann", "1", 1), ("Bob", "1", 1), ("Bob", "2", 3), ("Cy", "1", 2), ("Cy", "2", 2)):
        for d in ("css", "js"):
            (tmp_path / chat / sub / d).mkdir(parents=True)
        put(tmp_path, f"{chat}/{sub}/messages.html", PAGE * n)
    code, out = run(capsys, tmp_path)
    lines = [x for x in out.splitlines() if "size on disk" in x]
    assert code == 0 and [x.split(" html ")[0] for x in lines] == ["Bob 2", "      1", "Cy 1", "      2", "Ann 1"]


def test_check_from_the_command_line(spark, tmp_path, capsys):
    put(tmp_path, "out.txt")
    put(tmp_path, "r/messages.html", '<a href="../out.txt"><a href="photos/p.jpg">')
    put(tmp_path, "r/photos/p.jpg")
    code, out = run(capsys, tmp_path / "r", "--check-links", "--json")
    got = json.loads(out)
    assert code == 1 and (got["counters"]["outside"], got["counters"]["media_chat_local_ok"], got["counters"]["chat_local_files"]) == (1, 1, 1)
    code, out = run(capsys, tmp_path / "r", "--check-links", "--check-allow-outside-root")
    assert code == 0 and "  ok: 2" in out.splitlines()


def test_repair_is_idempotent(spark, tmp_path):
    put(tmp_path, "a#b.html")
    put(tmp_path, "page.html", '<a href="a#b.html"> <a href="page.html#anchor"> <a href="a%23b.html">')
    sinks.execute(engine.repair_links(spark, str(tmp_path)), dry_run=False)
    assert (tmp_path / "page.html").read_text() == '<a href="a%23b.html"> <a href="page.html#anchor"> <a href="a%23b.html">'
    assert engine.repair_links(spark, str(tmp_path)).count() == 0


def test_split_leaves_nothing_over(spark, tmp_path):
    src = tmp_path / "m"
    put(src, "export_results.html")
    put(src, "css/a.css")
    put(src, "js/a.js")
    put(src, "files/sh%20 #1.pdf", "x")
    put(src, "chats/chat_001/photos/p.jpg", "y")
    body = PAGE + '<link href="../../css/a.css"><a href="../../files/sh%20 #1.pdf"><img src="../../chats/chat_001/photos/p.jpg"><a href="../../lists/chats.html">'
    put(src, "chats/chat_001/messages.html", body)
    put(src, "chats/chat_002/messages.html", PAGE)
    out = tmp_path / "out"
    plan = engine.split(spark, str(src), str(out), created="now")
    assert {r["outcome"] for r in sinks.execute(plan).collect()} == {"planned"} and not out.exists()
    assert {r["outcome"] for r in sinks.execute(plan, dry_run=False).collect()} == {"done"}
    label = "2018-10-10T18-32-23Z__2018-10-11T03-40-00Z"
    assert sorted(p.name for p in out.iterdir()) == ["Alice & Bob", "Alice & Bob (chat_002)"]
    chat = out / "Alice & Bob" / label
    assert (chat / "media/files/sh%20 #1.pdf").read_text() == "x" and (chat / "photos/p.jpg").exists() and (chat / "css/a.css").exists()
    text = (chat / "messages.html").read_text()
    assert 'href="css/a.css"' in text and 'href="media/files/sh%2520%20%231.pdf"' in text and 'src="photos/p.jpg"' in text and 'href="messages.html"' in text
    c = engine.check_links(spark, str(chat))["counters"].first()
    assert (c["leftover"], c["missing"], c["outside"]) == (0, 0, 0)
    assert json.loads((chat / ".archive_lens_export_meta.json").read_text())["converted_from"]["chat_id"] == "chat_001"
    with pytest.raises(FileExistsError):
        engine.split(spark, str(src), str(out))
    with pytest.raises(ValueError):
        engine.split(spark, str(tmp_path / "out"))


def test_rename_and_backfill(spark, tmp_path):
    for d in ("css", "js"):
        (tmp_path / "Ann/unknown__unknown" / d).mkdir(parents=True)
    put(tmp_path, "Ann/unknown__unknown/messages.html", PAGE)
    sinks.execute(engine.rename_ranges(spark, str(tmp_path), "unknown"), dry_run=False)
    label = "2018-10-10T18-32-23Z__2018-10-11T03-40-00Z"
    assert (tmp_path / "Ann" / label / "messages.html").exists()
    assert engine.rename_ranges(spark, str(tmp_path)).count() == 0
    sinks.execute(engine.backfill_markers(spark, str(tmp_path), "now"), dry_run=False)
    assert json.loads((tmp_path / "Ann" / label / ".archive_lens_export_meta.json").read_text())["chat_name"] == "Ann"
    assert engine.backfill_markers(spark, str(tmp_path)).count() == 0


def test_fix_of_an_older_split(spark, tmp_path):
    put(tmp_path, "m/chats/chat_002/files/x 1.pdf", "z")
    put(tmp_path, "s/c/files/a#1.txt")
    put(tmp_path, "s/c/messages.html", '<a href="../../chats/chat_002/files/x 1.pdf"><a href="files/a#1.txt">')
    put(tmp_path, "s/d/messages.html", '<a href="../../chats/chat_002/files/x 1.pdf">')
    put(tmp_path, "s/d/messages2.html", '<a href="../c/files/a#1.txt">')  # another chat's file is left alone
    put(tmp_path, "s/d/media/chats/chat_002/files/x 1.pdf", "old")
    root = str(tmp_path / "s")
    plan = engine.fix_split(spark, root, str(tmp_path / "m"))
    pages = engine.split_pages(engine.inventory(spark, root)).select("chat")
    tell = lambda done: {os.path.basename(r["chat"]): tuple(r[k] for k in ("pages_scanned", "pages_rewritten", "pages_unchanged", "references_rewritten", "files_copied", "files_skipped", "failed")) for r in sinks.statistics(done, pages).collect()}
    assert tell(sinks.execute(plan)) == {"c": (1, 1, 0, 2, 0, 0, 0), "d": (2, 1, 1, 1, 0, 0, 0)}
    assert tell(sinks.execute(plan, dry_run=False, overwrite=False)) == {"c": (1, 1, 0, 2, 1, 0, 0), "d": (2, 1, 1, 1, 0, 1, 0)}
    assert (tmp_path / "s/c/media/chats/chat_002/files/x 1.pdf").read_text() == "z"
    assert (tmp_path / "s/d/media/chats/chat_002/files/x 1.pdf").read_text() == "old"
    assert (tmp_path / "s/c/messages.html").read_text() == '<a href="media/chats/chat_002/files/x%201.pdf"><a href="files/a%231.txt">'
    put(tmp_path, "s/d/messages.html", '<a href="../../chats/chat_002/files/x 1.pdf">')
    sinks.execute(engine.fix_split(spark, root, str(tmp_path / "m")), dry_run=False)
    assert (tmp_path / "s/d/media/chats/chat_002/files/x 1.pdf").read_text() == "z"


STEPS = "rank int, action string, src string, dst string, payload string"


def test_pages_change_together_or_not_at_all(spark, tmp_path):
    for k in range(8):
        put(tmp_path, f"p{k}.html", "old")
    step = lambda k, text: (1, "rewrite", None, str(tmp_path / f"p{k}.html"), text)
    broken = spark.createDataFrame([*(step(k, "new") for k in range(7)), step(7, None)], STEPS)  # a page that no task can write
    with pytest.raises(Exception):  # noqa: B017
        sinks.execute(broken.repartition(4), dry_run=False)
    assert {p.read_text() for p in tmp_path.iterdir()} == {"old"} and len(list(tmp_path.iterdir())) == 8
    (tmp_path / "file").write_text("")
    refused = (1, "marker", None, str(tmp_path / "file" / "x.json"), "{}")
    got = {os.path.basename(r["dst"]): r["outcome"] for r in sinks.execute(spark.createDataFrame([step(0, "new"), refused], STEPS), dry_run=False).collect()}
    assert got["p0.html"] == "done" and got["x.json"].startswith("failed")
    assert (tmp_path / "p0.html").read_text() == "new" and len(list(tmp_path.iterdir())) == 9


def test_copies_skip_or_overwrite(spark, tmp_path):
    put(tmp_path, "a/x/1.txt", "new")
    put(tmp_path, "a/2.txt", "new")
    put(tmp_path, "b/2.txt", "old")
    tree = spark.createDataFrame([(0, "copy_tree", str(tmp_path / "a"), str(tmp_path / "b"), None), (1, "copy", str(tmp_path / "a/2.txt"), str(tmp_path / "b/2.txt"), None), (1, "copy", str(tmp_path / "gone"), str(tmp_path / "b/3.txt"), None)], STEPS)
    tell = lambda **o: sorted((r["action"], r["outcome"][:6], r["written"], r["skipped"]) for r in sinks.execute(tree, dry_run=False, **o).collect())
    assert tell(overwrite=False) == [("copy", "failed", 0, 0), ("copy", "skippe", 0, 1), ("copy_tree", "done", 1, 1)]
    assert (tmp_path / "b/2.txt").read_text() == "old" and (tmp_path / "b/x/1.txt").read_text() == "new"
    assert tell() == [("copy", "done", 1, 0), ("copy", "failed", 0, 0), ("copy_tree", "done", 2, 0)]
    assert (tmp_path / "b/2.txt").read_text() == "new"


def test_sizes_come_from_a_listing_or_follow_from_it(spark, tmp_path):
    """One export alone in its folder, whose size is listed; one beside a note; one that is listed itself; a hidden entry is no neighbour."""
    root = tmp_path / "in"
    for d in ("alone/a__b", "beside/a__b", "listed"):
        put(root, f"{d}/messages.html", "x" * 100)
        put(root, f"{d}/css/a.css")
        put(root, f"{d}/js/a.js")
    put(root, "alone/.DS_Store", "y")
    put(root, "beside/note.txt", "z")
    put(tmp_path, "listing.txt", f"12K\t{root}/alone\n9K\t{root}/beside/\n7\t{root}/listed/\n7.5KiB {root}/listed\nno size {root}/listed\n\n")
    got = {r["export_root"].removeprefix(f"{root}/"): r["bytes"] for r in engine.discover(spark, str(root), listing=str(tmp_path / "listing.txt")).collect()}
    summed = {r["export_root"].removeprefix(f"{root}/"): r["bytes"] for r in engine.discover(spark, str(root)).collect()}
    assert got == {"alone/a__b": 12 << 10, "beside/a__b": summed["beside/a__b"], "listed": 7680}
    assert all(n > 100 for n in summed.values())
