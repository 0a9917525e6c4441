"""The folder source: tasks, pushed filters, bodies; SQLite ranges and pushed filters."""

import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from archive_lens import engine
from archive_lens.sources import filetree, sqlite


def grow(root, chats=300):
    for k in range(chats):
        at = root / "chats" / f"chat_{k:03d}"
        (at / "photos").mkdir(parents=True)
        (at / "messages.html").write_bytes(b"<title>\xff%d</title>" % k)
        (at / "photos" / "p.jpg").write_bytes(b"x" * k)
    (root / ".hidden").mkdir()
    (root / ".hidden" / "z").write_text("z")
    os.symlink(root / "chats", root / "link")
    os.symlink(root / "nowhere", root / "broken")


def by_hand(root):
    out = {str(root)}
    for at, dirs, names in os.walk(root):
        out |= {os.path.join(at, x) for x in [*dirs, *names]}
    return out


def test_one_folder_of_many_is_many_tasks(spark, tmp_path):
    grow(tmp_path)
    df = filetree.files(spark, str(tmp_path), tasks=8)
    rows = df.withColumn("p", F.spark_partition_id()).collect()
    assert len(rows) == len({r.path for r in rows}) and {r.path for r in rows} == by_hand(tmp_path)
    assert max(sum(r.p == p for r in rows) for p in {r.p for r in rows}) < len(rows) / 4
    known = {r.path: r for r in rows}
    link, broken = known[str(tmp_path / "link")], known[str(tmp_path / "broken")]
    assert link.is_dir and not broken.is_dir and broken.size is None
    assert known[str(tmp_path / "chats/chat_007/photos/p.jpg")].size == 7
    # planning stops at its bound, whatever the tree looks like
    few = filetree.files(spark, str(tmp_path), tasks=1000, planned=3)
    assert {r.path for r in few.collect()} == by_hand(tmp_path)


def test_tests_reach_the_listing(spark, tmp_path):
    grow(tmp_path, 20)
    below = str(tmp_path / "chats" / "chat_003")
    for where, want in (
        ((("path", "starts", below),), {below, below + "/messages.html", below + "/photos", below + "/photos/p.jpg"}),
        ((("name", "=", "p.jpg"), ("path", "starts", below)), {below + "/photos/p.jpg"}),
        ((("name", "in", "z", "gone"),), {str(tmp_path / ".hidden/z")}),
        ((("name", "ends", ".html"), ("dir", "=", below)), {below + "/messages.html"}),
        ((("is_dir", "=", True), ("ext", "=", ""), ("dir", "starts", below)), {below + "/photos"}),
        ((("path", "in", below, str(tmp_path)),), {below, str(tmp_path)}),
    ):
        assert {r.path for r in filetree.files(spark, str(tmp_path), where).collect()} == want
    df = filetree.files(spark, str(tmp_path))  # one DataFrame, two filters in one query
    assert df.filter("name = 'p.jpg'").union(df.filter("name = 'z'")).count() == 21
    import json

    reader = filetree.FileTreeReader({"path": str(tmp_path), "where": json.dumps([("path", "starts", below)])})
    seen = [x for part in reader.partitions() for x in part.folders]
    assert not [x for x in seen if "chat_" in x and not x.startswith(below)]  # other subtrees are not entered
    with pytest.raises(ValueError):
        filetree.FileTreeReader({"path": "/", "where": '[["name", "like", "x"]]'})


def test_bodies_are_read_where_asked(spark, tmp_path):
    grow(tmp_path, 12)
    (tmp_path / "chats/chat_001/empty.html").write_bytes(b"")
    files = engine.inventory(spark, str(tmp_path))
    assert "content" not in files.columns
    got = {r.file: (r.text, r.depth) for r in filetree.bodies(engine.html(files), "depth").collect()}
    assert len(got) == 13 and got[str(tmp_path / "chats/chat_005/messages.html")][0] == "<title>5</title>"  # bytes that are no UTF-8 go
    heads = {r.text for r in filetree.bodies(engine.html(files), most=4).collect()}
    assert heads == {"<tit", ""}
    (tmp_path / "chats/chat_002/messages.html").unlink()
    assert filetree.bodies(engine.html(files)).count() == 12
    assert filetree.bodies(files.limit(0)).count() == 0


def test_existing_paths(spark, tmp_path):
    grow(tmp_path, 2)
    paths = [str(tmp_path / p) for p in ("chats", "link/chat_001", "broken", "gone", "chats/chat_000/messages.html")] * 3 + [None]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert sorted(r.path for r in filetree.existing(df, F.col("p")).collect()) == sorted(paths[k] for k in (0, 1, 4))


def messages(path, n=250):
    con = sqlite3.connect(path)
    con.execute('create table "messages"(id integer primary key, source_type, "odd ""name", time)')
    con.executemany("insert into messages values (?, ?, ?, ?)", [(k, None if k % 5 == 0 else "dialog" if k % 2 else "group", k if k % 3 else f"é{k}", 1_500_000_000 + k) for k in range(n)])
    con.execute("create table pairs(a text primary key, b) without rowid")
    con.execute("insert into pairs values ('x', 1), ('y', null)")
    con.commit()
    con.close()
    return [(str(k), None if k % 5 == 0 else "dialog" if k % 2 else "group", str(k) if k % 3 else f"é{k}", str(1_500_000_000 + k)) for k in range(n)]


def test_sqlite_partitions_follow_the_size(spark, tmp_path):
    path = str(tmp_path / "d.sqlite")
    want = messages(path)
    df = sqlite.read(spark, path, "messages", rows=100)
    assert df.rdd.getNumPartitions() == 3 and sqlite.read(spark, path, "messages").rdd.getNumPartitions() == 1
    assert sqlite.read(spark, path, "messages", partitions=7).rdd.getNumPartitions() == 7
    assert sorted(map(tuple, df.collect())) == sorted(want)
    assert sorted(map(tuple, sqlite.read(spark, path, "pairs", rows=1).collect())) == [("x", "1"), ("y", None)]  # no row ids
    assert sqlite.read(spark, path, "messages", "time", "id", "no such").columns == ["id", "time"]


def test_sqlite_tests_reach_the_database(spark, tmp_path):
    path = str(tmp_path / "d.sqlite")
    want = messages(path)
    odd = 'odd "name'
    for where, test in (
        ((("source_type", "not null"), ("id", "=", "7")), lambda r: r[1] is not None and r[0] == "7"),
        ((("source_type", "null"),), lambda r: r[1] is None),
        ((("source_type", "in", "group", "x"), (odd, "starts", "é")), lambda r: r[1] == "group" and r[2].startswith("é")),
        ((("time", ">=", "1500000200"), ("id", "<", "21")), lambda r: r[3] >= "1500000200" and r[0] < "21"),
        (((odd, ">", "é"),), lambda r: r[2].encode() > "é".encode()),
    ):
        assert sorted(map(tuple, sqlite.read(spark, path, "messages", where=where, rows=100).collect())) == sorted(r for r in want if test(r))
    df = sqlite.read(spark, path, "messages")  # one DataFrame, two uses in one query
    assert df.filter("source_type is not null").union(df).count() == 450
    reader = sqlite.SqliteReader({"path": path, "table": "messages", "where": '[["source_type", "not null"], ["id", "=", "7"], ["time", "in", "1", "2"], ["id", "starts", "1"]]'}, sqlite.Sqlite({"path": path, "table": "messages"}).schema())
    asked, args = reader.query(sqlite._Range(0, 10))
    assert asked.endswith('where rowid >= ? and rowid < ? and "source_type" is not null and cast("id" as text) = ? and cast("time" as text) in (?, ?) and substr(cast("id" as text), 1, ?) = ?')
    assert args == [0, 10, "7", "1", "2", 1, "1"]
    with pytest.raises(ValueError):
        sqlite.condition("id", "like", "x")


def test_sqlite_reports_ask_for_their_columns(spark, tmp_path):
    path = str(tmp_path / "d.sqlite")
    messages(path)
    plan = sqlite.read(spark, path, "messages", "source_type", "time", where=(("source_type", "not null"),))
    assert plan.columns == ["source_type", "time"] and plan.count() == 200


def test_many_databases_are_read_at_once(spark, tmp_path):
    paths, want = [], []
    for k in range(6):
        at = tmp_path / f"a?b#{k}%20" / "database.sqlite"  # marks of addresses
        at.parent.mkdir()
        paths.append(str(at))
        want += [(str(at), r[0], r[1], r[3], None) for r in messages(at, 40 * k)]
    con = sqlite3.connect(paths[5])
    con.execute("insert into messages values (9000000000000000000, 'far', 1, 2), (-9000000000000000000, 'far', 1, 2)")  # sparse ids, over the whole range
    con.execute("insert into messages values (7000, cast(x'ff41' as text), 1, null)")  # no UTF-8
    con.execute("alter table messages add column more")
    con.commit()
    con.close()
    want += [(paths[5], str(k), "far", "2", None) for k in (9 * 10**18, -9 * 10**18)] + [(paths[5], "7000", "�A", None, None)]
    (tmp_path / "text").write_text("no database")
    (tmp_path / "empty").write_text("")
    others = [str(tmp_path / x) for x in ("text", "empty", "gone")] + [None]
    df = spark.createDataFrame([(p,) for p in [*paths, *others, *paths]], "path string")
    found = sqlite.probe(df, rows=50)
    told = {(r.path, r.table): r for r in found.collect()}
    assert set(told) == {(p, t) for p in paths for t in ("messages", "pairs")}
    assert [len(told[p, "messages"].cuts) for p in paths[:5]] == [0, 0, 1, 2, 3] and told[paths[5], "messages"].cuts and not told[paths[0], "pairs"].cuts
    cols = F.array(*map(F.lit, ("id", "source_type", "time", "no such")))
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.path, *r["values"]) for r in sqlite.scan(found, "messages", cols).collect()), key=key) == sorted(want, key=key)
    # columns that differ by database, tests, and a test of a column that only one has
    own = F.when(F.array_contains("columns", "more"), F.array(F.lit("more"), F.lit("id"))).otherwise(F.array(F.lit("id")))
    got = sqlite.scan(found, "messages", own, (("source_type", "=", "far"),)).collect()
    assert sorted(r["values"] for r in got) == [[None, "-9000000000000000000"], [None, "9000000000000000000"]]
    assert {r.path for r in sqlite.scan(found, "messages", own, (("more", "null"), ("id", "=", "7"))).collect()} == set(paths[1:])
    assert sqlite.scan(found, "messages", own, (("more", "not null"),)).count() == 0
    assert sqlite.scan(found, "nowhere", own).count() == 0 and sqlite.probe(df.limit(0)).count() == 0
    pairs = sqlite.scan(found, "pairs", F.array(F.lit("b"), F.lit("A"))).filter(F.col("path") == paths[0]).collect()
    assert sorted((r["values"] for r in pairs), key=str) == [["1", "x"], [None, "y"]]
