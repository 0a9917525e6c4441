"""JSON exports read in pieces against whole reads."""

import io
import json
import random

import pytest
from pyspark.sql import functions as F

from archive_lens import engine
from archive_lens.operators import reports as P
from archive_lens.sources import json_pieces as J

HARD = ['a"b\\', "{[,]}", "é\\\\", "x\ny", "", '"messages": [', '\\"', "日本", '","id":7,"']


def made(rng, f):
    def message(k):
        m = {"id": k, "text": [rng.choice(HARD), {"type": "link", "text": rng.choice(HARD), "messages": [{"id": "inner", "date": "2001-01-01T00:00:00"}]}], "date": "2018-10-%02dT21:32:23" % rng.randrange(1, 29)}
        if rng.random() < 0.7:
            m["date_unixtime"] = rng.choice([str(1539113543 + k), 1539113543 - k])
        return m

    some = lambda n: [message(k) if rng.random() < 0.9 else None for k in range(n)]
    chats = [rng.choice([{"name": rng.choice(HARD), "type": "t", "id": k, "messages": some(rng.randrange(5))}, {"messages": some(2), "title": "T" + rng.choice(HARD), "id": f"s{k}"}, None, {"id": k}]) for k in range(4)]
    return rng.choice([
        {"name": rng.choice(HARD), "type": "personal_chat", "id": f, "messages": some(rng.randrange(6))},
        {"about": rng.choice(HARD), "chats": {"about": "x", "list": chats}, "left_chats": {"list": [{"messages": some(2)}]}},
        {"contacts": {"list": [{"messages": [1]}]}, "messages": {"a": 1}},
        {}, {"chats": {"list": []}}, {"messages": []}, {"kéy\n": 1, "chats": {"list": [{"name": None, "id": 5, "messages": [{"id": 1}]}]}, "messages": [{"id": 9, "date": "2020-01-01T00:00:00"}]},
    ])


def told(df):
    return sorted(((r.path, r.kind, tuple(r["keys"] or []), r.name if r.pos is not None else None, r.id, r.n, r["first"], r["last"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_any_cut_gives_what_a_whole_read_gives(spark, seed):
    rng = random.Random(seed)
    texts = {f"/f{f}": json.dumps(made(rng, f), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]), separators=rng.choice([None, (",", ":")])) for f in range(40)}
    want = P.json_chat_ranges(P.json_chats(spark.createDataFrame(list(texts.items()), "path string, text string")))
    pieces = []
    for path, text in texts.items():
        data, at = text.encode(), 0
        while at < len(data):
            n = rng.choice([1, 2, 3, 7, 40, 200])
            pieces.append((path, at, data[at : at + n]))
            at += n
    rng.shuffle(pieces)
    items = J.items(spark.createDataFrame(pieces, "path string, start long, data binary"))
    got = P.json_item_ranges(spark.createDataFrame([(p,) for p in texts], "path string"), items)
    assert told(got) == told(want)


def test_broken_and_empty_files(spark):
    texts = {"/cut": '{"name":"A","messages":[{"id":1,"date":"2020-01-01T00:00:00"},{"id":2,"da', "/empty": "", "/list": "[1,2]", "/junk": "}}]{{[[,,", "/null": "null", "/bad": '{"messages":[{"id":1},{bad},{"id":3}]}'}
    pieces = [(p, k, t.encode()[k : k + 5]) for p, t in texts.items() for k in range(0, max(len(t), 1), 5)]
    items = J.items(spark.createDataFrame(pieces, "path string, start long, data binary"))
    rows = {r.path: r for r in P.json_item_ranges(spark.createDataFrame([(p,) for p in texts], "path string"), items).collect()}
    assert (rows["/cut"].kind, rows["/cut"].name, rows["/cut"].n) == ("single_chat_export", "A", 2)
    assert {rows[p].kind for p in ("/empty", "/list", "/junk", "/null")} == {"unknown"}
    assert rows["/bad"].n == 3


def test_a_file_is_read_by_many_tasks(spark, tmp_path):
    chats = [{"name": f"chat {c}", "id": c, "messages": [{"id": k, "date_unixtime": str(1_500_000_000 + 1000 * c + k), "text": "é{" * (k % 300)} for k in range(3000 if c == 1 else 40)]} for c in range(60)]
    path = tmp_path / "x" / "result.json"
    path.parent.mkdir()
    path.write_text(json.dumps({"chats": {"list": chats}}, ensure_ascii=False, separators=(",", ":")))
    files = engine.inventory(spark, str(tmp_path)).filter("name = 'result.json'")
    pieces = J.cut(files, 50_000)
    assert pieces.count() == -(-path.stat().st_size // 50_000) > 20
    used = pieces.select(F.spark_partition_id().alias("p"), "size").groupBy("p").agg(F.sum("size").alias("n")).collect()
    assert len(used) > 1
    got = {r.name: (r.n, r["first"].timestamp()) for r in P.json_item_ranges(files, J.items(pieces)).collect()}
    assert got == {c["name"]: (len(c["messages"]), 1_500_000_000 + 1000 * c["id"]) for c in chats}
    report = engine.discover(spark, str(tmp_path)).first()
    assert (report["chats_backed_up"], report["messages_backed_up"]) == (60, sum(len(c["messages"]) for c in chats))


def test_quotes_after_runs_of_backslashes():
    rng = random.Random(1)
    for _ in range(300):
        data = bytes(rng.choice(b'\\\\"ab') for _ in range(rng.randrange(12)))
        for escaped in (False, True):
            off, want = escaped, []
            for k, c in enumerate(data):
                if c == 34 and not off:
                    want.append(k)
                off = c == 92 and not off
            got, after = J.real_quotes(data, escaped)
            assert (got.tolist(), after) == (want, off)


def test_elements_that_are_no_objects_are_no_messages(spark):
    text = '{"chats": {"list": [1, "x", [{"id": 9, "messages": [{"id": 9}]}], null, {"id": 4, "messages": [1, "}", [{"id": 3}], null, {"id": 1, "x": [{}]}, true]}]}}'
    for n in (1, 7, 1000):
        pieces = [("/f", k, text.encode()[k : k + n]) for k in range(0, len(text), n)]
        rows = P.json_item_ranges(spark.createDataFrame([("/f",)], "path string"), J.items(spark.createDataFrame(pieces, "path string, start long, data binary"))).collect()
        assert [(r.id, r.n) for r in rows] == [("4", 1)]


def test_a_beginning_is_enough_for_the_keys(spark, tmp_path):
    big = tmp_path / "result.json"
    with big.open("wb") as f:
        f.write(b'{"about": "' + b"x" * 100_000 + rb'", "k\u00e9y": {"a": [1, {"b": "},{"}]}, "messages": [')
        f.seek(3 << 30)  # three GB, of which the file system holds next to nothing
        f.write(b"]}")
    asked = []
    with big.open("rb") as f:
        assert J.first_keys(lambda n: asked.append(n) or f.read(n)) == ["about", "kéy", "messages"]
    assert sum(asked) < 1 << 20
    r = engine.sniff(spark, str(tmp_path)).first()
    assert (r["path"], r["kind"], r["keys"]) == (str(big), "single_chat_export", ["about", "kéy", "messages"])
    assert engine.discover(spark, str(tmp_path), inspect=False, sizes=False).first()["kind"] == "unknown"  # nothing is read without inspection
    endless = []
    assert J.first_keys(lambda n: endless.append(n) or b'"' * n) == [] and sum(endless) == J.HEAD
    rows = [("a", b""), ("b", None), ("c", b"[1]"), ("d", b"{}"), ("e", b'{"a":1,"chats":2'), ("f", b'\xff{"chats"')]
    got = {r.path: (r.kind, r["keys"]) for r in J.sniff(spark.createDataFrame(rows, "path string, data binary")).collect()}
    assert got["e"] == ("multi_chat_export", ["a", "chats"]) and all(got[k] == ("unknown", []) for k in "abcdf")


def test_keys_are_read_without_a_decoder_each(monkeypatch):
    made = []
    monkeypatch.setattr(J.json, "JSONDecoder", lambda *a, **k: made.append(k) or json.JSONDecoder(*a, **k))
    monkeypatch.setattr(J, "_load", lambda data: made.append(data))
    for text, want in (('{"a\\u00e9": ", [", "b": [{"c": 1}], "chats": 2, "d": 3}', ["aé", "b", "chats"]), ('{"a": 1, "a": 2, "x\\"y": {}, "messages": []', ["a", 'x"y', "messages"]), ("", []), ("{", []), ('{"\t": 1, "z": 2}', ["z"])):
        assert J.first_keys(io.BytesIO(text.encode()).read) == want
    assert not made
