"""JSON exports of any size, read in pieces: a tokenizer whose state can be taken up at any byte.

A file is cut into pieces by bytes alone, wherever the cuts fall. Three passes over the pieces, each in as many tasks as
there are pieces, with two folds over a short row a piece between them:

1. quotes: which quotes part strings depends on the backslashes before them and on nothing else, so a piece tells the
   parity of its quotes for both cases of its first byte (escaped or not); the fold gives each piece whether it begins
   inside a string;
2. brackets: with that, a piece tells how many containers it closes that it did not open, and which it opens and leaves
   open, with their keys; the fold gives each piece the containers that it begins in;
3. items: with that, a piece knows where messages, chats, and the members of the root and of chats begin and end.
   Messages that lie in one piece are parsed there; parts of others are put together by the offset that they begin at.

A task holds one piece at a time; what is put together is one message. Nothing else of the text is held or shuffled,
and the files may be minified or not. A file that is cut off or broken gives the items up to there.
"""

from __future__ import annotations

import io
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

PIECE = 8 << 20
#: What sniff() reads at most, and at once; keys that are enough, one of them in TELLING.
HEAD, STEP, ENOUGH = 1 << 20, 1 << 16, 3
TELLING = {"chats": "multi_chat_export", "messages": "single_chat_export"}
#: Bytes kept of what stands between the last bracket or comma and the next: a key and, in a chat, its value.
KEY_BYTES = 1 << 16
MEMBERS = ("id", "name", "title")
KEY = re.compile(rb'\s*"((?:[^"\\]|\\.)*)"\s*:\s*', re.S)
#: Containers above a message of a multi-chat export, above one of a single chat, and above a chat's members.
MULTI, SINGLE, CHAT = 5, 2, 4

QUOTES = "path string, start long, parity0 boolean, next0 boolean, parity1 boolean, next1 boolean"
STRINGS = "path string, start long, escaped boolean, inside boolean"
OPENED = "array<struct<at:long,mark:string,key:string>>"
BRACKETS = f"path string, start long, closes int, opens {OPENED}, first_open boolean, lead binary, tail binary, last long"
STACKS = f"path string, start long, stack {OPENED}, since long, pending binary"
ITEMS = "path string, kind string, owner long, at long, key string, id string, date string, date_unixtime string, part long, data binary"


def cut(files: DataFrame, piece: int = PIECE) -> DataFrame:
    """(path, start, size) of the pieces of files (path, size): a row each, dealt evenly."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(piece).cast("long"))
    rows = files.select("path", F.explode(starts).alias("start"), F.col("size").alias("all"))
    return _spread(rows.select("path", "start", F.least(F.lit(piece).cast("long"), F.col("all") - F.col("start")).alias("size")))


def _spread(pieces: DataFrame) -> DataFrame:
    """Rows that stand for bytes of a file are dealt by a fixed number: by their own size they would all go to one task."""
    if "data" in pieces.columns:
        return pieces
    return pieces.repartition(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path", "start")


def _pieces(batches):
    """Rows with their bytes: those of the row, or of the file."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            if "data" in batch.schema.names:
                data = row.column("data")[0].as_py() or b""
            else:
                with open(row.column("path")[0].as_py(), "rb") as f:
                    f.seek(row.column("start")[0].as_py())
                    data = f.read(row.column("size")[0].as_py())
            yield {c: row.column(c)[0].as_py() for c in batch.schema.names if c not in ("data", "size")}, data


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _schema(**kinds) -> pa.Schema:
    return pa.schema(list(kinds.items()))


STACK = pa.list_(pa.struct([("at", pa.int64()), ("mark", pa.string()), ("key", pa.string())]))
A_QUOTES = _schema(path=pa.string(), start=pa.int64(), parity0=pa.bool_(), next0=pa.bool_(), parity1=pa.bool_(), next1=pa.bool_())
A_STRINGS = _schema(path=pa.string(), start=pa.int64(), escaped=pa.bool_(), inside=pa.bool_())
A_BRACKETS = _schema(path=pa.string(), start=pa.int64(), closes=pa.int32(), opens=STACK, first_open=pa.bool_(), lead=pa.binary(), tail=pa.binary(), last=pa.int64())
A_STACKS = _schema(path=pa.string(), start=pa.int64(), stack=STACK, since=pa.int64(), pending=pa.binary())
A_ITEMS = _schema(path=pa.string(), kind=pa.string(), owner=pa.int64(), at=pa.int64(), key=pa.string(), id=pa.string(), date=pa.string(), date_unixtime=pa.string(), part=pa.int64(), data=pa.binary())


def real_quotes(data: bytes, escaped: bool) -> tuple[np.ndarray, bool]:
    """(places of quotes that no backslash escapes, whether the byte after data is escaped)."""
    x = np.frombuffer(data, np.uint8)
    if not escaped and b"\\" not in data:
        return np.flatnonzero(x == 34), False
    slash = np.flatnonzero(x == 92)
    off = np.zeros(len(x) + 1, bool)  # bytes that are escaped
    off[0] = escaped
    if len(slash):
        first = np.concatenate([[True], np.diff(slash) > 1])
        head = slash[first][np.cumsum(first) - 1]
        # in a run of backslashes every other one escapes, from the first that is not escaped itself
        acts = (slash - head) % 2 == 0
        if escaped and slash[0] == 0:
            run = head == 0
            acts[run] = ~acts[run]
        off[slash[acts] + 1] = True
    quotes = np.flatnonzero(x == 34)
    return quotes[~off[quotes]], bool(off[len(x)])


def _quotes(batches):
    for row, data in _pieces(batches):
        (q0, n0), (q1, n1) = real_quotes(data, False), real_quotes(data, True)
        yield _table([(row["path"], row["start"], len(q0) % 2 == 1, n0, len(q1) % 2 == 1, n1)], A_QUOTES)


def _fold_quotes(batches):
    """Rows sorted by file and start."""
    path, escaped, inside = None, False, False
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["path"] != path:
                path, escaped, inside = r["path"], False, False
            out.append((path, r["start"], escaped, inside))
            k = "1" if escaped else "0"
            escaped, inside = r["next" + k], inside ^ r["parity" + k]
        if out:
            yield _table(out, A_STRINGS)


#: Which bytes are brackets and commas.
MARKS = np.isin(np.arange(256), np.frombuffer(b"{}[],", np.uint8))


def marks(data: bytes, escaped: bool, inside: bool) -> np.ndarray:
    """Places of brackets and commas outside strings."""
    x = np.frombuffer(data, np.uint8)
    quotes, _ = real_quotes(data, escaped)
    found = np.flatnonzero(MARKS[x])
    return found[(np.searchsorted(quotes, found) % 2 == 1) == inside]


def key_before(data: bytes) -> str | None:
    """The key that stands before a value."""
    m = KEY.fullmatch(data)
    try:
        return json.loads(b'"' + m[1] + b'"') if m else None
    except ValueError:
        return None


def _steps(data: bytes, at: np.ndarray) -> np.ndarray:
    """+1 for each opening bracket, -1 for each closing one, 0 for commas."""
    x = np.frombuffer(data, np.uint8)[at]
    return np.where((x == 123) | (x == 91), 1, np.where(x == 44, 0, -1))


def _brackets(batches):
    for row, data in _pieces(batches):
        at = marks(data, row["escaped"], row["inside"])
        step = _steps(data, at)
        after = np.cumsum(step)
        least = np.minimum.accumulate(after[::-1])[::-1] if len(at) else after  # the least depth from here on
        stay = np.flatnonzero((step == 1) & (least >= after)) if len(at) else at
        opens = []
        for i in stay:
            before = data[(at[i - 1] + 1 if i else 0) : at[i]]
            opens.append({"at": row["start"] + int(at[i]), "mark": chr(data[at[i]]), "key": key_before(before[:KEY_BYTES])})
        lead, tail = (data[: at[0]], data[at[-1] + 1 :]) if len(at) else (data, data)
        yield _table([(row["path"], row["start"], int(max(0, -min(after.min(initial=0), 0))), opens, bool(len(stay) and stay[0] == 0), lead[:KEY_BYTES], tail[:KEY_BYTES], row["start"] + int(at[-1]) if len(at) else None)], A_BRACKETS)


def _fold_brackets(batches):
    """Rows sorted by file and start: the containers that each piece begins in, and the place after the last mark before it."""
    path, stack, pending, since = None, [], b"", 0
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["path"] != path:
                path, stack, pending, since = r["path"], [], b"", 0
            out.append((path, r["start"], list(stack), since, pending))
            if r["first_open"]:
                r["opens"][0]["key"] = key_before(pending + r["lead"])
            stack = stack[: max(0, len(stack) - r["closes"])] + r["opens"]
            if r["last"] is None:
                pending = (pending + r["tail"])[:KEY_BYTES]
            else:
                pending, since = r["tail"], r["last"] + 1
        if out:
            yield _table(out, A_STACKS)


def place(stack: list[tuple[str, str | None, int]]) -> tuple[str, int] | None:
    """What the members or elements of the innermost container are, and the chat (its offset, -1: none) that they belong to."""
    marks_, keys = "".join(m for m, _, _ in stack), [k for _, k, _ in stack]
    if marks_ == "{":
        return "root", -1
    if marks_ == "{[" and keys[1] == "messages":
        return "message", -1
    if marks_[:3] == "{{[" and keys[1:3] == ["chats", "list"]:
        if len(stack) == CHAT - 1:
            return "chat", -1
        if marks_ == "{{[{":
            return "member", stack[3][2]
        if marks_ == "{{[{[" and keys[4] == "messages":
            return "message", stack[3][2]
    return None


def _load(data: bytes):
    try:
        return json.loads(data.decode("utf-8", "replace"), parse_int=str, parse_float=str)
    except (ValueError, RecursionError):
        return None


def _text(v) -> str | None:
    return v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def message(path: str, owner: int, at: int, data: bytes) -> tuple:
    """The row of a whole message."""
    m = _load(data)
    m = m if isinstance(m, dict) else {}
    return path, "message", owner, at, None, *(_text(m.get(k)) for k in ("id", "date", "date_unixtime")), None, None


def member(path: str, kind: str, owner: int, at: int, text: bytes) -> tuple | None:
    """The row of a member of the root or of a chat, in id the value if it is one that is asked for; None if text is none."""
    m = KEY.match(text)
    if not m:
        return None
    key = _text(_load(b'"' + m[1] + b'"'))
    value = text[m.end() :].strip() if key in MEMBERS else b""
    return path, kind, owner, at, key, _text(_load(value)) if value else None, None, None, None, None


def _items(batches):
    for row, data in _pieces(batches):
        path, start = row["path"], row["start"]
        at = marks(data, row["escaped"], row["inside"])
        step = _steps(data, at)
        stack = [(x["mark"], x["key"], x["at"]) for x in row["stack"]]
        before = len(stack) + np.cumsum(step) - step
        # what is deeper than the deepest message has no part in the outline
        around = np.where(step == -1, before - 1, before)
        shown = np.flatnonzero(around <= MULTI)
        out: list[tuple] = []
        since = row["since"]
        inside = None  # the message that we are in: its owner, its offset, the containers around it
        for n in (SINGLE, MULTI):
            if inside is None and len(stack) > n and stack[n][0] == "{" and (here := place(stack[:n])) and here[0] == "message":
                inside = here[1], stack[n][2], n

        def part(end: int):
            """The message that ends (or is cut) here: whole, or its part in this piece."""
            owner, begin, _ = inside
            out.append((path, "message", owner, begin, None, None, None, None, start, data[max(begin - start, 0) : end - start]))

        for i in shown.tolist():
            a, mark = start + int(at[i]), chr(data[at[i]])
            del stack[max(0, before[i]) :]  # hidden containers are not taken off one by one
            if inside is None:
                here = place(stack)
                text = (row["pending"] + data[: a - start])[:KEY_BYTES] if since < start else data[since - start : a - start]
                if here and here[0] in ("root", "member") and (x := member(path, *here, since, text)):
                    out.append(x)
                if mark in "{[":
                    key = key_before(text) if stack and stack[-1][0] == "{" else None
                    if not stack and mark == "{":
                        out.append((path, "object", -1, a, *[None] * 6))
                    if here == ("root", -1) and mark == "[" and key == "messages":
                        out.append((path, "single", -1, a, *[None] * 6))
                    if [x[:2] for x in stack[1:]] == [("{", "chats")] and stack[0][0] == "{" and mark == "[" and key == "list":
                        out.append((path, "multi", -1, a, *[None] * 6))
                    if here == ("chat", -1) and mark == "{":
                        out.append((path, "chat", -1, a, *[None] * 6))
                    if here and here[0] == "message" and mark == "{":
                        inside = here[1], a, len(stack)
                    stack.append((mark, key, a))
                elif mark in "}]" and stack:
                    stack.pop()
            elif mark in "{[":
                stack.append((mark, None, a))
            elif mark in "}]" and stack:
                stack.pop()
                if len(stack) == inside[2]:
                    if inside[1] >= start:
                        out.append(message(path, *inside[:2], data[inside[1] - start : a + 1 - start]))
                    else:
                        part(a + 1)
                    inside = None
            since = a + 1
        if inside is not None:
            part(start + len(data))
        if out:
            yield _table(out, A_ITEMS)


def _join(batches):
    """Messages from their parts."""
    for batch in batches:
        rows = [message(r["path"], r["owner"], r["at"], b"".join(p["data"] or b"" for p in r["parts"])) for r in batch.to_pylist()]
        if rows:
            yield _table(rows, A_ITEMS)


def items(pieces: DataFrame) -> DataFrame:
    """What the outline of JSON exports holds, from pieces (path, start, size: read from the file; or path, start, data).

    kind object (the root is one), single and multi (what it is an export of), root (a member of it), chat, member (of a
    chat) and message; at: where it begins in the file; owner: where its chat begins, -1 for none; key and id: of members,
    name and value; id, date and date_unixtime: of messages. Pieces of a file must follow each other without gaps. A chat's
    id, name or title may take KEY_BYTES.
    """
    known = pieces.select(*[c for c in pieces.columns if c in ("path", "start", "size", "data")])
    dealt = lambda df: df.repartition("path").sortWithinPartitions("path", "start")
    strings = materialize(dealt(known.mapInArrow(_quotes, QUOTES)).mapInArrow(_fold_quotes, STRINGS), "json_strings")
    told = known.join(strings, ["path", "start"])
    stated = _spread(told)
    stacks = materialize(dealt(stated.mapInArrow(_brackets, BRACKETS)).mapInArrow(_fold_brackets, STACKS), "json_stacks")
    found = materialize(_spread(told.join(stacks, ["path", "start"])).mapInArrow(_items, ITEMS), "json_items")
    parts = found.filter("data is not null").groupBy("path", "owner", "at").agg(F.array_sort(F.collect_list(F.struct("part", "data"))).alias("parts"))
    return found.filter("data is null").unionByName(parts.mapInArrow(_join, ITEMS)).drop("part", "data")


def _string(data: bytes) -> str | None:
    """What stands between a string's quotes; read without settings of its own, as a decoder is made for each that has some."""
    try:
        return json.loads(f'"{data.decode("utf-8", "replace")}"')
    except ValueError:
        return None


def first_keys(read) -> list[str]:
    """Keys of the root in order, from read(n) for the next n bytes: no more than HEAD bytes, and none after enough is known."""
    data = b""
    while len(data) < HEAD and (more := read(STEP)):
        data += more
        at = marks(data, False, False)
        depth = np.cumsum(_steps(data, at))
        # a member of the root begins behind a bracket or comma that leaves one container open
        ends = np.flatnonzero(depth == 1)
        keys: list[str] = []
        for k in ends.tolist():
            m = KEY.match(data, int(at[k]) + 1)
            key = _string(m[1]) if m else None
            if key is not None and key not in keys:
                keys.append(key)
            if len(keys) >= ENOUGH and TELLING.keys() & set(keys):
                return keys
    return keys if data else []


def _sniff(batches):
    schema = _schema(path=pa.string(), kind=pa.string(), keys=pa.list_(pa.string()))
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if "data" in row:
                keys = first_keys(io.BytesIO(row["data"] or b"").read)
            else:
                try:
                    with open(row["path"], "rb") as f:
                        keys = first_keys(f.read)
                except OSError:
                    continue
            out.append((row["path"], next((v for k, v in TELLING.items() if k in keys), "unknown"), sorted(keys)))
        if out:
            yield _table(out, schema)


def sniff(files: DataFrame) -> DataFrame:
    """(path, kind, keys) of JSON exports (path; or path, data) from their beginnings: what items() would tell of the root, as far as HEAD bytes go.

    kind goes by the keys alone; a `messages` that is no list is taken for one.
    """
    known = files.select(*[c for c in files.columns if c in ("path", "data")])
    return _spread(known.withColumn("start", F.lit(0))).drop("start").mapInArrow(_sniff, "path string, kind string, keys array<string>")
