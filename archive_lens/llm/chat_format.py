"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with offsets, and a token is under the loss mask if its span lies in an
assistant's text: the turns' spans are sorted, so each token finds its turn by binary search. The template is

    <|turn|>role<|text|>text<|end|>

per turn; its marks are added to the tokenizer as tokens of their own, so no token crosses a text's ends. Inside roles
and texts, a backslash is doubled and every control string (of this template and of common others) gets `\\-` after its first
character; reading back undoes both. No control string is left inside a text.

Rows are dealt by conversation and sorted by turn; a task holds one conversation at a time, whatever a conversation's
number of turns.

Defined results: rows of one conversation are ordered by turn, then role, then text (repeated rows are turns of their
own; a null turn comes first); null texts and roles are empty; null conv_ids are one conversation. An empty assistant
text has no tokens under the mask. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROL = [TURN, TEXT, END, "<|endoftext|>", "<|startoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_BACK = re.compile(r"\\([\\-])")
_TURNS = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.S)
#: Roles whose texts are learned.
LEARNED = ("assistant",)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\-" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _BACK.sub(lambda m: "\\" if m[1] == "\\" else "", text)


def render(turns: list[tuple[str, str]], learned: tuple[str, ...] = LEARNED) -> tuple[str, np.ndarray]:
    """(text, spans of the learned turns' texts)."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = TURN + escape(role) + TEXT, escape(text)
        if role in learned:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), np.array(spans, np.int64).reshape(-1, 2)


def mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens stand in a span; both are sorted."""
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), bool)
    i = np.searchsorted(spans[:, 0], offsets[:, 0], "right") - 1
    inside = (i >= 0) & (offsets[:, 1] > offsets[:, 0])
    return inside & (np.minimum(offsets[:, 1], spans[i, 1]) > np.maximum(offsets[:, 0], spans[i, 0]))


def masked_spans(offsets: np.ndarray, under: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of text that the tokens under the mask cover."""
    a, b = offsets[under].T
    if not len(a):
        return []
    b = np.maximum.accumulate(b)  # tokens of one character share its place
    first = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
    return list(zip(a[first].tolist(), b[np.append(first[1:], len(b)) - 1].tolist(), strict=True))


def read_back(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(r), unescape(t)) for r, t in _TURNS.findall(formatted)]


_HELD: dict = {}


def encoder(path: str):
    """This worker process's tokenizer, with the template's marks as tokens of their own."""
    if path not in _HELD:
        from tokenizers import AddedToken, Tokenizer

        t = Tokenizer.from_file(path)
        t.add_special_tokens([AddedToken(x, normalized=False) for x in (TURN, TEXT, END)])
        _HELD[path] = t
    return _HELD[path]


def format_one(turns: list[tuple[str, str]], tokenizer, learned: tuple[str, ...] = LEARNED) -> tuple[str, list[int], np.ndarray, np.ndarray]:
    """(text, ids, offsets, mask) of one conversation."""
    text, spans = render(turns, learned)
    e = tokenizer.encode(text, add_special_tokens=False)
    offsets = np.fromiter(chain.from_iterable(e.offsets), np.int64).reshape(-1, 2)
    return text, e.ids, offsets, mask(offsets, spans)


SCHEMA = "conv_id long, formatted string, ids array<int>, starts array<int>, ends array<int>, loss_mask array<boolean>"


def _format(path: str, learned: tuple[str, ...]):
    def run(batches):
        tokenizer = encoder(path)
        conv, turns, begun, out = None, [], False, []

        def done():
            text, ids, offsets, under = format_one(turns, tokenizer, learned)
            return conv, text, np.array(ids, np.int32), offsets[:, 0], offsets[:, 1], under

        def table(rows):
            cols = list(zip(*rows, strict=True))
            at = pa.array(np.cumsum([0, *map(len, cols[2])]), pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(c), k)) for c, k in zip(cols[2:], (pa.int32(), pa.int32(), pa.int32(), pa.bool_()), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), *lists], ["conv_id", "formatted", "ids", "starts", "ends", "loss_mask"])

        size = 0
        for b in batches:
            for c, r, t in zip(*(b.column(x).to_pylist() for x in ("conv_id", "role", "text")), strict=True):
                if not begun or c != conv:
                    if begun:
                        out.append(done())
                        size += len(out[-1][1])
                        if size > 1 << 20:
                            yield table(out)
                            out, size = [], 0
                    conv, turns, begun = c, [], True
                turns.append((r or "", t or ""))
        if begun:
            out.append(done())
        if out:
            yield table(out)

    return run


def format_chats(chats: DataFrame, tokenizer: str, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """A row per conversation: conv_id, formatted text, token ids, their offsets, and the loss mask."""
    rows = chats.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(_format(tokenizer, learned), SCHEMA)


def _digest(batches):
    for b in batches:
        rows = []
        at = b.column("starts").offsets.to_numpy()
        at = at - at[0]
        starts, ends, masks = (b.column(x).flatten().to_numpy(zero_copy_only=False) for x in ("starts", "ends", "loss_mask"))
        for i, (c, text) in enumerate(zip(b.column("conv_id").to_pylist(), b.column("formatted").to_pylist(), strict=True)):
            turns, own = read_back(text), slice(at[i], at[i + 1])
            loss = "".join(unescape(text[a:z]) for a, z in masked_spans(np.stack([starts[own], ends[own]], axis=1), masks[own].astype(bool)))
            told = "".join(f"{r}\n{t}\n" for r, t in turns)
            rows.append((c, len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        if rows:
            cols = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digest(formatted: DataFrame) -> DataFrame:
    """The contract's columns, from the formatted texts, offsets and masks alone."""
    return formatted.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
