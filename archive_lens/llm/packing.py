"""Best-two-fit packing of token sequences.

Bins are filled greedily (each time the longest piece that fits); then, while it narrows the gap, a bin's shortest piece
is replaced by the two unpacked pieces whose sum fits the gap that this opens most tightly. Pieces of one length are
interchangeable, so all of this runs on the histogram of lengths (at most `capacity` counters, whatever the input): a
bin's pattern of lengths is repeated for as long as the counters allow it, which is what packing bin by bin would do.
Each piece then finds its bin from its rank among the pieces of its length; ranks come from counts by length and shard,
so no length is gathered in one task.

Tokenizing: a text is cut where the tokenizer itself parts it (white space, letters, digits, symbols), and each distinct
segment is encoded once a worker process.

Defined results: null and empty texts are the end id alone. Each row is packed, repeated rows each by themselves; a null
doc_id stays null. Extra columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .kernels import _LOWER, _SPACE, C1, C2, C3, U, Words, buffers, mix, steps

CAPACITY = 4096
END = 1
#: Segments that a worker process keeps encoded.
KNOWN = 500_000
#: Segments encoded in one call: bounds what the encoder returns at once.
ENCODED = 8192
#: Letters, digits and symbols as the tokenizer parts them; bytes of Latin-1 letters count as letters.
_KINDS = np.full(256, 3, np.int8)
_KINDS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KINDS[48:58] = 2
SHARD_ROWS = 4_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


class Segments:
    """The stretches of text that are encoded alone: letters, single digits, runs of symbols of each word, lower-cased.

    The tokenizer parts words there itself. Words with an apostrophe, a `<|`, or characters beyond Latin-1 letters are
    segments as they stand.
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        w = Words(data, offs)
        n = len(data)
        kind = _KINDS[data]
        latin = np.zeros(n, bool)
        latin[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0xBF) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        pair = latin.copy()
        pair[:-1] |= latin[1:]
        odd = (data >= 128) & ~pair | (data == 39)
        odd[:-1] |= (data[:-1] == 60) & (data[1:] == 124)
        low = _LOWER[data]
        low[latin & (data < 0x9F)] += 32
        if not len(w):
            self.start = self.end = np.zeros(0, np.int64)
            self.hash, self.bounds, self.data = np.zeros(0, U), np.zeros(len(offs), np.int64), low
            return
        sums = np.concatenate([[0], np.cumsum(odd)])
        whole = sums[w.end] > sums[w.start]  # words that are one segment
        lens = w.end - w.start
        inside = np.flatnonzero(~_SPACE[data])
        own = np.repeat(whole, lens)
        low[inside[own]] = data[inside[own]]
        cut = np.ones(len(inside), bool)
        k = kind[inside]
        cut[1:] = (k[1:] != k[:-1]) | (k[1:] == 2)
        cut &= ~own
        cut[np.cumsum(lens) - lens] = True
        head = np.flatnonzero(cut)
        self.start = inside[head]
        size = np.diff(np.append(head, len(inside)))
        self.end = self.start + size
        x = low[inside].astype(U) | (np.arange(len(inside)) - np.repeat(head, size)).astype(U) << U(8)
        x = (x + U(1)) * C1
        x ^= x >> U(32)
        x *= C2
        x ^= x >> U(29)
        self.hash = mix(np.add.reduceat(x, head) + size.astype(U) * C3 + own[head].astype(U))
        self.bounds = np.searchsorted(self.start, offs)
        self.data = low

    def text(self, which: np.ndarray) -> list[str]:
        raw = self.data.tobytes()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(self.start[which].tolist(), self.end[which].tolist(), strict=True)]


class SegmentIds:
    """ids of segments, each distinct one encoded once a worker process (until KNOWN of them are held)."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.clear()

    def clear(self) -> None:
        self.tables = [(np.zeros(0, U), np.zeros(0, np.int64)) for _ in range(2)]  # sorted hashes and slots: settled, recent
        self.ids, self.at, self.slots = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), 0

    def _add(self, hashes: np.ndarray, ids: list[list[int]]) -> None:
        lens = np.array([len(g) for g in ids], np.int64)
        used, more = int(self.at[self.slots]), int(lens.sum())
        while used + more > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.slots + len(ids) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.ids[used : used + more] = [i for g in ids for i in g]
        self.at[self.slots + 1 : self.slots + len(ids) + 1] = used + np.cumsum(lens)
        slots = np.arange(self.slots, self.slots + len(ids))
        self.slots += len(ids)
        merge = lambda x, h, s: (lambda h, s, o: (h[o], s[o]))(h := np.concatenate([x[0], h]), np.concatenate([x[1], s]), np.argsort(h))
        self.tables[1] = merge(self.tables[1], hashes, slots)
        if len(self.tables[1][0]) > 1 << 16:
            self.tables = [merge(self.tables[0], *self.tables[1]), (np.zeros(0, U), np.zeros(0, np.int64))]

    def _find(self, h: np.ndarray) -> np.ndarray:
        slot = np.full(len(h), -1, np.int64)
        for held, slots in self.tables:
            if len(held):
                at = np.minimum(np.searchsorted(held, h), len(held) - 1)
                ok = held[at] == h
                slot[ok] = slots[at[ok]]
        return slot

    def encode(self, w: Segments) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all segments, number of ids of each)."""
        if not len(w.hash):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self.slots > KNOWN:
            self.clear()
        h, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        slot = self._find(h)
        if len(new := np.flatnonzero(slot < 0)):
            for a in range(0, len(new), ENCODED):
                part = new[a : a + ENCODED]
                self._add(h[part], [e.ids for e in self.tokenizer.encode_batch_fast(w.text(first[part]), add_special_tokens=False)])
            slot = self._find(h)
        slot = slot[inverse.reshape(-1)]
        count = self.at[slot + 1] - self.at[slot]
        total = np.cumsum(count)
        where = np.repeat(self.at[slot] - (total - count), count) + np.arange(total[-1])
        return self.ids[where], count


_HELD: dict[str, SegmentIds] = {}


def _held(path: str) -> SegmentIds:
    """This worker process's encoder for a tokenizer file."""
    if path not in _HELD:
        from tokenizers import Tokenizer

        _HELD[path] = SegmentIds(Tokenizer.from_file(path))
    return _HELD[path]


def _pieces(path: str, capacity: int, end: int, keep_ids: bool):
    def run(batches):
        held = _held(path)
        for batch in batches:
            data, offs = buffers(batch.column("text"))
            names = batch.column("doc_id")
            for lo, hi, d, o in steps(data, offs):
                w = Segments(d, o)
                ids, count = held.encode(w)
                bound = np.concatenate([[0], np.cumsum(count)])[w.bounds]
                row, piece, start, length, crc, raw = [], [], [], [], [], []
                for i in range(hi - lo):
                    own = np.append(ids[bound[i] : bound[i + 1]], np.uint32(end)).astype("<u4")
                    for k, a in enumerate(range(0, len(own), capacity)):
                        b = own[a : a + capacity].tobytes()
                        row.append(lo + i)
                        piece.append(k)
                        start.append(a)
                        length.append(len(b) // 4)
                        crc.append(zlib.crc32(b))
                        raw.append(b if keep_ids else None)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(raw, pa.binary())], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return run


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Bins for counts[length] pieces: (pieces of each length in a bin, bins like it)."""
    c = counts.astype(np.int64).copy()
    sizes = np.arange(capacity + 1)

    def fits() -> np.ndarray:
        return np.maximum.accumulate(np.where(c > 0, sizes, 0))

    out, below = [], fits()
    while below[capacity]:
        own: dict[int, int] = {}

        def take(x: int, n: int = 1, own=own) -> None:
            nonlocal below
            before = c[x] > 0
            c[x] -= n
            own[x] = own.get(x, 0) + n
            if not own[x]:
                del own[x]
            if before != (c[x] > 0):
                below = fits()

        gap = capacity
        while x := int(below[gap]):
            take(x)
            gap -= x
        while gap and own:
            least = min(own)
            room = least + gap
            take(least, -1)
            a = np.flatnonzero(c[:room] > 0)
            b = below[room - a]
            alone = (b == a) & (c[a] < 2)
            b[alone] = below[np.maximum(a[alone] - 1, 0)]
            sums = np.where(b > 0, a + b, 0)
            k = int(np.argmax(sums)) if len(a) else 0
            if not len(a) or sums[k] <= least:
                take(least)
                break
            x, y = int(a[k]), int(b[k])
            take(x)
            take(y)
            gap = room - x - y
        more = min(int(c[x]) // n for x, n in own.items())
        for x, n in own.items():
            c[x] -= n * more
        if more:
            below = fits()
        out.append((own, more + 1))
    return out


class Slots:
    """Where the r-th piece of a length goes."""

    def __init__(self, bins: list[tuple[dict[int, int], int]], capacity: int):
        rows, used, seq = [], np.zeros(capacity + 1, np.int64), 0
        for own, n in bins:
            at = 0
            for x in sorted(own, reverse=True):
                rows.append((x, used[x], own[x], seq, at))
                used[x] += own[x] * n
                at += x * own[x]
            seq += n
        rows.sort()
        self.key = np.array([(r[0] << 48) + r[1] for r in rows], np.int64)
        self.first, self.each, self.seq, self.at = (np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3, 4))

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.key, (length << 48) + rank, "right") - 1
        r = rank - self.first[i]
        return self.seq[i] + r // self.each[i], self.at[i] + r % self.each[i] * length


def _place(slots):
    def run(batches):
        for b in batches:
            seq, at = slots.value.find(b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(seq), pa.array(at), b.column("ids")], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids (null unless keep_ids)."""
    spark = docs.sparkSession
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_pieces(tokenizer, capacity, end, keep_ids), PIECES)
    pieces = materialize(cut, "pieces")
    histogram = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    counts = np.zeros(capacity + 1, np.int64)
    for r in histogram:
        counts[r["length"]] = r["count"]
    slots = spark.sparkContext.broadcast(Slots(plan(counts, capacity), capacity))
    shards = int(counts.sum() // SHARD_ROWS) + 1
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)))
    before = pieces.groupBy("length", "shard").count().withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "start")) - 1)
    ranked = ranked.join(before.select("length", "shard", "before"), ["length", "shard"]).withColumn("rank", F.col("rank") + F.coalesce("before", F.lit(0)))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank", "ids").mapInArrow(_place(slots), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, ids binary")
