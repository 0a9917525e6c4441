"""Line dedup: a sharded minimal perfect hash over distinct line hashes, probed by the documents.

A line's key is the line without white space at its ends and with A-Z lower-cased; keys of MIN_CHARS code points or more
are known by a 128-bit hash. Rounds of Spark:

1. every document is named for a chunk (by a hash of doc_id and text), and each task lists the distinct keys of its chunks
   with their least and greatest doc_id: however often a line occurs, a task has it once a chunk;
2. grouped by key that gives all distinct keys. They are dealt to shards, and each shard becomes one row of arrays: the
   levels of a minimal perfect hash, and by its index a fingerprint, a count of documents (255: that many or more) and,
   for counts over one, the least doc_id;
3. the chunks' keys go to the shards and probe the arrays; what is held by two documents or more comes back to the chunk
   with its least doc_id. No line meets another line: requests are 16-byte hashes, answers are only those of repeats;
4. the texts are dealt to their chunks, once, behind the answers, and streamed through.

A shard holds SHARD_KEYS keys and a chunk CHUNK_BYTES of text on average, at every size of input; a task holds one shard
or one chunk's answers at a time.

Defined results: a null or empty text is one empty line. A null doc_id comes before all others and is one document; rows
that share a doc_id are one document (a line is repeated only if another doc_id has it too), each of them has a row of its
own. A key that the smallest doc_id holds several times stays there every time. A table without rows has no result rows.
Other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..session import materialize
from .common import LEAST, partitions, spare
from .kernels import U, mix

MIN_CHARS = 10
SHARD_KEYS = 1 << 17
CHUNK_BYTES = 1 << 24
#: Keys that a task lists before it sends them on.
HELD = 200_000
#: Slots of a level for each key that is left.
SLOTS = 2.0
SPACE = b" \t\n\x0b\x0c\r"
_LATER = bytes(range(0x80, 0xC0))
KEYS = "chunk long, a long, b long, lo long, hi long, n long"
INDEX = "shard long, levels array<binary>, fingerprints binary, counts binary, owners binary"


def key_of(line: bytes, least: int = MIN_CHARS) -> bytes | None:
    """The key that a line is known by; None if it has less than least code points."""
    key = line.strip(SPACE).lower()  # bytes: A-Z alone
    if len(key) < least or (len(key) < 4 * least and len(key.translate(None, _LATER)) < least):
        return None
    return key


def hash_of(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_digest(key)
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


class PerfectHash:
    """A minimal perfect hash of distinct 128-bit keys: in each level, keys that have a slot to themselves are placed.

    A key's index is the number of taken slots before its own. With the fingerprints it tells members from others: a key
    that is no member is taken for one with a chance of 2^-32.
    """

    def __init__(self, levels: list[np.ndarray], fingerprints: np.ndarray):
        self.levels, self.fingerprints = levels, fingerprints
        self.words = [x.view(U) for x in levels]
        before, self.rank = 0, []
        for x in self.words:
            ones = np.bitwise_count(x).astype(np.int64)
            self.rank.append(before + np.cumsum(ones) - ones)
            before += int(ones.sum())

    @staticmethod
    def slot(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(a ^ mix(b + U(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))) % U(size)).astype(np.int64)

    @staticmethod
    def fingerprint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (mix(b ^ mix(a)) >> U(32)).astype(np.uint32)

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        levels, x, y = [], a, b
        while len(x):
            size = -(-max(64, int(SLOTS * len(x))) // 64) * 64
            at = cls.slot(x, y, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            left = ~alone[at]
            x, y = x[left], y[left]
        out = cls(levels, np.zeros(0, np.uint32))
        prints = np.empty(len(a), np.uint32)
        prints[out.places(a, b)] = cls.fingerprint(a, b)
        out.fingerprints = prints
        return out

    def places(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The index of each key; -1 where no level has its slot taken."""
        out, left = np.full(len(a), -1), np.arange(len(a))
        for k, (words, rank) in enumerate(zip(self.words, self.rank, strict=True)):
            at = self.slot(a[left], b[left], k, 64 * len(words))
            word, bit = at >> 6, (at & 63).astype(U)
            hit = (words[word] >> bit) & U(1) == 1
            below = words[word] & ((U(1) << bit) - U(1))
            out[left[hit]] = rank[word[hit]] + np.bitwise_count(below[hit])
            left = left[~hit]
            if not len(left):
                break
        return out

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The index of each key that is a member, -1 for others."""
        at = self.places(a, b)
        if len(self.fingerprints):
            at[(at >= 0) & (self.fingerprints[at] != self.fingerprint(a, b))] = -1
        return at


def _unsigned(col) -> np.ndarray:
    return col.to_numpy().view(U)


def _keys(least: int):
    """Distinct keys of each chunk in the task's rows, with the least and greatest doc_id and the number of rows."""

    def table(held):
        cols = list(zip(*((c, *k, *v) for (c, k), v in held.items()), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["chunk", "a", "b", "lo", "hi", "n"])

    def run(batches):
        held = {}
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for c, d, t in zip(batch.column("chunk").to_pylist(), batch.column("doc_id").to_pylist(), texts, strict=True):
                for k in {k for k in (key_of(x, least) for x in (t.as_py() or b"").split(b"\n")) if k is not None}:
                    at = c, hash_of(k)
                    lo, hi, n = held.get(at, (d, d, 0))
                    held[at] = min(lo, d), max(hi, d), n + 1
                if len(held) > HELD:
                    yield table(held)
                    held = {}
        if held:
            yield table(held)

    return run


def _build(batches):
    """Rows sorted by shard become one row of arrays a shard."""

    def shard(s, parts):
        a, b, lo, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        mph = PerfectHash.build(a, b)
        at = np.empty(len(a), np.int64)
        at[mph.places(a, b)] = np.arange(len(a))
        counts = np.minimum(n[at], 255).astype(np.uint8)
        owners = lo[at][counts > 1]
        cols = [pa.array([s], pa.int64()), pa.array([[x.tobytes() for x in mph.levels]], pa.list_(pa.binary()))]
        return pa.RecordBatch.from_arrays([*cols, *(pa.array([x.tobytes()], pa.binary()) for x in (mph.fingerprints, counts, owners))], ["shard", "levels", "fingerprints", "counts", "owners"])

    now, parts = None, []
    for batch in batches:
        s = batch.column("shard").to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]])) if len(s) else []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if s[i] != now:
                if parts:
                    yield shard(now, parts)
                now, parts = int(s[i]), []
            x = batch.slice(i, j - i)
            parts.append((_unsigned(x.column("a")), _unsigned(x.column("b")), x.column("lo").to_numpy(), x.column("n").to_numpy()))
    if parts:
        yield shard(now, parts)


class Arrays:
    """One shard's row of the index."""

    def __init__(self, row: dict):
        self.mph = PerfectHash([np.frombuffer(x, np.uint8) for x in row["levels"]], np.frombuffer(row["fingerprints"], np.uint32))
        self.counts = np.frombuffer(row["counts"], np.uint8)
        self.owner_at = np.cumsum(self.counts > 1) - 1
        self.owners = np.frombuffer(row["owners"], np.int64)

    def repeats(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which keys are held by two documents or more, their least doc_id)."""
        at = self.mph.find(a, b)
        which = np.flatnonzero((at >= 0) & (self.counts[at] > 1))
        return which, self.owners[self.owner_at[at[which]]]


def _probe(batches):
    """Rows sorted by shard, the arrays before the requests: the answers."""
    now, arrays = None, None
    for batch in batches:
        key = batch.column("shard").to_numpy() * 2 + batch.column("asks").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(i, j - i)
            if key[i] % 2 == 0:
                now, arrays = key[i] // 2, Arrays(part.slice(0, 1).to_pylist()[0])
            elif arrays is not None and now == key[i] // 2:
                which, owner = arrays.repeats(_unsigned(part.column("a")), _unsigned(part.column("b")))
                if len(which):
                    part = part.take(pa.array(which))
                    yield pa.RecordBatch.from_arrays([part.column("chunk"), part.column("a"), part.column("b"), pa.array(owner, pa.int64())], ["chunk", "a", "b", "owner"])


def _drop(names: list[str], p: str, least: int):
    """Rows sorted by chunk, the answers before the documents: documents with n_lines, n_dropped, kept."""

    def run(batches):
        now, owner = None, {}
        for batch in batches:
            chunk, is_doc = batch.column(p + "chunk").to_numpy(), batch.column(p + "is_doc").to_numpy(zero_copy_only=False)
            answers = batch.filter(pc.invert(batch.column(p + "is_doc"))).select([p + "a", p + "b", p + "owner"])
            a, b, own = (x.to_pylist() for x in answers.columns)
            docs = batch.filter(batch.column(p + "is_doc"))
            ids, texts = docs.column(p + "doc_id").to_pylist(), docs.column("text").cast(pa.binary())
            out, i, j = [], 0, 0
            for c, doc in zip(chunk.tolist(), is_doc.tolist(), strict=True):
                if c != now:
                    now, owner = c, {}
                if not doc:
                    owner[a[i], b[i]] = own[i]
                    i += 1
                    continue
                lines = (texts[j].as_py() or b"").split(b"\n")
                if owner:
                    keys = ((x, key_of(x, least)) for x in lines)
                    kept = [x for x, k in keys if k is None or owner.get(hash_of(k), ids[j]) == ids[j]]
                else:
                    kept = lines
                out.append((len(lines), len(lines) - len(kept), b"\n".join(kept)))
                j += 1
            if out:
                n, gone, kept = zip(*out, strict=True)
                new = [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*(docs.column(x) for x in names), *new], [*names, p + "n_lines", p + "n_dropped", p + "kept"])

    return run


def line_index(keys: DataFrame, shards: int) -> DataFrame:
    """One row of arrays a shard, of the distinct keys of (a, b, lo, hi, n)."""
    each = keys.groupBy("a", "b").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    one = F.when(F.col("lo") == F.col("hi"), F.lit(1).cast("long")).otherwise(F.greatest("n", F.lit(2).cast("long")))
    rows = each.select(F.pmod("a", F.lit(shards)).cast("long").alias("shard"), "a", "b", "lo", one.alias("n"))
    return rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(_build, INDEX)


def remove_repeats(docs: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """docs with n_lines, n_dropped and kept (the text without lines that a smaller doc_id holds), under names that spare() keeps free."""
    docs = docs.withColumn("text", F.col("text").cast("string"))
    spark, p = docs.sparkSession, spare(docs)
    doc_id, text = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)), F.col("text")
    size = docs.agg(F.sum(F.octet_length(text)).alias("bytes"), F.count("*").alias("rows")).first()
    tasks = 4 * partitions(spark)
    chunks = max((size["bytes"] or 0) // CHUNK_BYTES, min(tasks, size["rows"] // 16), 1)
    chunk = F.pmod(F.xxhash64(doc_id, text), F.lit(chunks)).cast("long")
    keys = materialize(docs.select(chunk.alias("chunk"), doc_id.alias("doc_id"), text.alias("text")).mapInArrow(_keys(least), KEYS), "line_keys")
    n = keys.count()
    shards = max(n // SHARD_KEYS, min(tasks, n // 64), 1)
    index = line_index(keys, shards)
    # a chunk asks for a key once, however many tasks and documents have it
    asks = keys.select("chunk", "a", "b").distinct().select(F.pmod("a", F.lit(shards)).cast("long").alias("shard"), F.lit(True).alias("asks"), "chunk", "a", "b")
    dealt = index.withColumn("asks", F.lit(False)).unionByName(asks, allowMissingColumns=True).repartition("shard").sortWithinPartitions("shard", "asks")
    answers = materialize(dealt.mapInArrow(_probe, "chunk long, a long, b long, owner long"), "line_answers")
    rows = docs.withColumn(p + "chunk", chunk).withColumn(p + "is_doc", F.lit(True)).withColumn(p + "doc_id", doc_id)
    back = answers.select(F.col("chunk").alias(p + "chunk"), F.lit(False).alias(p + "is_doc"), *[F.col(c).alias(p + c) for c in ("a", "b", "owner")])
    both = rows.unionByName(back, allowMissingColumns=True).repartition(p + "chunk").sortWithinPartitions(p + "chunk", p + "is_doc")
    new = [StructField(p + "n_lines", LongType()), StructField(p + "n_dropped", LongType()), StructField(p + "kept", StringType())]
    schema = StructType([*(StructField(f.name, f.dataType) for f in docs.schema.fields), *new])
    return both.mapInArrow(_drop(docs.columns, p, least), schema)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, n_lines, n_dropped, kept_sha256."""
    out, p = remove_repeats(docs), spare(docs)
    return out.select("doc_id", F.col(p + "n_lines").alias("n_lines"), F.col(p + "n_dropped").alias("n_dropped"), F.sha2(F.col(p + "kept"), 256).alias("kept_sha256"))
