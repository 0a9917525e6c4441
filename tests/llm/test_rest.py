import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from archive_lens.llm import chat_format, decontamination, neighbours, packing
from archive_lens.llm import queries as Q
from archive_lens.llm.kernels import buffers

from .helpers import LOWER, SF

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


# Packing.


def check_packing(rows, docs, tokenizer):
    want = {}
    for d, t in docs:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k, a in enumerate(range(0, len(ids), 4096)):
            want[d, k] = (a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 4096
    return len(seqs), sum(x[1] for x in want.values())


def test_packing_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    bins, tokens = check_packing(Q.op10_packing(spark, SF).collect(), docs, Tokenizer.from_file(WORD_BPE))
    assert bins <= -(-tokens // 4096) + 1


def test_packing_edges(spark):
    docs = [(1, None), (2, ""), (3, "It's 'sand <|endoftext|> ÀÉ×÷ Straße 日本 é a1b22  x"), (4, "ab " * 9000), (None, "q"), (6, "q")]
    df = spark.createDataFrame([(*d, 0, "y") for d in docs], "doc_id long, text string, rank int, shard string")
    rows = packing.pack(df, WORD_BPE, keep_ids=True).collect()
    check_packing(rows, docs, Tokenizer.from_file(WORD_BPE))
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    assert packing.pack(df.limit(0), WORD_BPE).collect() == []
    twice = packing.pack(df.union(df), WORD_BPE).collect()
    assert len(twice) == 2 * len(rows) and len({(r.sequence_id, r.offset) for r in twice}) == len(twice)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_plan_packs_every_piece_once(lengths):
    counts = np.bincount(lengths, minlength=51) if lengths else np.zeros(51, np.int64)
    bins = packing.plan(counts, 50)
    used = np.zeros(51, np.int64)
    for own, n in bins:
        assert sum(x * m for x, m in own.items()) <= 50
        for x, m in own.items():
            used[x] += m * n
    assert used.tolist() == counts.tolist()
    assert sum(n for _, n in bins) <= max(1, 1.5 * sum(lengths) / 50 + 1)


def test_two_pieces_replace_the_smallest():
    # greedy fills 6 + 3 and leaves 1; 3 is replaced by 2 + 2
    counts = np.bincount([6, 3, 2, 2], minlength=11)
    assert packing.plan(counts, 10)[0] == ({6: 1, 2: 2}, 1)


def bin_by_bin(lengths, capacity):
    """Best-two-fit on the pieces themselves."""
    held, out = sorted(lengths), []
    while held:
        own, gap = [], capacity
        while fit := [x for x in held if x <= gap]:
            own.append(fit[-1])
            held.remove(fit[-1])
            gap -= fit[-1]
        while gap:
            least = min(own)
            own.remove(least)
            held = sorted([*held, least])
            pairs = [(a + b, -a, b) for i, a in enumerate(held) for b in [max((x for x in held[:i] + held[i + 1 :] if x <= least + gap - a), default=0)] if b]
            if not pairs or max(pairs)[0] <= least:
                own.append(least)
                held.remove(least)
                break
            total, a, b = max(pairs)
            for x in (-a, b):
                own.append(x)
                held.remove(x)
            gap += least - total
        out.append(sorted(own))
    return sorted(out)


@pytest.mark.parametrize("capacity", [10, 20, 50])
def test_plan_equals_packing_bin_by_bin(capacity):
    r = random.Random(capacity)
    for _ in range(60):
        lengths = [r.randint(1, capacity) for _ in range(r.randint(0, 50))]
        bins = packing.plan(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)
        assert sorted(sorted(x for x, m in own.items() for _ in range(m)) for own, n in bins for _ in range(n)) == bin_by_bin(lengths, capacity)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=("Cs",)), max_size=30), max_size=4))
def test_segments_encode_as_the_tokenizer(xs):
    t = Tokenizer.from_file(WORD_BPE) if "t" not in _T else _T["t"]
    _T["t"] = t
    s = packing.Segments(*buffers(pa.array(xs, pa.string())))
    ids, count = packing.SegmentIds(t).encode(s)
    bound = np.concatenate([[0], np.cumsum(count)])[s.bounds]
    for i, x in enumerate(xs):
        assert ids[bound[i] : bound[i + 1]].tolist() == t.encode(x, add_special_tokens=False).ids


_T: dict = {}


# Chats.


@given(st.lists(st.one_of(st.sampled_from([*chat_format.CONTROL, "\\", "-", "n", "<", "[", "\n"]), st.text(st.characters(blacklist_categories=("Cs",)), max_size=3))).map("".join))
def test_escape_round_trip(x):
    e = chat_format.escape(x)
    assert chat_format.unescape(e) == x and not any(c in e for c in chat_format.CONTROL)


def test_chats(spark):
    got = {r.conv_id: r for r in Q.op5_chat_format(spark, SF).collect()}
    rows = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        rows[r.conv_id].append((r.turn, r.role, r.text or ""))
    rows[-7] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    assert set(got) == set(rows)
    for c, turns in rows.items():
        turns.sort()
        told = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(told.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_edges(spark):
    rows = [(None, 0, "user", "a"), (1, None, None, None), (1, 1, "assistant", ""), (1, 1, "assistant", ""), (1, 2, "assistant", "é漢 \n <|end|>"), (2, 0, "a\nb<|turn|>", "x\\")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, ids int")
    f = chat_format.format_chats(df, BYTE_BPE)
    got = {r.conv_id: r for r in f.collect()}
    assert chat_format.read_back(got[2].formatted) == [("a\nb<|turn|>", "x\\")] and chat_format.read_back(got[1].formatted)[0] == ("", "")
    d = {r.conv_id: r for r in chat_format.digest(f).collect()}
    assert (d[1].n_turns, d[1].loss_chars) == (4, len("é漢 \n <|end|>")) and d[None].loss_chars == 0
    assert chat_format.digest(chat_format.format_chats(df.limit(0), BYTE_BPE)).collect() == []


# Neighbours.


def brute(ids, x, q, k=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
    d[q] = np.inf
    o = np.lexsort((ids, d))[: min(k, len(ids) - 1)]
    return list(zip(ids[o].tolist(), d[o].tolist(), strict=True))


@pytest.mark.parametrize("sf", [SF, SF.replace("0.01", "0.1")])
def test_neighbours_recall_on_the_forest_path(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = defaultdict(list)
    for r in Q.op8_neighbours(spark, sf).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = []
    for q in np.flatnonzero(ids % 100 == 0):
        want = brute(ids, x, q)
        assert len(got[ids[q]]) == 10 and got[ids[q]] == sorted(got[ids[q]], key=lambda p: (p[1], p[0]))
        hits.append(len({a for a, _ in want} & {a for a, _ in got[ids[q]]}) / 10)
    assert np.mean(hits) >= 0.9
    assert neighbours.budget(len(ids)) < 0.55 * len(ids)  # the queries do not rank all rows


@pytest.mark.parametrize("n", [500, 6000, 20000])
def test_forest_recall_and_candidates(n):
    r = np.random.default_rng(0)
    x = r.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(n)
    forest = neighbours.Forest(ids, x, neighbours.Hashes(x.mean(axis=0)), 10)
    q = ids[:: max(1, n // 60)]
    enough = neighbours.budget(n)
    found = list(forest.search(q, x[q], enough))
    assert np.mean([len({a for a, _ in brute(ids, x, i)} & set(f[1].tolist())) / 10 for i, f in zip(q, found, strict=True)]) >= 0.9
    lo, hi = forest.places(forest.hashes.strings(x[q]))
    share = np.mean([len(forest.candidates(a, b, enough)) for a, b in zip(lo, hi, strict=True)]) / n
    assert share < {500: 0.62, 6000: 0.45, 20000: 0.38}[n]


def test_neighbour_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(100, [1.0, 0.0]), (200, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.5, 0.5]), (5, None), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (300, [None, 1.0]), (9, [1.0]), (4, [0.5, 0.5]), (None, [1.0, 1.0]), (10, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    got = [tuple(r) for r in neighbours.nearest(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    half = pytest.approx(0.5**0.5)
    assert got == [(100, 1, 3, 0.0), (100, 2, 200, 0.0), (100, 3, 4, half), (200, 1, 3, 0.0), (200, 2, 100, 0.0), (200, 3, 4, half)]
    assert neighbours.nearest(df.limit(0), F.lit(True)).collect() == [] and neighbours.nearest(df, F.lit(False)).collect() == []


# Decontamination.


def test_wand_returns_all_above_the_threshold():
    r = random.Random(2)
    texts = [" ".join(f"w{min(int(r.expovariate(0.05)), 199)}" for _ in range(r.randrange(3, 40))) for _ in range(150)]
    df = defaultdict(int)
    for t in texts:
        for x in set(decontamination.terms(t).tolist()):
            df[x] += 1
    index = decontamination.Index(list(range(150)), texts, df, 150, 20.0)
    for _ in range(150):
        h = decontamination.terms(" ".join(f"w{r.randrange(200)}" for _ in range(60)))
        k = np.searchsorted(index.terms, h)
        k[k == len(index.terms)] = 0
        q = np.unique(k[index.terms[k] == h])
        s = np.zeros(150)
        for t in q:
            s[index.items[t]] += index.impacts[t]
        for least in (0.1, 0.3, 0.6):
            want = set(np.flatnonzero(s >= least + 1e-9).tolist())
            for alive in (None, index.coarse[q].sum(axis=0) >= least - 1e-4):
                assert want <= {i for i, _ in index.search(q, least, alive)} <= set(np.flatnonzero(s >= least - 1e-9).tolist())


def brute_hits(docs, items, least, overlap):
    """{(document, item): best score} by scoring every passage against every item."""
    split = lambda t: re.findall("[0-9A-Za-z\x80-\U0010ffff]+", t.translate(LOWER))
    runs = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    words = {i: split(t) for i, t in items}
    mean = sum(map(len, words.values())) / len(items)
    df = Counter(x for w in words.values() for x in set(w))
    half = max(32, *map(len, words.values()))
    out = {}
    for i, text in items:
        w = words[i]
        tf = Counter(w)
        impact = {x: math.log(1 + (len(items) - df[x] + 0.5) / (df[x] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x, n in tf.items()}
        whole = sum(impact.values())
        cut = max([m.end() for m in re.finditer(r"(?i)\banswer\s*:|\?", text)], default=0)
        q = len(split(text[:cut]))
        q = q if 0 < q < len(w) else -(-2 * len(w) // 3)
        sides = [runs(x, min(3, len(x))) for x in (w[:q], w[q:])]
        for d, t in docs:
            own = split(t or "")
            for a in range(0, len(own), half):
                passage = own[a : a + 2 * half]
                score = sum(impact.get(x, 0) for x in set(passage)) / whole
                grams = set().union(*(runs(passage, n) for n in (1, 2, 3)))
                if score >= least and all(len(x & grams) >= overlap * len(x) for x in sides):
                    out[d, i] = max(score, out.get((d, i), 0))
    return out


def test_hits_equal_brute_force(spark):
    r = random.Random(5)
    word = lambda: f"w{min(int(r.expovariate(0.02)), 400)}"
    marks = ["", " ? ", " Answer: "]
    items = [(i, " ".join(word() for _ in range(r.randrange(4, 30))) + marks[i % 3] + " ".join(word() for _ in range(r.randrange(1, 12)))) for i in range(60)]
    docs = []
    for d in range(120):
        w = [word() for _ in range(r.choice([0, 3, 40, 150, 900]))]
        for _ in range(r.randrange(3)):
            own = re.findall(r"\w+", r.choice(items)[1])
            rate, end = r.choice([0.85, 0.95, 1]), r.choice([len(own) - 1, len(own), len(own)])
            kept = [x if r.random() < rate else "zz" for x in own[:end]]
            at = r.randrange(len(w) + 1)
            w[at:at] = kept
        docs.append((d, " ".join(w)))
    # columns called like the helpers of the index are not read
    table = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in items], "item_id long, text string, shard string, n int, term int")
    got = {(x.doc_id, x.item_id): x.score for x in decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), table).collect()}
    want = brute_hits(docs, items, decontamination.THRESHOLD, decontamination.OVERLAP)
    assert len(want) > 40 and got == pytest.approx(want)


def test_leaks_in_very_long_texts(spark):
    item = " ".join(f"q{i}" for i in range(30))
    long = "filler words " * 60_000
    docs = spark.createDataFrame([(1, long + item + " " + long), (2, long), (3, "x" * 1_000_000)], "doc_id long, text string")
    items = spark.createDataFrame([(10, item)], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items).collect()] == [(1, 10)]
    assert sorted(r.doc_id for r in decontamination.drop_contaminated(docs, items).collect()) == [2, 3]


def test_leaks_are_found(spark):
    item = " ".join(f"q{i}" for i in range(30))
    rows = [(1, "a b " * 200 + item.upper() + "! " + "c d " * 90), (2, "a b " * 300), (3, " ".join(f"q{i}" for i in range(8))), (4, None), (5, ""), (None, item), (7, item), (7, item)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")
    items = spark.createDataFrame([(10, item), (11, None), (12, ""), (None, "zz yy xx ww")], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id) for r in decontamination.contaminated(docs, items).collect())
    assert got == [(0, 10), (1, 10), (7, 10), (7, 10)]
    assert sorted(r.doc_id for r in decontamination.drop_contaminated(docs, items).collect()) == [2, 3, 4, 5]
    assert decontamination.contaminated(docs, items.limit(0)).collect() == [] and decontamination.contaminated(docs.limit(0), items).collect() == []


def test_planted_passages(spark):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = {(r.doc_id, i) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() for i, t in items.items() if t in r.text}
    got = {(r.doc_id, r.item_id) for r in Q.op3_decontamination(spark, SF).collect()}
    assert want <= got and len(got) <= len(want) + 5


# The pipeline.


def test_pipeline_stages(spark):
    p = " ".join(f"The word{i} of a text, and more" for i in range(12)) + "."
    rows = [(1, p, "en", "s", 9), (2, p, "en", "s", 9), (3, None, None, None, None), (4, "", "en", "s", 0), (None, p + " x", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        out.collect()
        assert stage(spark, docs.limit(0), SF).collect() == []
    kept = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["3", "4", "None"]


def test_pipeline_keeps_one_row_of_each_text(spark):
    p, q, u, v = (" ".join(f"{c}{i}" for i in range(60)) for c in "pquv")
    near = p.replace("p59", "other")
    rows = [(1, p), (1, p), (1, p), (2, near), (2, u), (None, q), (None, q), (None, v), (7, v), (8, ""), (8, ""), (9, None), (9, ""), (None, ""), (None, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs.repartition(3), SF).collect()]
    assert sorted(kept, key=str) == sorted([(1, p), (2, u), (None, q), (None, v), (8, ""), (9, None), (9, ""), (None, "")], key=str)


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100 and "sequence_id" in out.columns
