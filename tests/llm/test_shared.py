"""Line dedup, hard negatives and the prefix trie against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from archive_lens.llm import hard_negatives, line_dedup, prefix_trie
from archive_lens.llm.common import LEAST

LOWER = {c: c + 32 for c in range(65, 91)}
SPACE = " \t\n\x0b\x0c\r"

# Line dedup.


def lines_by_hand(docs, least=10):
    key = lambda x: x.strip(SPACE).translate(LOWER)
    held = defaultdict(set)
    for d, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                held[key(x)].add(LEAST if d is None else d)
    out = []
    for d, t in docs:
        own = (t or "").split("\n")
        kept = [x for x in own if not (len(held[key(x)]) > 1 and min(held[key(x)]) != (LEAST if d is None else d))]
        out.append((d, len(own), len(own) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def removed(spark, docs):
    df = spark.createDataFrame([(*x, "c", i) for i, x in enumerate(docs)], "doc_id long, text string, chunk string, __is_doc int")
    out = line_dedup.remove_repeats(df)
    assert out.columns == ["doc_id", "text", "chunk", "__is_doc", "___n_lines", "___n_dropped", "___kept"]
    rows = out.collect()
    assert sorted(((r.doc_id, r.text, r["__is_doc"]) for r in rows), key=str) == sorted(((d, t, i) for i, (d, t) in enumerate(docs)), key=str)
    return sorted(((r.doc_id, r["___n_lines"], r["___n_dropped"], r["___kept"]) for r in rows), key=str)


def test_lines_edges(spark):
    docs = [(5, None), (6, ""), (7, "\n\n"), (1, "  The Same Line here \r\nshort\nÀ la même ligne é"), (2, "the same line HERE\nshort\n\x0bthe same line here\nown line of two"), (3, "À LA MÊME LIGNE É\nà la même ligne é\nÀ la même ligne é"), (4, "ééééééééé\nééééééééé"), (8, "ééééééééé\néééééééééé"), (9, "éééééééééé "), (None, "null has this line\nq"), (10, "null has this line\nx" * 3), (11, "own line of two\nown line of two"), (11, "again in eleven"), (11, "again in eleven"), (12, "word " * 200_000 + "\n" + "z" * 300_000), (13, "z" * 300_000 + " ")]
    assert removed(spark, docs) == lines_by_hand(docs)


def test_lines_random(spark):
    rng = random.Random(11)
    vocabulary = [f"line number {k}" + " " * (k % 3) for k in range(60)] + ["x", "", "LINE NUMBER 1"]
    docs = [(rng.randrange(150), "\n".join(rng.choices(vocabulary, k=rng.randrange(9)))) for _ in range(300)]
    docs += [(1000 + k, f"a line in all of them\nand one of {k}") for k in range(400)]  # a line that a third and more hold
    assert removed(spark, docs) == lines_by_hand(docs)


def test_lines_empty_table(spark):
    assert line_dedup.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 64, 5000):
        a, b = rng.integers(0, 1 << 63, n, dtype=np.uint64), rng.integers(0, 1 << 63, n, dtype=np.uint64)
        mph = line_dedup.PerfectHash.build(a, b)
        assert sorted(mph.find(a, b)) == list(range(n))
        assert (mph.find(a[::-1], b) == mph.find(a[::-1].copy(), b)).all()
        strangers = mph.find(*(rng.integers(0, 1 << 63, 1000, dtype=np.uint64) for _ in "ab"))
        assert (strangers < 0).all()
        assert sum(8 * len(x) for x in mph.levels) <= 6 * max(n, 64)  # bits


# Hard negatives.


def mined_by_hand(rows, every=2):
    use = {}
    for i, label, v in sorted((r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[2])), key=lambda r: (r[0], r[1], r[2])):
        use.setdefault(i, (label, [int(np.floor(256.0 * np.float64(x))) for x in v]))
    out = []
    for a, (label, v) in use.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(v, w, strict=True)) for i, (_, w) in use.items() if i != a}
        best = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in best if use[i][0] == label][:5]:
            ok = [i for i in best if use[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out += [(a, p, k + 1, n, score[p], score[n]) for k, n in enumerate(ok[:3])]
    return sorted(out)


VECTORS = "vec_id long, label int, embedding array<double>, score int, anchor_id string"


def mined(spark, rows, **options):
    df = spark.createDataFrame([(*r, 0, "z") for r in rows], VECTORS)
    return sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % 2 == 0, **options).collect()))


def test_negatives_with_ties_and_bad_rows(spark):
    rng = np.random.default_rng(12)
    # few different vectors: many ties; a third of the rows are one vector
    rows = [(i, int(rng.integers(3)), [float(x) for x in rng.integers(0, 3, 4) / 256]) for i in range(90)] + [(100 + i, i % 2, [1 / 256, 2 / 256, 2 / 256, 0.0]) for i in range(45)]
    rows += [(200, None, [1.0] * 4), (201, 1, None), (202, 1, [1.0, None, 1.0, 1.0]), (203, 1, [float("nan")] * 4), (204, 1, [float("inf"), 1.0, 1.0, 1.0]), (None, 1, [1.0] * 4), (3, 9, [9.0] * 4), (4, 0, rows[4][2])]
    want = mined_by_hand(rows)
    assert len(want) > 200
    assert mined(spark, rows) == want
    assert mined(spark, rows, anchor_bytes=300) == want  # groups of anchors


def test_negatives_are_exact_for_large_components(spark):
    rng = np.random.default_rng(13)
    rows = [(i, i % 3, [float(x) for x in rng.uniform(0, 60_000, 8)]) for i in range(40)] + [(50, 0, [3e5] * 8), (51, 0, [2.9e5] * 8), (52, 1, [2.3e5] * 8)]
    want = mined_by_hand(rows)
    assert max(x[4] for x in want) > 1 << 47
    assert mined(spark, rows) == want
    big = [(i, i % 2, [float(x) for x in rng.uniform(1e6, 2e6, 8)]) for i in range(30)]  # past 2^53: in integers
    want = mined_by_hand(big)
    assert max(x[4] for x in want) > 1 << 53 and mined(spark, big) == want


def test_negatives_of_negative_scores_empty_tables_and_odd_widths(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [-1.0, 0.0]), (2, 2, [-0.7, 0.0]), (3, 1, [0.0, 1.0]), (4, 2, [0.0, -1.0])]
    assert mined(spark, rows) == mined_by_hand(rows)
    assert mined(spark, []) == [] and mined(spark, [(1, 1, [1.0])]) == []
    assert mined(spark, [*rows, (6, 1, [1.0]), (8, 1, [])]) == mined_by_hand(rows)
    assert mined(spark, [*rows, (6, 1, [1e300, 0.0])]) == mined_by_hand(rows)  # its products fit no long


def test_windows():
    for p in [*range(-50, 200), 10**12 + 7, (1 << 62) - 3]:
        lo, hi = (int(x[0]) for x in hard_negatives.windows(np.array([p])))
        for n in {lo - 1, lo, lo + 1, hi - 1, hi, hi + 1}:
            assert (lo <= n <= hi) == (50 * p <= 100 * n <= 95 * p)


# The prefix trie.


def trie_by_hand(chats):
    """Nodes of {conv_id: [(role, text), ...]}."""
    members = defaultdict(list)
    for c, turns in chats.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    out = []
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(members[k]) - 1) * len(k[-1][1].encode().split()) if k else 0)
        ends = ",".join(str(c) for c in sorted(members[k]) if len(chats[c]) == len(k))
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(chats):
    return [(c, k, r, t, "x", 1) for c, turns in chats.items() for k, (r, t) in enumerate(turns)]


CHATS = "conv_id long, turn long, role string, text string, depth string, a int"


def nodes(spark, rows, **heads):
    seqs = prefix_trie.sequences(spark.createDataFrame(rows, CHATS))
    return sorted(map(tuple, prefix_trie.trie(prefix_trie.with_heads(seqs, **heads) if heads else seqs).collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_trie_of_random_conversations(spark, seed):
    rng = random.Random(seed)
    chats = {}
    for c in rng.sample(range(-50, 500), 120):
        if chats and rng.random() < 0.6:  # beginnings and whole copies of others
            old = chats[rng.choice(list(chats))]
            chats[c] = old[: rng.randrange(1, len(old) + 1)] + [(rng.choice("ua"), rng.choice(["x y", "z", ""])) for _ in range(rng.randrange(3))]
        else:
            chats[c] = [(rng.choice("ua"), rng.choice(["one two three", "z", "é é b"])) for _ in range(rng.randrange(1, 12))]
    assert nodes(spark, rows_of(chats)) == trie_by_hand(chats)


def test_trie_of_copies_and_a_long_shared_beginning(spark):
    long = [("u", f"turn {k}") for k in range(70)]
    chats = {k: [("u", "hello there"), ("a", "hi")] for k in range(40, 100)} | {1: long, 2: long + [("a", "more")], 3: long[:69] + [("a", "else")], 4: [("u", "own")]}
    assert nodes(spark, rows_of(chats)) == trie_by_hand(chats)


def test_trie_edges(spark):
    rows = [(None, 0, "u", "t", "x", 1), (3, None, None, None, "x", 1), (3, 0, "u", "", "x", 1), (3, 0, "a", "b", "x", 1), (3, 0, "a", "b", "x", 1), (-4, 7, "", "", "x", 1), (-4, 8, "a", "b", "x", 1), (9, 0, "", "", "x", 1)]
    chats = {3: [("", ""), ("a", "b"), ("a", "b"), ("u", "")], -4: [("", ""), ("a", "b")], 9: [("", "")]}
    assert nodes(spark, rows) == trie_by_hand(chats)
    assert nodes(spark, [(7, 0, "u", "only", "x", 1)]) == trie_by_hand({7: [("u", "only")]})
    assert nodes(spark, []) == []
    assert nodes(spark, [(1, 0, "u", "w " * 100_000, "x", 1), (2, 0, "u", "w " * 100_000, "x", 1)]) == trie_by_hand({c: [("u", "w " * 100_000)] for c in (1, 2)})


def test_trie_of_rebuilt_conversations(spark):
    rng = random.Random(5)
    chats = {c: [(rng.choice("ua"), rng.choice("pq")) for _ in range(rng.randrange(1, 5))] for c in [*range(0, 70), *range(101, 118), -7, -33]}
    built = {}
    for c, own in chats.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        built[c] = chats.get(base, [])[:h] + own[h:]
    assert any(not x for x in built.values())
    assert nodes(spark, rows_of(chats), every=20, heads=4) == trie_by_hand(built)
