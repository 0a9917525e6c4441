import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from archive_lens.llm import near_dedup, substring_dedup
from archive_lens.llm.graph import components
from archive_lens.llm.kernels import Words, buffers

from .helpers import near, removed, words


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("*", "'x' as lang", "1 as n", "2 as g", "3 as rep", "4 as target") if extra else df


def texts(seed, n=120):
    r = random.Random(seed)
    out = []
    for i in range(n):
        letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"[: r.choice([1, 2, 3, 52])]
        out.append((i, " ".join(r.choice(letters) for _ in range(r.choice([0, 1, 3, 19, 20, 21, 60, 300])))))
    out += [(n + i, out[i][1]) for i in range(0, 40, 3)]
    return out + [(n + 50, None), (n + 51, ""), (n + 52, " \t\n "), (n + 53, "Ä b c " * 30)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \t\nÄ漢 \x0b\x1f"), max_size=40), max_size=6))
def test_words(xs):
    data, offs = buffers(pa.array(xs, pa.string()))
    w = Words(data, offs)
    raw = w.data.tobytes()
    assert [raw[a:b].decode() for a, b in zip(w.start, w.end, strict=True)] == [x for t in xs for x in words(t)]
    assert np.diff(w.first).tolist() == [len(words(t)) for t in xs]


def test_substring_brute_force(spark):
    rows = texts(1)
    got = substring_dedup.digest(frame(spark, rows).repartition(5))
    assert sorted(map(tuple, got.collect())) == removed(rows)


def test_substring_edges(spark):
    p = " ".join(f"w{i}" for i in range(60))
    assert substring_dedup.digest(frame(spark, [])).collect() == []
    # repeated rows are one document; a null id is smaller than all others
    got = substring_dedup.digest(frame(spark, [(1, p), (1, p), (2, "x " + p), (None, "y " + p + " z")])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (1, 60), (1, 60), (2, 60)]
    out = substring_dedup.remove_repeats(frame(spark, [(1, p), (2, "a " + p + " b")])).orderBy("doc_id").collect()
    assert out[1]["__kept"] == "a b" and out[1]["lang"] == "x" and out[1]["target"] == 4


def test_symbols_do_not_depend_on_what_surrounds_a_window():
    r = np.random.default_rng(0)
    h = r.integers(0, 6, 4000).astype(np.uint64)
    doc = np.zeros(len(h), np.int64)
    h[3000:3100] = h[100:200]
    s, node, names, wh = substring_dedup.windows(h, doc, 20)
    for k in range(81):
        assert wh[3000 + k] == wh[100 + k] and names[node[3000 + k]] == names[node[100 + k]]


def test_stretches_cover_a_long_document(monkeypatch):
    monkeypatch.setattr(substring_dedup, "STRETCH", 57)
    p = " ".join(f"w{i % 90}" for i in range(400))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2], pa.int64()), pa.array([7, 8], pa.int64()), pa.array([p, "a " + p])], ["__id", "__hash", "text"])
    packed = pa.Table.from_batches(substring_dedup._find(1, 20)([batch]))
    got = {r["__id"]: r["__ranges"] for r in substring_dedup._decide(packed).to_pylist()}
    gone = {d: int(substring_dedup._covered(400 + (d == 2), [b], 20).sum()) for d, b in got.items()}
    assert gone == {1: removed([(1, p)])[0][2], 2: 400}


def test_near_brute_force(spark):
    r = random.Random(3)
    rows, base = [], [[f"v{r.randrange(4000)}" for _ in range(80)] for _ in range(12)]
    for i in range(240):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            w[r.randrange(len(w))] = f"e{r.randrange(9)}"
        rows.append((i, " ".join(w).upper() if i % 7 == 0 else " ".join(w)))
    rows += [(300, None), (301, ""), (302, "one two"), (303, "ONE two"), (304, " ")]
    got = near_dedup.near_duplicates(frame(spark, rows).repartition(4), 3, 85, 100)
    assert sorted(map(tuple, got.collect())) == near(rows)


def test_near_edges(spark):
    assert near_dedup.near_duplicates(frame(spark, [])).collect() == []
    p = " ".join(f"w{i}" for i in range(40))
    got = near_dedup.near_duplicates(frame(spark, [(5, p), (5, p), (None, p), (9, "w1 w2"), (3, "other")])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (3, 3, True), (5, -1, False), (5, -1, False), (9, 9, True)]


def test_near_texts_that_share_a_doc_id(spark):
    p = " ".join(f"w{i}" for i in range(40))
    rows = [(1, p), (1, p + " x"), (2, p + " y"), (2, "another text")]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(frame(spark, rows)).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (2, 2, True)]


def test_trees_stop_before_pairs_are_lost():
    for s, depth in ((0.85, 7), (0.8, 5)):
        assert near_dedup.deepest(s, near_dedup.TREES) == depth
        assert (1 - s**depth) ** near_dedup.TREES <= near_dedup.MISS < (1 - s ** (depth + 1)) ** near_dedup.TREES


def test_star_of_many_variants(spark):
    """Each variant links with the original alone: nothing else makes up for a pair that the trees miss."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 20_501):
        w = list(base)
        for at in r.sample(range(1, 66), 5):
            w[3 * at] = f"x{i}y{at}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(t.split()[i : i + 3]) for i in range(198)} for _, t in rows]
    linked = sum(100 * len(sets[0] & x) >= 85 * len(sets[0] | x) for x in sets)
    got = near_dedup.near_duplicates(frame(spark, rows, False).repartition(8), 3, 85, 100)
    assert linked == len(rows) and got.filter("component_id = 0").count() == linked


def test_large_clusters_lose_no_links(spark, monkeypatch):
    """Stars, twins and unlinked texts in one cluster give the components of all pairs."""
    for name, n in (("BLOCK", 8), ("PAIRWISE", 40), ("SAMPLE", 16)):
        monkeypatch.setattr(near_dedup, name, n)
    r = random.Random(8)
    rows, common = [], [f"c{i}" for i in range(24)]
    for s in range(14):
        base = [*common, *(f"s{s}w{i}" for i in range(20))]
        for v in range(r.choice([1, 2, 9, 30])):
            w = list(base)
            if v:
                w[r.randrange(3, 41)] = f"x{s}y{v}"
            rows.append((len(rows), " ".join(w)))
    r.shuffle(rows)
    join = near_dedup._Join(frame(spark, rows, False), 3, 85, 100, 24)
    join.texts = join.docs.join(join.classes, ["__id", "__hash"]).select("rep", "text")
    got = dict(map(tuple, components(join.large_links(join.ids.selectExpr("1L as g", "rep"))).collect()))
    key = {r["__id"]: r["rep"] for r in join.classes.collect()}
    least = {}
    for d in sorted(key):
        least.setdefault(got.get(key[d], key[d]), d)
    assert [(d, least[got.get(key[d], key[d])]) for d in sorted(key)] == [(d, c) for d, _, c, _ in near(rows)]


def test_full_links_are_exact():
    r = np.random.default_rng(1)
    sets = [set(r.choice(60, r.integers(1, 30), replace=False).tolist()) for _ in range(40)]
    doc = np.concatenate([[i] * len(s) for i, s in enumerate(sets)])
    h = np.concatenate([sorted(s) for s in sets]).astype(np.uint64)
    a, b = near_dedup.full_links(doc, h, len(sets), 30, 100)
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == {(i, j) for i in range(40) for j in range(i + 1, 40) if 100 * len(sets[i] & sets[j]) >= 30 * len(sets[i] | sets[j])}


def test_groups_larger_than_a_block(spark):
    """Blocks of a group meet pairwise whatever its size: here by copies of the plan with small blocks."""
    n = near_dedup.BLOCK
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base, f"x{i}"])) for i in range(n + n // 2)]
    got = near_dedup.near_duplicates(frame(spark, rows, False).repartition(3), 5, 80, 100)
    assert got.filter("component_id <> 0").count() == 0 and got.filter("kept").count() == 1


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30))
