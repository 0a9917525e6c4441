"""Folders above paths: the same pairs, however crowded the folders are."""

from archive_lens.operators import tree

PATHS = ["/a/b/1", "/a/b/2", "/a/b/c/3", "/a/d/4", "/e/5", "/6", "/a/b/c"]
ROOTS = ["/a", "/a/b/c", "/e/5", "/x", "/a/b"]


def test_crowded_folders_are_no_keys(spark):
    paths, roots = (spark.createDataFrame([(x,) for x in xs], "path string") for xs in (PATHS, ROOTS))
    want = {(p, r) for p in PATHS for r in ROOTS if p.startswith(r + "/")}
    for most in (0, 1, 3, 100):
        got = [(r.path, r.ancestor) for r in tree.roots_above(paths, roots, most).collect()]
        assert set(got) == want and len(got) == len(want)
    assert {r.ancestor for r in tree.crowded(paths, 3).collect()} == {"/", "/a", "/a/b"}
    assert {r.path for r in tree.outside_of(paths, roots).collect()} == {"/e/5", "/6"}
    assert {(r.path, r.parent) for r in tree.nearest_ancestor(paths, spark.createDataFrame([("/",), ("/a/b",)], "path string")).collect()} == {(p, "/a/b" if p.startswith("/a/b/") else "/") for p in PATHS}
