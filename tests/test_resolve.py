"""References of exports against an inventory, by what the places of a file are."""

from archive_lens.functions import constants as K
from archive_lens.functions import scalars as S
from archive_lens.operators import resolve
from archive_lens.plans import rewrites
from pyspark.sql import functions as F

PATHS = ["/w/a/x y.jpg", "/w/a/photos/x.jpg", "/w/a/files/x.jpg", "/w/a/b.txt", "/w/a/stickers/b.txt", "/w/a/files/photos/c", "/photos/top", "//photos/odd", "/w/a/files/.h", "/w/a/p%20q", "/w/a/video_files/p q", "/w/photos/up"]
URLS = {"x.jpg": "/w/a/files/x.jpg", " x.jpg#t ": "/w/a/files/x.jpg", "x%20y.jpg": "/w/a/x y.jpg", "x%2520y.jpg?z": "/w/a/x y.jpg", "b.txt": "/w/a/b.txt", "./b.txt": "/w/a/b.txt", "./x.jpg": None, "c": None, "files/c": None, ".h": None, "p%20q": "/w/a/p%20q", "../up": None, "../photos/up": "/w/photos/up", "none": None}


def test_a_name_is_met_once_a_spelling(spark):
    files = spark.createDataFrame([(p,) for p in PATHS], "path string")
    rows = spark.createDataFrame([("/w/a", u) for u in URLS] + [("/", "top"), ("/", "odd")], "here string, url string")
    got = {(r.here, r.url): r.target for r in resolve.lookup_in_export(rows, files).collect()}
    assert got == {("/w/a", u): t for u, t in URLS.items() if t} | {("/", "top"): "/photos/top"}
    inside = {r.url for r in resolve.lookup_in_export(rows, files, inside=True).collect()}
    assert inside == {u for u, t in URLS.items() if t and t.startswith("/w/a/")} | {"top"}
    # a plain name is one row, not one for each folder of media; a file two at most
    assert resolve.spellings(spark.createDataFrame([("/w/a", "x.jpg")], "here string, url string")).count() == 1
    assert resolve.export_places(files).count() <= 2 * len(PATHS)


def test_white_space_of_any_kind_is_stripped(spark):
    xs = [a + m + a for a in K.WHITE_SPACE for m in ("", "a b", "​")] + ["﻿a", "\x1c a"]
    rows = spark.createDataFrame(list(enumerate(xs)), "i int, x string").select("x", S.strip(F.col("x")).alias("y"), F.regexp_replace("x", r"(?U)^\s+|\s+$", "").alias("z")).collect()
    assert all(r.y == r.z for r in rows)


def test_repairs_read_entities_once(spark):
    text = '<a href="a#1.txt"><a href="a&num;1.txt"><a href="a&#35;2.txt"><a href="b.txt"><a href="a%231.txt"><a href="x&amp;y#.txt"><a href="gone#.txt">'
    files = spark.createDataFrame([(f"/p/{x}", False) for x in ("a#1.txt", "a#2.txt", "b.txt", "x&y#.txt")], "path string, is_dir boolean")
    out = rewrites.repair_links(spark.createDataFrame([("/p/m.html", text)], "file string, text string"), files, "/p")
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") == 1
    assert {(r.idx, r.new) for r in out.collect()} == {(0, "a%231.txt"), (1, "a%231.txt"), (2, "a%232.txt"), (5, "x%26y%23.txt")}
