"""Scalar functions against fixed tables."""

import urllib.parse

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from archive_lens.functions import scalars as S
from archive_lens.functions.udfs import decode_lenient, url_quote, url_unquote


def values(spark, inputs, f):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string").select("i", f(F.col("x")).alias("y")).orderBy("i").collect()
    return [r["y"] for r in rows]


def test_bytes(spark):
    assert values(spark, ["0", "1023", "1024", "1152", "10240", "102400"], lambda c: S.format_bytes(c.cast("long"))) == ["0B", "1023B", "1.00KiB", "1.12KiB", "10.0KiB", "100KiB"]
    assert values(spark, ["1234", "1KB", "1K", "1k", "1.5MiB", "1kib", "", None], S.parse_bytes) == [1234, 1000, 1024, 1024, 1572864, None, None, None]


def test_names(spark):
    assert values(spark, ["a/b", "  x. ", "a\tb", "", "...", "x" * 130], S.sanitize_name) == ["a_b", "x", "ab", "unknown_chat", "unknown_chat", "x" * 120]
    assert values(spark, ["/x/DataExport_09_10_2018", "ChatExport-31.02.2018", "none"], S.export_date) == ["2018-10-09", None, None]


def test_references(spark):
    assert values(spark, ["weather.com", "1.2.3.4/x", "src.zip", "photos/a.jpg", "style.css", "1.2.3.400"], S.is_host) == [True, True, False, False, True, False]
    assert values(spark, ["src.zip", "messages2.html", "a/b.zip"], S.is_bare_file) == [True, True, False]
    assert values(spark, ["#x", "tg://a", "C:\\a", "photos/a.jpg", "//h/x", " "], S.is_skipped) == [True, True, True, False, False, True]
    assert values(spark, ["2018", "2018-10-09T21:32:23", "2018-10-09T21:32:23Z", "bad"], lambda c: F.unix_seconds(S.parse_iso(c))) == [None, 1539120743, 1539120743, None]
    assert values(spark, ["1539113543", "1.5", ""], lambda c: F.unix_seconds(S.parse_unixtime(c))) == [1539113543, None, None]
    assert values(spark, ["/a/b/c", "/a", "/"], lambda c: F.array_join(S.ancestors(c), "|")) == ["/a/b|/a|/", "/", ""]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=("Cs",)), max_size=12), min_size=1, max_size=8))
def test_quoting_is_pythons(spark, xs):
    got = values(spark, xs, url_quote)
    assert got == [urllib.parse.quote(x, safe="/") for x in xs]
    assert values(spark, got, url_unquote) == xs


#: Whole characters, heads and tails of others, surrogates, overlong forms, U+FFFD itself and the marks that stand for it.
BYTES = [b"a", b"b", b"\0", b"\n", b"\xff", b"\xc3", b"\xc3\xa9", b"\x80", b"\xbf", b"\xe2\x82", b"\xe2\x82\xac", b"\xf0\x9f", b"\xf0\x9f\x98\x80", b"\xed\xa0\x80", b"\xef\xbf\xbd", b"\xef", b"\xbd", b"\xf4\x90\x80\x80", b"\xc0\x80", b"\xe0\x80\x80"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(BYTES), max_size=12).map(b"".join), min_size=1, max_size=50))
def test_lenient_decoding_is_pythons(spark, xs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([*xs, None])], "i int, x binary").select("i", decode_lenient("x").alias("y")).orderBy("i").collect()
    assert [r["y"] for r in rows] == [x.decode("utf-8", "ignore") for x in xs] + [None]


def test_texts_do_not_pass_through_python(spark):
    """A batch of an Arrow UDF is of rows, whatever their length: so many long texts are held at once."""
    x = spark.createDataFrame([("a", b"a")], "s string, b binary").select(url_quote("s"), decode_lenient("b"))
    assert "EvalPython" not in x._jdf.queryExecution().executedPlan().toString()
