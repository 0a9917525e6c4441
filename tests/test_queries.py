"""Every registered query that has SQL against DuckDB, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FOUND = [n for n in entry.oracle_sql() if n.startswith("q_")]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(xs):
    return sorted(([None if v is None else round(v, 6) if isinstance(v, float) else v for v in x] for x in xs), key=str)


@pytest.mark.parametrize("name", FOUND)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = ", ".join(f'"{c}"' for c in sorted(df.columns))
    want = con.execute(f"select {cols} from ({entry.oracle_sql()[name]})").fetchall()
    assert rows(df.select(*sorted(df.columns)).collect()) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


#: Titles that end inside an entity, have others than three, odd white space at their ends, or more than 64 Ki characters.
TITLES = ["a &am", "a &amp", "&quot;a&quot;", "&amp;lt;", "&lt;i&gt; &amp;", "&amp;amp;quot;", "\t a\n", "\xa0a\u3000", "\x0b a \x1c", "a\u2028", "&nbsp;", "", " ", "x" * 70000, "&#60;", "&copy"]


def test_titles_as_sql_reads_them(spark, tmp_path):
    html = [f"<title>{t}</title>" for t in TITLES] + ["none", None]
    spark.createDataFrame(list(enumerate(html)), "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = dict(c.execute(entry.oracle_sql()["q_title_extract"]).fetchall())
    assert {r.page_id: r.title for r in entry.queries()["q_title_extract"](spark, str(tmp_path)).collect()} == want
