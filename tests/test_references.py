"""Character references that no semicolon ends."""

import duckdb

from civicforms.operators import html
from civicforms.plans.registry import ORACLE, QUERIES

TITLES = ["cut&amp", "a &lt b &amp;lt; c", "x&&amp; y &#39; z &quot", "AT&T &copy", "&amp;&ampx"]


def test_page_extract_leaves_bare_references_like_its_sql(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", f"<html><h1>{t}</h1><p>x<a href='?a=1&amp=2'>l</a></html>") for k, t in enumerate(TITLES)], "page_id long, url string, html string")
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    found = QUERIES["page_extract"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == sorted(con.execute(ORACLE["page_extract"]).fetchall())


def test_pages_are_read_with_bare_references_otherwise():
    assert html.parse_page("<h1>cut&amp</h1>")["title"] == "cut&"
    assert html.parse_page("<h1>cut&amp</h1>", bare_references=False)["title"] == "cut&amp"
