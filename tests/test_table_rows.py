"""Rows of tables read from many pages at once: the rows that the tree of each page gives."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from civicforms.functions.urls import absolute_url
from civicforms.operators import tables
from civicforms.operators.html import TABLES, _Node, parse_page
from civicforms.plans import registry

TEXTS = ("", "x", "a  b", "Acte &amp;  &lt;m1&gt;", "&nbsp;1", "&amp;lt;", "&am", "p;", "&eacute;&#39;&quot;", "&&amp;", "&lt", " \n ", "  z\u0085y", "a > b", "\x1c\t", "ș", "\x00")
INNER = (
    "<p>{0}</p>", "<b>{0}</b> {1}", "{0}<br>{1}", "{0}<BR>{1}", "<i class='glyphicon glyphicon-ok'></i>", "<a class=x href='/f/1.pdf'>{0}</a>", "<a>{0}</a>", "<a href>{0}</a>", '<a href="?a=1&amp;b=2">{1}</a>',
    "<div>{0}<span>{1}</span></div>\n{0}", "{0}",
)
# What ends where it does not begin, tables within cells, and what is no plain markup.
ODD = (
    "<p>{0}", "</b>{0}", "<b><i>{0}</b></i>", "<table><tr><td>{0}</td></tr></table>", "<table class=proc-viz-legi><tbody></tbody></table>", "<!-- {0} </td></tr> -->", "<script><td></script>", "<a title='x>y'>{0}</a>", "< {0}",
    "<a href=x&lt;y>{0}</a>", "<td>{0}</td>", "</td></tr >", "</tr>", "<tr>", "<TR><td>{0}</TR>", "</table>", "<track>", "<th>{0}</th>", "<a href='{0}</tr>'>", "<", "<![CDATA[{0}]]>", "<br></br>", "{0}<BR/>{1}",
)


def _page(rng: random.Random, odd: float) -> str:
    def some(most: int) -> str:
        kinds = [rng.choice(ODD if rng.random() < odd else INNER) for _ in range(rng.randrange(most))]
        return "".join(k.format(rng.choice(TEXTS), rng.choice(TEXTS)) for k in kinds)

    def row() -> str:
        start = rng.choice(("<tr>", "<tr>", "<tr>", "<tr class='tabel-header'>", "<tr class=\"odd\" >"))
        return start + "".join(f"{rng.choice(('', '', ' ', 'z'))}<td{rng.choice(('', '', ' class=glyphicon-ok'))}>{some(3)}</td>" for _ in range(rng.randrange(9))) + rng.choice(("", "", "\n")) + "</tr>"

    def table() -> str:
        name = rng.choice(("documenteintrare", "documenteiesire", "legi", "legi", "other"))
        inner = "\n".join(row() for _ in range(rng.randrange(4))) + (some(2) if rng.random() < odd else "")
        return f"<table class='table proc-viz-{name}'>{rng.choice(('<tbody>{}</tbody>', '<tbody>{}</tbody>', '{}', '<thead></thead><TBODY>{}</TBODY>')).format(inner)}</table>"

    return "".join(rng.choice((lambda: "<h1>Order</h1>", table, table, table, lambda: some(2), lambda: f"<div>{table()}</div>"))() for _ in range(rng.randrange(6)))


def _wanted(pages: list[str]) -> list[tuple]:
    return [(p, name, k, row) for p, html in enumerate(pages) for name, rows in parse_page(html).items() if name in TABLES for k, row in enumerate(rows)]


def _found(pages: list[str]) -> tuple[list[tuple], np.ndarray]:
    parts, left = tables.read_rows(pa.array(pages, pa.string()))
    rows = [(p, name, k, {c: v for c, v in zip(tables.COLUMNS, row, strict=True) if c in TABLES[name][1]}) for name, numbers, places, columns in parts for p, k, *row in zip(numbers.tolist(), places.tolist(), *(c.to_pylist() for c in columns), strict=True)]
    order = [*TABLES]
    return sorted(rows, key=lambda r: (r[0], order.index(r[1]), r[2])), left


def test_rows_of_pages_are_those_of_the_tree():
    rng = random.Random(7)
    for odd, least in ((0.0, 1.0), (0.05, 0.3), (0.3, 0.02)):
        pages = ["", "text", "<tr>", "</tr>", "<td></td>", "<tr></tr>"] + [_page(rng, odd) for _ in range(3000)]
        found, left = _found(pages)
        assert found == [r for r in _wanted(pages) if not left[r[0]]]
        assert 1 - left[6:].mean() >= least


def test_plain_pages_are_not_parsed_one_by_one(spark, monkeypatch):
    # Each page's tree would take 50 times as long; only the last page needs one.
    rows = "".join(f"<tr><td>{k}</td><td><p>N &amp; {k}</p><b>rev</b></td><td>d</td><td><i class='glyphicon-ok'></i></td><td></td><td>t</td><td><a href='/f/{k}.pdf'>f</a></td></tr>" for k in range(3))
    page = f"<h1>T</h1><table class=proc-viz-documenteintrare><tbody><tr class='tabel-header'><td>Nr</td></tr>{rows}</tbody></table>"
    assert not tables.read_rows(pa.array([page] * 5))[1].any()
    pages = spark.createDataFrame([(k, page) for k in range(5)] + [(5, None), (6, page + "<!-- end -->"), (None, page)], "page_id int, html string")
    found = tables.table_rows(pages).collect()
    assert sorted((-1 if r["page_id"] is None else r["page_id"], r["place"]) for r in found) == [(p, k) for p in (-1, 0, 1, 2, 3, 4, 6) for k in range(3)]
    assert {tuple(r)[3:] for r in found if r["place"] == 2} == {tuple({"nr": "2", "name": "N & 2\nrev", "description": "d", "required": True, "e_signature": False, "type": "t", "href": "/f/2.pdf"}[c] for c in tables.COLUMNS)}


def test_portions_hold_all_pages(monkeypatch):
    monkeypatch.setattr(tables, "BYTES_AT_ONCE", 10)
    html = pa.array(["x" * n for n in (0, 3, 7, 1, 30, 0, 0, 10, 11, 2)])
    assert [*tables._portions(html)] == [(0, 3), (3, 1), (4, 1), (5, 3), (8, 1), (9, 1)]
    assert [*tables._portions(html.slice(0, 0))] == []


def test_white_space_is_that_of_split():
    signs = [c for c in map(chr, range(0x110000)) if c.isspace() or ord(c) < 256]
    texts = [f"{sign}a{sign}{sign}b{sign}" for sign in signs] + ["", " ", "a\n \nb", "\n"]
    node = _Node("td", {})
    for text, lines in zip(texts, tables._lines(pa.array(texts)).to_pylist(), strict=True):
        node.children = [text]
        assert lines == node.lines(), repr(text)


def test_plain_paths_lead_where_all_others_do(spark):
    links = ["/", "/f/2.pdf", "/a/b/", "/a//b", "//h.example/a", "/./a", "/a/..", "/a/.b", "/a b", "/a%2e", "/a~b_c-D", "/ș", "/a?b", "/a#b", "/a\n", "", None, "a/b", "/a:b"]
    rows = spark.createDataFrame([(x,) for x in links], "link string")
    # A blank before the link is taken off and keeps it from the short way.
    found = rows.select("link", absolute_url("link", "https://H.example/p/q?r").alias("short"), absolute_url(F.concat(F.lit(" "), "link"), "https://H.example/p/q?r").alias("long")).collect()
    assert [r for r in found if r["link"] and r["short"] != r["long"]] == []
    assert {r["link"]: r["short"] for r in found}["/f/2.pdf"] == "https://h.example/f/2.pdf"


def test_flags_of_repeated_lines_are_those_of_the_sql(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randrange(40), rng.randrange(1, 8), rng.randrange(99), rng.choice(("A", "N", "R", "S", None)), rng.choice(("F", "O", "P", None))) for _ in range(500)]
    rows += [(page, nr, 100, "R", "O") for page, nr in {r[:2] for r in rows}]
    pq.write_table(pa.table({f"l_{c}": v for c, v in zip(("orderkey", "linenumber", "partkey", "returnflag", "linestatus"), zip(*rows, strict=True), strict=True)}), tmp_path / "lineitem.parquet")
    found = registry.QUERIES["scraped_tables"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    wanted = con.execute(f"SELECT {', '.join(found.columns)} FROM ({registry.ORACLE['scraped_tables']})").fetchall()
    rows = [tuple(r) for r in found.collect()]
    assert sorted(rows, key=repr) == sorted(wanted, key=repr)
    assert {r[found.columns.index("required")] for r in rows} == {True, False}
