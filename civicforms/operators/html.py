"""Procedure pages: from HTML to nested rows.

Only the HTML itself is read in Python, page by page in Arrow batches; everything
after it is Spark expressions over the nested result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicforms.functions.text import fold
from civicforms.functions.urls import absolute_url

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

# Known labels of a procedure page, folded, and the field each fills.
LABEL_KEYS = {
    "descriere procedura": "descriere",
    "cai de atac": "caiDeAtac",
    "date de contact": "dateContact",
    "institutia responsabila": "institutiaResponsabila",
    "modalitate prestare": "modalitatePrestare",
    "timp de solutionare": "timpSolutionare",
    "termen de arhivare": "termenArhivare",
    "termen de completare dosar": "termenCompletareDosar",
    "taxe": "taxe",
}
# Class of each table and its columns.
TABLES = {
    "documents": ("proc-viz-documenteintrare", ("nr", "name", "description", "required", "e_signature", "type", "href")),
    "output_documents": ("proc-viz-documenteiesire", ("nr", "name", "type", "href")),
    "laws": ("proc-viz-legi", ("nr", "name", "href")),
}
#: The sign of a character reference that no semicolon ends.
_BARE = re.compile(r"&(?!(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);)")
FLAGS, LINK, HEADER = {"required", "e_signature"}, "href", "tabel-header"
#: Pages whose parsed rows are held as Python objects at a time.
PAGES_AT_ONCE = 64


_NO_CLASSES: frozenset[str] = frozenset()

# Plain tags, which are read by one pattern: an end tag, or a start tag with plain attributes.
_SPACE = r"[ \t\n\r\f]"
_VALUE = r"""=(?:"([^"<>]*)"|'([^'<>]*)'|(/*[^\s"'<>=`&/]+(?:/+[^\s"'<>=`&/]+)*))"""
_ATTRIBUTE = re.compile(rf"{_SPACE}+([a-zA-Z][a-zA-Z0-9_-]*)(?:{_VALUE})?")
_PLAIN = re.compile(rf"</([a-zA-Z][a-zA-Z0-9]*){_SPACE}*>|<([a-zA-Z][a-zA-Z0-9]*)((?:{re.sub(r'[(](?![?])', '(?:', _ATTRIBUTE.pattern)})*){_SPACE}*>")
#: Tags whose content is no markup.
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"}


@lru_cache(maxsize=1024)
def _attributes(text: str) -> dict[str, str | None] | None:
    """Plain attributes by name, the last of equal ones; None if one holds a reference other than ``&amp;``, which is left to the parser."""
    found = {}
    for a in _ATTRIBUTE.finditer(text):
        name, double, single, bare = a.groups()
        value = double or single or bare or ("" if "=" in a[0] else None)
        if value and "&" in value:
            if value.count("&") != value.count("&amp;"):
                return None
            value = value.replace("&amp;", "&")
        found[name.lower()] = value
    return found


class _Node:
    __slots__ = ("tag", "attrs", "children", "classes")

    def __init__(self, tag: str, attrs: dict[str, str | None]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []
        classes = attrs.get("class")
        self.classes = set(classes.split()) if classes else _NO_CLASSES

    def walk(self) -> Iterator[_Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, _Node)]

    def first(self, tag: str, cls: str = "") -> _Node | None:
        return next((n for n in self.walk() if (not tag or n.tag == tag) and (not cls or cls in n.classes)), None)

    def pieces(self, breaks: bool = False) -> Iterator[str]:
        """Text in its order; with ``breaks`` also a line feed for each break and at the end of each block."""
        stack: list[_Node | str] = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                yield node
            elif breaks and node.tag == "br":
                yield "\n"
            else:
                if breaks and node.tag in ("p", "div"):
                    stack.append("\n")
                stack += reversed(node.children)

    def text(self) -> str:
        return "".join(self.pieces())

    def lines(self) -> str:
        """Text with breaks and block ends as line feeds, without empty lines."""
        if not self.children:
            return ""
        cleaned = (" ".join(line.split()) for line in "".join(self.pieces(breaks=True)).replace("\xa0", " ").split("\n"))
        return "\n".join(line for line in cleaned if line)


class _Tree(HTMLParser):
    """The nodes of a page, nested to any depth, and all of them in the order of their start tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.plant()

    def plant(self) -> None:
        self.root = _Node("", {})
        self.nodes = [self.root]
        self.open = [self.root]
        self.open_tags: Counter[str] = Counter()

    def read(self, html: str) -> None:
        """The whole page: plain markup by one pattern, any other by the parser."""
        if not self.read_plain(html):
            self.plant()
            self.feed(html)
            self.close()

    def read_plain(self, html: str) -> bool:
        """Read a page that is plain markup throughout; False, with an unfinished tree, if it is not."""
        at, end = 0, len(html)
        match, find, nodes, opened, tags = _PLAIN.match, html.find, self.nodes, self.open, self.open_tags
        children = opened[-1].children
        while at < end:
            start = find("<", at)
            if start != at:
                start = end if start < 0 else start
                data = html[at:start]
                children.append(unescape(data) if "&" in data else data)
                at = start
                continue
            token = match(html, at)
            if token is None:
                return False
            at = token.end()
            closing, opening, attributes = token.groups()
            if closing is not None:
                self.handle_endtag(closing.lower())
                children = opened[-1].children
                continue
            tag = opening.lower()
            attrs = _attributes(attributes) if attributes else {}
            if tag in _RAW or attrs is None:
                return False
            node = _Node(tag, attrs)
            nodes.append(node)
            children.append(node)
            if tag not in _VOID:
                opened.append(node)
                tags[tag] = tags.get(tag, 0) + 1
                children = node.children
        return True

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = _Node(tag, dict(attrs))
        self.nodes.append(node)
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)
            self.open_tags[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        node = _Node(tag, dict(attrs))
        self.nodes.append(node)
        self.open[-1].children.append(node)

    def handle_endtag(self, tag: str) -> None:
        closed, tags = None, self.open_tags
        while closed != tag and tags.get(tag):
            closed = self.open.pop().tag
            tags[closed] -= 1

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse_page(html: str, bare_references: bool = True) -> dict:
    """Title, error, notice, labels, values and tables of one page.

    Without ``bare_references``, character references that no semicolon ends stay as they are written.
    """
    tree = _Tree()
    tree.read(html if bare_references else _BARE.sub("&amp;", html))
    nodes = tree.nodes
    classed = [n for n in nodes if n.classes]
    title = next((n for n in classed if n.tag == "h1" and "page-title" in n.classes), None) or next((n for n in nodes if n.tag == "h1"), None)
    error = next((n for n in classed if "cssPanelEroare" in n.classes), None)
    notice = next((n.first("span") for n in classed if "procedura-informationala-notificare" in n.classes), None)
    out = {
        "title": (title.text().strip() or None) if title else None,
        "error": (error.lines() or None) if error else None,
        "notice": (notice.text().strip() or None) if notice else None,
        "labels": [n.text().strip() for n in classed if n.tag == "div" and "csslabelsmall" in n.classes],
        "field_values": [n.lines() for n in classed if n.tag == "div" and "csslabellarge" in n.classes],
        "links": [n.attrs["href"] or "" for n in nodes if n.tag == "a" and "href" in n.attrs],
        "paragraphs": sum(n.tag == "p" for n in nodes),
    }
    for name, (cls, columns) in TABLES.items():
        out[name] = [_row([c for c in r.children if isinstance(c, _Node)], columns) for r in rows_of(classed, cls) if HEADER not in r.classes]
    return out


def rows_of(classed: list[_Node], cls: str) -> list[_Node]:
    """All rows of the first table of a class."""
    table = next((n for n in classed if n.tag == "table" and cls in n.classes), None)
    body = table.first("tbody") if table else None
    return [n for n in (body or table or _Node("", {})).children if isinstance(n, _Node) and n.tag == "tr"]


def flag_of(cell: _Node) -> bool:
    return cell.first("", "glyphicon-ok") is not None


def link_of(cell: _Node) -> str | None:
    return next((n.attrs["href"] for n in cell.walk() if n.tag == "a" and n.attrs.get("href")), None)


def _row(cells: list[_Node], columns: tuple[str, ...]) -> dict:
    row = {}
    for k, name in enumerate(columns):
        cell = cells[k] if k < len(cells) else None
        if name in FLAGS:
            row[name] = cell is not None and flag_of(cell)
        elif name == LINK:
            row[name] = link_of(cell) if cell else None
        else:
            row[name] = cell.lines() if cell else None
    return row


def _table_type(columns: tuple[str, ...]) -> str:
    return "array<struct<" + ", ".join(f"{c}: {'boolean' if c in FLAGS else 'string'}" for c in columns) + ">>"


PAGE_TYPE = "title string, error string, notice string, labels array<string>, field_values array<string>, links array<string>, paragraphs int, " + ", ".join(f"{n} {_table_type(c)}" for n, (_, c) in TABLES.items())


def parse_pages(pages: DataFrame, bare_references: bool = True) -> DataFrame:
    """Pages (page_id, url, html) as nested rows (H1); null HTML gives a row without content."""
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], *T.StructType.fromDDL(PAGE_TYPE).fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, PAGES_AT_ONCE) for k in range(0, batch.num_rows, PAGES_AT_ONCE)):
                rows = [parse_page(h.as_py() or "", bare_references) for h in part.column("html")]
                parsed = [pa.array([r[f.name] for r in rows], f.type) for f in list(arrow)[2:]]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), *parsed], names=arrow.names)

    return pages.select("page_id", "url", "html").mapInArrow(run, schema)


def zip_label_values(parsed: DataFrame) -> DataFrame:
    """Labels and values paired up to the shorter list (H3)."""
    n = F.least(F.size("labels"), F.size("field_values"))
    pairs = F.arrays_zip(F.slice("labels", F.lit(1), n).alias("label"), F.slice("field_values", F.lit(1), n).alias("value"))
    return parsed.withColumn("raw_fields", F.transform(pairs, lambda p: F.struct(p["label"].alias("label"), p["value"].alias("value"))))


def label_key_map(raw_fields: Column) -> Column:
    """Known labels as a map from field to value; of equal ones the last counts."""
    keys = F.create_map(*[F.lit(x) for pair in LABEL_KEYS.items() for x in pair])
    pairs = F.filter(F.transform(raw_fields, lambda p: F.struct(F.element_at(keys, F.trim(fold(p["label"]))).alias("key"), p["value"].alias("value"))), lambda p: p["key"].isNotNull())
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def parse_procedures(pages: DataFrame, base_url: str, bare_references: bool = True) -> DataFrame:
    """Procedures of pages: fields by key, notice, status and documents with absolute links."""
    parsed = zip_label_values(parse_pages(pages, bare_references))
    documents = F.transform("documents", lambda d: d.withField("download_url", absolute_url(d["href"], base_url)).dropFields("href"))
    missing = F.col("title").isNull() & F.col("error").isNotNull()
    return parsed.withColumns({"fields": label_key_map(F.col("raw_fields")), "documents": documents, "informational": F.col("notice").isNotNull(), "status": F.when(missing, "missing").otherwise("ok")})


def flatten(procedures: DataFrame, column: str, key: str = "page_id") -> DataFrame:
    """One row for each element of a nested list, with its place; none for an empty list (H2)."""
    return procedures.select(key, F.posexplode(column).alias("pos", "item")).select(key, "pos", "item.*")


def empty_page_gate(pages: DataFrame, marker: str) -> DataFrame:
    """Pages with a status: ``ok`` where the marker occurs, ``empty`` where not (P20)."""
    return pages.withColumn("status", F.when(F.coalesce(F.col("html").contains(marker), F.lit(False)), "ok").otherwise("empty"))
