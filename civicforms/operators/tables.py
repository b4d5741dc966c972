"""Rows of the tables of procedure pages, read from many pages at once.

Pages are cut at the ends of their rows, rows at the ends of their cells, cells at their tags, each by one
call of Arrow for all pages.  What depends on tags alone (whether they nest, which texts make a cell's lines,
its flag and link, the table of each row) is found once for each list of tags, by the tree of ``html``.
A page that is not plain markup, or whose rows and cells do not end all they begin, is left to ``parse_page``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from civicforms.operators.html import FLAGS, HEADER, LINK, PAGES_AT_ONCE, TABLES, _Node, _Tree, flag_of, link_of, parse_page, rows_of

#: Bytes of HTML that are read at a time, or one page.
BYTES_AT_ONCE = 8 << 20
#: The columns of all tables.
COLUMNS = tuple(dict.fromkeys(c for _, columns in TABLES.values() for c in columns))
#: Tags that tell which rows a table has.
_OF_TABLES = {"table", "tbody", "tr"}
#: References read by Arrow; all others by ``unescape``.
_SIGNS = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&nbsp;": "\xa0"}
#: What ``str.split`` takes for white space, but line feeds.
_WHITE = r"[\t\x0b\x0c\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_TAG, _TAG_OR_END = re.compile(r"<[^<>]*>"), re.compile(r"<[^<>]*>|>")


class _Fragment(_Tree):
    """The nodes of some markup, and whether each end tag ends the innermost open node."""

    def plant(self) -> None:
        super().plant()
        self.regular = True

    def handle_endtag(self, tag: str) -> None:
        self.regular = self.regular and self.open[-1].tag == tag
        super().handle_endtag(tag)


def _cells(tags: list[str]) -> list[tuple[list[int], bool, str | None]] | None:
    """Cells by their tags alone: the numbers of the texts that make their lines (text 0 is before the first tag; -1 is a line feed), flag and link.

    None for tags that are left to ``parse_page``.
    """
    tree = _Fragment()
    if not tree.read_plain("".join(f"{k}{tag}" for k, tag in enumerate(tags))) or not tree.regular or len(tree.open) > 1 or any(n.tag in _OF_TABLES for n in tree.nodes):
        return None
    return [([-1 if x == "\n" else int(x) for x in n.pieces(breaks=True)], flag_of(n), link_of(n)) for n in tree.root.children if isinstance(n, _Node)]


def _row_start(tag: str) -> int:
    """1 for a header, 0 for any other row, -1 if this is no plain tag of a row."""
    tree = _Fragment()
    return int(HEADER in tree.nodes[1].classes) if tree.read_plain(tag) and len(tree.nodes) == 2 and tree.nodes[1].tag == "tr" else -1


def _row_end(text: str) -> int:
    """What is behind the last cell that ends with a plain tag: 0 for text, 1 for other nodes, -1 if it is left to ``parse_page``."""
    if "<" not in text:
        return 0
    tags = _TAG.findall(text)
    return -1 if text.count("<") != len(tags) or _cells(tags) is None else 1


def _tags(text: str) -> str | None:
    """The tags alone; None if a sign is left that may begin one."""
    if "<" not in text:
        return ""
    tags = _TAG.findall(text)
    return "".join(tags) if text.count("<") == len(tags) else None


def _tables_of_rows(frame: str) -> list[int] | None:
    """Number of the table of each row, -1 for none, by the tags around rows with ``>`` for each row; None for tags that are left to ``parse_page``."""
    tree, rows = _Tree(), []
    for tag in _TAG_OR_END.findall(frame):
        if tag == ">":
            rows.append(_Node("tr", {}))
            tree.nodes.append(rows[-1])
            tree.open[-1].children.append(rows[-1])
        elif not tree.read_plain(tag):
            return None
    classed, numbers, found = [n for n in tree.nodes if n.classes], {id(r): k for k, r in enumerate(rows)}, [-1] * len(rows)
    for table, (cls, _) in enumerate(TABLES.values()):
        for row in rows_of(classed, cls):
            k = numbers.get(id(row))
            if k is None or found[k] >= 0:
                return None
            found[k] = table
    return found


def _kept(function: Callable, length: int = 512) -> Callable:
    """Results for short texts are remembered."""
    kept = lru_cache(maxsize=2048)(function)
    return lambda text: kept(text) if len(text) <= length else function(text)


_kept_cells = _kept(lambda tags: _cells([*(f"<{t}>" for t in tags.split("<")), "</td>"]))
_kept_start, _kept_end, _kept_tags, _kept_tables = _kept(lambda inner: _row_start(f"<tr{inner}>")), _kept(_row_end), _kept(_tags), _kept(_tables_of_rows, 4096)


def _split(texts: pa.Array, sign: str, most: int | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All pieces, the place of each text's first one and their number."""
    lists = pc.split_pattern(texts, sign, max_splits=most)
    offsets = lists.offsets.to_numpy()
    return lists.values, offsets[:-1], np.diff(offsets)


def _halves(texts: pa.Array, sign: str) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """What is before and behind the first such sign, and whether there is one."""
    pieces, at, n = _split(texts, sign, 1)
    return pieces.take(pa.array(at)), pieces.take(pa.array(at + n - 1)), n == 2


def _each(texts: pa.Array, function: Callable) -> tuple[list, np.ndarray]:
    """The function's value of each different text, and the number of each text's value."""
    coded = texts.dictionary_encode()
    return [function(x) for x in coded.dictionary.to_pylist()], coded.indices.to_numpy()


def _unescaped(texts: pa.Array) -> pa.Array:
    escaped = pc.match_substring(texts, "&")
    some = read = texts.filter(escaped)
    if not len(some):
        return texts
    for name, sign in _SIGNS.items():
        read = pc.replace_substring(read, name, sign)
    rest = pc.match_substring(pc.replace_substring(read, "&amp;", ""), "&")
    read = pc.replace_substring(read, "&amp;", "&")
    others = pa.array([unescape(x) for x in some.filter(rest).to_pylist()], pa.string())
    return pc.replace_with_mask(texts, escaped, pc.replace_with_mask(read, rest, others))


def _lines(texts: pa.Array) -> pa.Array:
    """Lines with single spaces and without empty ones, as ``_Node.lines`` has them."""
    some = pc.match_substring_regex(texts, r"[\t-\r\x1c-\x20]|[^\x00-\x7f]")
    read = pc.replace_substring_regex(texts.filter(some), _WHITE, " ")
    return pc.replace_with_mask(texts, some, pc.utf8_trim(pc.replace_substring_regex(read, r"[ \n]*\n[ \n]*", "\n"), " \n"))


def _read_cells(cells: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array, np.ndarray]:
    """Lines, flag and link of each cell, and how many cells it is: -1 if it is left to ``parse_page``."""
    pieces, first, n = _split(cells, "<")
    inner = np.ones(len(pieces), bool)
    inner[first] = False
    tags, texts, ended = _halves(pieces.filter(pa.array(inner)), ">")
    begin = np.concatenate([[0], np.cumsum(n - 1)])
    shapes, shape = _each(pc.binary_join(pa.ListArray.from_arrays(pa.array(begin, pa.int32()), tags), "<"), _kept_cells)
    number = np.array([-1 if s is None else len(s) for s in shapes], np.int64)[shape]
    number[np.repeat(np.arange(len(cells)), n - 1)[~ended]] = -1
    ones = [s[0] if s and len(s) == 1 else ([], False, None) for s in shapes]
    # The texts of all cells, one after another: each is a text of its cell or a line feed.
    sizes = np.array([len(s[0]) for s in ones], np.int64)
    flat, place = np.array([x for s in ones for x in s[0]], np.int64), np.cumsum(sizes) - sizes
    size = sizes[shape]
    ends = np.cumsum(size)
    op = flat[np.repeat(place[shape] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
    which = np.where(op < 0, len(texts), np.repeat(begin[:-1], size) + op - 1)
    joined = pa.concat_arrays([_unescaped(texts), pa.array(["\n"])]).take(pa.array(which))
    lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), joined), "")
    return _lines(lines), np.array([s[1] for s in ones], bool)[shape], pa.array([s[2] for s in ones], pa.string()).take(pa.array(shape)), number


def read_rows(html: pa.Array) -> tuple[list[tuple[str, np.ndarray, np.ndarray, list[pa.Array]]], np.ndarray]:
    """For each table the number of each row's page, its place and the columns; and which pages are left to ``parse_page``."""
    left = np.zeros(len(html), bool)
    parts, first, n = _split(html, "</tr>")
    page = np.repeat(np.arange(len(html)), n)
    last = np.zeros(len(parts), bool)
    last[first + n - 1] = True
    frame, body, begun = _halves(parts, "<tr")
    left[page[begun == last]] = True
    row = np.flatnonzero(begun & ~last)
    page_of = page[row]

    start, rest, ended = _halves(body.take(pa.array(row)), ">")
    left[page_of[~ended]] = True
    kinds, kind = _each(start, _kept_start)
    header = np.array(kinds, np.int64)[kind]
    pieces, at, size = _split(rest, "</td>")
    kinds, kind = _each(pieces.take(pa.array(at + size - 1)), _kept_end)
    end = np.array(kinds, np.int64)[kind]
    left[page_of[(header < 0) | (end < 0) | (end > 0) & (header == 0)]] = True

    inner = np.ones(len(pieces), bool)
    inner[at + size - 1] = False
    size = size - 1
    begin = np.cumsum(size) - size
    coded = pieces.filter(pa.array(inner)).dictionary_encode()
    lines, flags, links, numbers = _read_cells(coded.dictionary)
    cell = coded.indices.to_numpy()
    number, row_of = numbers[cell], np.repeat(np.arange(len(row)), size)
    left[page_of[row_of[(number < 0) | (number != 1) & (header[row_of] == 0)]]] = True

    found, which = _each(frame, _kept_tags)
    frames = pa.ListArray.from_arrays(pa.array(np.append(first, len(parts)), pa.int32()), pa.array(found, pa.string()).take(pa.array(which)))
    keys = pc.binary_join(frames, ">").fill_null("<")
    found, which = _each(keys, lambda key: None if key == "<" else _kept_tables(key))
    left[np.array([f is None for f in found], bool)[which]] = True
    sizes = np.array([len(f or ()) for f in found], np.int64)
    flat, place = np.array([x for f in found for x in f or ()], np.int64), np.cumsum(sizes) - sizes
    read = np.flatnonzero(~left[page_of] & (header == 0))
    table = flat[place[which[page_of[read]]] + row[read] - first[page_of[read]]]

    out = []
    for k, (name, (_, columns)) in enumerate(TABLES.items()):
        rows = read[table == k]
        pages, count = page_of[rows], np.arange(len(rows))
        places = count - np.maximum.accumulate(np.where(np.diff(pages, prepend=-1) != 0, count, 0)) if len(rows) else count
        values = []
        for column in COLUMNS:
            if column not in columns:
                values.append(pa.nulls(len(rows), pa.bool_() if column in FLAGS else pa.string()))
                continue
            c = columns.index(column)
            there = size[rows] > c
            own = np.zeros(len(rows), np.int64)
            own[there] = cell[begin[rows[there]] + c]
            if column in FLAGS:
                value = np.zeros(len(rows), bool)
                value[there] = flags[own[there]]
                values.append(pa.array(value))
            else:
                values.append((links if column == LINK else lines).take(pa.array(own, mask=~there)))
        out.append((name, pages, places, values))
    return out, left


def _portions(html: pa.Array) -> Iterator[tuple[int, int]]:
    """Begin and number of pages that are read at a time."""
    ends, begin = np.cumsum(pc.binary_length(html).to_numpy().astype(np.int64)), 0
    while begin < len(html):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + BYTES_AT_ONCE, "right")))
        yield begin, end - begin
        begin = end


def table_rows(pages: DataFrame) -> DataFrame:
    """One row for each row of the tables of pages (page_id, html): its table, its place there and the columns of all tables, null where its table has none (H1, H2)."""
    schema = T.StructType([pages.schema["page_id"], T.StructField("part", T.StringType()), T.StructField("place", T.LongType()), *(T.StructField(c, T.BooleanType() if c in FLAGS else T.StringType()) for c in COLUMNS)])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(ids, numbers, names, places, columns):
            values = [ids.take(pa.array(numbers, pa.int64())), names, pa.array(places, pa.int64()), *columns]
            return pa.RecordBatch.from_arrays([v.cast(f.type) for v, f in zip(values, arrow, strict=True)], names=arrow.names)

        for batch in batches:
            every = batch.column("html").cast(pa.string()).fill_null("")
            for begin, number in _portions(every):
                html, ids = every.slice(begin, number), batch.column("page_id").slice(begin, number)
                tables, left = read_rows(html)
                for name, numbers, places, columns in tables:
                    if len(numbers):
                        yield batch_of(ids, numbers, pa.repeat(pa.scalar(name), len(numbers)), places, columns)
                others = np.flatnonzero(left)
                for k in range(0, len(others), PAGES_AT_ONCE):
                    rows = [(int(p), name, place, *map(r.get, COLUMNS)) for p in others[k : k + PAGES_AT_ONCE] for page in [parse_page(html[p].as_py())] for name in TABLES for place, r in enumerate(page[name])]
                    if rows:
                        numbers, names, places, *columns = zip(*rows, strict=True)
                        yield batch_of(ids, numbers, pa.array(names), places, [pa.array(v, f.type) for v, f in zip(columns, list(arrow)[3:], strict=True)])

    return pages.select("page_id", "html").mapInArrow(run, schema)
