"""Pages of plain markup, which one pattern reads, against the parser."""

import random

import pytest

from civicforms.operators.html import _Tree

ROW = "<tr class='a b'><td>1<td nowrap>x &amp;  &lt;m&gt;\n <b>r</b>&nbsp;2</td><br><td><a class=x href='/f?a=1&amp;b=2'>f</a></TD></tr>"
BITS = ["<", "</", ">", "/>", "&", "&amp", "&copy", "=", "'", '"', " ", "\n", "\xa0", "/", "<br>", "</p>", "<a href=x/>", "<a href=/y/z>", "<a href= x>", "<a href=>", "<a href='?a&b'>", "<!--x-->", "<i a=1 A=2 c>", "<title>", "</ td>", "<td/>", "\x00"]


def nodes(tree):
    shape = lambda n: n if isinstance(n, str) else (n.tag, n.attrs, sorted(n.classes), merged(n.children))

    def merged(children):
        out = []
        for c in map(shape, children):
            if isinstance(c, str) and out and isinstance(out[-1], str):
                out[-1] += c
            else:
                out.append(c)
        return out

    assert list(tree.root.walk()) == tree.nodes
    return shape(tree.root)


def parsed(html):
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return nodes(tree)


def test_plain_markup_is_read_without_the_parser():
    tree = _Tree()
    assert tree.read_plain(ROW * 3)
    assert nodes(tree) == parsed(ROW * 3)


@pytest.mark.parametrize("seed", range(4))
def test_any_markup_is_read_as_by_the_parser(seed):
    r = random.Random(seed)
    plain = 0
    for _ in range(2_000):
        html = ROW[: r.randrange(len(ROW) + 1)]
        for _ in range(r.randrange(4)):
            at = r.randrange(len(html) + 1)
            html = html[:at] + r.choice(BITS) + html[at:]
        plain += _Tree().read_plain(html)
        tree = _Tree()
        tree.read(html)
        assert nodes(tree) == parsed(html), html
    assert plain > 200
