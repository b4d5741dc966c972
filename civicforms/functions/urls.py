"""Resolution of links by the URL standard, as far as addresses on the web need it."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the URL standard: schemes with a host and their ports, and what is coded in each part.
PORTS = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443"}
IN_PATH, IN_QUERY, IN_FRAGMENT = r"[^\x21\x24-\x3B\x3D\x40-\x5F\x61-\x7A\x7C\x7E%]", r"[^\x21\x24-\x26\x28-\x3B\x3D\x3F-\x7E%]", r"[^\x21\x23-\x3B\x3D\x3F-\x5F\x61-\x7E%]"
NOT_IN_HOST = r"[\x00-\x20#%/:<>?@\[\\\]^`{|}\x7F]"
HERE, UP = r"(?i)^(\.|%2e)$", r"(?i)^(\.|%2e){2}$"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _coded(text: Column, unsafe: str) -> Column:
    """Signs that may not stand in a part of an address, as percent codes of their bytes."""
    sign = lambda c: F.when(c.rlike(unsafe), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c)
    return F.when(text.rlike(unsafe), F.array_join(F.transform(F.split(text, ""), sign), "")).otherwise(text)


def plain_path(path: Column) -> Column:
    """A path from the root without dot segments: a stack of its segments, from which ``..`` takes the last."""
    parts = F.slice(F.split(path, "/"), 2, 1 << 30)
    marked = F.transform(parts, lambda s, i: F.struct(s.alias("s"), (i == F.size(parts) - 1).alias("last")))

    def step(stack: Column, part: Column) -> Column:
        up, here = part["s"].rlike(UP), part["s"].rlike(HERE)
        left = F.when(up, F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(stack)
        return F.when((up | here) & ~part["last"], left).when(up | here, F.concat(left, F.array(F.lit("")))).otherwise(F.concat(left, F.array(part["s"])))

    return F.concat(F.lit("/"), F.array_join(F.aggregate(marked, F.array().cast("array<string>"), step), "/"))


def _site(authority: Column, scheme: Column) -> Column:
    """``user@host:port`` made regular: a small host without the scheme's own port; null if it names no host."""
    user = F.regexp_extract(authority, r"^(.*@)?", 1)
    place = F.lower(F.regexp_extract(authority, r"^(?:.*@)?(.*)$", 1))
    host, port = F.regexp_replace(place, r":[0-9]*$", ""), F.regexp_extract(place, r":0*([0-9]*)$", 1)
    own = F.lit(False)
    for name, number in PORTS.items():
        own = own | ((scheme == name) & (port == number))
    six = host.rlike(r"^\[[0-9a-f:.]+\]$")
    wrong = (host == "") | (host.rlike(NOT_IN_HOST) & ~six) | (F.length(port) > 5) | (F.coalesce(port.try_cast("int"), F.lit(0)) > 65535)
    number = F.when((port == "") & ~place.rlike(":0+$") | own, "").otherwise(F.concat(F.lit(":"), F.when(port == "", "0").otherwise(port)))
    return F.when(~wrong, F.concat(user, host, number))


def absolute_url(c: Column | str, base: str) -> Column:
    """The address a link of a page at ``base`` leads to; null for an empty one and for what names no place.

    Follows the URL standard for dot segments, queries, fragments, back slashes, hosts, ports and percent
    codes.  Addresses without a host (``mailto:``, ``data:``) stay as they are; hosts are not turned into ASCII.
    """
    site = urlsplit(base)
    b_scheme, b_site, b_path = site.scheme, site.netloc.lower(), site.path or "/"
    b_query = f"?{site.query}" if site.query else ""
    column = F.col(c) if isinstance(c, str) else c
    href = F.regexp_replace(F.regexp_replace(column, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")

    def resolve(h: Column) -> Column:
        scheme = F.lower(F.regexp_extract(h, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
        after = F.when(scheme == "", h).otherwise(F.substring(h, F.length(scheme) + 2, F.length(h)))
        slashed = after.rlike(r"^[/\\]")
        relative = (scheme == "") | ((scheme == b_scheme) & ~slashed)
        known = (scheme == "") | scheme.isin(*PORTS)
        # With a scheme, however many slashes stand before the host; without one exactly two lead to a host.
        target = F.when(relative, after).otherwise(F.concat(F.lit("//"), F.regexp_replace(after, r"^[/\\]+", "")))
        own_scheme = F.when(scheme == "", F.lit(b_scheme)).otherwise(scheme)
        return F.when(known, _let(F.struct(target.alias("t"), own_scheme.alias("s")), placed)).otherwise(F.concat(scheme, F.lit(":"), after))

    def placed(x: Column) -> Column:
        body = F.regexp_extract(x["t"], r"(?s)^([^#]*)", 1)
        fragment = F.when(x["t"].contains("#"), F.concat(F.lit("#"), _coded(F.regexp_extract(x["t"], r"(?s)^[^#]*#(.*)$", 1), IN_FRAGMENT))).otherwise("")
        query = F.when(body.contains("?"), F.concat(F.lit("?"), _coded(F.regexp_extract(body, r"(?s)^[^?]*\?(.*)$", 1), IN_QUERY))).otherwise("")
        path = F.translate(F.regexp_extract(body, r"(?s)^([^?]*)", 1), "\\", "/")
        return _let(F.struct(path.alias("path"), query.alias("query"), fragment.alias("fragment"), x["s"].alias("scheme")), joined)

    def joined(x: Column) -> Column:
        path, has_host = x["path"], x["path"].startswith("//")
        named = F.regexp_replace(path, "^//+", "")
        where = F.when(has_host, _site(F.regexp_extract(named, r"(?s)^([^/]*)", 1), x["scheme"])).otherwise(F.lit(b_site))
        folder = b_path[: b_path.rindex("/") + 1]
        full = F.when(has_host, F.regexp_extract(named, r"(?s)^[^/]*(.*)$", 1)).when(path.startswith("/"), path).when(path == "", F.lit(b_path)).otherwise(F.concat(F.lit(folder), path))
        rooted = F.when(full == "", F.lit("/")).otherwise(full)
        query = F.when((path == "") & (x["query"] == ""), F.lit(b_query)).otherwise(x["query"])
        return F.concat(x["scheme"], F.lit("://"), where, _coded(plain_path(rooted), IN_PATH), query, x["fragment"])

    # A path from the root whose signs are all safe and that has no dot segment stays as it is.
    plain = column.startswith("/") & ~column.contains("//") & ~column.contains("/.") & ~column.rlike(r"[^A-Za-z0-9._~/\-]")
    return F.when(column.isNotNull() & (column != ""), F.when(plain, F.concat(F.lit(f"{b_scheme}://{b_site}"), column)).otherwise(_let(href, resolve)))
