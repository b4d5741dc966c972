"""Which county an institution, template or procedure belongs to.

Lookup tables are small and fixed (below 200 rows), so they are broadcast.  Names
are resolved once each: distinct (organisation, city) pairs first, then joined back.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicforms.functions import rules
from civicforms.functions.text import any_match, fold, java_pattern

CAPITAL = "Bucuresti"
TEMPLATE_NATIONAL = "Național / Necunoscut"
PROCEDURE_NATIONAL = "Național"
# Fixed value: how names say a sector of the capital.
SECTOR = r"\bSector(?:ul|ului)?\s*\d\b|\bSector\s+\d\b"


def _plain(s: str) -> str:
    """``fold`` for the constants of the lookup tables."""
    return "".join(c for c in unicodedata.normalize("NFD", s) if not 0x300 <= ord(c) <= 0x36F).lower()


def _map(pairs: list[tuple[str, str]]) -> Column:
    """A literal map; of equal keys the last counts."""
    last = dict(pairs)
    return F.create_map(*[F.lit(x) for pair in last.items() for x in pair])


def canonicalize_county(c: Column) -> Column:
    """The county a text names exactly, whatever its case and accents (R2)."""
    return F.element_at(_map([(_plain(x), x) for x in rules.COUNTIES]), fold(c))


def _first_of(hay: Column, patterns: list[str], keys: list[str], values: list[str], key: Callable[[Column], Column] = lambda m: m) -> Column:
    """The value of the first pattern in the list that occurs as words.

    One search finds, at every place, the first pattern that matches there; looking
    ahead lets matches overlap, so none is hidden by another.
    """
    first = {k: i for i, k in reversed(list(enumerate(keys)))}
    rank = _map([(k, i) for k, i in first.items()])
    found = F.regexp_extract_all(hay, F.lit(java_pattern(rf"\b(?=((?:{'|'.join(patterns)})\b))")), 1)
    best = F.array_min(F.transform(found, lambda m: F.element_at(rank, key(m))))
    return F.when(F.size(found) > 0, F.element_at(F.array(*[F.lit(v) for v in values]), best + 1))


def derive_county_from_text(c: Column) -> Column:
    """The first county, in list order, that occurs as words in a text; dash and blank are one.

    The search for words runs only over texts that hold a name's first word as letters at all.
    """
    plain = [_plain(x) for x in rules.COUNTIES]
    dashed = lambda m: F.regexp_replace(m, r"[-\s]+", "-")
    search = lambda f: _first_of(f, [re.sub(r"[-\s]+", r"[-\\s]+", x) for x in plain], [re.sub(r"[-\s]+", "-", x) for x in plain], list(rules.COUNTIES), dashed)
    firsts = dict.fromkeys(re.split(r"[-\s]", x)[0] for x in plain)
    some = lambda f: reduce(or_, (f.contains(w) for w in firsts))
    return F.element_at(F.transform(F.array(fold(c)), lambda f: F.when(some(f), search(f))), 1)


def is_national(c: Column) -> Column:
    """Whether a name is that of a nationwide institution."""
    return F.coalesce(any_match(c, rules.NATIONAL), F.lit(False))


def _by_length() -> list[tuple[str, str]]:
    return sorted(rules.PLACES, key=lambda p: -len(p[0]))  # stable: ties keep the table's order


def derive_county_from_org(org: Column, city: Column, skip_national: bool = False) -> Column:
    """The county of an institution: exact name, sector, city, nationwide pattern, longest place in its name."""
    plain, hay, places = _plain, fold(org), _by_length()
    by_city = F.coalesce(F.element_at(_map(rules.PLACES), city), F.element_at(_map([(plain(k), v) for k, v in reversed(places)]), fold(city)))
    token = _first_of(hay, [re.escape(plain(k)) for k, _ in places], [plain(k) for k, _ in places], [v for _, v in places])
    steps = [
        F.element_at(_map([(plain(k), v) for k, v in rules.INSTITUTIONS]), hay),
        F.when(org.rlike(java_pattern(SECTOR, False)), F.lit(CAPITAL)),
        F.when(city != "", by_city),
    ]
    if not skip_national:
        steps.append(F.when(is_national(org), F.lit(CAPITAL)))
    return F.when(org != "", F.coalesce(*steps, token))


def resolve_once(df: DataFrame, keys: list[str], **derived: Column) -> DataFrame:
    """Add columns that depend on ``keys`` alone, computed once for each distinct value of them."""
    known = df.select(*keys).distinct().withColumns(derived)
    matched = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    condition = matched[0]
    for m in matched[1:]:
        condition = condition & m
    return df.alias("l").join(known.alias("r"), condition, "left").select("l.*", *[f"r.{c}" for c in derived])


def with_org_county(df: DataFrame, skip_national: bool = False, name: str = "county_of_org") -> DataFrame:
    """Resolve ``organization`` and ``city``."""
    return resolve_once(df, ["organization", "city"], **{name: derive_county_from_org(F.col("organization"), F.col("city"), skip_national)})


def _tagged(county: Column, national: str) -> Column:
    """A county that was given: nationwide tag, canonical name, county within the text, or the text itself."""
    raw = F.trim(county)
    return F.when(fold(raw) == "national", F.lit(national)).otherwise(F.coalesce(canonicalize_county(raw), derive_county_from_text(raw), raw))


def template_county(county: Column, org: Column, name: Column) -> Column:
    """County bucket of a template."""
    told = F.concat(F.coalesce(org, F.lit("")), F.lit(" "), F.coalesce(name, F.lit("")))
    derived = F.coalesce(derive_county_from_org(org, F.lit(None).cast("string")), derive_county_from_text(told), F.lit(TEMPLATE_NATIONAL))
    return F.when(county != "", _tagged(county, TEMPLATE_NATIONAL)).otherwise(derived)


def procedure_county(county: Column, institution: Column, city: Column, responsible: Column) -> Column:
    """County bucket of a procedure (R5): nationwide institutions are kept apart from their seat."""
    derived = F.coalesce(
        derive_county_from_org(institution, city, skip_national=True),
        F.when(is_national(institution), F.lit(PROCEDURE_NATIONAL)),
        derive_county_from_text(responsible),
        F.lit(PROCEDURE_NATIONAL),
    )
    return F.when(county != "", _tagged(county, PROCEDURE_NATIONAL)).otherwise(derived)


def with_template_county(df: DataFrame) -> DataFrame:
    """Add ``county_bucket`` to templates (county, organization, name)."""
    return resolve_once(df, ["county", "organization", "name"], county_bucket=template_county(F.col("county"), F.col("organization"), F.col("name")))


def with_procedure_county(df: DataFrame) -> DataFrame:
    """Add ``county_bucket`` to procedures (county, institution, city, responsible)."""
    keys = ["county", "institution", "city", "responsible"]
    return resolve_once(df, keys, county_bucket=procedure_county(*[F.col(k) for k in keys]))


# Names of town halls, councils and prefectures.
_CITY = ((r"^Primaria\s+Municipiului\s+(.+)$", "municipiu"), (r"^Primaria\s+Orasului\s+(.+)$", "oras"), (r"^Primaria\s+Comunei\s+(.+)$", "comuna"))
_SECTOR_CITY = r"^Primaria\s+Sectorului\s+(\d+)\s+(.+)$"
_COUNTY = (r"^Consiliul\s+Judetean\s+(.+)$", r"^Prefectura\s+Judetului\s+(.+)$")
_CAPITAL_PREFECTURE = r"^Prefectura\s+Municipiului\s+Bucuresti$"


def parse_institution(raw: Column) -> dict[str, Column]:
    """institution, city, county and locality_type that a name tells."""
    name = F.trim(raw)
    part = lambda p, k=1: F.when(name.rlike(f"(?iu){p}"), F.regexp_extract(name, f"(?iu){p}", k))
    cities = [F.trim(F.regexp_replace(part(p), r"\s*-\s*[A-Za-z0-9_]+$", "")) for p, _ in _CITY]
    sector = name.rlike(f"(?iu){_SECTOR_CITY}")
    is_city = [name.rlike(f"(?iu){p}") for p, _ in _CITY]
    any_city = is_city[0] | is_city[1] | is_city[2] | sector
    is_county = name.rlike(f"(?iu){_COUNTY[0]}") | name.rlike(f"(?iu){_COUNTY[1]}") | name.rlike(f"(?iu){_CAPITAL_PREFECTURE}")
    county = F.when(~any_city & is_county, F.coalesce(part(_COUNTY[0]), part(_COUNTY[1]), F.lit(CAPITAL)))
    county = F.coalesce(F.when(~is_city[0] & ~is_city[1] & ~is_city[2], part(_SECTOR_CITY, 2)), county)
    ends = sorted([*rules.COUNTIES, *rules.SUFFIX_SPELLINGS], key=lambda x: -len(x))
    by_end = F.coalesce(*[F.when(name.endswith(x) | name.endswith(x.replace("-", " ")), F.lit(x)) for x in ends])
    kind = F.lit(None).cast("string")
    kind = F.when(is_city[0], "municipiu").when(is_city[1], "oras").when(is_city[2], "comuna").when(sector, "sector").when(is_county, "judet").otherwise(kind)
    return {
        "institution": name,
        "city": F.coalesce(*cities, F.when(sector, F.concat(F.lit("Sector "), part(_SECTOR_CITY)))),
        "county": F.coalesce(county, by_end),
        "locality_type": kind,
    }
