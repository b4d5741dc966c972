"""Scalar text functions: Spark column expressions, all JVM-side."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def java_pattern(pattern: str, case_matters: bool = True) -> str:
    r"""A JavaScript pattern for Spark: ``\b`` between ASCII word characters only, ``\s`` with no-break space."""
    out = pattern.replace(r"\b", _EDGE)
    return out if case_matters else "(?iu)" + out


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Characters whose canonical decomposition is one base character and combining marks U+0300-036F, and the bases."""
    source, target = [], []
    for point in range(0xC0, 0x2000):
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(point)) if not 0x300 <= ord(c) <= 0x36F)
        if len(plain) == 1 and plain != chr(point):
            source.append(chr(point))
            target.append(plain)
    return "".join(source), "".join(target)


def fold(c: Column | str) -> Column:
    """Lower case without accents (F1)."""
    source, target = _accents()
    return F.lower(F.regexp_replace(F.translate(col(c), source, target), "[̀-ͯ]", ""))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def collapse(c: Column | str) -> Column:
    """Runs of white space to one blank, trimmed (F2)."""
    return F.trim(F.regexp_replace(col(c), r"[\s ]+", " "))


def sanitize_filename(c: Column | str) -> Column:
    """A name without the characters that file systems reject, at most 200 long."""
    return F.substring(collapse(F.regexp_replace(col(c), r'[<>:"/\\|?*]', "_")), 1, 200)


def sanitize_folder(c: Column | str) -> Column:
    """A folder name: no control characters, slashes as dashes."""
    plain = F.regexp_replace(col(c), r"[\x00-\x1f\x7f]", "")
    return F.substring(collapse(F.regexp_replace(plain, r"[\\/]", " - ")), 1, 200)


def doc_id_from_stem(c: Column | str) -> Column:
    """The digits after the last underscore of a file stem."""
    return blank_to_null(F.regexp_extract(col(c), r"_(\d+)$", 1))


def template_name_from_stem(c: Column | str) -> Column:
    """A readable name from a file stem."""
    return F.trim(F.replace(F.regexp_replace(col(c), r"_\d+$", ""), F.lit("_"), F.lit(" ")))


def organization_from_path(c: Column | str) -> Column:
    """The folder that holds a file."""
    parts = F.split(col(c), "/")
    return F.when((col(c) != "") & (F.size(parts) >= 2), F.element_at(parts, -2))


def split_progress_key(c: Column | str) -> tuple[Column, Column]:
    """(bundle, stem) of a key, cut at its first slash; without one all of it is the stem (F8)."""
    at = F.locate("/", col(c))
    return F.when(at > 0, F.substring_index(col(c), "/", 1)), F.when(at > 0, F.substring(col(c), at + 1, F.length(col(c)))).otherwise(col(c))


def normalize_url(c: Column | str) -> Column:
    """Trim and decode escapes as decodeURI does: reserved signs stay coded, a broken escape leaves all as it is."""
    plain = F.trim(col(c))
    kept = F.regexp_replace(plain, r"(?i)%(2F|3F|23|26|3D|2B|2C|24|3A|3B|40)", "%25$1")
    decoded = F.try_url_decode(F.replace(kept, F.lit("+"), F.lit("%2B")))
    return F.when(decoded.isNull() | decoded.contains("�"), plain).otherwise(decoded)


def html_to_lines(c: Column | str) -> Column:
    """Text of an HTML fragment: breaks and block ends as line feeds, blanks collapsed, empty lines dropped."""
    text = F.regexp_replace(col(c), r"(?i)<br\s*/?>|</(?:p|div)\s*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", "")
    for name, sign in (("&nbsp;", " "), (" ", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def contact_block(c: Column | str) -> Column:
    """``key: value`` lines as a map with lower-case keys; of equal keys the last counts."""
    lines = F.filter(F.split(col(c), "\n"), lambda x: x.rlike(r"^\s*[^:]+:"))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("key"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def phone_href(c: Column | str) -> Column:
    """First number of a list, without blanks."""
    return F.regexp_replace(F.element_at(F.split(col(c), "[/,]"), 1), r"\s", "")


def to_field_name(c: Column | str) -> Column:
    """A label as an identifier of at most 50 signs."""
    plain = F.regexp_replace(fold(c), r"[^a-z0-9]+", "_")
    return F.substring(F.regexp_replace(plain, r"^_|_$", ""), 1, 50)


# Label patterns of each kind of field (JavaScript; True where case matters), most length, placeholder.  First match wins.
FIELD_PATTERNS = (
    ("cnp", ((r"\bCNP\b", False), (r"\bCod\s+numeric\s+personal\b", False), (r"\bNIF\b", False)), 13, "_ _ _ _ _ _ _ _ _ _ _ _ _"),
    ("date", ((r"\bdata\b", False), (r"\bla\s+data\b", False), (r"\bdin\s+data\b", False), (r"\bdata\s+nasterii\b", False), (r"\bnascut.*la\b", False)), None, "ZZ.LL.AAAA"),
    ("email", ((r"\be-?mail\b", False), (r"\badresa\s+electronic", False)), None, "exemplu@email.ro"),
    ("phone", ((r"\btelefon\b", False), (r"\btel\.\b", False), (r"\btel\/fax\b", False), (r"\bfax\b", False), (r"\bnr\.\s*tel", False)), None, "07XX XXX XXX"),
    ("iban", ((r"\bIBAN\b", False), (r"\bCont\s+IBAN\b", False)), 24, "ROXX XXXX XXXX XXXX XXXX XXXX"),
    ("cui", ((r"\bCUI\b", True), (r"\bCIF\b", True), (r"\bCod\s+fiscal\b", False), (r"\bCod\s+unic\b", False)), 10, None),
    ("seria_nr", ((r"\bseria\b", False), (r"\bnr\.\s*carte", False), (r"\bCI\s+seria\b", False), (r"\bBI\s+seria\b", False)), None, None),
    ("judet", ((r"\bjude[tț]ul?\b", False), (r"\bjud\.\b", False)), None, None),
    ("localitate", ((r"\blocalitat", False), (r"\bora[sș]ul?\b", False), (r"\bmunicipiul?\b", False), (r"\bcomuna\b", False), (r"\bsatul?\b", False)), None, None),
    ("adresa", ((r"\badresa\b", False), (r"\bdomicili", False), (r"\bstr\.\b", False), (r"\bstrada\b", False), (r"\bbloc\b", False)), None, None),
    ("nume", ((r"\bnumele?\b", False), (r"\bnume\s+[sș]i\s+prenume\b", False)), None, None),
    ("prenume", ((r"\bprenumele?\b", False),), None, None),
    ("signature", ((r"\bsemn[aă]tur", False),), None, None),
)
# Texts that are no labels.
SKIP_PATTERNS = ((r"^Pag\.\s*\d", False), (r"^ANEX[AĂ]", False), (r"^Not[eaă]\s*:", False), (r"^\(\d+\)", True), (r"^MONITORUL\s+OFICIAL", False), (r"^NECLASIFICAT", False))


def any_match(c: Column | str, patterns: tuple[tuple[str, bool], ...]) -> Column:
    """Whether any of the patterns is found."""
    found = F.lit(False)
    for pattern, case_matters in patterns:
        found = found | col(c).rlike(java_pattern(pattern, case_matters))
    return found


def match_pattern(c: Column | str) -> Column:
    """The first kind of field whose patterns match a label: struct of id, max_length, placeholder; null if none."""
    out = None
    for name, patterns, most, shown in FIELD_PATTERNS:
        value = F.struct(F.lit(name).alias("id"), F.lit(most).cast("int").alias("max_length"), F.lit(shown).cast("string").alias("placeholder"))
        hit = any_match(c, patterns)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def is_skip_label(c: Column | str) -> Column:
    """Whether a text is a page number, annex or note rather than a label (F16)."""
    return any_match(F.trim(col(c)), SKIP_PATTERNS)


def _share(c: Column, kept: str) -> Column:
    return F.length(F.regexp_replace(c, f"[^{kept}]", "")) / F.length(c)


READABLE = r"a-zA-ZăâîșțĂÂÎȘȚşţŞŢ0-9\s.,;:!?()/\-'\"_@#%&*+="


def is_readable(c: Column | str) -> Column:
    """More than 0.6 of the signs are letters, digits or common signs (F17, stream variant)."""
    return F.coalesce((F.length(col(c)) > 0) & (_share(col(c), READABLE) > 0.6), F.lit(False))


def is_readable_ocr(c: Column | str) -> Column:
    """At least two signs and 0.6 of them readable (F17, raster variant)."""
    return F.coalesce((F.length(col(c)) >= 2) & (_share(col(c), r"\p{L}\p{N} .,:;?!()/\-'\"") >= 0.6), F.lit(False))


def is_placeholder(c: Column | str) -> Column:
    """Shorter than two signs, or more than 0.4 of them leaders (F18, stream variant)."""
    plain = F.trim(col(c))
    return (F.length(plain) < 2) | (_share(plain, r"._\-…") > 0.4)


def is_placeholder_ocr(c: Column | str) -> Column:
    """At least four signs, more than 0.7 of them leaders (F18, raster variant)."""
    plain = F.trim(col(c))
    return (F.length(plain) >= 4) & (_share(plain, "._⋯…¨ ") > 0.7)


def clean_label(c: Column | str) -> Column:
    """Without trailing signs and one leading number (F19, stream variant)."""
    return F.trim(F.regexp_replace(F.regexp_replace(collapse(c), r"[:;,.\s]+$", ""), r"^\d+[.)]\s*", ""))


def clean_label_ocr(c: Column | str) -> Column:
    """Without leading numbers, however many, and trailing signs (F19, raster variant)."""
    return F.trim(F.regexp_replace(F.regexp_replace(collapse(c), r"^(?:\d+[.)]\s*)+", ""), r"[ :;,.…]+$", ""))


def prettify_field_name(c: Column | str) -> Column:
    """A readable label from a field name: its last dotted part, words apart, each with a capital."""
    last = F.element_at(F.split(col(c), r"\."), -1)
    apart = F.regexp_replace(F.regexp_replace(last, r"[_\-]", " "), r"([a-z])([A-Z])", "$1 $2")
    words = F.split(apart, r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])")
    return F.trim(F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), ""))


def xml_escape(c: Column | str) -> Column:
    """Markup signs as entities."""
    out = col(c)
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out


def html_escape(c: Column | str) -> Column:
    """Markup signs as entities, apostrophes as they are."""
    return F.replace(xml_escape(c), F.lit("&apos;"), F.lit("'"))


def page_title(name: Column, organization: Column, site: str) -> Column:
    """Title of a template's page."""
    return F.concat(name, F.when(organization != "", F.concat(F.lit(" — "), organization)).otherwise(""), F.lit(f" | {site}"))


def page_description(name: Column, organization: Column, county: Column) -> Column:
    """Description of a template's page."""
    # The words of the description.
    issued = F.when(organization != "", F.concat(F.lit(" emis de "), organization)).otherwise("")
    place = F.when(county != "", F.concat(F.lit(" ("), county, F.lit(")"))).otherwise("")
    return F.concat(F.lit("Completați online formularul „"), name, F.lit('"'), issued, place, F.lit(". Descărcați PDF-ul gata de imprimat sau de transmis prin canalele oficiale."))


def json_ld(name: Column, organization: Column, county: Column, url: Column) -> Column:
    """A linked-data record of a template; missing parts are left out."""
    typed = lambda kind, c: F.when(c != "", F.struct(F.lit(kind).alias("@type"), c.alias("name")))
    record = F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("DigitalDocument").alias("@type"), name.alias("name"),
        page_description(name, organization, county).alias("description"), F.lit("ro").alias("inLanguage"), F.lit(True).alias("isAccessibleForFree"),
        F.lit("application/pdf").alias("fileFormat"), url.alias("url"),
        typed("GovernmentOrganization", organization).alias("publisher"), typed("AdministrativeArea", county).alias("spatialCoverage"),
    )
    return F.to_json(record)


def to_iso_string(c: Column | str) -> Column:
    """ISO form of a time given as text or as seconds; null if neither (F32)."""
    text = col(c).cast("string")
    seconds = F.when(text.rlike(r"^-?\d+(\.\d+)?$"), F.timestamp_seconds(text.cast("double")))
    return F.date_format(F.coalesce(seconds, F.try_to_timestamp(text)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_date(c: Column | str) -> Column:
    """Date part of an ISO time."""
    return F.substring(col(c), 1, 10)


def normalize_comment(c: Column | str) -> Column:
    """Trimmed, at most 1000 signs, null if empty."""
    return blank_to_null(F.substring(F.trim(col(c)), 1, 1000))
