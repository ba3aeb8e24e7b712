"""Plain text out of HTML, and small string rules, as columns of built-in functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
ENTITIES = (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("middot", "·"), ("hellip", "…"), ("ndash", "–"), ("mdash", "—"), ("lsquo", "‘"), ("rsquo", "’"), ("ldquo", "“"), ("rdquo", "”"), ("amp", "&"))
#: Elements whose content is never shown, and elements that begin and end lines.
HIDDEN = ("noscript", "script", "style", "svg", "template")
LINES = ("article", "blockquote", "br", "div", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "header", "li", "ol", "p", "pre", "section", "table", "tr", "ul")
#: Characters that are no text. And white space at the ends of a line (Java's classes).
_CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\u200B\uFEFF]"
_ENDS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: An entity: a name, or a number in decimal or hexadecimal digits.
_ENTITY = r"&(?:#[xX][0-9a-fA-F]+|#[0-9]+|[a-zA-Z]+);"


def _interleaved(pieces: Column, between: Column) -> Column:
    """Pieces of a text that was split, joined with what stands between them."""
    return F.array_join(F.flatten(F.transform(F.arrays_zip(pieces.alias("piece"), between.alias("mark")), lambda x: F.array(x["piece"], F.coalesce(x["mark"], F.lit(""))))), "")


def _entity(found: Column) -> Column:
    """The character of an entity; one that names none stays."""
    body = F.substring(found, 2, F.length(found) - 2)
    hexa = F.lower(F.substring(body, 2, 1)) == "x"
    digits = F.ltrim(F.substring(body, F.when(hexa, 3).otherwise(2), F.length(body)), F.lit("0"))
    code = F.when(F.length(digits) <= 8, F.when(hexa, F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint"))
    good = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    number = F.when(good, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    names = F.create_map(*[F.lit(x) for pair in ENTITIES for x in pair])
    return F.coalesce(F.when(body.startswith("#"), number).otherwise(F.try_element_at(names, F.lower(body))), found)


def decode_entities(text: Column) -> Column:
    """Named (in either case) and numeric entities, in one pass, so that nothing is decoded twice; unknown ones stay."""

    def decoded(t: Column) -> Column:
        return _interleaved(F.split(t, _ENTITY, -1), F.transform(F.regexp_extract_all(t, F.lit(_ENTITY), F.lit(0)), _entity))

    return once(text, lambda t: F.when(F.contains(t, F.lit("&")), decoded(t)).otherwise(t))


def _tidy_lines(text: Column) -> Column:
    """Lines without control characters, with single blanks and none at their ends; empty lines go."""
    lines = F.transform(F.split(F.regexp_replace(text, _CONTROLS, ""), "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, "[ \t\u00A0]+", " "), _ENDS, ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def _shown(text: Column, hidden: tuple[str, ...], lines: tuple[str, ...]) -> Column:
    """A text without markup: what lies between the tags, with a line end for a tag in ``lines`` and a blank for any other.
    A hidden element, tags and content, counts as one tag."""
    tag = "(?is)<!--.*?-->|" + "|".join(rf"<{n}\b[^>]*>.*?</{n}\s*>" for n in hidden) + "|<[^>]+>"

    def mark(t: Column) -> Column:
        return F.when(F.lower(F.regexp_extract(t, "^</?([a-zA-Z0-9]+)", 1)).isin(*lines), "\n").otherwise(" ")

    def joined(t: Column) -> Column:
        marks = F.transform(F.regexp_extract_all(t, F.lit(tag), F.lit(0)), mark)
        return _interleaved(F.split(t, tag, -1), marks)

    return once(text, lambda t: F.when(F.contains(t, F.lit("<")), joined(t)).otherwise(t))


def plain_text(text: Column) -> Column:
    """A text that may hold inline markup: tags away, entities decoded, lines and blanks in order."""
    return _tidy_lines(decode_entities(_shown(text, ("script", "style"), ("br",))))


def html_text(html: Column) -> Column:
    """Readable text of a page: hidden elements away, a line for each block, no empty lines."""
    return _tidy_lines(decode_entities(_shown(html, HIDDEN, LINES)))


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…"))).otherwise(text)


def single_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s\u00A0]+", " "))


#: What brings texts into a Unicode form; Spark ships the class.
_FORMS = {"NFKC": "compose", "NFKD": "decompose"}


def normalized(text: Column, form: str) -> Column:
    """Unicode normalisation of texts beyond ASCII, in the JVM."""
    other = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit(_FORMS[form]), F.coalesce(text, F.lit("")), F.lit(True))
    return F.when(text.rlike(r"[^\x00-\x7F]"), other).otherwise(text)


def for_match(text: Column) -> Column:
    """A text as it is compared: without forms of width and composition, case and runs of blanks."""
    return F.lower(single_line(normalized(text, "NFKC")))


def host(url: Column) -> Column:
    """The host of a URL in lower case, as browsers read it: a backslash ends it like a slash, what stands before the last
    ``@`` is a name, a port may follow. Empty for what is no URL or has no proper host."""
    part = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*:[/\\]{2}([^/\\?#]*)", 1)
    named = F.regexp_extract(F.substring_index(part, "@", -1), r"^(\[[0-9a-fA-F:.]+\]|[\p{L}\p{N}._~-]+)(?::\d*)?$", 1)
    return F.lower(named)


def host_allowed(url: Column, hosts: Column) -> Column:
    """Whether a URL's host is one of ``hosts`` or below one; false for what is no URL."""
    h = host(url)
    return (h != "") & F.exists(hosts, lambda x: (h == F.lower(x)) | h.endswith(F.concat(F.lit("."), F.lower(x))))


def trailing_number(url: Column, marker: str) -> Column:
    return F.nullif(F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), rf"{marker}/?(\d+)/?$", 1), F.lit(""))


def maintenance_type(title: Column) -> Column:
    return F.when(title.contains("긴급"), "EMERGENCY").when(title.contains("연장"), "EXTENDED").otherwise("SCHEDULED")
