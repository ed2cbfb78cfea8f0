"""String expressions with the whitespace and case rules the operators rely on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when a value is stripped.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The characters and pairs that end a line in recognised text.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

LOWERCASE = r"[\p{Ll}\p{Lt}ªº]"


def strip(text: Column) -> Column:
    """Remove white space of every kind from both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def collapse_spaces(text: Column) -> Column:
    """Runs of white space become one space, ends are trimmed."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def is_upper(text: Column) -> Column:
    """At least one capital letter and no lower-case one."""
    return text.rlike(r"\p{Lu}") & ~text.rlike(LOWERCASE)


def title_case(text: Column) -> Column:
    """Capitalise every run of letters (``x-ray`` becomes ``X-Ray``)."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(0))
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(r.substr(F.lit(2), F.length(r))))),
        "",
    )


def is_title(text: Column) -> Column:
    """Whether title-casing the text would leave it unchanged."""
    return ~text.rlike(r"(^|\P{L})\p{Ll}") & ~text.rlike(r"\p{L}\p{Lu}")


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether any of a short literal word list is a substring."""
    out = F.lit(False)
    for word in words:
        out = out | text.contains(word)
    return out


def keep_first(array: Column) -> Column:
    """First element, null for an empty array."""
    return F.get(array, F.lit(0))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def extension(name: Column) -> Column:
    """Lower-case extension with its dot, empty when there is none."""
    return F.lower(F.regexp_extract(name, r"[^./\\](\.[^./\\]*)$", 1))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem_of(name: Column) -> Column:
    """File name without its extension; a leading dot is not an extension."""
    return F.regexp_replace(basename(name), r"(?<=[^.])\.[^.]*$", "")
