"""Text helpers as Column expressions."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that Python's str.strip() and str.split() treat as blank.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
BLANK_RUN = (
    r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
)
LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim every kind of blank, not just spaces."""
    return F.btrim(col(c), F.lit(BLANKS))


def nz(c: Column | str) -> Column:
    """NULL as empty text."""
    return F.coalesce(col(c), F.lit(""))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def collapse(c: Column | str) -> Column:
    """One space for each run of blanks, none at the ends."""
    return F.btrim(F.regexp_replace(col(c), BLANK_RUN, " "), F.lit(" "))


def words(c: Column | str) -> Column:
    """Blank-separated words; empty array for blank text."""
    return F.filter(F.split(collapse(c), " "), lambda w: w != "")


def norm(c: Column | str) -> Column:
    """Lower case without outer blanks; NULL as empty."""
    return strip(F.lower(nz(c)))


def title_case(c: Column | str) -> Column:
    """Capital after every character that has no case, as in ``O'Neil-Mc``."""
    runs = F.regexp_extract_all(
        col(c), F.lit(r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"), F.lit(1)
    )
    return F.array_join(
        F.transform(
            runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(r.substr(F.lit(2), F.length(r))))
        ),
        "",
    )


def slug(c: Column | str, dash: str = "-") -> Column:
    """Lower case, every run of other characters as one dash, no dash at the ends."""
    raw = F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", dash)
    return F.btrim(raw, F.lit(dash)) if dash else raw


def space_slug(c: Column | str) -> Column:
    """Lower case with each space as a dash."""
    return F.replace(F.lower(col(c)), F.lit(" "), F.lit("-"))


def has_any(c: Column, terms: Iterable[str]) -> Column:
    """True where one of the terms occurs in the text; False for NULL."""
    tests = [F.contains(c, F.lit(t)) for t in terms]
    return F.coalesce(reduce(lambda a, b: a | b, tests, F.lit(False)), F.lit(False))


def count_terms(c: Column, terms: Iterable[str]) -> Column:
    """How many of the terms occur in the text."""
    hits = [F.contains(c, F.lit(t)).cast("int") for t in terms]
    return F.coalesce(reduce(lambda a, b: a + b, hits, F.lit(0)), F.lit(0))


def fill(template: str, values: dict[str, Column]) -> Column:
    """A text with {names} as one concat; a missing value reads as empty."""
    parts, rest = [], template
    while "{" in rest:
        head, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        if head:
            parts.append(F.lit(head))
        parts.append(nz(values[name]))
    if rest:
        parts.append(F.lit(rest))
    return F.concat(*parts)
