"""Mixed date texts to UTC instants, with a given ``as_of`` instead of the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom.functions.frames import once
from postloom.functions.text import col, strip

MICROS = 1_000_000
# Epoch numbers above this are milliseconds; how far ahead a date may lie.
MILLIS_ABOVE = 1e10
MAX_AHEAD_SECONDS = 50 * 365.25 * 86400
UNIT_SECONDS = {
    "second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 7 * 86400, "month": 30 * 86400,
}

_ISO = (
    r"^(\d{4})(-?)(\d{2})\2(\d{2})"
    r"(?:.(\d{2})(?:(:?)(\d{2})(?:\6(\d{2})(?:[.,](\d+))?)?)?"
    r"(Z|[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?)?)?$"
)
# Shape of a text -> the Spark patterns that may read it.
_SHAPES = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", ("yyyy-M-d",)),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", ("yyyy-M-d H:m:s",)),
    (r"(?i)^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}Z?$",
     ("yyyy-M-d'T'H:m:s", "yyyy-M-d'T'H:m:s'Z'")),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", ("MMM d, yyyy",)),
    (r"^[A-Za-z]{3,9} \d{1,2}, \d{4}$", ("MMMM d, yyyy",)),
    (r"^[A-Za-z]{3} \d{1,2} \d{4}$", ("MMM d yyyy",)),
    (r"^[A-Za-z]{3,9} \d{1,2} \d{4}$", ("MMMM d yyyy",)),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", ("d MMM yyyy",)),
    (r"^\d{1,2} [A-Za-z]{3,9} \d{4}$", ("d MMMM yyyy",)),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", ("d-M-yyyy",)),
)


def parse_iso(c: Column | str) -> Column:
    """ISO-8601 date or date-time with optional offset; naive means UTC; else NULL."""
    text = col(c)
    # One match gives all groups, as an array; a group that is not there is empty.
    split = F.split(F.regexp_replace(text, _ISO, "".join(f"${n}\u0001" for n in range(1, 11))), "\u0001")
    return once(F.when(text.rlike(_ISO), split), _from_groups)


def _from_groups(groups: Column) -> Column:
    def group(n: int) -> Column:
        return F.get(groups, F.lit(n - 1))

    def part(n: int) -> Column:
        return F.coalesce(group(n).try_cast("int"), F.lit(0))

    base = F.try_make_timestamp(part(1), part(3), part(4), part(5), part(7), part(8).cast("decimal(16,6)"))
    fraction = F.rpad(F.substring(group(9), 1, 6), 6, "0").try_cast("int")
    offset = group(10)
    digits = F.rpad(F.regexp_replace(offset, "[^0-9]", ""), 6, "0")
    hours, minutes, seconds = (F.substring(digits, at, 2).try_cast("int") for at in (1, 3, 5))
    shift = F.when(offset.isin("", "Z"), F.lit(0)).otherwise(
        F.when(offset.startswith("-"), -1).otherwise(1) * (hours * 3600 + minutes * 60 + seconds)
    )
    valid = (part(5) < 24) & (part(7) < 60) & (part(8) < 60) & (
        offset.isin("", "Z") | ((hours < 24) & (minutes < 60) & (seconds < 60))
    )
    micros = F.unix_micros(base) + F.coalesce(fraction, F.lit(0)) - shift.cast("long") * MICROS
    return F.when(groups.isNotNull() & valid, F.timestamp_micros(micros))


def parse_epoch(seconds: Column, as_of: Column) -> Column:
    """Epoch seconds or milliseconds as double; negative or far-future numbers give NULL."""
    scaled = F.when(seconds > MILLIS_ABOVE, seconds / 1000.0).otherwise(seconds)
    latest = F.unix_micros(as_of) / F.lit(float(MICROS)) + F.lit(MAX_AHEAD_SECONDS)
    good = (seconds >= 0) & (scaled <= latest)
    return F.when(good, F.timestamp_micros(F.bround(scaled * MICROS, 0).cast("long")))


def _shaped(text: Column) -> Column:
    one_spaced = F.regexp_replace(text, r"\s+", " ")
    branches = None
    for shape, formats in _SHAPES:
        value = F.coalesce(*[F.try_to_timestamp(one_spaced, F.lit(f)) for f in formats])
        test = one_spaced.rlike(shape)
        branches = F.when(test, value) if branches is None else branches.when(test, value)
    return branches


def _minus(as_of: Column, count: Column, unit: Column) -> Column:
    seconds = F.lit(None).cast("long")
    for name, size in UNIT_SECONDS.items():
        seconds = F.when(unit == name, F.lit(size).cast("long")).otherwise(seconds)
    micros = F.try_multiply(F.try_multiply(count.try_cast("long"), seconds), F.lit(MICROS).cast("long"))
    shifted = F.try_subtract(F.unix_micros(as_of), micros)
    return F.timestamp_micros(F.when(shifted > F.lit(-62135596800 * MICROS), shifted))


def parse_relative(text: Column, as_of: Column) -> Column:
    """``3 days ago``, ``yesterday``, ``just now`` as the whole text."""
    low = F.lower(text)
    pattern = r"^(\d+)\s+(second|minute|hour|day|week|month)s?\s+ago$"
    return (
        F.when(low.rlike(r"^just\s*now$|^today$"), as_of)
        .when(low == "yesterday", as_of - F.expr("INTERVAL 1 DAY"))
        .when(
            low.rlike(pattern),
            _minus(as_of, F.regexp_extract(low, pattern, 1), F.regexp_extract(low, pattern, 2)),
        )
    )


def normalize_date(c: Column | str, as_of: Column) -> Column:
    """Epoch, ISO, ten written shapes or a relative phrase as an instant; else NULL."""
    text = strip(c)
    return (
        F.when(text.rlike(r"^-?\d+(\.\d+)?$"), parse_epoch(text.try_cast("double"), as_of))
        .when(
            F.length(text) > 0,
            F.coalesce(
                F.when(F.contains(text, F.lit("T")) | text.endswith("Z"), parse_iso(text)),
                _shaped(text),
                parse_relative(text, as_of),
            ),
        )
    )


def relative_label(c: Column | str, as_of: Column) -> Column:
    """A short label such as ``Posted 2 days ago``: searched, not anchored; no seconds."""
    return lowered_label(F.lower(strip(c)), as_of)


def lowered_label(c: Column | str, as_of: Column) -> Column:
    """``relative_label`` of a text in lower case without outer blanks."""
    low = col(c)
    pattern = r"(\d+)\s+(minute|hour|day|week|month)s?\s+ago"
    return (
        F.when(low.isin("today", "just now"), as_of)
        .when(low == "yesterday", as_of - F.expr("INTERVAL 1 DAY"))
        .when(
            low.rlike(pattern),
            _minus(as_of, F.regexp_extract(low, pattern, 1), F.regexp_extract(low, pattern, 2)),
        )
    )


def scan_relative_date(c: Column | str, as_of: Column) -> Column:
    """First relative phrase anywhere in a longer text as an instant."""
    phrase = relative_phrase(c)
    return F.when(phrase != "", relative_label(phrase, as_of))


def relative_phrase(c: Column | str) -> Column:
    """First relative phrase anywhere in a longer text, in lower case; empty if none."""
    return F.regexp_extract(
        F.lower(col(c)),
        r"(?U)\b(just now|today|yesterday|\d+\s+(?:minute|hour|day|week|month)s?\s+ago)\b",
        1,
    )


def week_label(as_of: Column) -> Column:
    """Monday to Sunday around an instant, as ``dd Mon–dd Mon yyyy``."""
    monday = F.date_trunc("week", as_of)
    sunday = monday + F.expr("INTERVAL 6 DAYS")
    return F.concat(F.date_format(monday, "dd MMM"), F.lit("–"), F.date_format(sunday, "dd MMM yyyy"))


def iso_text(c: Column | str) -> Column:
    """UTC ISO text with offset; fraction only where it is not zero."""
    at = col(c)
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(at), F.lit(MICROS))
    fraction = F.when(micros == 0, "").otherwise(F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0")))
    return F.concat(whole, fraction, F.lit("+00:00"))
