"""URL helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom import lexicon
from postloom.functions.text import col, has_any, nz, strip, title_case

_PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def authority(url: Column | str) -> Column:
    """Host with port as written; empty without ``//``."""
    return F.regexp_extract(col(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def path_of(url: Column | str) -> Column:
    return F.regexp_extract(
        col(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1
    )


def _decoded(c: Column) -> Column:
    mended = F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(mended), c)


def _encoded(c: Column) -> Column:
    # Java leaves '*' and escapes '~'; the wanted form is the other way round.
    return F.replace(
        F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")
    )


def _kept_query(query: Column) -> Column:
    def pair(item: Column) -> Column:
        at = F.instr(item, "=")
        name = F.when(at > 0, F.substring(item, F.lit(1), at - 1)).otherwise(item)
        value = F.when(at > 0, F.substring(item, at + 1, F.length(item))).otherwise(F.lit(""))
        return F.struct(_decoded(name).alias("k"), _decoded(value).alias("v"))

    pairs = F.transform(F.filter(F.split(query, "&"), lambda i: i != ""), pair)

    def keep(p: Column) -> Column:
        tracked = p["k"].isin(*lexicon.TRACKING_KEYS)
        for prefix in lexicon.TRACKING_PREFIXES:
            tracked = tracked | p["k"].startswith(prefix)
        return ~tracked

    return F.array_join(
        F.transform(
            F.filter(pairs, keep), lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))
        ),
        "&",
    )


def normalize_url(c: Column | str) -> Column:
    """Canonical http(s) URL without tracking keys and fragment; empty text if not one."""
    text = F.regexp_replace(strip(nz(c)), "[\t\r\n]", "")
    scheme = F.lower(F.regexp_extract(text, _PARTS, 1))
    host = F.regexp_extract(text, _PARTS, 2)
    path = F.rtrim(F.regexp_extract(text, _PARTS, 3), F.lit("/"))
    raw_query = F.regexp_extract(text, _PARTS, 4)
    query = F.when(raw_query == "", F.lit("")).otherwise(_kept_query(raw_query))
    return F.when(
        scheme.isin("http", "https") & (host != ""),
        F.concat(
            scheme, F.lit("://"), F.lower(host),
            F.when(path == "", F.lit("/")).otherwise(path),
            F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)),
        ),
    ).otherwise(F.lit(""))


def bare_domain(url: Column | str) -> Column:
    """Lower-case host without a leading ``www.``."""
    return F.regexp_replace(F.lower(authority(url)), r"^www\.", "")


def blocked_domain(url: Column | str) -> Column:
    domain = bare_domain(url)
    test = F.lit(False)
    for bad in lexicon.BLOCKED_DOMAINS:
        test = test | (domain == bad) | domain.endswith("." + bad)
    return test


def company_from_url(url: Column | str) -> Column:
    """Display name of the company behind a host."""
    labels = F.split(bare_domain(url), r"\.")
    n = F.size(labels)
    label = (
        F.when((n >= 3) & F.get(labels, F.lit(0)).isin("careers", "jobs"), F.get(labels, F.lit(1)))
        .when(n >= 2, F.get(labels, n - 2))
    )
    named = title_case(F.replace(label, F.lit("-"), F.lit(" ")))
    whole = F.when(bare_domain(url) == "", F.lit("Unknown Company")).otherwise(bare_domain(url))
    return F.when(n >= 2, named).otherwise(whole)


def detect_ats(url: Column | str) -> Column:
    """Hosting system of a posting URL; ``generic`` where none is known."""
    kind = F.lit("generic")
    for name, markers in reversed(lexicon.ATS_MARKERS):
        kind = F.when(has_any(col(url), markers), name).otherwise(kind)
    return kind


def company_slug(url: Column | str, ats: Column | str) -> Column:
    """First path segment for systems that put the company there, else NULL."""
    first = F.split_part(F.btrim(path_of(url), F.lit("/")), F.lit("/"), F.lit(1))
    return F.when(col(ats).isin(*lexicon.ATS_WITH_SLUG), first)


def _plain_path(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc))
        .otherwise(F.concat(acc, F.array(s))),
    )
    slash = F.when(path.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.array_join(kept, "/"), slash)


def resolve_url(base: Column | str, link: Column | str) -> Column:
    """A link of a page as an absolute URL."""
    page, ref = col(base), col(link)
    scheme = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    origin = F.concat(scheme, F.lit("://"), authority(page))
    folder = F.regexp_replace(path_of(page), "[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    ref_path = F.regexp_extract(ref, "^([^?#]*)", 1)
    ref_tail = F.substring(ref, F.length(ref_path) + 1, F.length(ref))
    return (
        F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(ref == "", page)
        .when(ref.startswith("//"), F.concat(scheme, F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(origin, _plain_path(ref_path), ref_tail))
        .when(ref.startswith("?"), F.concat(origin, path_of(page), ref))
        .when(ref.startswith("#"), F.concat(F.regexp_replace(page, "#.*$", ""), ref))
        .otherwise(F.concat(origin, _plain_path(F.concat(folder, ref_path)), ref_tail))
    )


def location_hint(text: Column | str) -> Column:
    """First known city word in a text, capitalised; empty if none."""
    low = F.lower(nz(text))
    hint = F.lit("")
    for word in reversed(lexicon.LOCATION_WORDS):
        hint = F.when(F.contains(low, F.lit(word)), word.title()).otherwise(hint)
    return hint
