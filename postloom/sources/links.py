"""Links of landed pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom import lexicon
from postloom.functions.text import has_any, nz, strip
from postloom.functions.urls import resolve_url
from postloom.operators.dedup import dedup_first

_HREF = r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"']"
_MARKDOWN = r"\[([^\]]+)\]\((https?://[^\)]+)\)"


def canonical_link(href: Column) -> Column:
    """Link without query and trailing slashes."""
    return F.rtrim(F.split_part(href, F.lit("?"), F.lit(1)), F.lit("/"))


def listing_links(
    links: DataFrame, order: Sequence[str], href: str = "href", parsed: Column | None = None
) -> DataFrame:
    """Links with at least two path segments, the first per canonical form.

    ``parsed`` tells which cards gave a posting; only those take the canonical form.
    """
    clean = links.withColumn(href, strip(nz(href))).withColumn("canonical", canonical_link(F.col(href)))
    segments = F.size(F.filter(F.split("canonical", "/"), lambda s: s != ""))
    wanted = clean.where((F.col(href) != "") & (segments >= 2))
    if parsed is not None:
        wanted = wanted.where(parsed)
    return dedup_first(wanted, "canonical", list(order))


def career_links(
    pages: DataFrame, keywords: Sequence[str] = lexicon.CAREER_KEYWORDS, html: str = "html", url: str = "url"
) -> DataFrame:
    """Outgoing links of HTML pages whose address holds a career word, made absolute."""
    links = F.posexplode(F.regexp_extract_all(F.col(html), F.lit(_HREF), F.lit(1))).alias("position", "link")
    found = pages.select(*[c for c in pages.columns if c != html], links)
    kept = found.where(has_any(F.lower("link"), keywords))
    return kept.withColumn("link", resolve_url(url, "link"))


def readme_career_links(
    readmes: DataFrame, keywords: Sequence[str] = lexicon.CAREER_KEYWORDS, text: str = "text"
) -> DataFrame:
    """Markdown links whose label or address holds a career word, in texts that hold one at all."""
    gated = readmes.where(has_any(F.lower(text), keywords))
    whole = F.col(text)
    pairs = F.arrays_zip(
        F.regexp_extract_all(whole, F.lit(_MARKDOWN), F.lit(1)).alias("label"),
        F.regexp_extract_all(whole, F.lit(_MARKDOWN), F.lit(2)).alias("link"),
    )
    found = gated.select(*[c for c in readmes.columns if c != text], F.posexplode(pairs).alias("position", "pair"))
    rows = found.select(*[c for c in found.columns if c != "pair"], "pair.label", "pair.link")
    return rows.where(has_any(F.lower("link"), keywords) | has_any(F.lower("label"), keywords))
