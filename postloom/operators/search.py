"""Search queries and the filter for what they find."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom import lexicon
from postloom.functions.frames import computed
from postloom.functions.text import collapse, count_terms, fill, has_any, nz, strip
from postloom.functions.urls import blocked_domain, normalize_url


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), collapse(c), F.lit('"'))


def search_queries(profiles: DataFrame) -> DataFrame:
    """Distinct queries per profile in platform order.

    ``profiles``: profile_id, role, stack, location, year, after, platforms (NULL: all six),
    max_queries. Everything happens inside the row; nothing is shuffled.
    """
    filled = F.filter(F.coalesce("stack", F.array().cast("array<string>")), lambda t: strip(t) != "")
    context = F.concat_ws(
        " ",
        _quoted(nz("role")),
        F.nullif(F.array_join(F.transform(filled, _quoted), " "), F.lit("")),
        F.when(nz("location") != "", _quoted(F.col("location"))),
        F.when(F.coalesce("year", F.lit(0)) != 0, F.col("year").cast("string")),
        F.when(F.col("after").isNotNull(), F.concat(F.lit("after:"), F.date_format("after", "yyyy-MM-dd"))),
    )
    hiring = "(" + " OR ".join(f'"{t}"' for t in lexicon.HIRING_TERMS) + ")"
    with_context = profiles.withColumn("_context", context)

    def written(platform: Column) -> Column:
        query = F.lit(None).cast("string")
        for name, template in lexicon.SEARCH_TEMPLATES.items():
            # Context and hiring terms are collapsed and not empty, so a collapsed template gives a collapsed text.
            text = fill(" ".join(template.split()), {"context": F.col("_context"), "hiring_terms": F.lit(hiring)})
            query = F.when(platform == name, text).otherwise(query)
        return query

    every = F.array(*[F.lit(p) for p in lexicon.SEARCH_PLATFORMS])
    platforms = F.coalesce("platforms", every)
    queries = F.array_distinct(F.array_compact(F.transform(platforms, written)))
    most = F.greatest(F.coalesce("max_queries", F.lit(12)), F.lit(1))
    capped = F.slice(queries, F.lit(1), most)
    return with_context.select("profile_id", F.posexplode(capped).alias("position", "query"))


def score_results(results: DataFrame, min_score: int = 2, seq: str = "seq", scope: Sequence[str] = ()) -> DataFrame:
    """Every search result with canonical URL, score and the reason why it is kept or not.

    ``seq`` orders results and is unique within one ``scope`` (a request, its columns not NULL); a URL
    counts as seen from its first result of the scope that is neither missing nor blocked. The first result per URL is
    found by a pre-aggregated minimum and matched by ``seq``, so a URL with many copies never
    meets in one task.
    """
    return _reasoned(_judged(results), min_score, seq, scope)


def _judged(results: DataFrame) -> DataFrame:
    """Results with what each one tells by itself, so that its texts need not move to find the first of a URL."""
    rows = computed(results, norm_url=normalize_url("url"))
    rows = computed(
        rows,
        _early=F.when(F.col("norm_url") == "", "missing_url").when(blocked_domain("norm_url"), "blocked_domain"),
        _text=F.lower(F.concat(nz("title"), F.lit(" "), nz("snippet"), F.lit(" "), F.col("norm_url"))),
    )
    return computed(
        rows, score=count_terms(F.col("_text"), lexicon.HIGH_SIGNAL_TERMS), _noisy=has_any(F.col("_text"), lexicon.NOISY_TERMS),
    ).drop("_text")


def _reasoned(rows: DataFrame, min_score: int, seq: str, scope: Sequence[str]) -> DataFrame:
    """Judged results with the reason why each is kept or not."""
    firsts = (
        rows.where(F.col("_early").isNull())
        .groupBy(*scope, "norm_url").agg(F.min(seq).alias(seq))
        .select(*scope, seq, F.lit(True).alias("_first"))
    )
    scored = rows.join(firsts, [*scope, seq], "left")
    reason = (
        F.when(F.col("_early").isNotNull(), F.col("_early"))
        .when(F.col("_first").isNull(), "duplicate_url")
        .when(F.col("_noisy"), "noisy_term")
        .when(F.col("score") < min_score, "low_signal")
        .otherwise("accepted")
    )
    return scored.withColumns({"reason": reason, "accepted": reason == "accepted"}).drop("_early", "_first", "_noisy")


def candidates(scored: DataFrame) -> DataFrame:
    """Accepted results as cleaned candidates."""
    return scored.where("accepted").select(
        strip(nz("title")).alias("title"), F.col("norm_url").alias("url"), strip(nz("snippet")).alias("snippet"),
        "query", "score",
    )


def search_fanout(queries: DataFrame, seeds: DataFrame, per_query: int = 10, min_score: int = 2) -> DataFrame:
    """Each query with the first ``per_query`` seed results, then scored.

    ``queries`` has (profile_id, position, query), one request per profile: results are numbered and
    duplicates found within a profile. Without profile_id all queries are one request. The seeds are
    a fixed handful, judged once and read as one value by a scalar subquery; no join is planned.
    """
    scope = [c for c in ("profile_id",) if c in queries.columns]
    few = _judged(seeds.orderBy("seq").limit(per_query))
    shown = ("title", "url", "snippet", "norm_url", "_early", "score", "_noisy")
    listed = few.agg(F.array_sort(F.collect_list(F.struct("seq", *shown))).alias("s"))
    fanned = queries.select(*scope, "position", "query", F.posexplode(listed.scalar()).alias("_n", "_seed"))
    results = fanned.select(
        *scope, (F.col("position").cast("long") * per_query + F.col("_n")).alias("seq"), "query",
        *(f"_seed.{c}" for c in shown),
    )
    return _reasoned(results, min_score, "seq", scope)
