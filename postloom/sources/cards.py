"""One-line listing cards (link and visible text) as postings, in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom import lexicon
from postloom.functions.frames import computed
from postloom.functions.text import blank_to_null, collapse, nz, strip


def _trim_commas(c: Column) -> Column:
    return F.btrim(c, F.lit(" ,"))


def parse_listing_cards(
    cards: DataFrame, href: str = "href", text: str = "text", base: str = "https://unstop.com",
    source: str = "unstop",
) -> DataFrame:
    """Cards with an experience marker as postings; other cards give no row.

    Text before the marker is role and company together. The role is repeated after the
    location, so the longest start of that text found there is the role; without a repeat the
    words are halved.
    """
    marker = rf"(?i)\b(?:{lexicon.CARD_EXPERIENCE})\b"
    work_mode = rf"(?i)\b({lexicon.CARD_WORK_MODE})\b"

    # One pass per pattern: a split at the first match gives what stands before and after it.
    step = computed(cards, _text=collapse(nz(text))).where(F.length("_text") >= 20)
    step = computed(step, _parts=F.split("_text", marker, 2)).where(F.size("_parts") == 2)
    step = computed(step, _pre=strip(F.get("_parts", 0)), _post=strip(F.get("_parts", 1)))
    step = computed(
        step,
        _mode=F.regexp_extract("_post", work_mode, 1),
        _before_mode=F.length(F.get(F.split("_post", work_mode, 2), 0)),
        _place=F.regexp_extract("_post", lexicon.CARD_LOCATION, 0),
        _words=F.filter(F.split("_pre", " "), lambda w: w != ""),
    )
    step = step.withColumns({
        "_mode_end": F.when(F.col("_mode") == "", 0).otherwise(F.col("_before_mode") + F.length("_mode")),
        "_city": _trim_commas(strip(F.regexp_extract("_place", lexicon.CARD_LOCATION, 1))),
    })
    place_end = F.when(
        F.col("_place") != "", F.instr("_post", F.col("_place")) - 1 + F.length("_place")
    ).otherwise(F.lit(0))
    step = step.withColumn("_after", F.greatest("_mode_end", place_end))
    step = computed(step, _tail=F.lower(strip(F.substring("_post", F.col("_after") + 1, F.length("_post")))))

    count = F.size("_words")

    def first_words(n: Column) -> Column:
        return F.array_join(F.slice("_words", F.lit(1), n), " ")

    repeated = F.filter(
        F.when(count > 0, F.sequence(count, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>")),
        lambda n: F.startswith(F.col("_tail"), F.lower(first_words(n))),
    )
    half = F.greatest(F.lit(1), F.floor(count / 2).cast("int"))
    step = computed(step, _cut=F.coalesce(F.get(repeated, F.lit(0)), half))
    step = computed(
        step,
        _role=strip(F.rtrim(first_words(F.col("_cut")), F.lit(" ,"))),
        _company=_trim_commas(
            strip(F.array_join(F.slice("_words", F.col("_cut") + 1, F.greatest(count, F.lit(1))), " "))
        ),
    )
    step = computed(step, _lead=F.split_part("_company", F.lit(" "), F.lit(1)))
    lead = F.col("_lead")
    moves = F.lower(lead).isin(*lexicon.ROLE_PREFIXES) & F.contains(F.col("_company"), F.lit(" "))
    rest = _trim_commas(strip(F.substring("_company", F.length(lead) + 1, F.length("_company"))))
    step = computed(
        step,
        company=F.when(moves, rest).otherwise(F.col("_company")),
        role=F.when(moves, strip(F.concat_ws(" ", "_role", lead))).otherwise(F.col("_role")),
    ).where((F.col("company") != "") & (F.col("role") != ""))

    city = (F.col("_city") != "") & ~F.contains(F.col("_city"), F.lit("Home")) & (F.length("_city") < 80)
    job_type = F.regexp_extract("_post", rf"(?i)\b({lexicon.CARD_JOB_TYPE})\b", 1)
    kind = F.when(F.contains(F.col(href), F.lit("/internships/")), "internship").when(
        F.contains(F.col(href), F.lit("/jobs/")), "job"
    )
    return step.withColumns({
        "source": F.lit(source),
        "url": F.when(F.startswith(F.col(href), F.lit("http")), F.col(href)).otherwise(
            F.concat(F.lit(base), F.col(href))
        ),
        "stack": F.array_compact(F.array(blank_to_null(job_type), blank_to_null("_mode"), kind)),
        "product": blank_to_null(strip(F.regexp_extract("_text", rf"(?i){lexicon.CARD_SALARY}", 1))),
        "location": F.when(city, F.col("_city")),
        "posted_at": blank_to_null(strip(F.regexp_extract("_text", rf"(?i){lexicon.CARD_POSTED}", 1))),
    }).drop(*[c for c in step.columns if c.startswith("_")])
