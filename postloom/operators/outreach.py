"""Candidate profiles, product observations, drafts and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom import lexicon, schemas
from postloom.functions.text import LINE_END, blank_to_null, col, count_terms, fill, has_any, nz, strip, title_case
from postloom.operators.filters import check_choice

PREVIEW_CHARS = 300
SHOWN_SKILLS = 8
# Last words of the title patterns; a text without any of them holds no title.
TITLE_HEADS = (
    "engineer", "developer", "architect", "scientist", "analyst", "lead", "manager", "director",
)


# -- candidate profile ----------------------------------------------------------------------


def extract_years(low: Column) -> Column:
    """Years of experience in a lower-case text, by the first pattern that occurs."""
    tries = []
    for pattern in lexicon.EXPERIENCE_PATTERNS:
        tries.append(blank_to_null(F.regexp_extract(low, "(?U)" + pattern, 1)))
    # Every pattern holds one of these words; most long texts hold neither.
    return F.when(has_any(low, ("year", "yr")), F.coalesce(*tries).try_cast("bigint"))


def extract_title(low: Column) -> Column:
    """Job title in a lower-case text, by the first pattern that occurs."""
    tries = [blank_to_null(F.regexp_extract(low, "(?U)" + p, 0)) for p in lexicon.TITLE_PATTERNS]
    return F.when(has_any(low, TITLE_HEADS), strip(F.coalesce(*tries)))


def extract_skills(low: Column) -> Column:
    """Known skill terms in a lower-case text, in dictionary order."""
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(s)), s) for s in lexicon.SKILLS]))


def candidate_profile(resumes: DataFrame, text: str = "text") -> DataFrame:
    """Skills, years, title, preview, emptiness and a one-line snippet of each résumé text."""
    low = resumes.withColumn("_low", F.lower(nz(text)))
    parsed = low.withColumns({
        "skills": extract_skills(F.col("_low")),
        "years_experience": extract_years(F.col("_low")),
        "recent_role": extract_title(F.col("_low")),
        "resume_preview": F.when(strip(nz(text)) == "", "").otherwise(F.substring(text, 1, PREVIEW_CHARS)),
    })
    return parsed.withColumns({"is_empty": profile_is_empty(), "snippet": profile_snippet()}).drop("_low")


def profile_is_empty(skills: Column | str = "skills", role: Column | str = "recent_role") -> Column:
    return (F.coalesce(F.size(col(skills)), F.lit(0)) <= 0) & (nz(role) == "")


def profile_snippet() -> Column:
    role = F.when(nz("recent_role") != "", F.concat(F.lit("Role: "), title_case("recent_role")))
    years = F.when(
        F.coalesce("years_experience", F.lit(0)) != 0,
        F.concat(F.lit("Experience: "), F.col("years_experience").cast("string"), F.lit("+ years")),
    )
    shown = F.array_join(F.slice("skills", 1, SHOWN_SKILLS), ", ")
    return F.concat_ws(" | ", role, years, F.when(F.size("skills") > 0, F.concat(F.lit("Skills: "), shown)))


# -- observation ----------------------------------------------------------------------------


def observation_category(df: DataFrame, product: str = "product", stack: str = "stack") -> DataFrame:
    """Category with most keywords in product and stack; the first wins ties, none is default."""
    tags = blank_to_null(F.array_join(col(stack), " "))
    step = df.withColumn("_low", F.lower(F.concat_ws(" ", blank_to_null(product), tags)))
    names = list(lexicon.OBSERVATION_KEYWORDS)
    step = step.withColumns({
        f"_in_{n}": count_terms(F.col("_low"), lexicon.OBSERVATION_KEYWORDS[n]) for n in names
    })
    best = F.greatest(*[F.col(f"_in_{n}") for n in names])
    category = F.when(best == 0, "default")
    for name in names:
        category = category.when(F.col(f"_in_{name}") == best, name)
    return step.withColumn("category", category).drop("_low", *[f"_in_{n}" for n in names])


def pick_observation(row_id: Column | str, category: Column | str) -> Column:
    """One text of the category, chosen by a hash of the row's id."""
    number = F.conv(F.substring(F.md5(col(row_id)), 1, 6), 16, 10).cast("int")
    text = F.lit(None).cast("string")
    for name, texts in lexicon.OBSERVATIONS.items():
        choice = F.element_at(F.array(*[F.lit(t) for t in texts]), F.pmod(number, F.lit(len(texts))) + 1)
        text = F.when(col(category) == name, choice).otherwise(text)
    return text


# -- drafts ---------------------------------------------------------------------------------


def split_rendered(c: Column | str) -> tuple[Column, Column]:
    """Subject from a first line ``Subject:``, and the text after the line that follows it."""
    lines = F.split(strip(nz(c)), LINE_END)
    first = F.get(lines, F.lit(0))
    titled = F.startswith(F.lower(first), F.lit("subject:"))
    subject = F.when(titled, strip(F.substring(first, F.lit(9), F.length(first)))).otherwise(F.lit(""))
    rest = F.slice(lines, F.lit(3), F.greatest(F.size(lines), F.lit(1)))
    kept = F.when(titled, rest).otherwise(F.concat(F.array(first), rest))
    return subject, strip(F.array_join(kept, "\n"))


def render_email(contexts: DataFrame) -> DataFrame:
    """Subject and body of each draft from its ``template`` and the context columns."""
    values = {
        name: nz(name) for name in ("company", "role", "your_name", "github_url", "product_observation")
    }
    values["your_stack"] = F.array_join("your_stack", ", ")
    for name in ("contact_name", "referred_by"):
        values[name] = F.coalesce(blank_to_null(name), F.lit(lexicon.DRAFT_DEFAULTS[name]))
    values["availability"] = F.coalesce("availability", F.lit(lexicon.DRAFT_DEFAULTS["availability"]))
    values["graduation_year"] = F.coalesce(
        F.col("graduation_year").cast("string"), F.lit(lexicon.DRAFT_DEFAULTS["graduation_year"])
    )
    text = F.lit(None).cast("string")
    for name in schemas.EMAIL_TEMPLATES:
        text = F.when(F.col("template") == name, fill(lexicon.DRAFT_TEXTS[name], values)).otherwise(text)
    step = contexts.withColumn("_text", text)
    subject, body = split_rendered("_text")
    return step.withColumns({"subject": subject, "body": body}).drop("_text")


def draft_emails(contexts: DataFrame, as_of: Column, template: str | None = None) -> DataFrame:
    """Email rows for draft contexts: observation (a landed one, else a picked one), subject, body."""
    check_choice(template, schemas.EMAIL_TEMPLATES, "template")
    step = contexts.withColumn("template", F.lit(template)) if template else contexts
    own = F.when(F.size("stack") > 0, F.col("stack")).otherwise(F.col("your_stack"))
    step = observation_category(step.withColumn("_tags", own), "product", "_tags")
    picked = pick_observation(F.concat_ws("|", "job_id", "template"), "category")
    landed = blank_to_null("observation") if "observation" in contexts.columns else F.lit(None)
    step = step.withColumn(
        "product_observation", F.when(F.col("template") != "followup", F.coalesce(landed, picked)).otherwise("")
    )
    drafted = render_email(step)
    return drafted.select(
        F.md5(F.concat_ws("|", F.lit("email"), "job_id", nz("contact_id"), "template")).alias("id"),
        "job_id", "contact_id", "template", "subject", "body", as_of.alias("generated_at"),
        F.lit(None).cast("timestamp").alias("sent_at"), F.lit("draft").alias("status"),
    )


def build_prompt(df: DataFrame) -> DataFrame:
    """Prompt and system text per row; personal where the profile is not empty.

    Needs product, your_stack, stack and the profile columns; no product text means no prompt.
    """
    parts = F.array_compact(F.flatten(F.array(
        F.array(blank_to_null("product")),
        F.coalesce("your_stack", F.array().cast("array<string>")),
        F.coalesce("stack", F.array().cast("array<string>")),
    )))
    product = F.array_join(F.filter(parts, lambda p: p != ""), " ")
    personal = ~profile_is_empty()
    step = df.withColumn("_product", product)
    texts = {"product": F.col("_product"), "candidate": profile_snippet()}
    known = strip("_product") != ""
    return step.withColumns({
        "prompt": F.when(
            known, F.when(personal, fill(lexicon.PERSONAL_PROMPT, texts)).otherwise(fill(lexicon.PLAIN_PROMPT, texts))
        ),
        "system_text": F.when(
            known, F.when(personal, lexicon.PERSONAL_SYSTEM_TEXT).otherwise(lexicon.PLAIN_SYSTEM_TEXT)
        ),
    }).drop("_product")
