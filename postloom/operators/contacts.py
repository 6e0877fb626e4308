"""Company domains, address patterns, people and contacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postloom import lexicon
from postloom.functions.text import blank_to_null, col, has_any, nz, slug, strip, words
from postloom.operators.dedup import dedup_first
from postloom.operators.tables import upsert_contacts

FALLBACK_PATTERN = "{first}.{last}@"
# Shapes of a local part and the pattern each gives away, in order.
PATTERN_OF_SHAPE = (
    (r"^[a-z]+\.[a-z]+$", "{first}.{last}@"),
    (r"^[a-z][a-z]{3,}$", "{fi}{last}@"),
    (r"^[a-z]{3,}[a-z]$", "{first}{li}@"),
    (r"^[a-z]{3,}$", "{first}@"),
)


def infer_email_pattern(email: Column | str, domain: Column | str) -> Column:
    """Address template that a known address suggests, NULL if none."""
    local = F.lower(F.split_part(col(email), F.lit("@"), F.lit(1)))
    head = F.lit(None).cast("string")
    for shape, pattern in reversed(PATTERN_OF_SHAPE):
        head = F.when(local.rlike(shape), pattern).otherwise(head)
    return F.concat(head, col(domain))


def vote_pattern(domains: DataFrame, addresses: DataFrame) -> DataFrame:
    """Most frequent pattern per domain, the first seen among equals; a default without votes.

    ``addresses``: domain, email, seq. Votes are counted per (domain, pattern) before domains meet.
    """
    usable = addresses.where(
        F.contains("email", F.concat(F.lit("@"), F.col("domain"))) & ~F.contains(F.col("email"), F.lit("noreply"))
    )
    votes = (
        usable.withColumn("pattern", infer_email_pattern("email", "domain"))
        .where(F.col("pattern").isNotNull())
        .groupBy("domain", "pattern").agg(F.count("*").alias("_votes"), F.min("seq").alias("_first"))
    )
    best = votes.groupBy("domain").agg(
        F.max_by("pattern", F.struct("_votes", (-F.col("_first")).alias("_early"))).alias("_best")
    )
    default = F.concat(F.lit(FALLBACK_PATTERN), "domain")
    return domains.select("domain").distinct().join(best, "domain", "left").select(
        "domain", F.coalesce("_best", default).alias("pattern")
    )


def build_email(name: Column | str, pattern: Column | str) -> Column:
    """Address of a person from a pattern; NULL if that gives no address."""
    parts = words(F.lower(nz(name)))
    first = F.coalesce(F.get(parts, F.lit(0)), F.lit(""))
    last = F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise(F.lit(""))
    address = col(pattern)
    for mark, value in (
        ("{first}", first), ("{last}", last), ("{fi}", F.substring(first, 1, 1)), ("{li}", F.substring(last, 1, 1)),
    ):
        address = F.replace(address, F.lit(mark), value)
    good = (first != "") & ~F.contains(address, F.lit("{")) & address.rlike(r"^[^@]+@[^@]+\.[^@]+$")
    return F.when(good, address)


def role_from_bio(bio: Column | str) -> Column:
    low = F.lower(nz(bio))
    return (
        F.when(has_any(low, lexicon.ENGINEER_WORDS), "Engineer")
        .when(has_any(low, lexicon.RECRUITER_WORDS), "Recruiter")
        .otherwise("Unknown")
    )


def merge_people(code_host: DataFrame, directory: DataFrame) -> DataFrame:
    """People per company, code host before directory, the first of a name (any case) counts.

    Both inputs: company, name, role, seq.
    """
    both = code_host.select(
        "company", strip("name").alias("name"), "role", "seq", F.lit("github").alias("source"), F.lit(0).alias("_rank")
    ).unionByName(directory.select(
        "company", strip("name").alias("name"), "role", "seq", F.lit("linkedin").alias("source"), F.lit(1).alias("_rank")
    ))
    named = both.where(nz("name") != "")
    window = Window.partitionBy("company", F.lower("name")).orderBy("_rank", "seq")
    first = named.withColumn("_rn", F.row_number().over(window)).where("_rn = 1")
    return first.select("company", "name", "role", "source", "seq")


def classify_probe(email: Column | str, code: Column | str) -> Column:
    """State of an address from the reply code of a landed probe."""
    reply = col(code)
    return (
        F.when(~F.contains(nz(email), F.lit("@")), "invalid")
        .when(reply.isin(*lexicon.PROBE_OK), "verified")
        .when(reply.isin(*lexicon.PROBE_REFUSED), "invalid")
        .otherwise("unverified")
    )


def pick_mx(domains: DataFrame, records: DataFrame) -> DataFrame:
    """Mail host of lowest preference per domain without final dot, or ``mail.<domain>``."""
    best = records.groupBy("domain").agg(
        F.min_by("exchange", F.struct("preference", "exchange")).alias("_host")
    )
    host = F.coalesce(F.rtrim("_host", F.lit(".")), F.concat(F.lit("mail."), "domain"))
    return domains.select("domain").distinct().join(best, "domain", "left").select("domain", host.alias("mx_host"))


def resolve_domain(companies: DataFrame, probes: DataFrame) -> DataFrame:
    """Domain per company: the suggestion, else the first suffix whose landed probe answered.

    ``companies``: company, suggestion; ``probes``: candidate, status_code.
    """
    alive = probes.where(F.col("status_code") < 400).select("candidate").distinct().withColumn("_alive", F.lit(True))
    suffixes = F.posexplode(F.array(*[F.lit(s) for s in lexicon.DOMAIN_SUFFIXES])).alias("_pos", "_suffix")
    tried = companies.select("company", "suggestion", suffixes).withColumn(
        "candidate", F.concat(slug("company", ""), F.lit("."), "_suffix")
    )
    found = tried.join(alive, "candidate", "left")
    return found.groupBy("company").agg(
        F.coalesce(
            blank_to_null(F.max("suggestion")),
            F.min_by("candidate", F.when(F.col("_alive"), F.col("_pos"))),
        ).alias("domain")
    )


def discover_contacts(
    companies: DataFrame, probes: DataFrame, addresses: DataFrame, code_host: DataFrame, directory: DataFrame,
    replies: DataFrame,
) -> DataFrame:
    """Contacts for a batch of companies (company, provided, suggestion, job_id), before storing.

    Companies without a domain give no rows. ``replies`` holds landed probe codes (email, code).
    """
    resolved = resolve_domain(companies.select("company", "suggestion"), probes)
    known = companies.groupBy("company").agg(
        F.max("provided").alias("provided"), F.min("job_id").alias("job_id")
    ).join(resolved, "company")
    known = known.withColumn("domain", F.coalesce(blank_to_null("provided"), "domain")).where("domain IS NOT NULL")
    patterns = vote_pattern(known, addresses)
    people = merge_people(code_host, directory)
    found = people.join(known.select("company", "domain", "job_id").join(patterns, "domain"), "company")
    found = found.withColumn("email", build_email("name", "pattern"))
    codes = replies.groupBy("email").agg(F.min("code").alias("code"))
    checked = found.join(codes, "email", "left")
    verified = F.when(F.col("email").isNull(), "unverified").otherwise(classify_probe("email", "code"))
    return checked.select("job_id", "company", "domain", "name", "email", "role", "source", verified.alias("verified"), "seq")


def store_contacts(current: DataFrame, discovered: DataFrame, as_of: Column) -> DataFrame:
    """Contacts table after storing a discovery batch; new ids are stable across retries."""
    incoming = discovered.withColumns({
        "id": F.md5(F.concat_ws("|", F.lit("contact"), "company", F.coalesce("email", F.concat(F.lit("#"), F.lower("name"))))),
        "created_at": as_of,
    })
    return upsert_contacts(current, incoming)
