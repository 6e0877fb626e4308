"""Jobs with contacts, drafts with recipients, rows with a profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postloom import lexicon
from postloom.functions.text import blank_to_null, nz
from postloom.functions.vectors import cosine, match_tier, norm2

NEWEST_CONTACTS = 50


def _newest_per(contacts: DataFrame, key: str, most: int) -> DataFrame:
    """The newest contacts per key; Spark prunes the ranks before the shuffle."""
    window = Window.partitionBy(key).orderBy(F.desc("created_at"), F.asc("id"))
    return contacts.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= most)


def _best(ranked: DataFrame, key: str) -> DataFrame:
    """Per key how many contacts there are, and the best one: not invalid, verified first, newest."""
    usable = F.coalesce(F.col("verified") != "invalid", F.lit(True))
    order = F.when(usable, F.struct((F.col("verified") != "verified").alias("v"), "_rank"))
    return ranked.groupBy(key).agg(
        F.count("*").alias("contacts_seen"), F.min_by("id", order).alias("contact_id")
    )


def _anchor(pattern: Column) -> Column:
    """Longest literal piece of a LIKE pattern, lower case; empty if it is all wildcards."""
    pieces = F.transform(
        F.split(F.lower(pattern), r"[%_\\]"), lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))
    )
    return F.array_max(pieces)["p"]


def _first_contact() -> Column:
    """Order of the newest contact: later instants first, missing ones last, then by id."""
    at = F.col("created_at")
    return F.struct(at.isNull().alias("none"), (-F.unix_micros(at)).alias("age"), F.col("id").alias("id"))


def companies_containing(jobs: DataFrame, contacts: DataFrame, newest: int = NEWEST_CONTACTS) -> DataFrame:
    """Pairs (job_company, company) where the contact's company contains the job's, any case.

    Containment as an equality join: each distinct contact company is spread into its substrings
    of the lengths in use and met by the longest literal piece of the job's company; the pattern
    itself, with its wildcards, is then checked. No product of companies is formed. Per job company
    only the ``newest`` companies by their newest contact stay, as no other can hold one of its
    newest contacts; Spark prunes these ranks before the shuffle. Names without any literal piece
    are left to ``unnamed_contacts``.
    """
    wanted = jobs.select(F.col("company").alias("job_company")).distinct().withColumn(
        "_anchor", _anchor(F.col("job_company"))).where(F.col("_anchor") != "")
    lengths = wanted.agg(F.array_sort(F.collect_set(F.length("_anchor"))).alias("n")).scalar()
    low = F.lower(F.col("company"))

    def pieces(n: Column) -> Column:
        starts = F.when(
            F.length(low) >= n, F.sequence(F.lit(1), F.greatest(F.length(low) - n + 1, F.lit(1)))
        ).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(low, i, n))

    spread = contacts.groupBy("company").agg(F.min(_first_contact()).alias("_first")).withColumn("_n", lengths).select(
        "company", "_first", F.explode(F.array_distinct(F.flatten(F.transform("_n", pieces)))).alias("_anchor")
    )
    met = spread.join(wanted, "_anchor").where(F.expr("company ILIKE concat('%', job_company, '%')"))
    order = Window.partitionBy("job_company").orderBy("_first")
    return met.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= newest).select("job_company", "company")


def unnamed_contacts(jobs: DataFrame, contacts: DataFrame, newest: int = NEWEST_CONTACTS) -> DataFrame:
    """The ``newest`` contacts for each job company that is blank or all wildcards, as ``job_company``.

    Such a name asks for nothing but a least length, so contacts are ranked once per length in use.
    """
    wanted = jobs.select(F.col("company").alias("job_company")).distinct().where(_anchor(F.col("job_company")) == "").withColumn(
        "_least", F.length(F.regexp_replace("job_company", r"[^_]", "")))
    lengths = wanted.agg(F.array_sort(F.collect_set("_least")).alias("n")).scalar()
    fits = contacts.where(F.col("company").isNotNull()).withColumn("_lengths", lengths).withColumn("_least", F.explode(
        F.filter("_lengths", lambda n: n <= F.length("company")))).drop("_lengths")
    return _newest_per(fits, "_least", newest).drop("_rank").join(wanted, "_least").drop("_least")


def draft_candidates(jobs: DataFrame, contacts: DataFrame, newest: int = NEWEST_CONTACTS) -> DataFrame:
    """Jobs to draft for, with the contact to use.

    Contacts are the ``newest`` whose company contains the job's company; a job without any is
    left out, a job whose contacts are all invalid is drafted without one.
    """
    slim = contacts.select("id", "company", "verified", "created_at")
    few = _newest_per(slim, "company", newest).drop("_rank")
    pairs = companies_containing(jobs, slim, newest).join(few, "company")
    pairs = pairs.unionByName(unnamed_contacts(jobs, slim, newest).select(*pairs.columns))
    best = _best(_newest_per(pairs, "job_company", newest), "job_company")
    return jobs.join(best.withColumnRenamed("job_company", "company"), "company")


def apply_candidates(jobs: DataFrame, contacts: DataFrame, newest: int = NEWEST_CONTACTS) -> DataFrame:
    """Every job with the best contact stored for it; a placeholder draft while there is none."""
    own = contacts.where(F.col("job_id").isNotNull()).select("id", "job_id", "verified", "created_at")
    best = _best(_newest_per(own, "job_id", newest), "job_id")
    joined = jobs.join(best.withColumnRenamed("job_id", "id"), "id", "left")
    pending = F.col("contacts_seen").isNull()
    return joined.withColumns({
        "discovery_status": F.when(pending, "pending").otherwise("complete"),
        "draft_subject": F.when(pending, lexicon.PENDING_SUBJECT),
        "draft_body": F.when(pending, lexicon.PENDING_BODY),
        "contacts_seen": F.coalesce("contacts_seen", F.lit(0)),
    })


def resolve_recipient(emails: DataFrame, contacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Emails with the address to send to, and those that have none."""
    addresses = contacts.select(F.col("id").alias("contact_id"), F.col("email").alias("to_address"))
    joined = emails.join(addresses, "contact_id", "left").withColumn("to_address", blank_to_null("to_address"))
    return joined.where("to_address IS NOT NULL"), joined.where("to_address IS NULL")


def email_context(requests: DataFrame, jobs: DataFrame, contacts: DataFrame) -> DataFrame:
    """Draft requests (job_id, contact_id, ...) with the fields of their job and contact."""
    job = jobs.select(
        F.col("id").alias("job_id"), "company", "role", "product", "stack"
    )
    contact = contacts.select(
        F.col("id").alias("contact_id"), F.col("name").alias("contact_name"), F.col("email").alias("contact_email")
    )
    joined = requests.join(job, "job_id", "left").join(contact, "contact_id", "left")
    return joined.withColumns({
        "company": F.coalesce("company", F.lit(lexicon.DRAFT_DEFAULTS["company"])),
        "role": F.coalesce("role", F.lit(lexicon.DRAFT_DEFAULTS["role"])),
        "product": nz("product"),
    })


def jd_text() -> Column:
    """Role, company, stack and product of a job as one text, without the missing parts."""
    tags = F.array_join("stack", " ")
    return F.concat_ws(" ", *[blank_to_null(c) for c in ("role", "company", tags, "product")])


def rank_by_profile(
    rows: DataFrame, profile: DataFrame, order: tuple[str, ...], k: int | None = None, vector: str = "embedding"
) -> DataFrame:
    """Rows with ``match_score`` and ``match_tier`` against one profile vector, best first.

    ``profile`` holds one row with the same vector column. It is read by a scalar subquery, so no
    join is planned; with ``k`` only the top rows are kept, without it the order is total.
    The tier uses the score before rounding.
    """
    one = profile.select(F.struct(F.col(vector).alias("v"), norm2(F.col(vector)).alias("n")).alias("p")).scalar()
    with_profile = rows.withColumn("_p", one)
    score = cosine(F.col("_p.v"), F.col(vector), norm_a=F.col("_p.n"))
    scored = with_profile.withColumn("_score", score).withColumns({
        "match_score": F.round("_score", 4), "match_tier": match_tier(F.col("_score")),
    }).drop("_p", "_score")
    ranked = scored.orderBy(F.desc("match_score"), *order)
    return ranked.limit(k) if k else ranked
