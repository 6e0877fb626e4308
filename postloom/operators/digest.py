"""Weekly digest and follow-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postloom import lexicon
from postloom.functions.dates import parse_iso
from postloom.functions.frames import computed
from postloom.functions.text import blank_to_null, fill, nz
from postloom.session import shared_dir

MAX_AGE_DAYS = 7
DIGEST_JOBS = 100
MAX_BROADCAST_SOURCES = 50_000


def digest_select(jobs: DataFrame, as_of: Column, days: int = MAX_AGE_DAYS, posted: str = "posted_at") -> DataFrame:
    """Jobs posted in the last ``days``, or with a date that is missing or unreadable."""
    kind = jobs.schema[posted].dataType.simpleString()
    first = as_of - F.make_dt_interval(F.lit(days))
    if kind.startswith("timestamp"):
        return jobs.where(F.col(posted).isNull() | (F.col(posted) >= first))
    # the date is read once per row, not once per use of it
    return computed(jobs, _at=parse_iso(posted)).where(F.col("_at").isNull() | (F.col("_at") >= first)).drop("_at")


def _source() -> Column:
    return F.coalesce(blank_to_null("source"), F.lit("unknown"))


def _numbered(rows: DataFrame, order: list[str], purpose: str) -> DataFrame:
    """``rows`` with ``_number``, their place from 1 in a total order.

    Ranges of the order are sorted by many tasks and written once; a range's offset is the count of the
    ranges before it, from one row per range. No value of any column gathers rows in one task.
    """
    spark = rows.sparkSession
    path = shared_dir(spark, purpose)
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged.write.parquet(path)
    stored = spark.read.schema(ranged.schema).parquet(path).withColumns({
        "_range": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = stored.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    return stored.join(F.broadcast(before), "_range").withColumn("_number", F.col("_before") + F.col("_at") + 1).drop(
        "_range", "_at", "_before")


def digest_groups(jobs: DataFrame, time: str = "created_at", tie: str = "id") -> DataFrame:
    """Jobs with their source group: order of first appearance, size, and index within the group.

    Jobs are numbered in the order of source, time and id, so a source is a run of numbers and an
    index its distance from the first; neither a source nor an instant that holds most jobs gathers
    them in one task. Sources are ranked in the same way.
    """
    rows = _numbered(jobs.withColumn("source", _source()), ["source", time, tie], "digest-rows")
    sizes = rows.groupBy("source").agg(
        F.count("*").alias("group_size"), F.min("_number").alias("_start"), F.min(F.struct(time, tie)).alias("_first"))
    groups = _numbered(sizes, ["_first"], "digest-sources").select(
        "source", "group_size", "_start", F.col("_number").alias("group_position"))
    if groups.count() <= MAX_BROADCAST_SOURCES:
        groups = F.broadcast(groups)
    index = (F.col("_number") - F.col("_start") + 1).alias("index_in_group")
    return rows.join(groups, "source").select(*jobs.columns, "group_position", "group_size", index)


def _line(job: Column, index: Column) -> Column:
    place = F.when(nz(job["location"]) != "", F.concat(F.lit("📍 "), job["location"])).otherwise(F.lit(""))
    tags = F.when(
        F.coalesce(F.size(job["stack"]), F.lit(0)) > 0,
        F.concat(F.lit("  🛠  "), F.array_join(job["stack"], ", ")),
    ).otherwise(F.lit(""))
    link = F.when(nz(job["url"]) != "", F.concat(F.lit("🔗 "), job["url"])).otherwise(F.lit(""))
    return F.concat(
        F.lit("  "), index.cast("string"), F.lit(". "), nz(job["company"]), F.lit(" — "), nz(job["role"]),
        F.lit("\n"), place, tags, F.lit("\n"), link, F.lit("\n"),
    )


def _plural(n: Column) -> Column:
    return F.when(n == 1, F.lit("")).otherwise(F.lit("s"))


def render_digest(
    jobs: DataFrame, recipients: DataFrame, week: Column, generated_at: Column, order: tuple[Column | str, ...],
    most: int = DIGEST_JOBS, dashboard: str = "your dashboard", signature: str = "Your job digest",
) -> DataFrame:
    """Subject and body of one digest per recipient.

    ``recipients``: recipient, your_name. ``jobs`` carries ``recipient``; the first ``most`` jobs of
    each, in ``order``, are shown (a top-k that Spark prunes before the shuffle), so the list that
    is put into one text is bounded. A recipient without jobs gets the empty message.
    """
    window = Window.partitionBy("recipient").orderBy(*order)
    shown = jobs.withColumn("_at", F.row_number().over(window)).where(F.col("_at") <= most)
    lists = shown.groupBy("recipient").agg(
        F.array_sort(F.collect_list(F.struct(
            "_at", _source().alias("source"), "company", "role", "location", "stack", "url",
        ))).alias("_jobs")
    )
    step = recipients.join(lists, "recipient", "left")
    step = step.withColumn("_count", F.when(F.col("_jobs").isNull(), 0).otherwise(F.size("_jobs")))
    step = step.withColumn("_sources", F.array_distinct(F.transform("_jobs", lambda j: j["source"])))

    def group(source: Column) -> Column:
        own = F.filter("_jobs", lambda j: j["source"] == source)
        head = F.concat(
            F.lit("── "), F.upper(source), F.lit(" ("), F.size(own).cast("string"), F.lit(" role"),
            _plural(F.size(own)), F.lit(f") {lexicon.DIGEST_GROUP_TAIL}\n\n"),
        )
        return F.concat(head, F.array_join(F.transform(own, lambda j, i: _line(j, i + 1)), ""))

    groups = F.when(F.col("_count") == 0, F.lit(lexicon.DIGEST_EMPTY + "\n")).otherwise(
        F.array_join(F.transform("_sources", group), "")
    )
    sources = F.when(F.col("_count") == 0, 0).otherwise(F.size("_sources"))
    subject = fill(lexicon.DIGEST_SUBJECT, {
        "count": F.col("_count").cast("string"), "plural": _plural(F.col("_count")), "week": week,
    })
    body = F.concat(
        F.lit("Hi "), nz("your_name"), F.lit(f",\n\n{lexicon.DIGEST_INTRO}\n\n"), groups,
        F.lit(f"\n{lexicon.DIGEST_RULE}\nRoles shown: "), F.col("_count").cast("string"),
        F.lit("  |  Sources: "), sources.cast("string"),
        F.lit("\nGenerated: "), F.date_format(generated_at, "yyyy-MM-dd HH:mm"), F.lit(f" UTC\n{lexicon.DIGEST_RULE}\n\n"),
        F.lit(lexicon.DIGEST_OUTRO.replace("{dashboard}", dashboard)), F.lit(f"\n\nBest,\n{signature}"),
    )
    return step.select("recipient", subject.alias("subject"), body.alias("body"), F.col("_count").alias("job_count"))


def followups_due(emails: DataFrame, as_of: Column, days: int = 7, sent: str = "sent_text") -> DataFrame:
    """Sent emails old enough for a follow-up that is not already pending; unreadable dates never are."""
    at = parse_iso(sent)
    due = (F.col("status") == "sent") & (at <= as_of - F.make_dt_interval(F.lit(days)))
    open_ = F.coalesce(F.col("followup_status") != "pending_followup", F.lit(True))
    return emails.where(due & open_)
