"""Queries and changes on the jobs, contacts and emails tables.

Changes are pure: (current, changes) -> next. Publish the result with ``sources.snapshots``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F

from postloom import schemas
from postloom.functions.text import col
from postloom.operators.filters import check_choice, job_predicate

MAX_PAGE = 500
MAX_GROUPS = 10_000
# Batch sizes.
BATCH_SIZES = {"discover": 20, "draft": 20, "digest": 100}


def _page(limit: int, offset: int, most: int | None = None) -> None:
    if limit < 1 or (most and limit > most):
        raise ValueError(f"limit must be at least 1{f' and at most {most}' if most else ''}")
    if offset < 0:
        raise ValueError("offset must not be negative")


def _by_posted(sort: str) -> list[Column]:
    check_choice(sort, schemas.SORT_ORDERS, "sort")
    posted = F.col("posted_at")
    return [posted.asc_nulls_last() if sort == "oldest" else posted.desc_nulls_last(), F.col("id").asc()]


def check_page(limit: int, offset: int, sort: str) -> None:
    """Refuse a page of jobs that cannot be asked for."""
    _page(limit, offset, MAX_PAGE)
    check_choice(sort, schemas.SORT_ORDERS, "sort")


def list_jobs(
    jobs: DataFrame, role: str | None = None, stack: Sequence[str] | str | None = None,
    status: str | None = None, sort: str = "latest", limit: int = 50, offset: int = 0,
) -> DataFrame:
    """One page of jobs by posting date, missing dates last in both orders, ties by id."""
    _page(limit, offset, MAX_PAGE)
    kept = jobs.where(job_predicate(role, stack, status)).orderBy(*_by_posted(sort))
    return kept.offset(offset).limit(limit) if offset else kept.limit(limit)


def count_jobs(jobs: DataFrame, role: str | None = None, stack: Sequence[str] | str | None = None,
               status: str | None = None) -> DataFrame:
    return jobs.where(job_predicate(role, stack, status)).agg(F.count("*").alias("total"))


def page_info(total: DataFrame, limit: int, offset: int) -> DataFrame:
    """``total`` with the page position and whether more rows follow."""
    return total.select(
        "total", F.lit(limit).alias("limit"), F.lit(offset).alias("offset"),
        (F.lit(offset + limit) < F.col("total")).alias("has_more"),
    )


def page_with_info(
    jobs: DataFrame, role: str | None = None, stack: Sequence[str] | str | None = None, status: str | None = None,
    sort: str = "latest", limit: int = 50, offset: int = 0,
) -> tuple[list[Row], dict[str, int | bool]]:
    """The rows of a page, as of ``list_jobs``, and its ``page_info``, from one pass over the jobs.

    All rows that pass the filter are counted on their way to the top ``offset + limit``; each task keeps only its own
    top rows, so the driver gets the page alone (at most MAX_PAGE rows). For an empty page Spark may cut the counting step out
    of the plan, so only then the rows are counted by a job of their own.
    """
    check_page(limit, offset, sort)
    counted = Observation()
    kept = jobs.where(job_predicate(role, stack, status)).observe(counted, F.count(F.lit(1)).alias("total"))
    ordered = kept.orderBy(*_by_posted(sort))
    rows = (ordered.offset(offset).limit(limit) if offset else ordered.limit(limit)).collect()
    total = counted.get["total"] if rows else count_jobs(jobs, role, stack, status).first()["total"]
    return rows, {"total": total, "limit": limit, "offset": offset, "has_more": offset + limit < total}


def row_by_id(table: DataFrame, row_id: Column | str) -> DataFrame:
    """The row of an id, given as text or as a scalar subquery."""
    return table.where(F.col("id") == row_id)


def new_job_batch(jobs: DataFrame, purpose: str) -> DataFrame:
    """Newest jobs with status ``new``: 20 to discover or draft, 100 for a digest."""
    return list_jobs(jobs, status="new", sort="latest", limit=BATCH_SIZES[purpose])


def _latest(changes: DataFrame, fields: Sequence[str], seq: str = "seq") -> DataFrame:
    return changes.groupBy("id").agg(*[F.max_by(f, seq).alias(f"_new_{f}") for f in fields])


def set_status(
    table: DataFrame, changes: DataFrame, allowed: Sequence[str] = schemas.JOB_STATUSES, seq: str = "seq"
) -> DataFrame:
    """Table after status changes (id, status, seq); the last valid one per id wins."""
    valid = changes.where(F.col("status").isin(*allowed))
    joined = table.join(_latest(valid, ["status"], seq), "id", "left")
    return joined.withColumn("status", F.coalesce("_new_status", "status")).select(*table.columns)


def mark_sent(emails: DataFrame, sent_ids: DataFrame, as_of: Column) -> DataFrame:
    """Emails after sending: status ``sent`` and the instant."""
    hits = sent_ids.select("id").distinct().withColumn("_hit", F.lit(True))
    joined = emails.join(hits, "id", "left")
    return joined.withColumns({
        "status": F.when(F.col("_hit"), "sent").otherwise(F.col("status")),
        "sent_at": F.when(F.col("_hit"), as_of).otherwise(F.col("sent_at")),
    }).select(*emails.columns)


def stats_by(jobs: DataFrame, column: str, as_of: Column, days: int | None = 30) -> DataFrame:
    """Jobs per value of a column, created in the last ``days``; NULL counts as ``unknown``."""
    recent = jobs
    if days is not None:
        recent = jobs.where(F.col("created_at") >= as_of - F.make_dt_interval(F.lit(days)))
    key = F.coalesce(F.col(column), F.lit("unknown")) if column == "source" else F.col(column)
    return recent.groupBy(key.alias(column)).agg(F.count("*").alias("jobs"))


def stats_map(jobs: DataFrame, as_of: Column, days: int | None = 30, most: int = MAX_GROUPS) -> DataFrame:
    """One row with both counts as maps; fails if a column has more than ``most`` values.

    The long form, ``stats_by``, has no bound.
    """
    def as_map(column: str) -> Column:
        groups = stats_by(jobs, column, as_of, days).limit(most + 1)
        map_ = F.map_from_entries(F.collect_list(F.struct(column, "jobs")))
        checked = F.when(F.count("*") <= most, map_).otherwise(
            F.raise_error(F.lit(f"{column} has more than {most} values; use stats_by")).cast("map<string,bigint>"))
        return groups.agg(checked).scalar()

    one = jobs.sparkSession.range(1)
    return one.select(as_map("source").alias("by_source"), as_map("status").alias("by_status"))


def board_column(status: Column | str = "status") -> Column:
    """Board column of a status; an unknown one counts as discovered."""
    board = F.lit("discovered")
    for value, name in schemas.BOARD_OF_STATUS.items():
        board = F.when(col(status) == value, name).otherwise(board)
    return board


def board_cards(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("board", board_column())


def board_counts(jobs: DataFrame) -> DataFrame:
    """Cards per board column in board order, empty columns included."""
    spark = jobs.sparkSession
    board = spark.createDataFrame(list(enumerate(schemas.BOARD_COLUMNS)), "position int, board string")
    counts = board_cards(jobs).groupBy("board").agg(F.count("*").alias("n"))
    return board.join(counts, "board", "left").select(
        "position", "board", F.coalesce("n", F.lit(0)).cast("long").alias("cards")
    )


def newest(table: DataFrame, limit: int, offset: int) -> DataFrame:
    _page(limit, offset)
    ordered = table.orderBy(F.col("created_at").desc(), F.col("id").asc())
    return ordered.offset(offset).limit(limit) if offset else ordered.limit(limit)


def _company_like(contacts: DataFrame, company: str | None) -> DataFrame:
    return contacts.where(F.col("company").ilike(f"%{company}%")) if company else contacts


def contacts_by_company(contacts: DataFrame, company: str | None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Contacts whose company contains the text, newest first; no text means all."""
    return newest(_company_like(contacts, company), limit, offset)


def count_contacts(contacts: DataFrame, company: str | None) -> DataFrame:
    return _company_like(contacts, company).agg(F.count("*").alias("total"))


def contacts_by_job(contacts: DataFrame, job_id: Column | str, limit: int = 50, offset: int = 0) -> DataFrame:
    return newest(contacts.where(F.col("job_id") == job_id), limit, offset)


def emails_by_job(emails: DataFrame, job_id: Column | str) -> DataFrame:
    found = emails.where(F.col("job_id") == job_id)
    return found.orderBy(F.col("generated_at").desc(), F.col("id").asc())


def upsert_contacts(current: DataFrame, incoming: DataFrame, seq: str = "seq") -> DataFrame:
    """Contacts after inserting ``incoming`` in order of ``seq``.

    One row per (company, email): the first keeps id, job, domain and creation time, the last
    sets verified and source, and the last known name and role win. Rows without an email never
    meet. Every aggregate combines before the shuffle, so a crowded address stays cheap.
    """
    columns = current.columns
    old = current.withColumn("_seq", F.struct(F.lit(0).alias("new"), F.lit(0).cast("long").alias("at")))
    new = incoming.withColumn("_seq", F.struct(F.lit(1).alias("new"), F.col(seq).cast("long").alias("at")))
    both = old.unionByName(new.select(*columns, "_seq"))
    keyed = both.where(F.col("email").isNotNull())
    first = F.min_by(F.struct("id", "job_id", "domain", "created_at"), "_seq").alias("_first")
    last = F.max_by(F.struct("verified", "source"), "_seq").alias("_last")
    known = [
        F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("_seq"))).alias(f"_{c}")
        for c in ("name", "role")
    ]
    merged = keyed.groupBy("company", "email").agg(first, last, *known)
    values = {
        "company": F.col("company"), "email": F.col("email"),
        "id": F.col("_first.id"), "job_id": F.col("_first.job_id"), "domain": F.col("_first.domain"),
        "created_at": F.col("_first.created_at"), "verified": F.col("_last.verified"),
        "source": F.col("_last.source"), "name": F.col("_name"), "role": F.col("_role"),
    }
    rows = merged.select(*[values[c].alias(c) for c in columns])
    return rows.unionByName(both.where(F.col("email").isNull()).select(*columns))


def delete_rows(table: DataFrame, gone: DataFrame) -> DataFrame:
    return table.join(gone.select("id").distinct(), "id", "left_anti")


def null_references(table: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """References to deleted rows become NULL; the referring rows stay."""
    ids = gone.select(F.col("id").alias(column)).distinct().withColumn("_gone", F.lit(True))
    joined = table.join(ids, column, "left")
    kept = F.when(F.col("_gone").isNull(), F.col(column))
    return joined.withColumn(column, kept).select(*table.columns)


def export_rows(
    jobs: DataFrame, role: str | None = None, stack: Sequence[str] | str | None = None,
    status: str | None = None, sort: str = "latest",
) -> DataFrame:
    """All matching jobs in order as the eleven text columns of the export."""
    from postloom.functions.dates import iso_text
    from postloom.functions.text import nz

    ordered = jobs.where(job_predicate(role, stack, status)).orderBy(*_by_posted(sort))
    return ordered.select(
        "id", "company", "role", nz("source").alias("source"), nz("url").alias("url"),
        nz(F.array_join("stack", ",")).alias("stack"), nz("product").alias("product"),
        nz("location").alias("location"), nz(iso_text("posted_at")).alias("posted_at"),
        "status", iso_text("created_at").alias("created_at"),
    )


def export_csv(rows: DataFrame, path: str) -> None:
    """Write the export as CSV with a header; parts are in global order, nothing is collected."""
    rows.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
