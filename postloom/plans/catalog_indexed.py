"""Registered queries over tables that are laid out for them: by month, by part of the key, with postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from postloom import schemas
from postloom.operators import postings, tables
from postloom.plans import catalog_tables as plain
from postloom.plans.registry import ORACLES, query
from postloom.plans.views import as_of, view
from postloom.session import shared_dir
from postloom.sources import monthly, parts

_stamp = plain._stamp


def _like(name: str, of: str):
    """Register a query that has the SQL counterpart of another."""

    def wrap(build):
        query(name)(build)
        ORACLES[name] = ORACLES[of]
        return build

    return wrap


def _by_month(spark, d) -> str:
    path = shared_dir(spark, "jobs-by-month")
    monthly.write(view(spark, d, "jobs").select(*schemas.JOB.fieldNames()), path)
    return path


@_like("q1_list_jobs_by_month", "q1_list_jobs")
def _(spark, d):
    page = monthly.list_jobs(spark, _by_month(spark, d), role="bolt", stack="blue", status="new", limit=200, offset=20)
    return page.select("id", "company", "role", "source", _stamp("posted_at"), "status")


@_like("q1_list_jobs_oldest_by_month", "q1_list_jobs_oldest")
def _(spark, d):
    page = monthly.list_jobs(spark, _by_month(spark, d), status="ignored", sort="oldest", limit=500)
    return page.select("id", "role", _stamp("posted_at"))


@_like("q14_new_job_batch_by_month", "q14_new_job_batch")
def _(spark, d):
    return monthly.new_job_batch(spark, _by_month(spark, d), "digest").select("id", "company", _stamp("posted_at"))


@_like("f4_job_predicates_by_tags", "f4_job_predicates")
def _(spark, d):
    path, jobs = shared_dir(spark, "job-tags"), view(spark, d, "jobs")
    postings.write_tags(jobs, path)
    kept = postings.jobs_with(jobs, path, "b_l", "blue, bolt", "applied")
    return kept.groupBy("role").agg(F.count("*").alias("jobs"))


@_like("q8_contacts_by_company_by_grams", "q8_contacts_by_company")
def _(spark, d):
    path = shared_dir(spark, "company-grams")
    postings.write_companies(view(spark, d, "contacts"), path)
    page = postings.contacts_by_company(spark, path, "R#00000000", 50, 10)
    total = postings.contacts_like(spark, path, "R#00000000").agg(F.count("*").alias("total")).scalar()
    return page.select("id", "company", "name", _stamp("created_at"), total.alias("total"))


@_like("q4_set_status_by_part", "q4_set_status")
def _(spark, d):
    path, changes = shared_dir(spark, "jobs-by-id"), view(spark, d, "status_changes")
    parts.create(view(spark, d, "jobs").select("id", "status"), path, ["id"])
    parts.change(spark, path, changes, lambda held: tables.set_status(held, changes))
    return parts.read(spark, path).groupBy("status").agg(
        F.count("*").alias("jobs"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@_like("q10_upsert_contacts_by_part", "q10_upsert_contacts")
def _(spark, d):
    path, fields = shared_dir(spark, "contacts-by-address"), schemas.CONTACT.fieldNames()
    contacts = view(spark, d, "contacts")
    incoming = plain.incoming_contacts(contacts)
    parts.create(contacts.select(*fields), path, ["company", "email"])
    parts.change(spark, path, incoming, lambda held: tables.upsert_contacts(held, incoming))
    return parts.read(spark, path).drop("created_at")


@_like("q11_delete_cascade_by_part", "q11_delete_cascade")
def _(spark, d):
    contacts, emails = shared_dir(spark, "contacts-by-id"), shared_dir(spark, "emails-by-id")
    parts.create(view(spark, d, "contacts").select("id", "verified"), contacts, ["id"])
    parts.create(view(spark, d, "emails").select("id", "contact_id"), emails, ["id"])
    gone = parts.read(spark, contacts).where("verified = 'invalid'").select("id")
    referring = parts.read(spark, emails).join(gone.select(F.col("id").alias("contact_id")), "contact_id", "left_semi").select("id")
    parts.change(spark, emails, referring, lambda held: tables.null_references(held, "contact_id", gone))
    parts.change(spark, contacts, gone, lambda held: tables.delete_rows(held, gone))
    reference = F.when(F.col("contact_id").isNull(), "none").otherwise("kept").alias("reference")
    left = parts.read(spark, contacts).agg(F.count("*")).scalar()
    return parts.read(spark, emails).groupBy(reference).agg(
        F.count("*").alias("emails"), F.min("id").alias("first_id")).withColumn("contacts_left", left)


@_like("q13_mark_sent_by_part", "q13_mark_sent")
def _(spark, d):
    path = shared_dir(spark, "emails-by-id")
    emails = view(spark, d, "emails").withColumn("sent_at", F.lit(None).cast("timestamp"))
    parts.create(emails.select("id", "status", "sent_at"), path, ["id"])
    sent = emails.where("status = 'draft' AND ok % 3 = 0").select("id")
    parts.change(spark, path, sent, lambda held: tables.mark_sent(held, sent, as_of()))
    return parts.read(spark, path).groupBy("status", _stamp("sent_at")).agg(
        F.count("*").alias("emails"), F.min("id").alias("first_id"))
