"""Registered queries: jobs, contacts and emails tables, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from postloom import schemas
from postloom.operators import filters, tables
from postloom.plans.registry import query
from postloom.plans.views import AS_OF, as_of, table, view

_STAMP = "yyyy-MM-dd HH:mm:ss"


def _stamp(name: str):
    return F.date_format(name, _STAMP).alias(name)


def _sql_stamp(name: str) -> str:
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S') AS {name}"


@query("q1_list_jobs", f"""
SELECT id, company, role, source, {_sql_stamp('posted_at')}, status FROM jobs
WHERE role ILIKE '%bolt%' AND list_contains(stack, 'blue') AND status = 'new'
ORDER BY jobs.posted_at DESC NULLS LAST, id LIMIT 200 OFFSET 20""", ["jobs"])
def _(spark, d):
    page = tables.list_jobs(view(spark, d, "jobs"), role="bolt", stack="blue", status="new", limit=200, offset=20)
    return page.select("id", "company", "role", "source", _stamp("posted_at"), "status")


@query("q1_list_jobs_oldest", f"""
SELECT id, role, {_sql_stamp('posted_at')} FROM jobs WHERE status = 'ignored'
ORDER BY jobs.posted_at ASC NULLS LAST, id LIMIT 500""", ["jobs"])
def _(spark, d):
    page = tables.list_jobs(view(spark, d, "jobs"), status="ignored", sort="oldest", limit=500)
    return page.select("id", "role", _stamp("posted_at"))


@query("q2_page_info", """
SELECT count(*) AS total, CAST(50 AS INT) AS "limit", CAST(100 AS INT) AS "offset", 150 < count(*) AS has_more
FROM jobs WHERE role ILIKE '%ring%'""", ["jobs"])
def _(spark, d):
    return tables.page_info(tables.count_jobs(view(spark, d, "jobs"), role="ring"), 50, 100)


@query("q2_page_one_pass", f"""
SELECT id, role, {_sql_stamp('posted_at')}, count(*) OVER () AS total, CAST(50 AS INT) AS "limit", CAST(100 AS INT) AS "offset",
       150 < count(*) OVER () AS has_more
FROM jobs WHERE role ILIKE '%ring%' ORDER BY jobs.posted_at DESC NULLS LAST, id LIMIT 50 OFFSET 100""", ["jobs"])
def _(spark, d):
    """The page and its counts in one job."""
    jobs = view(spark, d, "jobs")
    rows, info = tables.page_with_info(jobs, role="ring", limit=50, offset=100)
    page = spark.createDataFrame(rows, jobs.schema)
    total = F.lit(info.pop("total")).cast("long").alias("total")
    return page.select("id", "role", _stamp("posted_at"), total, *[F.lit(value).alias(name) for name, value in info.items()])


@query("q3_job_by_id", """
SELECT id, company, role, url FROM jobs WHERE id = (SELECT min(id) FROM jobs)""", ["jobs"])
def _(spark, d):
    jobs = view(spark, d, "jobs")
    wanted = jobs.agg(F.min("id")).scalar()
    return tables.row_by_id(jobs, wanted).select("id", "company", "role", "url")


@query("q4_set_status", """
SELECT status, count(*) AS jobs, min(id) AS first_id, max(id) AS last_id FROM after_changes GROUP BY status""",
       ["jobs", "status_changes"], ctes="""
last_change AS (SELECT id, arg_max(status, seq) AS new_status FROM status_changes
                WHERE status IN ('new', 'applied', 'ignored') GROUP BY id),
after_changes AS (SELECT jobs.id, coalesce(new_status, status) AS status
                  FROM jobs LEFT JOIN last_change ON jobs.id = last_change.id)""")
def _(spark, d):
    after = tables.set_status(view(spark, d, "jobs").select("id", "status"), view(spark, d, "status_changes"))
    return after.groupBy("status").agg(
        F.count("*").alias("jobs"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
    )


@query("q5_stats_by_source", f"""
SELECT coalesce(source, 'unknown') AS source, count(*) AS jobs FROM jobs
WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY GROUP BY 1""", ["jobs"])
def _(spark, d):
    return tables.stats_by(view(spark, d, "jobs"), "source", as_of(), 365)


@query("q6_stats_by_status", f"""
SELECT status, count(*) AS jobs FROM jobs
WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 365 DAY GROUP BY 1""", ["jobs"])
def _(spark, d):
    return tables.stats_by(view(spark, d, "jobs"), "status", as_of(), 365)


@query("q6_stats_map", """
SELECT string_agg(kind || ':' || k || '=' || CAST(n AS VARCHAR), ' ' ORDER BY kind, k) AS stats FROM (
  SELECT 'source' AS kind, coalesce(source, 'unknown') AS k, count(*) AS n FROM jobs GROUP BY ALL
  UNION ALL SELECT 'status', status, count(*) FROM jobs GROUP BY ALL)""", ["jobs"])
def _(spark, d):
    one = tables.stats_map(view(spark, d, "jobs"), as_of(), None)

    def shown(kind):
        return F.transform(
            F.array_sort(F.map_entries(f"by_{kind}")),
            lambda e: F.concat(F.lit(f"{kind}:"), e["key"], F.lit("="), e["value"].cast("string")),
        )

    return one.select(F.array_join(F.concat(shown("source"), shown("status")), " ").alias("stats"))


@query("q7_board_counts", """
SELECT CAST(position AS INT) AS position, board, count(id) AS cards
FROM (VALUES (0, 'discovered'), (1, 'contacted'), (2, 'applied'), (3, 'interviewing'), (4, 'offer'),
             (5, 'rejected')) AS b(position, board)
LEFT JOIN (SELECT id, CASE WHEN shown IN ('contacted', 'applied', 'interviewing', 'offer', 'rejected') THEN shown
                  WHEN shown = 'ignored' THEN 'rejected' ELSE 'discovered' END AS card_board
           FROM (SELECT id, CASE pk % 5 WHEN 0 THEN 'offer' WHEN 1 THEN 'odd' ELSE status END AS shown FROM jobs))
ON board = card_board GROUP BY 1, 2""", ["jobs"])
def _(spark, d):
    shown = F.when(F.col("pk") % 5 == 0, "offer").when(F.col("pk") % 5 == 1, "odd").otherwise(F.col("status"))
    return tables.board_counts(view(spark, d, "jobs").withColumn("status", shown))


@query("q8_contacts_by_company", f"""
SELECT id, company, name, {_sql_stamp('created_at')}, (SELECT count(*) FROM contacts WHERE company ILIKE '%r#00000000%') AS total
FROM contacts WHERE company ILIKE '%r#00000000%'
ORDER BY contacts.created_at DESC, id LIMIT 50 OFFSET 10""", ["contacts"])
def _(spark, d):
    contacts = view(spark, d, "contacts")
    page = tables.contacts_by_company(contacts, "R#00000000", 50, 10)
    total = tables.count_contacts(contacts, "R#00000000").scalar()
    return page.select("id", "company", "name", _stamp("created_at"), total.alias("total"))


@query("q9_contacts_by_job", """
SELECT id, job_id, company FROM contacts WHERE job_id = (SELECT max(job_id) FROM contacts)
ORDER BY created_at DESC, id LIMIT 50""", ["contacts"])
def _(spark, d):
    contacts = view(spark, d, "contacts")
    wanted = contacts.agg(F.max("job_id")).scalar()
    return tables.contacts_by_job(contacts, wanted).select("id", "job_id", "company")


_INCOMING = """
incoming AS (
  SELECT concat('n', id) AS id, job_id, company, 'changed.example.com' AS domain,
         CASE WHEN ck % 4 = 0 THEN NULL ELSE upper(name) END AS name,
         CASE WHEN ck % 10 = 9 THEN concat('new', CAST(ck AS VARCHAR(20)), '@x.org') ELSE email END AS email,
         CASE WHEN ck % 3 = 0 THEN NULL ELSE 'lead' END AS role, 'upload' AS source, 'verified' AS verified,
         created_at, 1 AS seq FROM contacts WHERE ck % 2 = 0 OR ck % 10 = 9
  UNION ALL
  SELECT concat('m', id), NULL, company, NULL, NULL, email, 'head', 'again', 'invalid', created_at, 2
  FROM contacts WHERE ck % 4 = 2)"""


def incoming_contacts(contacts):
    """Rows to be inserted or merged, made of every second contact, with their order ``seq``."""
    fields = schemas.CONTACT.fieldNames()
    k = F.col("ck")
    one = contacts.where((k % 2 == 0) | (k % 10 == 9)).withColumns({
        "id": F.concat(F.lit("n"), "id"), "domain": F.lit("changed.example.com"),
        "name": F.when(k % 4 != 0, F.upper("name")),
        "email": F.when(k % 10 == 9, F.concat(F.lit("new"), k.cast("string"), F.lit("@x.org"))).otherwise(F.col("email")),
        "role": F.when(k % 3 != 0, "lead"), "source": F.lit("upload"), "verified": F.lit("verified"), "seq": F.lit(1),
    })
    two = contacts.where(k % 4 == 2).withColumns({
        "id": F.concat(F.lit("m"), "id"), "job_id": F.lit(None).cast("string"),
        "domain": F.lit(None).cast("string"), "name": F.lit(None).cast("string"), "role": F.lit("head"),
        "source": F.lit("again"), "verified": F.lit("invalid"), "seq": F.lit(2),
    })
    return one.select(*fields, "seq").unionByName(two.select(*fields, "seq"))


@query("q10_upsert_contacts", """
SELECT id, job_id, company, domain, name, email, role, source, verified FROM (
  SELECT struct_extract(arg_min(struct_pack(v := id), ord), 'v') AS id, struct_extract(arg_min(struct_pack(v := job_id), ord), 'v') AS job_id, company,
         struct_extract(arg_min(struct_pack(v := domain), ord), 'v') AS domain,
         arg_max(name, ord) AS name, email, arg_max(role, ord) AS role,
         struct_extract(arg_max(struct_pack(v := source), ord), 'v') AS source, struct_extract(arg_max(struct_pack(v := verified), ord), 'v') AS verified
  FROM everything WHERE email IS NOT NULL GROUP BY company, email
  UNION ALL SELECT id, job_id, company, domain, name, email, role, source, verified FROM everything WHERE email IS NULL)""",
       ["contacts"], ctes=_INCOMING + """,
everything AS (SELECT id, job_id, company, domain, name, email, role, source, verified, 0 AS ord FROM contacts
  UNION ALL SELECT id, job_id, company, domain, name, email, role, source, verified, seq FROM incoming)""")
def _(spark, d):
    contacts = view(spark, d, "contacts")
    after = tables.upsert_contacts(contacts.select(*schemas.CONTACT.fieldNames()), incoming_contacts(contacts))
    return after.drop("created_at")


@query("q11_delete_cascade", """
SELECT CASE WHEN contact_id IS NULL THEN 'none' ELSE 'kept' END AS reference, count(*) AS emails,
       min(id) AS first_id, (SELECT count(*) FROM contacts WHERE verified <> 'invalid') AS contacts_left
FROM (SELECT emails.id, CASE WHEN gone.id IS NULL THEN contact_id END AS contact_id
      FROM emails LEFT JOIN (SELECT id FROM contacts WHERE verified = 'invalid') gone ON contact_id = gone.id)
GROUP BY 1""", ["emails", "contacts"])
def _(spark, d):
    contacts, emails = view(spark, d, "contacts"), view(spark, d, "emails")
    gone = contacts.where("verified = 'invalid'").select("id")
    left = tables.delete_rows(contacts, gone).agg(F.count("*")).scalar()
    after = tables.null_references(emails, "contact_id", gone)
    reference = F.when(F.col("contact_id").isNull(), "none").otherwise("kept").alias("reference")
    return after.groupBy(reference).agg(
        F.count("*").alias("emails"), F.min("id").alias("first_id")
    ).withColumn("contacts_left", left)


@query("q12_emails_by_job", f"""
SELECT id, template, status, {_sql_stamp('generated_at')} FROM emails
WHERE job_id = (SELECT min(job_id) FROM emails)""", ["emails"])
def _(spark, d):
    emails = view(spark, d, "emails")
    wanted = emails.agg(F.min("job_id")).scalar()
    return tables.emails_by_job(emails, wanted).select("id", "template", "status", _stamp("generated_at"))


@query("q13_mark_sent", f"""
SELECT status, strftime(sent_at, '%Y-%m-%d %H:%M:%S') AS sent_at, count(*) AS emails, min(id) AS first_id FROM (
  SELECT id, CASE WHEN status = 'draft' AND ok % 3 = 0 THEN 'sent' ELSE status END AS status,
         CASE WHEN status = 'draft' AND ok % 3 = 0 THEN TIMESTAMP '{AS_OF}' END AS sent_at FROM emails)
GROUP BY 1, 2""", ["emails"])
def _(spark, d):
    emails = view(spark, d, "emails").withColumn("sent_at", F.lit(None).cast("timestamp"))
    sent = emails.where("status = 'draft' AND ok % 3 = 0").select("id")
    after = tables.mark_sent(emails.select("id", "status", "sent_at"), sent, as_of())
    return after.groupBy("status", _stamp("sent_at")).agg(
        F.count("*").alias("emails"), F.min("id").alias("first_id")
    )


@query("q14_new_job_batch", f"""
SELECT id, company, {_sql_stamp('posted_at')} FROM jobs WHERE status = 'new'
ORDER BY jobs.posted_at DESC NULLS LAST, id LIMIT 100""", ["jobs"])
def _(spark, d):
    return tables.new_job_batch(view(spark, d, "jobs"), "digest").select("id", "company", _stamp("posted_at"))


@query("s4_export_rows", """
SELECT id, company, role, coalesce(source, '') AS source, coalesce(url, '') AS url,
       array_to_string(stack, ',') AS stack, coalesce(product, '') AS product, coalesce(location, '') AS location,
       coalesce(strftime(posted_at, '%Y-%m-%dT%H:%M:%S+00:00'), '') AS posted_at, status,
       strftime(created_at, '%Y-%m-%dT%H:%M:%S+00:00') AS created_at
FROM jobs WHERE status = 'applied'""", ["jobs"])
def _(spark, d):
    return tables.export_rows(view(spark, d, "jobs"), status="applied")


@query("f1_stack_filter", """
SELECT source, count(*) AS kept, min(event_id) AS first_id FROM postings
WHERE len(list_filter(list_concat(list_transform(stack, lambda t: lower(trim(t))), string_split(lower(role), ' ')),
                      lambda t: t IN ('blue', 'economy'))) > 0 GROUP BY source""", ["postings"])
def _(spark, d):
    kept = filters.stack_filter(view(spark, d, "postings"), [" Blue", "economy", ""])
    return kept.groupBy("source").agg(F.count("*").alias("kept"), F.min("event_id").alias("first_id"))


@query("f2_stack_matches", """
SELECT location, count(*) AS kept FROM postings
WHERE list_contains(stack, 'red') OR list_contains(stack, 'bolt') GROUP BY location""", ["postings"])
def _(spark, d):
    kept = view(spark, d, "postings").where(filters.stack_matches(["Red", "bolt"]))
    return kept.groupBy("location").agg(F.count("*").alias("kept"))


@query("f3_role_matches", """
SELECT location, count(*) AS kept FROM postings
WHERE contains(lower(role), 'wid') OR contains(lower(role), 'prom') GROUP BY location""", ["postings"])
def _(spark, d):
    kept = view(spark, d, "postings").where(filters.role_matches("Wid PROM"))
    return kept.groupBy("location").agg(F.count("*").alias("kept"))


@query("f4_job_predicates", """
SELECT role, count(*) AS jobs FROM jobs
WHERE role ILIKE '%b_l%' AND list_contains(stack, 'blue') AND list_contains(stack, 'bolt') AND status = 'applied'
GROUP BY role""", ["jobs"])
def _(spark, d):
    kept = view(spark, d, "jobs").where(filters.job_predicate("b_l", "blue, bolt", "applied"))
    return kept.groupBy("role").agg(F.count("*").alias("jobs"))


@query("f6_status_guard", """
SELECT status, count(*) AS refused, min(id) AS first_id FROM status_changes
WHERE status NOT IN ('new', 'applied', 'ignored') GROUP BY status""", ["status_changes"])
def _(spark, d):
    _, refused = filters.split_guarded(view(spark, d, "status_changes"), "status", schemas.JOB_STATUSES)
    return refused.groupBy("status").agg(F.count("*").alias("refused"), F.min("id").alias("first_id"))
