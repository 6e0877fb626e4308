"""Registered queries: events, cleaning, de-duplication."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from postloom.functions.dates import normalize_date
from postloom.operators import dedup, ingest
from postloom.plans.registry import query
from postloom.plans.views import AS_OF, as_of, table, view



def chain_sql(source: str, key: str, ts: str, event_id: str, interval: str, limit: int = 1, tag: str = "") -> str:
    """Recursive CTEs that end in ``admitted<tag>(event_id)``: the sequential rule, row by row."""
    return f"""
numbered{tag} AS (SELECT {key} AS k, {ts} AS t, {event_id} AS e,
  row_number() OVER (PARTITION BY {key} ORDER BY {ts}, {event_id}) AS rn FROM {source}),
chain{tag} AS (
  SELECT k, e, rn, t AS start, 1 AS n, true AS ok FROM numbered{tag} WHERE rn = 1
  UNION ALL
  SELECT b.k, b.e, b.rn,
    CASE WHEN b.t >= a.start + {interval} THEN b.t ELSE a.start END,
    CASE WHEN b.t >= a.start + {interval} THEN 1 WHEN a.n < {limit} THEN a.n + 1 ELSE a.n END,
    b.t >= a.start + {interval} OR a.n < {limit}
  FROM chain{tag} a JOIN numbered{tag} b ON a.k = b.k AND b.rn = a.rn + 1),
admitted{tag} AS (SELECT e AS event_id FROM chain{tag} WHERE ok)"""


_KEY_SQL = "md5(concat(lower(trim(company)), '|', lower(trim(role))))"


@query("flagship_accepted_by_source", """
SELECT coalesce(source, 'unknown') AS source, count(*) AS jobs
FROM postings JOIN admitted USING (event_id) GROUP BY 1""", ["postings"],
       ctes=chain_sql("postings", "concat(company, '|', split_part(role, ' ', 1))", "seen_at", "event_id",
                      "INTERVAL 7 DAY"))
def accepted_by_source(spark, d):
    """Postings accepted after seven-day de-duplication, counted per source."""
    postings = ingest.require_company_role(view(spark, d, "postings"))
    key = dedup.consumer_key("company", F.split_part("role", F.lit(" "), F.lit(1)))
    accepted = dedup.dedup_ttl(postings, key)
    return accepted.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("jobs"))


@query("d1_key_producer", """
SELECT event_id, concat('dedup:', md5(concat(lower(trim(company)), '::', lower(trim(role))))) AS k FROM wire_events""",
       ["wire_events"])
def _(spark, d):
    return view(spark, d, "wire_events").select("event_id", dedup.producer_key().alias("k"))


@query("d2_key_consumer", """
SELECT event_id, concat('dedup:agg:', md5(concat(lower(trim(company)), '|', lower(trim(role))))) AS k FROM wire_events""",
       ["wire_events"])
def _(spark, d):
    return view(spark, d, "wire_events").select("event_id", dedup.consumer_key().alias("k"))


@query("d3_dedup_ttl", "SELECT event_id FROM admitted",
       ctes=chain_sql("events", "concat(user_id, '|', event_type)", "ts", "event_id", "INTERVAL 7 DAY").strip())
def _(spark, d):
    key = F.concat_ws("|", F.col("user_id").cast("string"), "event_type")
    return dedup.dedup_ttl(table(spark, d, "events"), key, "ts").select("event_id")


@query("d3_dedup_ttl_hot_keys", "SELECT event_id FROM admitted",
       ctes=chain_sql("events", "event_type", "ts", "event_id", "INTERVAL 1 HOUR").strip())
def _(spark, d):
    """Five keys hold all rows: the plan for hot keys, in time slices."""
    events = table(spark, d, "events")
    bound = 1500
    return dedup.dedup_ttl(
        events, "event_type", "ts", ttl=timedelta(hours=1), max_rows_per_key=bound
    ).select("event_id")


TWO_STAGE_SQL = chain_sql("postings", "concat(lower(company), '::', lower(role))", "seen_at", "event_id", "INTERVAL 7 DAY") + """,
wanted AS (SELECT * FROM postings JOIN admitted USING (event_id)
           WHERE list_contains(stack, 'blue') OR list_contains(string_split(lower(role), ' '), 'economy')),""" + chain_sql(
    "wanted", "concat(lower(company), '|', lower(role))", "seen_at", "event_id", "INTERVAL 7 DAY", tag="_b")


@query("d5_two_stage_dedup", "SELECT e AS event_id FROM chain_b WHERE ok", ["postings"], ctes=TWO_STAGE_SQL)
def _(spark, d):
    return dedup.two_stage_dedup(view(spark, d, "postings"), ["blue", "economy"]).select("event_id")


@query("d6_dedup_first", """
SELECT arg_min(event_id, struct_pack(a := seen_at, b := event_id)) AS event_id, lower(company) AS k, count(*) > 0 AS found
FROM postings GROUP BY lower(company)""", ["postings"])
def _(spark, d):
    postings = view(spark, d, "postings").withColumn("k", F.lower("company"))
    first = dedup.dedup_first(postings, "k", ["seen_at", "event_id"])
    return first.select("event_id", "k", F.lit(True).alias("found"))


_NO_URL = "CASE WHEN pk % 17 = 0 THEN NULL ELSE url END"


@query("d7_unique_url", f"""
SELECT min(event_id) AS event_id, url FROM (SELECT event_id, pk, {_NO_URL} AS url FROM postings)
WHERE url IS NOT NULL AND url NOT IN (SELECT url FROM postings WHERE pk % 10 = 3) GROUP BY url
UNION ALL SELECT event_id, NULL FROM postings WHERE pk % 17 = 0""", ["postings"])
def _(spark, d):
    postings = view(spark, d, "postings").select("event_id", "pk", "url")
    incoming = postings.withColumn("url", F.expr(_NO_URL))
    return dedup.unique_url(incoming, postings.where("pk % 10 = 3"), ["event_id"]).select("event_id", "url")


@query("d8_admit_rate_limit", "SELECT event_id FROM admitted",
       ctes=chain_sql("events", "event_type", "ts", "event_id", "INTERVAL 1 HOUR", 3).strip())
def _(spark, d):
    return dedup.admit_rate_limit(table(spark, d, "events"), "event_type", "ts", "event_id").select("event_id")


@query("d8_admit_rate_limit_hot_keys", "SELECT event_id FROM admitted",
       ctes=chain_sql("events", "event_type", "ts", "event_id", "INTERVAL 5 DAY", 30).strip())
def _(spark, d):
    """Every slice is above the bound: rounds of pruned top-n windows."""
    return dedup.admit_rate_limit(
        table(spark, d, "events"), "event_type", "ts", "event_id",
        per_window=30, window=timedelta(days=5), max_rows_per_key=100,
    ).select("event_id")
