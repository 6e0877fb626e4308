"""Posting-shaped views over the test tables, as SQL text that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
AS_OF = "2001-11-05 00:00:00"

# name -> SQL. ``ymd(x)`` and ``stamp(x)`` are replaced by each engine's date formatting.
VIEWS: dict[str, str] = {
    "postings": """
SELECT md5(concat_ws('|', CAST(l_orderkey AS VARCHAR(20)), CAST(l_linenumber AS VARCHAR(20)),
           CAST(l_partkey AS VARCHAR(20)), CAST(l_suppkey AS VARCHAR(20)), ymd(l_shipdate))) AS event_id,
       s_name AS company, concat(p_type, ' ', p_name) AS role,
       CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL
            ELSE lower(substring(o_orderpriority, 3)) END AS source,
       concat('https://jobs.example.com/', CAST(l_suppkey AS VARCHAR(20)), '/',
              CAST(l_partkey AS VARCHAR(20))) AS url,
       split(p_name, ' ') AS stack, p_brand AS product, n_name AS location,
       CAST(l_shipdate AS TIMESTAMP) AS seen_at, CAST(o_orderdate AS TIMESTAMP) AS posted_at,
       CASE o_orderstatus WHEN 'O' THEN 'new' WHEN 'F' THEN 'applied' ELSE 'ignored' END AS status,
       l_partkey AS pk, l_suppkey AS sk, l_orderkey AS ok, p_name AS words
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "jobs": """
SELECT event_id AS id, company, role, source, url, stack, product, location,
       CASE WHEN pk % 13 = 0 THEN NULL ELSE posted_at END AS posted_at, status,
       seen_at AS created_at, pk, sk, words
FROM postings""",
    "wire_events": """
SELECT event_id,
       CASE pk % 50 WHEN 1 THEN '   ' WHEN 2 THEN concat('  ', company, '  ') ELSE company END AS company,
       CASE pk % 50 WHEN 3 THEN '' ELSE role END AS role,
       coalesce(source, '') AS source,
       CASE pk % 50 WHEN 8 THEN '' ELSE url END AS url,
       CASE pk % 50 WHEN 4 THEN 'not-valid-json' WHEN 5 THEN '[1, 2]' WHEN 6 THEN '{"a": 1}'
            WHEN 7 THEN NULL ELSE concat('["', replace(words, ' ', '","'), '"]') END AS stack,
       CASE pk % 50 WHEN 9 THEN '' ELSE product END AS product,
       CASE pk % 50 WHEN 10 THEN '' ELSE location END AS location,
       CASE pk % 5 WHEN 0 THEN '' WHEN 1 THEN '3 days ago' ELSE ymd(posted_at) END AS posted_at,
       seen_at, pk
FROM postings""",
    "contacts": """
SELECT md5(concat('contact|', CAST(c_custkey AS VARCHAR(20)))) AS id,
       CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE first_job END AS job_id,
       s_name AS company,
       concat('s', CAST(s_suppkey AS VARCHAR(20)), '.example.com') AS domain,
       concat('Ana', chr(CAST(97 + c_custkey % 26 AS INT)), ' Fam',
              chr(CAST(97 + CAST(floor(c_custkey / 26) AS BIGINT) % 26 AS INT)),
              chr(CAST(97 + CAST(floor(c_custkey / 676) AS BIGINT) % 26 AS INT))) AS name,
       CASE WHEN c_custkey % 11 = 0 THEN NULL
            ELSE concat('c', CAST(c_custkey AS VARCHAR(20)), '@s', CAST(s_suppkey AS VARCHAR(20)),
                        '.example.com') END AS email,
       lower(c_mktsegment) AS role,
       CASE WHEN c_custkey % 2 = 0 THEN 'github' ELSE 'linkedin' END AS source,
       CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'verified' WHEN 'MACHINERY' THEN 'invalid'
            ELSE 'unverified' END AS verified,
       TIMESTAMP '2001-01-01 00:00:00' + INTERVAL '1' MINUTE * CAST(c_custkey AS INT) AS created_at,
       c_custkey AS ck, s_suppkey AS sk
FROM (SELECT *, c_custkey % (SELECT count(*) FROM supplier) AS c_suppkey FROM customer) AS buyers
JOIN supplier ON s_suppkey = c_suppkey
LEFT JOIN (SELECT sk AS job_sk, min(event_id) AS first_job FROM postings GROUP BY sk) ON job_sk = s_suppkey""",
    "emails": """
SELECT md5(concat('email|', CAST(o_orderkey AS VARCHAR(20)))) AS id,
       md5(concat('job|', CAST(o_custkey AS VARCHAR(20)))) AS job_id,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL
            ELSE md5(concat('contact|', CAST(o_custkey AS VARCHAR(20)))) END AS contact_id,
       CASE o_orderkey % 4 WHEN 0 THEN 'cold_outreach' WHEN 1 THEN 'recruiter_outreach'
            WHEN 2 THEN 'referral_outreach' ELSE 'followup' END AS template,
       concat('About ', o_orderpriority) AS subject,
       concat('Body ', CAST(o_orderkey AS VARCHAR(20))) AS body,
       CAST(o_orderdate AS TIMESTAMP) AS generated_at,
       CASE WHEN o_orderstatus = 'F' AND o_orderkey % 9 <> 0 THEN
            CASE o_orderkey % 10 WHEN 0 THEN 'soon' WHEN 1 THEN concat(ymd(o_orderdate), 'T08:30:00+02:00')
                 ELSE concat(ymd(o_orderdate), 'T00:00:00Z') END END AS sent_text,
       CASE o_orderstatus WHEN 'F' THEN 'sent' WHEN 'P' THEN 'replied' ELSE 'draft' END AS status,
       CASE WHEN o_orderkey % 6 = 0 THEN 'pending_followup' END AS followup_status,
       o_orderkey AS ok
FROM orders""",
    "raw_dates": """
SELECT o_orderkey AS row_id,
       CASE o_orderkey % 24
         WHEN 0 THEN ymd(o_orderdate)
         WHEN 1 THEN concat(ymd(o_orderdate), 'T10:20:30')
         WHEN 2 THEN concat(ymd(o_orderdate), 'T10:20:30Z')
         WHEN 3 THEN concat(ymd(o_orderdate), ' 10:20:30')
         WHEN 4 THEN concat(ymd(o_orderdate), 'T10:20:30.250+05:30')
         WHEN 5 THEN concat(ymd(o_orderdate), 'T10:20:30-0500')
         WHEN 6 THEN mdy_short(o_orderdate)
         WHEN 7 THEN mdy_long(o_orderdate)
         WHEN 8 THEN dmy_short(o_orderdate)
         WHEN 9 THEN dmy_long(o_orderdate)
         WHEN 10 THEN concat('  ', dmy_dash(o_orderdate), ' ')
         WHEN 11 THEN CAST(o_orderkey * 1000 AS VARCHAR(20))
         WHEN 12 THEN CAST(1500000000000 + o_orderkey * 1000 AS VARCHAR(20))
         WHEN 13 THEN '-1'
         WHEN 14 THEN concat(CAST(o_orderkey % 40 AS VARCHAR(20)), ' Days ago')
         WHEN 15 THEN concat(CAST(o_orderkey % 12 AS VARCHAR(20)), ' month ago')
         WHEN 16 THEN concat(CAST(o_orderkey % 50 AS VARCHAR(20)), ' hours ago')
         WHEN 17 THEN 'Yesterday'
         WHEN 18 THEN 'just now'
         WHEN 19 THEN ''
         WHEN 20 THEN NULL
         WHEN 21 THEN '06/01/2024'
         WHEN 22 THEN '2024-06'
         ELSE 'a while back' END AS raw,
       CAST(o_orderdate AS TIMESTAMP) AS day
FROM orders""",
    "known_addresses": """
SELECT c_custkey AS seq, concat('s', CAST(s_suppkey AS VARCHAR(20)), '.example.com') AS domain,
       concat(CASE (c_custkey + s_suppkey) % 5 WHEN 0 THEN 'ana.fam' WHEN 1 THEN 'afam' WHEN 2 THEN 'Ana'
                   WHEN 3 THEN 'x9' ELSE 'noreply' END, '@',
              CASE WHEN c_custkey % 19 = 0 THEN 'elsewhere.org'
                   ELSE concat('s', CAST(s_suppkey AS VARCHAR(20)), '.example.com') END) AS email
FROM (SELECT *, CAST(floor(c_custkey / 3) AS BIGINT) % (SELECT count(*) FROM supplier) AS c_suppkey
      FROM customer) AS buyers
JOIN supplier ON s_suppkey = c_suppkey
WHERE s_suppkey % 6 <> 5""",
    "companies": """
SELECT s_suppkey AS sk, s_name AS company,
       CASE WHEN s_suppkey % 5 = 0 THEN concat('s', CAST(s_suppkey AS VARCHAR(20)), '.example.com') END AS suggestion,
       CASE WHEN s_suppkey % 7 = 1 THEN concat('s', CAST(s_suppkey AS VARCHAR(20)), '.example.com') END AS provided
FROM supplier""",
    "domain_probes": """
SELECT concat(lower(replace(s_name, '#', '')), '.', suffix) AS candidate,
       CAST(CASE WHEN (s_suppkey + pos) % 4 = 0 THEN 404 WHEN (s_suppkey + pos) % 5 = 0 THEN 500
            ELSE 200 END AS INT) AS status_code
FROM (SELECT s_suppkey, s_name, 'com' AS suffix, 0 AS pos FROM supplier
      UNION ALL SELECT s_suppkey, s_name, 'io', 1 FROM supplier
      UNION ALL SELECT s_suppkey, s_name, 'co.in', 2 FROM supplier
      UNION ALL SELECT s_suppkey, s_name, 'in', 3 FROM supplier) AS tried
WHERE pos >= s_suppkey % 5""",
    "mx_records": """
SELECT concat('s', CAST(l_suppkey AS VARCHAR(20)), '.example.com') AS domain,
       CAST(l_partkey AS INT) AS preference,
       concat('mx', CAST(l_partkey AS VARCHAR(20)), '.s', CAST(l_suppkey AS VARCHAR(20)), '.example.com.') AS exchange
FROM lineitem WHERE l_suppkey % 4 <> 3""",
    "probe_results": """
SELECT coalesce(email, '') AS email,
       CAST(CASE ck % 5 WHEN 0 THEN 250 WHEN 1 THEN 550 WHEN 2 THEN 553 WHEN 3 THEN 450 ELSE NULL END AS INT) AS code
FROM contacts""",
    "people": """
SELECT ck AS seq, company, sk,
       CASE WHEN ck % 8 = 0 THEN upper(name) WHEN ck % 8 = 1 THEN concat('  ', substring(name, 1, 4), ' ')
            ELSE name END AS name,
       CASE ck % 4 WHEN 0 THEN 'Backend engineer at heart' WHEN 1 THEN 'Talent partner'
            WHEN 2 THEN NULL ELSE 'I like music' END AS bio,
       source
FROM contacts""",
    "status_changes": """
SELECT event_id AS id, CASE pk % 3 WHEN 0 THEN 'applied' WHEN 1 THEN 'ignored' ELSE 'new' END AS status, 1 AS seq
FROM postings WHERE pk % 2 = 0
UNION ALL
SELECT CASE WHEN pk % 9 = 0 THEN 'no-such-id' ELSE event_id END,
       CASE pk % 4 WHEN 0 THEN 'ignored' WHEN 1 THEN 'pending' ELSE 'applied' END, 2
FROM postings WHERE pk % 4 < 3""",
    "search_results": """
SELECT page_id * 2 AS seq, concat(CASE page_id % 6 WHEN 0 THEN 'Open roles, apply now: ' WHEN 1 THEN 'Hiring a position: '
            WHEN 2 THEN 'A tutorial on ' WHEN 3 THEN 'jobs ' ELSE '' END, text) AS title,
       CASE WHEN page_id % 17 = 0 THEN replace(url, 'example', 'youtube') WHEN page_id % 23 = 0 THEN 'ftp://x.y/z'
            WHEN page_id % 29 = 0 THEN concat('  https://www.youtu.be/', CAST(page_id AS VARCHAR(20)), ' ')
            ELSE url END AS url,
       text AS snippet, concat('q', CAST(page_id % 5 AS VARCHAR(20))) AS query
FROM pages JOIN documents ON doc_id = page_id
UNION ALL
SELECT page_id * 2 + 1, concat('Careers page, apply: ', text),
       concat(split_part(url, '#', 1), CASE WHEN contains(url, '?') THEN '&' ELSE '?' END, 'utm_medium=x&B=1%20a+b&c'),
       text, 'again'
FROM pages JOIN documents ON doc_id = page_id WHERE page_id % 3 <> 0""",
    "texts": """
SELECT doc_id, lang, source, text AS raw_text,
       concat(CASE doc_id % 7
         WHEN 0 THEN 'Senior Software Engineer with 5 years of experience. Python, FastAPI, Docker, PostgreSQL. '
         WHEN 1 THEN 'I have worked with JavaScript and nodejs for 2 years. '
         WHEN 2 THEN 'Full-Stack Developer, over 4 years, React and GraphQL in Berlin. '
         WHEN 3 THEN 'Product lead in payments and banking, experience of 12+ years. New York. '
         WHEN 4 THEN 'Talent recruiter, 7 yrs of experience, kubernetes platform, cloud storage. '
         WHEN 5 THEN '3+ years in design work, remote. '
         ELSE '' END, text) AS text
FROM documents""",
}

_NEEDS = {
    name: [t for t in VIEWS if t != name and re.search(rf"\b(FROM|JOIN)\s+{t}\b", text)]
    for name, text in VIEWS.items()
}

_DATES = {
    "ymd": ("yyyy-MM-dd", "%Y-%m-%d"),
    "mdy_short": ("MMM d, yyyy", "%b %-d, %Y"),
    "mdy_long": ("MMMM dd yyyy", "%B %d %Y"),
    "dmy_short": ("dd MMM yyyy", "%d %b %Y"),
    "dmy_long": ("d MMMM yyyy", "%-d %B %Y"),
    "dmy_dash": ("dd-MM-yyyy", "%d-%m-%Y"),
}


def _closure(names: list[str]) -> list[str]:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in _NEEDS[name]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return ordered


def _dialect(text: str, engine: str) -> str:
    for name, (spark_format, duck_format) in _DATES.items():
        if engine == "spark":
            text = re.sub(rf"\b{name}\(([^()]*)\)", rf"date_format(\1, '{spark_format}')", text)
        else:
            text = re.sub(rf"\b{name}\(([^()]*)\)", rf"strftime(\1, '{duck_format}')", text)
    return text


def view_ctes(names: list[str], engine: str) -> str:
    """The views and what they need, as a comma-separated list of WITH items."""
    return ",\n".join(f"{n} AS ({_dialect(VIEWS[n], engine)})" for n in _closure(names))


# Large tables and the key to spread them by.
_SPREAD_BY = {"lineitem": "l_orderkey", "documents": "doc_id", "pages": "page_id"}


def _tasks_wanted(spark: SparkSession, path: str, name: str) -> int | None:
    """Tasks to spread a table over if it has fewer splits than the cluster has cores, else None.

    Only a table that is small next to the cluster is moved; with more splits than cores the scan
    stays as it is.
    """
    if name not in _SPREAD_BY:
        return None
    cores = spark.sparkContext.defaultParallelism
    splits = spark.read.parquet(path)._jdf.queryExecution().toRdd().getNumPartitions()
    return cores if splits < cores else None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    df = spark.read.parquet(path)
    tasks = _tasks_wanted(spark, path, name)
    if tasks:
        df = df.repartition(tasks, _SPREAD_BY[name])
    naive = [f.name for f in df.schema.fields if f.dataType.simpleString() == "timestamp_ntz"]
    return df.withColumns({c: df[c].cast("timestamp") for c in naive}) if naive else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = view_ctes([name], "spark")

    def root(t: str) -> str:
        path = f"{sf_dir}/{t}.parquet"
        tasks = _tasks_wanted(spark, path, t)
        hint = f"/*+ REPARTITION({tasks}, {_SPREAD_BY[t]}) */ " if tasks else ""
        return f"{t} AS (SELECT {hint}* FROM parquet.`{path}`)"

    used = [t for t in TABLES if re.search(rf"\b(FROM|JOIN)\s+{t}\b", text)]
    roots = ",\n".join(root(t) for t in used)
    return spark.sql(f"WITH {roots},\n{text}\nSELECT * FROM {name}")


def as_of() -> Column:
    """The instant that all registered queries count from."""
    return F.lit(AS_OF).cast("timestamp")
