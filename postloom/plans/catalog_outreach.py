"""Registered queries: search, contacts, matching, ranking, drafts, digest, summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from postloom import lexicon, schemas
from postloom.functions import dates
from postloom.functions.vectors import cosine, match_tier
from postloom.operators import contacts as people
from postloom.operators import digest, matching, outreach, runs, search, summary, tables
from postloom.plans.catalog_sources import _NORM_SQL
from postloom.plans.registry import query
from postloom.plans.views import AS_OF, as_of, table, view
from postloom.session import shared_dir


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _hits(text: str, terms) -> str:
    """How many terms occur, as SQL."""
    return "(" + " + ".join(f"CAST(contains({text}, {_sql_text(t)}) AS INT)" for t in terms) + ")"


# -- search --------------------------------------------------------------------------------

_SCORED = f"""
canon AS (SELECT *, {_NORM_SQL} AS norm FROM search_results),
early AS (SELECT *, CASE WHEN norm = '' THEN 'missing_url'
  WHEN regexp_matches(regexp_replace(regexp_extract(norm, '^https?://([^/?#]*)', 1), '^www\\.', ''),
       '(^|\\.)(youtube\\.com|youtu\\.be|facebook\\.com|instagram\\.com|pinterest\\.com)$') THEN 'blocked_domain' END AS stop,
  lower(concat(title, ' ', snippet, ' ', norm)) AS txt FROM canon),
ranked AS (SELECT *, CASE WHEN stop IS NULL THEN row_number() OVER (PARTITION BY stop IS NULL, norm ORDER BY seq) END AS nth FROM early),
scored AS (SELECT seq, norm AS norm_url, {_hits('txt', lexicon.HIGH_SIGNAL_TERMS)} AS score,
  CASE WHEN stop IS NOT NULL THEN stop WHEN nth > 1 THEN 'duplicate_url'
       WHEN {_hits('txt', lexicon.NOISY_TERMS)} > 0 THEN 'noisy_term'
       WHEN {_hits('txt', lexicon.HIGH_SIGNAL_TERMS)} < 2 THEN 'low_signal' ELSE 'accepted' END AS reason FROM ranked)"""


@query("f5_score_search_results", "SELECT seq, norm_url, CAST(score AS INT) AS score, reason FROM scored",
       ["search_results"], ctes=_SCORED)
def _(spark, d):
    return search.score_results(view(spark, d, "search_results")).select("seq", "norm_url", "score", "reason")


@query("f5_candidates", """
SELECT trim(title, concat(' ', chr(10))) AS title, norm_url AS url, query, CAST(score AS INT) AS score
FROM scored JOIN search_results USING (seq) WHERE reason = 'accepted'""", ["search_results"], ctes=_SCORED)
def _(spark, d):
    found = search.candidates(search.score_results(view(spark, d, "search_results")))
    return found.select("title", "url", "query", "score")


_PROFILES = """CASE pk % 4 WHEN 0 THEN 'notion,company_careers,notion' WHEN 1 THEN 'lever,unknown,github' END"""
_HIRING = '("hiring" OR "we are hiring" OR "open roles" OR "careers" OR "jobs")'


@query("g15_search_queries", f"""
SELECT event_id, CAST(position AS INT) AS position, query FROM (
  SELECT event_id, pk, unnest(range(len(plats))) AS position,
    replace(CASE unnest(plats)
      WHEN 'company_careers' THEN concat('inurl:careers ("open roles" OR jobs OR hiring) ', ctx)
      WHEN 'notion' THEN concat('site:notion.so ', ctx, ' {_HIRING}') WHEN 'github' THEN concat('site:github.com ', ctx, ' {_HIRING}')
      WHEN 'linkedin_jobs' THEN concat('site:linkedin.com/jobs ', ctx) WHEN 'greenhouse' THEN concat('site:greenhouse.io ', ctx)
      ELSE concat('site:jobs.lever.co ', ctx) END, '  ', ' ') AS query
  FROM (SELECT event_id, pk, concat('"', role, '" "', replace(words, ' ', '" "'), '" ', CASE WHEN pk % 3 = 0 THEN '' ELSE concat('"', location, '" ') END,
               CASE WHEN pk % 5 = 0 THEN '2026 ' ELSE '' END, 'after:2024-05-01') AS ctx,
          CASE pk % 4 WHEN 0 THEN ['notion', 'company_careers'] WHEN 1 THEN ['lever', 'github']
               ELSE ['company_careers', 'notion', 'github', 'linkedin_jobs', 'greenhouse', 'lever'] END AS plats FROM postings))
WHERE position < CASE WHEN pk % 4 = 2 THEN 3 ELSE 12 END""", ["postings"])
def _(spark, d):
    profiles = view(spark, d, "postings").select(
        F.col("event_id").alias("profile_id"), "role", F.concat("stack", F.array(F.lit(" "))).alias("stack"),
        F.when(F.col("pk") % 3 != 0, F.concat(F.lit(" "), "location")).alias("location"),
        F.when(F.col("pk") % 5 == 0, 2026).alias("year"), F.lit("2024-05-01").cast("date").alias("after"),
        F.split(F.expr(_PROFILES), ",").alias("platforms"),
        F.when(F.col("pk") % 4 == 2, 3).alias("max_queries"),
    )
    return search.search_queries(profiles).select(F.col("profile_id").alias("event_id"), "position", "query")


@query("j5_search_fanout", f"""
SELECT seq, query, CAST(score AS INT) AS score, CASE WHEN reason IN ('missing_url', 'blocked_domain') THEN reason
       WHEN seq >= 10 OR reason = 'duplicate_url' THEN 'duplicate_url' ELSE reason END AS reason
FROM (SELECT doc_id * 10 + n AS seq, source AS query, score, reason
      FROM (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS n FROM scored ORDER BY seq LIMIT 10) JOIN documents ON true)""",
       ["search_results"], ctes=_SCORED)
def _(spark, d):
    queries = table(spark, d, "documents").select(F.col("doc_id").alias("position"), F.col("source").alias("query"))
    rows = search.search_fanout(queries, view(spark, d, "search_results").select("seq", "title", "url", "snippet"))
    return rows.select("seq", "query", "score", "reason")


@query("j5_search_fanout_profiles", """
SELECT profile_id, seq, query, CAST(score AS INT) AS score,
       CASE WHEN reason IN ('missing_url', 'blocked_domain') THEN reason
            WHEN seq >= 10 OR reason = 'duplicate_url' THEN 'duplicate_url' ELSE reason END AS reason
FROM (SELECT profile_id, position * 10 + n AS seq, query, score, reason
      FROM (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS n FROM scored ORDER BY seq LIMIT 10) JOIN asked ON true)""",
       ["search_results"], ctes=_SCORED + """,
asked AS (SELECT s_suppkey AS profile_id, CAST(p AS BIGINT) AS position,
  concat(CASE p WHEN 0 THEN 'site:jobs.lever.co ' ELSE 'site:linkedin.com/jobs ' END, '"', s_name, '" "', s_suppkey, '"') AS query
  FROM supplier, (VALUES (0), (1)) AS v(p))""")
def _(spark, d):
    """Two queries for each of many profiles, each profile a request of its own."""
    none = F.lit(None)
    profiles = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("profile_id"), F.col("s_name").alias("role"), F.array(F.col("s_suppkey").cast("string")).alias("stack"),
        none.cast("string").alias("location"), none.cast("int").alias("year"), none.cast("date").alias("after"),
        F.array(F.lit("lever"), F.lit("linkedin_jobs")).alias("platforms"), none.cast("int").alias("max_queries"))
    seeds = view(spark, d, "search_results").select("seq", "title", "url", "snippet")
    rows = search.search_fanout(search.search_queries(profiles), seeds)
    return rows.select("profile_id", "seq", "query", "score", "reason")


# -- contacts ------------------------------------------------------------------------------

_PATTERN_SQL = """CASE WHEN regexp_matches(lower(split_part(email, '@', 1)), '^[a-z]+\\.[a-z]+$') THEN concat('{first}.{last}@', domain)
  WHEN regexp_matches(lower(split_part(email, '@', 1)), '^[a-z]{4,}$') THEN concat('{fi}{last}@', domain)
  WHEN regexp_matches(lower(split_part(email, '@', 1)), '^[a-z]{3}$') THEN concat('{first}@', domain) END"""


@query("c1_infer_email_pattern", f"SELECT seq, {_PATTERN_SQL} AS pattern FROM known_addresses", ["known_addresses"])
def _(spark, d):
    return view(spark, d, "known_addresses").select("seq", people.infer_email_pattern("email", "domain").alias("pattern"))


_VOTES = f"""
votes AS (SELECT domain, pattern, count(*) AS n, min(seq) AS first_seq FROM (
  SELECT domain, seq, {_PATTERN_SQL} AS pattern FROM known_addresses
  WHERE contains(email, concat('@', domain)) AND NOT contains(email, 'noreply')) WHERE pattern IS NOT NULL GROUP BY ALL),
best AS (SELECT domain, pattern FROM votes QUALIFY row_number() OVER (PARTITION BY domain ORDER BY n DESC, first_seq) = 1),
patterns AS (SELECT dom AS domain, coalesce(pattern, concat('{{first}}.{{last}}@', dom)) AS pattern
  FROM (SELECT concat('s', s_suppkey, '.example.com') AS dom FROM supplier) LEFT JOIN best ON dom = domain)"""


@query("c2_vote_pattern", "SELECT domain, pattern FROM patterns", ["known_addresses"], ctes=_VOTES)
def _(spark, d):
    domains = table(spark, d, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".example.com")).alias("domain")
    )
    return people.vote_pattern(domains, view(spark, d, "known_addresses"))


_EMAIL_SQL = """CASE WHEN first_name = '' THEN NULL ELSE replace(replace(replace(replace(pattern, '{first}', first_name), '{last}', last_name),
  '{fi}', substring(first_name, 1, 1)), '{li}', substring(last_name, 1, 1)) END"""
_NAMES_SQL = """split_part(lower(trim(name)), ' ', 1) AS first_name,
  CASE WHEN contains(trim(name), ' ') THEN split_part(lower(trim(name)), ' ', 2) ELSE '' END AS last_name"""


@query("c3_build_email", f"""
SELECT seq, {_EMAIL_SQL} AS email FROM (SELECT seq, {_NAMES_SQL},
  CASE seq % 4 WHEN 0 THEN '{{first}}.{{last}}@x.com' WHEN 1 THEN '{{fi}}{{last}}@y.io' WHEN 2 THEN '{{first}}{{li}}@z.in'
       ELSE NULL END AS pattern FROM people)""", ["people"])
def _(spark, d):
    pattern = F.expr("""CASE seq % 4 WHEN 0 THEN '{first}.{last}@x.com' WHEN 1 THEN '{fi}{last}@y.io'
      WHEN 2 THEN '{first}{li}@z.in' ELSE '{nick}@bad' END""")
    return view(spark, d, "people").select("seq", people.build_email("name", pattern).alias("email"))


_MERGED = """
merged AS (SELECT company, trim(name) AS name, bio, source, seq FROM people
  QUALIFY row_number() OVER (PARTITION BY company, lower(trim(name)) ORDER BY source, seq) = 1)"""


@query("c4_merge_people", "SELECT company, name, source, seq FROM merged", ["people"], ctes=_MERGED)
def _(spark, d):
    return _people(spark, d).select("company", "name", "source", "seq")


def _people(spark, d):
    found = view(spark, d, "people").withColumn("role", people.role_from_bio("bio"))
    return people.merge_people(found.where("source = 'github'"), found.where("source = 'linkedin'"))


@query("c5_role_from_bio", f"""
SELECT doc_id, CASE WHEN {_hits('lower(text)', lexicon.ENGINEER_WORDS)} > 0 THEN 'Engineer'
  WHEN {_hits('lower(text)', lexicon.RECRUITER_WORDS)} > 0 THEN 'Recruiter' ELSE 'Unknown' END AS role FROM texts""", ["texts"])
def _(spark, d):
    return view(spark, d, "texts").select("doc_id", people.role_from_bio("text").alias("role"))


@query("c6_classify_probe", """
SELECT CASE WHEN NOT contains(email, '@') THEN 'invalid' WHEN code = 250 THEN 'verified'
  WHEN code IN (550, 551, 553) THEN 'invalid' ELSE 'unverified' END AS verified, count(*) AS probes FROM probe_results GROUP BY 1""",
       ["probe_results"])
def _(spark, d):
    probes = view(spark, d, "probe_results")
    return probes.groupBy(people.classify_probe("email", "code").alias("verified")).agg(F.count("*").alias("probes"))


@query("c7_pick_mx", """
SELECT dom AS domain, coalesce(rtrim(host, '.'), concat('mail.', dom)) AS mx_host
FROM (SELECT concat('s', s_suppkey, '.example.com') AS dom FROM supplier)
LEFT JOIN (SELECT domain, arg_min(exchange, preference) AS host FROM mx_records GROUP BY domain) ON dom = domain""", ["mx_records"])
def _(spark, d):
    domains = table(spark, d, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".example.com")).alias("domain")
    )
    return people.pick_mx(domains, view(spark, d, "mx_records"))


_DOMAINS = """
tried AS (SELECT company, suggestion, provided, lower(replace(company, '#', '')) AS slug FROM companies),
resolved AS (SELECT company, provided, coalesce(suggestion, (
  SELECT arg_min(candidate, CASE split_part(candidate, '.', 2) WHEN 'com' THEN 0 WHEN 'io' THEN 1 WHEN 'co' THEN 2 ELSE 3 END)
  FROM domain_probes WHERE status_code < 400 AND split_part(candidate, '.', 1) = slug)) AS domain FROM tried)"""


@query("c8_resolve_domain", "SELECT company, domain FROM resolved", ["companies", "domain_probes"], ctes=_DOMAINS)
def _(spark, d):
    return people.resolve_domain(view(spark, d, "companies"), view(spark, d, "domain_probes"))


_FOUND = f"""
SELECT seq, company, domain, name, email, role, source, CASE WHEN email IS NULL THEN 'unverified' WHEN code = 250 THEN 'verified'
  WHEN code IN (550, 551, 553) THEN 'invalid' ELSE 'unverified' END AS verified FROM (
  SELECT seq, company, domain, name, source, {_EMAIL_SQL} AS email,
    CASE WHEN contains(coalesce(bio, ''), 'engineer') THEN 'Engineer' WHEN contains(coalesce(bio, ''), 'Talent') THEN 'Recruiter'
         ELSE 'Unknown' END AS role
  FROM (SELECT m.*, {_NAMES_SQL}, dd.domain, coalesce(p.pattern, concat('{{first}}.{{last}}@', dd.domain)) AS pattern
        FROM merged m JOIN (SELECT company, coalesce(provided, domain) AS domain FROM resolved) dd
          ON m.company = dd.company AND dd.domain IS NOT NULL
        LEFT JOIN patterns p ON dd.domain = p.domain))
LEFT JOIN codes ON email = address"""
_FOUND_CTES = _DOMAINS + "," + _MERGED + "," + _VOTES + """,
codes AS (SELECT concat('ana', chr(CAST(97 + s_suppkey % 26 AS INT)), '.fama', 'a@s', s_suppkey, '.example.com') AS address,
  CASE WHEN s_suppkey % 2 = 0 THEN 250 ELSE 550 END AS code FROM supplier)"""
_FOUND_VIEWS = ["companies", "domain_probes", "people", "known_addresses"]


@query("c9_discover_contacts", f"SELECT * EXCLUDE (seq) FROM ({_FOUND})", _FOUND_VIEWS, ctes=_FOUND_CTES)
def _(spark, d):
    return _discovered(spark, d).drop("job_id", "seq")


@query("c9_store_contacts", """
SELECT id, job_id, company, domain, name, email, role, source, verified FROM (
  SELECT struct_extract(arg_min(struct_pack(v := id), ord), 'v') AS id, struct_extract(arg_min(struct_pack(v := job_id), ord), 'v') AS job_id, company,
         struct_extract(arg_min(struct_pack(v := domain), ord), 'v') AS domain, arg_max(name, ord) AS name, email, arg_max(role, ord) AS role,
         struct_extract(arg_max(struct_pack(v := source), ord), 'v') AS source, struct_extract(arg_max(struct_pack(v := verified), ord), 'v') AS verified
  FROM everything WHERE email IS NOT NULL GROUP BY company, email
  UNION ALL SELECT id, job_id, company, domain, name, email, role, source, verified FROM everything WHERE email IS NULL)""",
       [*_FOUND_VIEWS, "contacts"], ctes=_FOUND_CTES + f""",
everything AS (
  SELECT id, job_id, company, domain, name, email, role, source, verified, CAST(-1 AS BIGINT) AS ord FROM contacts
  UNION ALL
  SELECT md5(concat('contact|', company, '|', coalesce(email, concat('#', lower(name))))), NULL, company, domain, name, email, role, source,
         verified, CAST(seq AS BIGINT) FROM ({_FOUND}))""")
def _(spark, d):
    """Discovery stored in the contacts table."""
    current = view(spark, d, "contacts").select(*schemas.CONTACT.fieldNames())
    return people.store_contacts(current, _discovered(spark, d), as_of()).drop("created_at")


def _discovered(spark, d):
    found = view(spark, d, "people").withColumn("role", people.role_from_bio("bio"))
    replies = table(spark, d, "supplier").select(
        F.expr("concat('ana', chr(97 + s_suppkey % 26), '.famaa@s', s_suppkey, '.example.com')").alias("email"),
        F.expr("CASE WHEN s_suppkey % 2 = 0 THEN 250 ELSE 550 END").alias("code"),
    )
    companies = view(spark, d, "companies").withColumn("job_id", F.lit(None).cast("string"))
    return people.discover_contacts(
        companies, view(spark, d, "domain_probes"), view(spark, d, "known_addresses"),
        found.where("source = 'github'"), found.where("source = 'linkedin'"), replies,
    )


# -- matching ------------------------------------------------------------------------------

_BATCH = """
batch AS (SELECT * FROM jobs WHERE status = 'new' ORDER BY posted_at DESC NULLS LAST, id LIMIT {n}),
near AS (SELECT batch.id AS job_id, contacts.id AS contact_id, verified,
  row_number() OVER (PARTITION BY batch.id ORDER BY contacts.created_at DESC, contacts.id) AS nth
  FROM batch JOIN contacts ON contacts.company ILIKE concat('%', {name}, '%')),
picked AS (SELECT job_id, count(*) AS contacts_seen,
  arg_min(contact_id, nth + CASE WHEN verified = 'verified' THEN 0 ELSE 1000 END) FILTER (WHERE verified <> 'invalid') AS contact_id
  FROM near WHERE nth <= 50 GROUP BY job_id)"""


@query("j1_draft_candidates", "SELECT job_id AS id, contacts_seen, contact_id FROM picked", ["jobs", "contacts"],
       ctes=_BATCH.format(n=20, name="batch.company"))
def _(spark, d):
    batch = tables.new_job_batch(view(spark, d, "jobs"), "draft")
    return matching.draft_candidates(batch, view(spark, d, "contacts")).select("id", "contacts_seen", "contact_id")


_SHORT = "CASE WHEN batch.sk % 3 = 0 THEN concat(substring(batch.company, 14, 4), '_') ELSE substring(batch.company, 14, 5) END"


@query("j1_draft_candidates_all", f"""
SELECT firm AS company, contacts_seen, contact_id FROM (
  SELECT firm, count(*) AS contacts_seen,
    arg_min(contact_id, nth + CASE WHEN verified = 'verified' THEN 0 ELSE 1000 END) FILTER (WHERE verified <> 'invalid') AS contact_id
  FROM (SELECT firm, contacts.id AS contact_id, verified,
          row_number() OVER (PARTITION BY firm ORDER BY contacts.created_at DESC, contacts.id) AS nth
        FROM (SELECT DISTINCT {_SHORT} AS firm FROM jobs batch WHERE status = 'new')
        JOIN contacts ON contacts.company ILIKE concat('%', firm, '%')) WHERE nth <= 50 GROUP BY firm)""", ["jobs", "contacts"])
def _(spark, d):
    """All new jobs at once, with company names that are pieces and patterns of the contacts' ones."""
    name = F.expr(_SHORT.replace("batch.", ""))
    batch = view(spark, d, "jobs").where("status = 'new'").select(name.alias("company")).distinct()
    return matching.draft_candidates(batch, view(spark, d, "contacts")).select("company", "contacts_seen", "contact_id")


@query("j2_apply_candidates", f"""
SELECT jobs.id, coalesce(contacts_seen, 0) AS contacts_seen, contact_id,
       CASE WHEN contacts_seen IS NULL THEN 'pending' ELSE 'complete' END AS discovery_status,
       CASE WHEN contacts_seen IS NULL THEN {_sql_text(lexicon.PENDING_SUBJECT)} END AS draft_subject
FROM jobs LEFT JOIN (
  SELECT job_id, count(*) AS contacts_seen,
    arg_min(id, nth + CASE WHEN verified = 'verified' THEN 0 ELSE 1000 END) FILTER (WHERE verified <> 'invalid') AS contact_id
  FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, id) AS nth FROM contacts WHERE job_id IS NOT NULL)
  WHERE nth <= 50 GROUP BY job_id) ON jobs.id = job_id""", ["jobs", "contacts"])
def _(spark, d):
    rows = matching.apply_candidates(view(spark, d, "jobs"), view(spark, d, "contacts"))
    return rows.select("id", "contacts_seen", "contact_id", "discovery_status", "draft_subject")


@query("j3_resolve_recipient", """
SELECT emails.id, email AS to_address FROM emails JOIN contacts ON contact_id = contacts.id WHERE email IS NOT NULL""",
       ["emails", "contacts"])
def _(spark, d):
    good, _ = matching.resolve_recipient(view(spark, d, "emails"), view(spark, d, "contacts"))
    return good.select("id", "to_address")


@query("j3_missing_recipient", """
SELECT template, count(*) AS emails FROM emails LEFT JOIN contacts ON contact_id = contacts.id
WHERE email IS NULL GROUP BY template""", ["emails", "contacts"])
def _(spark, d):
    _, bad = matching.resolve_recipient(view(spark, d, "emails"), view(spark, d, "contacts"))
    return bad.groupBy("template").agg(F.count("*").alias("emails"))


_REQUESTS = """
requests AS (SELECT CASE WHEN ck % 9 = 0 THEN 'gone' ELSE job_id END AS job_id, id AS contact_id,
  CASE ck % 4 WHEN 0 THEN 'cold_outreach' WHEN 1 THEN 'recruiter_outreach' WHEN 2 THEN 'referral_outreach' ELSE 'followup' END AS template,
  CASE WHEN ck % 5 = 0 THEN 'Noor Haddad' END AS referred_by, ck FROM contacts),
contexts AS (SELECT requests.*, coalesce(jobs.company, 'the company') AS company, coalesce(role, 'the role') AS role,
  coalesce(product, '') AS product, stack, name AS contact_name
  FROM requests LEFT JOIN jobs ON requests.job_id = jobs.id
  LEFT JOIN (SELECT id AS cid, CASE WHEN ck % 10 = 0 THEN '' ELSE name END AS name FROM contacts) ON contact_id = cid)"""


def _contexts(spark, d):
    contacts = view(spark, d, "contacts")
    k = F.col("ck")
    requests = contacts.select(
        F.when(k % 9 == 0, "gone").otherwise(F.col("job_id")).alias("job_id"), F.col("id").alias("contact_id"),
        F.expr("""CASE ck % 4 WHEN 0 THEN 'cold_outreach' WHEN 1 THEN 'recruiter_outreach' WHEN 2 THEN 'referral_outreach'
                  ELSE 'followup' END""").alias("template"),
        F.when(k % 5 == 0, "Noor Haddad").alias("referred_by"), "ck",
    )
    named = contacts.withColumn("name", F.when(k % 10 == 0, "").otherwise(F.col("name")))
    return matching.email_context(requests, view(spark, d, "jobs"), named)


@query("j4_email_context", "SELECT ck, template, company, role, product, contact_name FROM contexts", ["jobs", "contacts"],
       ctes=_REQUESTS)
def _(spark, d):
    return _contexts(spark, d).select("ck", "template", "company", "role", "product", "contact_name")


_COSINE = """
SELECT vec_id, round(s, 4) AS match_score, CASE WHEN s >= 0.55 THEN 'strong' WHEN s >= 0.40 THEN 'moderate' ELSE 'weak' END AS match_tier
FROM (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS s
      FROM embeddings)"""


@query("r1_jd_text", "SELECT id, concat(role, ' ', company, ' ', words, ' ', product) AS jd FROM jobs", ["jobs"])
def _(spark, d):
    return view(spark, d, "jobs").select("id", matching.jd_text().alias("jd"))


@query("r2_r3_cosine_tier", _COSINE)
def _(spark, d):
    rows = table(spark, d, "embeddings")
    one = rows.where("vec_id = 0").select("embedding").scalar()
    scored = rows.withColumn("_one", one).withColumn("s", cosine(F.col("_one"), F.col("embedding")))
    return scored.select("vec_id", F.round("s", 4).alias("match_score"), match_tier(F.col("s")).alias("match_tier"))


@query("r4_rank_global", _COSINE + " ORDER BY match_score DESC, vec_id LIMIT 100")
def _(spark, d):
    rows = table(spark, d, "embeddings")
    ranked = matching.rank_by_profile(rows, rows.where("vec_id = 0"), ("vec_id",), k=100)
    return ranked.select("vec_id", "match_score", "match_tier")


@query("r4_rank_page", _COSINE.replace("FROM embeddings)", "FROM (SELECT * FROM embeddings ORDER BY label DESC, vec_id LIMIT 50))"))
def _(spark, d):
    rows = table(spark, d, "embeddings")
    page = rows.orderBy(F.desc("label"), "vec_id").limit(50)
    ranked = matching.rank_by_profile(page, rows.where("vec_id = 0"), (F.desc("label"), "vec_id"))
    return ranked.select("vec_id", "match_score", "match_tier")


# -- profiles and drafts -------------------------------------------------------------------

_SKILLS_SQL = f"array_to_string(list_filter({_sql_list(lexicon.SKILLS)}, lambda s: contains(low, s)), ',')"


@query("g1_observation_category", """
SELECT doc_id, CASE WHEN greatest(a, b, c, d, e) = 0 THEN 'default' WHEN a >= greatest(b, c, d, e) THEN 'fintech'
  WHEN b >= greatest(c, d, e) THEN 'devtools' WHEN c >= greatest(d, e) THEN 'saas' WHEN d >= e THEN 'ecommerce' ELSE 'infra' END AS category
FROM (SELECT doc_id, """ + ", ".join(
    f"{_hits('low', terms)} AS {n}" for n, terms in zip("abcde", lexicon.OBSERVATION_KEYWORDS.values())
) + " FROM (SELECT doc_id, lower(concat(text, ' ', source)) AS low FROM texts))", ["texts"])
def _(spark, d):
    docs = view(spark, d, "texts").select("doc_id", F.col("text").alias("product"), F.array("source").alias("stack"))
    return outreach.observation_category(docs).select("doc_id", "category")


_KINDS = list(lexicon.OBSERVATIONS)
_PICK_SQL = "CASE pk % {n} {cases} END".format(n=len(_KINDS), cases=" ".join(
    f"WHEN {i} THEN [{', '.join(map(_sql_text, lexicon.OBSERVATIONS[kind]))}]"
    f"[CAST(concat('0x', substring(md5(id), 1, 6)) AS INT) % {len(lexicon.OBSERVATIONS[kind])} + 1]" for i, kind in enumerate(_KINDS)))


@query("g2_pick_observation", f"SELECT id, {_PICK_SQL} AS observation FROM jobs", ["jobs"])
def _(spark, d):
    """Every category in turn."""
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.pmod("pk", F.lit(len(_KINDS))) + 1).cast("int"))
    return view(spark, d, "jobs").select("id", outreach.pick_observation("id", kind).alias("observation"))


def _draft_sql() -> str:
    """Each template as one concat over the context columns."""
    names = {
        "contact_name": "coalesce(nullif(contact_name, ''), 'there')",
        "referred_by": "coalesce(referred_by, 'A mutual connection')",
        "your_stack": "'Go, Kubernetes'", "your_name": "'Sam Okafor'", "github_url": "'https://git.example.org/a'",
        "product_observation": "'Seen.'", "graduation_year": "'2025'", "company": "company", "role": "role",
        "availability": _sql_text(lexicon.DRAFT_DEFAULTS["availability"]),
    }
    cases = []
    for name, text in lexicon.DRAFT_TEXTS.items():
        sql = _sql_text(text)
        for field, value in names.items():
            sql = f"replace({sql}, '{{{field}}}', {value})"
        cases.append(f"WHEN '{name}' THEN {sql}")
    return "CASE template " + " ".join(cases) + " END"


@query("g3_render_email", f"""
SELECT ck, template, substring(split_part(t, chr(10), 1), 10) AS subject, substring(t, strpos(t, chr(10)) + 2) AS body
FROM (SELECT ck, template, {_draft_sql()} AS t FROM contexts)""", ["jobs", "contacts"], ctes=_REQUESTS)
def _(spark, d):
    contexts = _contexts(spark, d).withColumns({
        "your_name": F.lit("Sam Okafor"), "your_stack": F.array(F.lit("Go"), F.lit("Kubernetes")),
        "github_url": F.lit("https://git.example.org/a"), "product_observation": F.lit("Seen."),
        "graduation_year": F.lit(None).cast("int"), "availability": F.lit(None).cast("string"),
    })
    return outreach.render_email(contexts).select("ck", "template", "subject", "body")


@query("g3_draft_emails", """
SELECT template, status, count(*) AS drafts, count(*) FILTER (WHERE template <> 'followup') AS observed FROM (
  SELECT template, 'draft' AS status FROM contexts) GROUP BY 1, 2""", ["jobs", "contacts"], ctes=_REQUESTS)
def _(spark, d):
    contexts = _contexts(spark, d).withColumns({
        "your_name": F.lit("Sam Okafor"), "your_stack": F.array(F.lit("Go")), "github_url": F.lit("u"),
        "graduation_year": F.lit(2024), "availability": F.lit("any day"),
    })
    drafts = outreach.draft_emails(contexts, as_of())
    texts = [F.contains("body", F.lit(t)) for group in lexicon.OBSERVATIONS.values() for t in group]
    seen = F.greatest(*[t.cast("int") for t in texts])
    return drafts.groupBy("template", "status").agg(
        F.count("*").alias("drafts"), F.sum(seen).cast("long").alias("observed")
    )


@query("draft_cycle", f"""
SELECT md5(concat('email|', job_id, '|', coalesce(contact_id, ''), '|cold_outreach')) AS id, job_id, contact_id, template,
       substring(split_part(t, chr(10), 1), 10) AS subject, substring(t, strpos(t, chr(10)) + 2) AS body, 'draft' AS status
FROM (SELECT job_id, contact_id, template, {_draft_sql()} AS t FROM (
  SELECT picked.job_id, contact_id, 'cold_outreach' AS template, jobs.company, jobs.role, NULL AS referred_by, contacts.name AS contact_name
  FROM picked JOIN jobs ON picked.job_id = jobs.id LEFT JOIN contacts ON contact_id = contacts.id))""", ["jobs", "contacts"],
       ctes=_BATCH.format(n=20, name="batch.company"))
def _(spark, d):
    """Newest new jobs, their contacts, the choice, the context, the email rows."""
    jobs, contacts = view(spark, d, "jobs"), view(spark, d, "contacts")
    chosen = matching.draft_candidates(tables.new_job_batch(jobs, "draft"), contacts)
    requests = chosen.select(F.col("id").alias("job_id"), "contact_id", F.lit(None).cast("string").alias("referred_by"))
    contexts = matching.email_context(requests, jobs, contacts).withColumns({
        "your_name": F.lit("Sam Okafor"), "your_stack": F.array(F.lit("Go"), F.lit("Kubernetes")),
        "github_url": F.lit("https://git.example.org/a"), "observation": F.lit("Seen."),
        "graduation_year": F.lit(None).cast("int"), "availability": F.lit(None).cast("string"),
    })
    return outreach.draft_emails(contexts, as_of(), "cold_outreach").drop("generated_at", "sent_at")


@query("g4_split_rendered", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE trim(lines[1]) END AS subject,
  trim(CASE WHEN doc_id % 3 = 0 THEN concat('No ', lines[1], chr(10), array_to_string(lines[3:], chr(10)))
       ELSE array_to_string(lines[3:], chr(10)) END, concat(' ', chr(10))) AS body
FROM (SELECT doc_id, string_split(trim(raw_text, concat(' ', chr(10))), chr(10)) AS lines FROM texts WHERE trim(raw_text, concat(' ', chr(10))) <> '')""",
       ["texts"])
def _(spark, d):
    docs = view(spark, d, "texts").select("doc_id", F.btrim("raw_text", F.lit(" \n")).alias("t")).where("t <> ''")
    text = F.concat(F.when(F.col("doc_id") % 3 == 0, "No ").otherwise("\n SUBJECT: "), "t", F.lit(" \n"))
    subject, body = outreach.split_rendered(text)
    return docs.select("doc_id", subject.alias("subject"), body.alias("body"))


@query("g5_extract_skills", f"SELECT doc_id, {_SKILLS_SQL} AS skills FROM (SELECT doc_id, lower(text) AS low FROM texts)", ["texts"])
def _(spark, d):
    docs = view(spark, d, "texts").withColumn("low", F.lower("text"))
    return docs.select("doc_id", F.array_join(outreach.extract_skills(F.col("low")), ",").alias("skills"))


_YEARS_SQL = "coalesce(" + ", ".join(
    "TRY_CAST(nullif(regexp_extract(low, " + _sql_text(p.replace(r"\w", r"[\pL\pN_]")) + ", 1), '') AS BIGINT)"
    for p in lexicon.EXPERIENCE_PATTERNS
) + ")"
_TITLE_SQL = "coalesce(" + ", ".join(f"nullif(regexp_extract(low, {_sql_text(p)}, 0), '')" for p in lexicon.TITLE_PATTERNS) + ")"


@query("g6_extract_years", f"SELECT doc_id, {_YEARS_SQL} AS years FROM (SELECT doc_id, lower(text) AS low FROM texts)", ["texts"])
def _(spark, d):
    docs = view(spark, d, "texts").withColumn("low", F.lower("text"))
    return docs.select("doc_id", outreach.extract_years(F.col("low")).alias("years"))


@query("g7_extract_title", f"SELECT doc_id, {_TITLE_SQL} AS title FROM (SELECT doc_id, lower(text) AS low FROM texts)", ["texts"])
def _(spark, d):
    docs = view(spark, d, "texts").withColumn("low", F.lower("text"))
    return docs.select("doc_id", outreach.extract_title(F.col("low")).alias("title"))


_TITLED = """array_to_string(list_transform(regexp_extract_all(title, '[a-z]+|[^a-z]+'), lambda w: concat(upper(w[1]), w[2:])), '')"""
_PROFILE = f"""
profiles AS (SELECT doc_id, text, skills, years, title, skills = '' AND title IS NULL AS is_empty,
  concat_ws(' | ', CASE WHEN title IS NOT NULL THEN concat('Role: ', {_TITLED}) END,
    CASE WHEN years > 0 THEN concat('Experience: ', years, '+ years') END,
    CASE WHEN skills <> '' THEN concat('Skills: ', array_to_string(string_split(skills, ',')[1:8], ', ')) END) AS snippet
  FROM (SELECT doc_id, text, {_SKILLS_SQL} AS skills, {_YEARS_SQL} AS years, {_TITLE_SQL} AS title
        FROM (SELECT doc_id, text, lower(text) AS low FROM texts)))"""


@query("g8_candidate_profile", "SELECT doc_id, snippet, is_empty, substring(text, 1, 300) AS resume_preview FROM profiles",
       ["texts"], ctes=_PROFILE)
def _(spark, d):
    profiles = outreach.candidate_profile(view(spark, d, "texts"))
    return profiles.select("doc_id", "snippet", "is_empty", "resume_preview")


@query("g9_build_prompt", f"""
SELECT doc_id, CASE WHEN is_empty THEN replace({_sql_text(lexicon.PLAIN_PROMPT)}, '{{product}}', p)
  ELSE replace(replace({_sql_text(lexicon.PERSONAL_PROMPT)}, '{{product}}', p), '{{candidate}}', snippet) END AS prompt,
  CASE WHEN p IS NOT NULL THEN is_empty END AS plain
FROM (SELECT *, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE concat('Src ', doc_id, ' Go') END AS p FROM profiles)""", ["texts"], ctes=_PROFILE)
def _(spark, d):
    k = F.col("doc_id")
    docs = outreach.candidate_profile(view(spark, d, "texts")).withColumns({
        "product": F.when(k % 5 != 0, F.concat(F.lit("Src "), k.cast("string"))),
        "your_stack": F.when(k % 5 == 0, F.array(F.lit(""))).otherwise(F.array(F.lit("Go"))),
        "stack": F.lit(None).cast("array<string>"),
    })
    plain = F.col("system_text") == lexicon.PLAIN_SYSTEM_TEXT
    return outreach.build_prompt(docs).select("doc_id", "prompt", plain.alias("plain"))


# -- digest and follow-ups -----------------------------------------------------------------


@query("g10_digest_select", f"""
SELECT id FROM jobs WHERE posted_at IS NULL OR pk % 17 = 0 OR posted_at >= TIMESTAMP '{AS_OF}' - INTERVAL 400 DAY""", ["jobs"])
def _(spark, d):
    text = F.when(F.col("pk") % 17 == 0, "someday").otherwise(F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    text = F.when(F.col("posted_at").isNotNull() | (F.col("pk") % 17 == 0), text)
    jobs = view(spark, d, "jobs").withColumn("posted_at", text)
    return digest.digest_select(jobs, as_of(), days=400).select("id")


@query("g11_digest_groups", """
SELECT id, coalesce(source, 'unknown') AS source, dense_rank() OVER (ORDER BY group_first) AS group_position,
       count(*) OVER (PARTITION BY source) AS group_size,
       row_number() OVER (PARTITION BY source ORDER BY created_at, id) AS index_in_group
FROM (SELECT *, first_value(struct_pack(a := created_at, b := id)) OVER (PARTITION BY source ORDER BY created_at, id) AS group_first FROM jobs)""",
       ["jobs"])
def _(spark, d):
    rows = digest.digest_groups(view(spark, d, "jobs"))
    return rows.select("id", "source", F.col("group_position").cast("long"), "group_size", "index_in_group")


@query("g12_render_digest", f"""
SELECT n_name AS recipient, coalesce(job_count, 0) AS job_count,
  concat('Your weekly job digest — ', coalesce(job_count, 0), ' new role', CASE WHEN job_count = 1 THEN '' ELSE 's' END,
         ' (05 Nov–11 Nov 2001)') AS subject,
  concat('Hi Ada,', chr(10), chr(10), {_sql_text(lexicon.DIGEST_INTRO)}, chr(10), chr(10),
    coalesce(groups, concat({_sql_text(lexicon.DIGEST_EMPTY)}, chr(10))), chr(10), {_sql_text(lexicon.DIGEST_RULE)}, chr(10),
    'Roles shown: ', coalesce(job_count, 0), '  |  Sources: ', coalesce(sources, 0), chr(10), 'Generated: 2001-11-05 00:00 UTC', chr(10),
    {_sql_text(lexicon.DIGEST_RULE)}, chr(10), chr(10), {_sql_text(lexicon.DIGEST_OUTRO.replace("{dashboard}", "your dashboard"))},
    chr(10), chr(10), 'Best,', chr(10), 'Your job digest') AS body
FROM nation LEFT JOIN (
  SELECT location, sum(n) AS job_count, count(*) AS sources, string_agg(concat('── ', upper(source), ' (', n, ' role',
      CASE WHEN n = 1 THEN '' ELSE 's' END, ') {lexicon.DIGEST_GROUP_TAIL}', chr(10), chr(10), lines), '' ORDER BY first_at) AS groups
  FROM (SELECT location, source, count(*) AS n, min(at_pos) AS first_at,
          string_agg(concat('  ', i, '. ', company, ' — ', role, chr(10), '📍 ', location, '  🛠  ', replace(words, ' ', ', '), chr(10),
                     '🔗 ', url, chr(10)), '' ORDER BY i) AS lines
        FROM (SELECT *, row_number() OVER (PARTITION BY location, source ORDER BY at_pos) AS i FROM (
          SELECT company, role, location, url, words, coalesce(source, 'unknown') AS source,
            row_number() OVER (PARTITION BY location ORDER BY posted_at DESC NULLS LAST, id) AS at_pos
          FROM jobs WHERE status = 'new') WHERE at_pos <= 100) GROUP BY location, source) GROUP BY location)
ON n_name = location""", ["jobs"])
def _(spark, d):
    """One digest per country: its hundred newest new jobs."""
    jobs = view(spark, d, "jobs").where("status = 'new'").withColumn("recipient", F.col("location"))
    recipients = table(spark, d, "nation").select(F.col("n_name").alias("recipient"), F.lit("Ada").alias("your_name"))
    order = (F.col("posted_at").desc_nulls_last(), F.col("id").asc())
    out = digest.render_digest(jobs, recipients, dates.week_label(as_of()), as_of(), order)
    return out.withColumn("job_count", F.col("job_count").cast("long"))


@query("g13_followups_due", f"""
SELECT id FROM emails WHERE status = 'sent' AND sent_text IS NOT NULL AND ok % 10 <> 0 AND ok % 6 <> 0
AND generated_at <= TIMESTAMP '{AS_OF}' - INTERVAL 900 DAY - CASE WHEN ok % 10 = 1 THEN INTERVAL '06:30:00' ELSE INTERVAL '00:00:00' END""",
       ["emails"])
def _(spark, d):
    return digest.followups_due(view(spark, d, "emails"), as_of(), days=900).select("id")


@query("g14_week_label", """
SELECT o_orderkey, concat(strftime(date_trunc('week', o_orderdate), '%d %b'), '–',
       strftime(date_trunc('week', o_orderdate) + INTERVAL 6 DAY, '%d %b %Y')) AS week FROM orders""")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", dates.week_label(F.col("o_orderdate")).alias("week"))


@query("s6_run_summary", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id,
  coalesce(sum(CASE WHEN event_type = 'view' THEN greatest(user_id - 70, 0) END), 0) AS jobs_discovered,
  coalesce(sum(CASE WHEN event_type = 'click' AND event_id % 7 <> 0 THEN event_id % 5 END), 0) AS contacts_found,
  coalesce(sum(CASE WHEN event_type = 'signup' AND event_id % 7 <> 0 THEN event_id % 5 END), 0) AS emails_drafted,
  coalesce(sum(CASE WHEN event_type NOT IN ('view', 'click', 'signup') AND event_id % 2 = 0 AND event_id % 7 <> 0 THEN event_id % 5 END), 0) AS followups_drafted,
  coalesce(sum(CASE WHEN event_type NOT IN ('view', 'click', 'signup') AND event_id % 2 = 1 AND event_id % 7 <> 0 THEN event_id % 5 END), 0) AS digest_sent,
  count(*) FILTER (WHERE event_type = 'click' AND event_id % 7 <> 0) AS companies_processed,
  count(*) FILTER (WHERE event_id % 7 = 0) AS errors FROM events GROUP BY 1""")
def _(spark, d):
    return summary.run_summary(_run_log(spark, d))


@query("s6_run_errors", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id, event_type AS context, CAST(event_id AS VARCHAR) AS detail
FROM events WHERE event_id % 7 = 0""")
def _(spark, d):
    return summary.run_errors(_run_log(spark, d)).drop("task")


def _run_log(spark, d):
    task = F.expr("""CASE event_type WHEN 'view' THEN 'scrape' WHEN 'click' THEN 'discover' WHEN 'signup' THEN 'draft'
                     ELSE CASE event_id % 2 WHEN 0 THEN 'followup' ELSE 'digest' END END""")
    return table(spark, d, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("run_id"), task.alias("task"), (F.col("event_id") % 7 != 0).alias("ok"),
        (F.col("event_id") % 5).alias("n"), F.lit(70).alias("jobs_before"), F.col("user_id").alias("jobs_after"),
        F.col("event_type").alias("context"), F.col("event_id").cast("string").alias("detail"),
    )


@query("s6_run_summary_observed", f"""
SELECT '2001-11-05' AS run_id, (SELECT count(*) FROM jobs WHERE created_at >= TIMESTAMP '1998-01-01') AS jobs_discovered,
  (SELECT count(*) FROM contacts JOIN companies USING (company) WHERE verified <> 'invalid') AS contacts_found,
  (SELECT count(*) FROM emails WHERE status = 'draft' AND template <> 'followup') AS emails_drafted,
  (SELECT count(*) FROM emails WHERE status = 'sent' AND sent_text IS NOT NULL AND ok % 10 <> 0 AND ok % 6 <> 0
     AND generated_at <= TIMESTAMP '{AS_OF}' - INTERVAL 900 DAY - CASE WHEN ok % 10 = 1 THEN INTERVAL '06:30:00' ELSE INTERVAL '00:00:00' END)
    AS followups_drafted,
  (SELECT count(*) FROM nation) AS digest_sent, (SELECT count(*) FROM companies) AS companies_processed, 1 AS errors""",
       ["jobs", "contacts", "companies", "emails"])
def _(spark, d):
    """A whole run: each step counts its rows while it writes them; one step fails and is logged."""
    base = shared_dir(spark, "run")
    run = runs.Run(spark, base, "2001-11-05")
    jobs, emails, contacts = (view(spark, d, n) for n in ("jobs", "emails", "contacts"))
    run.write("scrape", lambda: jobs.where("created_at >= '1998-01-01'"), jobs_before=0)
    asked = run.counted(view(spark, d, "companies").select("company"), "companies")
    run.write("discover", lambda: contacts.where("verified <> 'invalid'").join(asked, "company"), companies="companies")
    run.write("draft", lambda: emails.where("status = 'draft' AND template <> 'followup'"))
    run.write("followup", lambda: digest.followups_due(emails, as_of(), days=900))
    run.write("digest", lambda: table(spark, d, "nation").select(F.col("n_name").alias("recipient")))
    run.write("draft_again", lambda: spark.read.parquet(f"{base}/no-such-table"), context="draft")
    run.publish()
    return runs.latest(spark, base)
