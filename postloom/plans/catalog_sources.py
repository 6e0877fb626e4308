"""Registered queries: events, dates, URLs, feeds, cards and pages.

Feeds and listing pages are written out from the postings by Spark, then read back by the
operator; the SQL counterpart states the rows that must come out.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from postloom.functions import dates, text, urls
from postloom.operators import ingest
from postloom.plans.registry import query
from postloom.plans.views import AS_OF, as_of, table, view
from postloom.session import shared_dir
from postloom.sources import cards, events, feeds, html, links


def _shown(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


# -- events ---------------------------------------------------------------------------------


@query("s1_read_posting_events", """
SELECT event_id, company, role, source, url, stack, product, location, posted_at,
       strftime(seen_at, '%Y-%m-%d %H:%M:%S') AS seen_at FROM wire_events""", ["wire_events"])
def _(spark, d):
    """Wire events landed as JSON files, read back with the given schema."""
    from postloom import schemas

    land = f"{shared_dir(spark, 'landed')}/events"
    events.write_events(view(spark, d, "wire_events").select(*schemas.POSTING_WIRE.fieldNames()), land)
    return events.read_posting_events(spark, land).withColumn("seen_at", _shown("seen_at"))


@query("s2_encode_events", f"""
SELECT event_id, company, role, coalesce(source, 'yard') AS source,
       concat('["', replace(words, ' ', '","'), '"]') AS stack,
       CASE WHEN pk % 13 = 0 THEN '2001-11-05T00:00:00+00:00' ELSE strftime(posted_at, '%Y-%m-%d') END AS posted_at
FROM postings""", ["postings"])
def _(spark, d):
    postings = view(spark, d, "postings")
    posted = F.when(F.col("pk") % 13 != 0, F.date_format("posted_at", "yyyy-MM-dd"))
    wire = ingest.encode_events(postings.withColumn("posted_at", posted), "yard", as_of())
    return wire.select("event_id", "company", "role", "source", "stack", "posted_at")


@query("s2_encode_events_scraper", """
SELECT event_id, trim(company) AS company, role, coalesce(source, '') AS source
FROM wire_events WHERE trim(company) <> '' AND trim(role) <> ''""", ["wire_events"])
def _(spark, d):
    wire = view(spark, d, "wire_events").withColumn("stack", ingest.decode_stack("stack"))
    out = ingest.encode_events(wire, "yard", as_of(), variant="scraper")
    return out.select("event_id", "company", "role", "source")


@query("s3_tail_events", """
SELECT event_id, company, CASE WHEN pk % 50 IN (4, 6, 7) THEN '—' WHEN pk % 50 = 5 THEN '1, 2'
       ELSE array_to_string(from_json(stack, '["VARCHAR"]')[1:5], ', ') END AS stack_shown
FROM (SELECT * FROM wire_events ORDER BY seen_at DESC, event_id DESC LIMIT 200)""", ["wire_events"])
def _(spark, d):
    tail = events.tail_events(view(spark, d, "wire_events"), 200)
    return tail.select("event_id", "company", "stack_shown")


@query("s5_append_jobs", f"""
SELECT md5(concat('job|', event_id)) AS id, role, source, strftime(coalesce(posted, TIMESTAMP '{AS_OF}'),
       '%Y-%m-%d %H:%M:%S') AS posted_at, 'new' AS status
FROM (SELECT *, CASE WHEN pk % 13 <> 0 THEN posted_at END AS posted FROM postings)""", ["postings"])
def _(spark, d):
    postings = view(spark, d, "postings").withColumn(
        "posted_at", F.when(F.col("pk") % 13 != 0, F.col("posted_at"))
    )
    jobs = ingest.append_jobs(postings, as_of())
    return jobs.select("id", "role", "source", _shown("posted_at"), "status")


# -- cleaning ------------------------------------------------------------------------------


@query("p1_decode_stack", """
SELECT event_id, CASE WHEN pk % 50 IN (4, 6) THEN NULL WHEN pk % 50 = 5 THEN '1,2' WHEN pk % 50 = 7 THEN ''
       ELSE array_to_string(from_json(stack, '["VARCHAR"]'), ',') END AS tags FROM wire_events""", ["wire_events"])
def _(spark, d):
    stack = ingest.decode_stack("stack")
    return view(spark, d, "wire_events").select("event_id", F.array_join(stack, ",").alias("tags"))


@query("p2_require_company_role", """
SELECT event_id, trim(company) AS company, trim(role) AS role FROM wire_events
WHERE trim(company) <> '' AND trim(role) <> ''""", ["wire_events"])
def _(spark, d):
    return ingest.require_company_role(view(spark, d, "wire_events")).select("event_id", "company", "role")


@query("p3_empty_to_null", """
SELECT event_id, nullif(source, '') AS source, nullif(url, '') AS url, nullif(product, '') AS product,
       nullif(location, '') AS location FROM wire_events""", ["wire_events"])
def _(spark, d):
    return ingest.empty_to_null(view(spark, d, "wire_events")).select("event_id", *ingest.OPTIONAL_TEXT)


@query("p4_normalize_date", f"""
SELECT row_id, strftime(CASE row_id % 24
  WHEN 0 THEN day WHEN 1 THEN day + INTERVAL '10:20:30' WHEN 2 THEN day + INTERVAL '10:20:30'
  WHEN 3 THEN day + INTERVAL '10:20:30' WHEN 4 THEN day + INTERVAL '04:50:30.25'
  WHEN 5 THEN day + INTERVAL '15:20:30'
  WHEN 11 THEN make_timestamp(row_id * 1000 * 1000000)
  WHEN 12 THEN make_timestamp((1500000000 + row_id) * 1000000)
  WHEN 14 THEN TIMESTAMP '{AS_OF}' - to_days(CAST(row_id % 40 AS INT))
  WHEN 15 THEN TIMESTAMP '{AS_OF}' - to_days(CAST(row_id % 12 * 30 AS INT))
  WHEN 16 THEN TIMESTAMP '{AS_OF}' - to_hours(CAST(row_id % 50 AS INT))
  WHEN 17 THEN TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY WHEN 18 THEN TIMESTAMP '{AS_OF}'
  WHEN 6 THEN day WHEN 7 THEN day WHEN 8 THEN day WHEN 9 THEN day WHEN 10 THEN day END,
  '%Y-%m-%d %H:%M:%S.%f') AS at FROM raw_dates""", ["raw_dates"])
def _(spark, d):
    at = dates.normalize_date("raw", as_of())
    return view(spark, d, "raw_dates").select("row_id", F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))


@query("p5_validate_contract", """
SELECT rule, count(*) AS events FROM (
  SELECT 'company_blank' AS rule FROM wire_events WHERE trim(company) = ''
  UNION ALL SELECT 'role_blank' FROM wire_events WHERE trim(role) = ''
  UNION ALL SELECT 'source_blank' FROM wire_events WHERE trim(source) = ''
  UNION ALL SELECT 'url_blank' FROM wire_events WHERE trim(url) = ''
  UNION ALL SELECT 'stack_not_list' FROM wire_events WHERE pk % 50 = 6
  UNION ALL SELECT 'stack_item_not_text' FROM wire_events WHERE pk % 50 = 5)
GROUP BY rule""", ["wire_events"])
def _(spark, d):
    return ingest.violation_counts(view(spark, d, "wire_events"))


@query("p6_scan_relative_date", f"""
SELECT doc_id, strftime(CASE doc_id % 5 WHEN 0 THEN TIMESTAMP '{AS_OF}' - to_days(CAST(doc_id % 20 AS INT))
  WHEN 1 THEN TIMESTAMP '{AS_OF}' - to_days(CAST(30 * (doc_id % 9) AS INT)) WHEN 2 THEN TIMESTAMP '{AS_OF}'
  WHEN 3 THEN TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY END, '%Y-%m-%d %H:%M:%S') AS at FROM documents""")
def _(spark, d):
    n = F.col("doc_id")
    phrase = (
        F.when(n % 5 == 0, F.format_string("seen %d DAYS ago", n % 20))
        .when(n % 5 == 1, F.format_string("%d month ago, or 3 hours ago", n % 9))
        .when(n % 5 == 2, "Posted Just Now").when(n % 5 == 3, "(yesterday)").otherwise("5 seconds ago")
    )
    at = dates.scan_relative_date(F.concat_ws(" ", "text", phrase), as_of())
    return table(spark, d, "documents").select("doc_id", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at"))


# -- feeds ---------------------------------------------------------------------------------

_FEED_SQL = """
SELECT event_id, CAST(position AS INT) AS position, role, {team} AS team, location, url, {posted} AS posted_at, {tags} AS tags
FROM (SELECT *, 0 AS position FROM postings UNION ALL SELECT *, 1 AS position FROM postings WHERE pk % 3 = 0)"""


def _feed(spark, d, item, wrap):
    """Each posting as one landed payload with one or two items."""
    postings = view(spark, d, "postings").withColumn("role", F.replace("role", F.lit('"'), F.lit("")))
    both = F.when(F.col("pk") % 3 == 0, F.concat(item, F.lit(","), item)).otherwise(item)
    payload = F.concat(F.lit(wrap[0]), both, F.lit(wrap[1]))
    return postings.select("event_id", "company", payload.alias("payload"))


def _out(rows):
    return rows.select("event_id", "position", "role", "team", "location", "url", "posted_at",
                       F.array_join("tags", ",").alias("tags"))


@query("p7_flatten_lever", _FEED_SQL.format(
    team="CASE WHEN pk % 5 = 0 THEN '' WHEN pk % 5 = 1 THEN NULL ELSE product END",
    posted="CASE WHEN pk % 7 <> 0 THEN strftime(seen_at, '%Y-%m-%dT%H:%M:%S.025000+00:00') END",
    tags="replace(words, ' ', ',')"), ["postings"])
def _(spark, d):
    team = F.expr("CASE pk % 5 WHEN 0 THEN '' WHEN 1 THEN '\"team\":null,' ELSE concat('\"team\":\"', product, '\",') END")
    made = F.when(F.col("pk") % 7 == 0, "0").otherwise((F.unix_millis("seen_at") + 25).cast("string"))
    item = F.concat(
        F.lit('{"text":"'), "role", F.lit('","categories":{'), team, F.lit('"location":"'), "location",
        F.lit('"},"hostedUrl":"'), "url", F.lit('","createdAt":'), made, F.lit(',"tags":'),
        F.to_json("stack"), F.lit("}"),
    )
    return _out(feeds.flatten_lever(_feed(spark, d, item, ("[", "]"))))


@query("p8_flatten_greenhouse", _FEED_SQL.format(
    team="CASE WHEN pk % 4 = 0 THEN '' ELSE product END", posted="strftime(posted_at, '%Y-%m-%dT00:00:00Z')",
    tags="''"), ["postings"])
def _(spark, d):
    team = F.expr("CASE pk % 4 WHEN 0 THEN '' ELSE concat('{\"name\":\"', product, '\"},{\"name\":\"second\"}') END")
    item = F.concat(
        F.lit('{"title":"'), "role", F.lit('","departments":['), team, F.lit('],"location":{"name":"'), "location",
        F.lit('"},"absolute_url":"'), "url", F.lit('","updated_at":"'),
        F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"}'),
    )
    return _out(feeds.flatten_greenhouse(_feed(spark, d, item, ('{"jobs":[', "]}"))))


@query("p9_flatten_ashby", """
SELECT event_id, role, CASE pk % 5 WHEN 1 THEN 'Remote' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE location END AS location,
       CASE WHEN pk % 3 = 1 THEN concat('https://jobs.ashbyhq.com/', company, '/', CAST(pk AS VARCHAR)) ELSE url END AS url
FROM postings WHERE pk % 4 <> 0 OR pk % 3 = 0""", ["postings"])
def _(spark, d):
    place = F.expr("""CASE pk % 5 WHEN 1 THEN '"isRemote":true,' WHEN 2 THEN '"isRemote":false,'
      WHEN 3 THEN '"locationName":null,"isRemote":true,' ELSE concat('"locationName":"', location, '",') END""")
    link = F.expr("""CASE WHEN pk % 3 = 1 THEN '' ELSE concat('"externalLink":"', url, '",') END""")
    state = F.expr("CASE WHEN pk % 4 = 0 AND pk % 3 <> 0 THEN 'Draft' ELSE 'Published' END")
    item = F.concat(
        F.lit("{"), place, link, F.lit('"id":"'), F.col("pk").cast("string"), F.lit('","title":"'), "role",
        F.lit('","jobPostingState":"'), state, F.lit('"}'),
    )
    payload = F.concat(F.lit('{"data":{"jobBoard":{"jobPostings":['), item,
                       F.lit(',{"title":"x","jobPostingState":"Closed"}]}}}'))
    landed = view(spark, d, "postings").select("event_id", "company", payload.alias("payload"))
    return feeds.flatten_ashby(landed).select("event_id", "role", "location", "url")


@query("p10_flatten_remotive", """
SELECT event_id, company, role, url, replace(words, ' ', ',') AS stack, substring(repeat(concat(product, ' '), 60), 1, 300)
       AS product, CASE WHEN pk % 6 = 0 THEN 'Remote' ELSE location END AS location
FROM postings WHERE (list_contains(stack, 'red') OR list_contains(stack, 'ring')) AND contains(lower(role), 'prom')""",
       ["postings"])
def _(spark, d):
    place = F.expr("CASE WHEN pk % 6 = 0 THEN '' ELSE concat('\"candidate_required_location\":\"', location, '\",') END")
    item = F.concat(
        F.lit('{"jobs":[{'), place, F.lit('"company_name":"'), "company", F.lit('","title":"'), "role",
        F.lit('","tags":[7,'), F.expr("concat('\"', replace(words, ' ', '\",\"'), '\"')"), F.lit(',null],"url":"'), "url",
        F.lit('","company_description":"'), F.repeat(F.concat("product", F.lit(" ")), F.lit(60)), F.lit('"}]}'),
    )
    landed = view(spark, d, "postings").select("event_id", item.alias("payload"))
    rows = feeds.flatten_remotive(landed, target_role="promo lead", target_stack=["Red", "ring"])
    return rows.select("event_id", "company", "role", "url", F.array_join("stack", ",").alias("stack"), "product", "location")


# -- cards and pages -----------------------------------------------------------------------


@query("p11_parse_listing_cards", """
SELECT event_id,
  CASE WHEN pk % 4 = 2 THEN company ELSE concat(company, ' Works') END AS company,
  CASE WHEN pk % 4 = 2 THEN concat(titled, ' Lead') ELSE titled END AS role,
  CASE WHEN pk % 2 = 0 THEN 'Full Time,In Office,job' ELSE 'Part Time,Work from Home,internship' END AS stack,
  CASE WHEN pk % 2 = 0 THEN concat('City', CAST(sk AS VARCHAR)) END AS location,
  CASE WHEN pk % 3 = 0 THEN '20 K - 25 K/Month' END AS product,
  CASE WHEN pk % 5 <> 0 THEN 'May 16, 2026' END AS posted_at,
  concat('https://unstop.com/', CASE WHEN pk % 2 = 0 THEN 'jobs' ELSE 'internships' END, '/x-', CAST(pk AS VARCHAR)) AS url
FROM (SELECT *, array_to_string(list_transform(string_split(role, ' '),
        lambda w: concat(upper(substring(w, 1, 1)), lower(substring(w, 2)))), ' ') AS titled FROM postings)
WHERE pk % 11 <> 0""", ["postings"])
def _(spark, d):
    front = F.expr("""CASE WHEN pk % 4 = 2 THEN concat(role, '  Lead ', company) ELSE concat(role, ' ', company, ' Works') END""")
    marker = F.expr("""CASE WHEN pk % 11 = 0 THEN ' some years ' WHEN pk % 3 = 1 THEN ' No prior experience required '
                       ELSE ' 1 - 3 years ' END""")
    mode = F.expr("""CASE WHEN pk % 2 = 0 THEN concat('Full Time\n In Office | City', sk, '  ') ELSE 'Part Time Work from Home ' END""")
    tail = F.expr("""concat(' Students ', CASE WHEN pk % 3 = 0 THEN '20 K - 25 K/Month ' ELSE '' END, 'Prize Icon ',
                     CASE WHEN pk % 5 <> 0 THEN 'Posted May 16, 2026 ' ELSE '' END, '12 days left')""")
    href = F.expr("concat('/', CASE WHEN pk % 2 = 0 THEN 'jobs' ELSE 'internships' END, '/x-', pk)")
    title = F.initcap("role")
    landed = _spread(spark, d).withColumn("role", title).select(
        "event_id", href.alias("href"), F.concat(front, marker, mode, "role", tail).alias("text")
    )
    rows = cards.parse_listing_cards(landed)
    return rows.select("event_id", "company", "role", F.array_join("stack", ",").alias("stack"), "location", "product",
                       "posted_at", "url")


@query("p12_listing_links", """
SELECT regexp_replace(split_part(url, '?', 1), '/+$', '') AS canonical, min(page_id) AS page_id FROM pages
WHERE len(list_filter(string_split(regexp_replace(split_part(url, '?', 1), '/+$', ''), '/'), lambda s: s <> '')) >= 2
GROUP BY 1""")
def _(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.col("url").alias("href"))
    return links.listing_links(pages, ["page_id"]).select("canonical", "page_id")


def _spread(spark, d):
    """Postings spread over tasks: reading HTML costs far more than moving these short rows."""
    return view(spark, d, "postings").repartition("event_id")


def _card_page(card: str):
    """One landed page per posting."""
    return F.concat(F.lit("<html><body><ul>"), F.expr(card), F.lit("</ul></body></html>"))


_CARD_SQL = """
SELECT event_id, CAST(1 AS INT) AS ordinal, company, {role} AS role, {url} AS url, {stack} AS stack, {product} AS product,
       {location} AS location, {posted} AS posted_at FROM postings {where}"""
_NONE = "CAST(NULL AS VARCHAR)"


def _cards(spark, d, site, card, base="https://listing.example.com/find/page", **rules):
    pages = _spread(spark, d).select("event_id", F.lit(base).alias("url"), _card_page(card).alias("html"))
    rows = html.extract_postings(pages, site, as_of(), keep=("event_id",), **rules)
    return rows.select("event_id", "ordinal", "company", "role", "url", F.array_join("stack", ",").alias("stack"),
                       "product", "location", "posted_at")


@query("p13_cards_naukri", _CARD_SQL.format(
    role="CASE WHEN pk % 9 = 0 THEN 'searched' ELSE role END", url="concat('https://www.naukri.com/j/', pk)",
    stack="replace(words, ' ', ',')", product=_NONE, location="location",
    posted="CASE WHEN pk % 2 = 0 THEN '3 days ago' END", where="WHERE pk % 8 <> 0"), ["postings"])
def _(spark, d):
    return _cards(spark, d, "naukri", """concat('<article class="jobTuple new"><a class="title" href="/j/', pk, '"> ',
      CASE WHEN pk % 9 = 0 THEN '' ELSE role END, '</a>', CASE WHEN pk % 8 = 0 THEN '' ELSE
      concat('<span class="comp-name">', company, '</span>') END, '<span class="loc"><span><a>', location,
      '</a></span></span><ul class="tags"><li>', replace(words, ' ', '</li><li>'), '</li></ul>',
      CASE WHEN pk % 2 = 0 THEN '<span class="job-post-day">3 days ago</span>' ELSE '' END, '</article>')""",
                  searched_role="searched")


@query("p13_cards_internshala", _CARD_SQL.format(
    role="role", url="CASE WHEN pk % 5 = 0 THEN concat('https://internshala.com/d/', pk) ELSE url END",
    stack="replace(words, ' ', ',')", product="CASE WHEN pk % 4 <> 0 THEN product END", location="location",
    posted="""CASE pk % 3 WHEN 0 THEN '2001-11-03T00:00:00+00:00' WHEN 1 THEN '2001-11-04T19:00:00+00:00'
              ELSE NULL END""", where=""), ["postings"])
def _(spark, d):
    return _cards(spark, d, "internshala", """concat('<div class="individual_internship" data-href="/d/', pk,
      '"><h3 class="job-internship-name"><a href="', CASE WHEN pk % 5 = 0 THEN '' ELSE url END, '">', role,
      '</a></h3><p class="company-name">', company, '</p><p class="locations"><span><a>', location,
      '</a></span></p><div class="job_skills"><div class="job_skill">',
      replace(words, ' ', '</div><div class="job_skill">'), '</div></div>',
      CASE WHEN pk % 4 <> 0 THEN concat('<span class="stipend">', product, '</span>') ELSE '' END,
      CASE pk % 3 WHEN 0 THEN '<div class="status-info"><span>2 days ago</span></div>'
      WHEN 1 THEN '<div class="status-info"><span>Early</span></div><i>5 hours <b>ago</b></i>' ELSE '' END, '</div>')""")


@query("p13_cards_linkedin", _CARD_SQL.format(
    role="role", url="CASE WHEN pk % 5 = 0 THEN 'https://listing.example.com/find/page' ELSE url END", stack="''",
    product=_NONE, location="location", posted="strftime(posted_at, '%Y-%m-%d')", where="WHERE pk % 7 <> 0"), ["postings"])
def _(spark, d):
    return _cards(spark, d, "linkedin", """concat('<li><div class="base-search-card x">',
      CASE WHEN pk % 5 = 0 THEN '' ELSE concat('<a class="base-card__full-link" href="', url, '">go</a>') END,
      '<h3 class="base-search-card__title">\n ', CASE WHEN pk % 7 = 0 THEN '' ELSE role END,
      ' </h3><h4 class="base-search-card__subtitle"><a>', company, '</a></h4><span class="job-search-card__location">',
      location, '</span><time datetime="', date_format(posted_at, 'yyyy-MM-dd'), '">then</time></div></li>
      <div class="base-search-card"><h3 class="base-search-card__title">stray</h3></div>')""")


@query("p13_cards_yc", _CARD_SQL.format(
    role="role", url="concat('https://listing.example.com/r/', pk)", stack="replace(words, ' ', ',')",
    product="product", location="location", posted=_NONE, where="WHERE contains(lower(role), 'prom')"), ["postings"])
def _(spark, d):
    return _cards(spark, d, "yc_jobs", """concat('<div class="company"><h4><a> ', company, '</a></h4><p class="description">',
      product, '<b>x</b></p><span class="tag">', replace(words, ' ', '</span><span class="tag">'),
      '</span><span class="location">', location, '</span><div class="job"><a href="/r/', pk, '">', role, '</a></div></div>')""",
                  target_role="prom")


@query("p13_cards_cutshort", _CARD_SQL.format(
    role="CASE WHEN pk % 3 = 0 THEN concat('Listed ', role) ELSE role END",
    url="concat('https://listing.example.com/job/', pk)", stack="CASE WHEN pk % 4 = 0 THEN '' ELSE replace(words, ' ', ',') END",
    product="''", location="location", posted=_NONE,
    where="WHERE pk % 4 = 0 OR list_contains(stack, 'red') OR list_contains(stack, 'blue')"), ["postings"])
def _(spark, d):
    return _cards(spark, d, "cutshort", """concat('<script type="application/ld+json">',
      CASE WHEN pk % 3 = 0 THEN concat('{"@type":"ItemList","itemListElement":[{"position":1,"name":"old"},{"position":1,"name":" Listed ',
      role, ' "}]}') WHEN pk % 3 = 1 THEN '{"@type":"Other","itemListElement":[{"position":1,"name":"no"}]}' ELSE '{broken' END,
      '</script><div class="a jEsvIvx"><a href="../job/', pk, '">o</a><h2><a>', role, '</a></h2>',
      CASE WHEN pk % 2 = 0 THEN concat('<img alt="', company, '">') ELSE concat('<h3>', company, '</h3>') END,
      '<div class="loAaLs">', location, '</div><div class="z lfkCpY">',
      CASE WHEN pk % 4 = 0 THEN '' ELSE concat('<span> ', replace(words, ' ', '</span><span>'), '</span>') END, '</div></div>')""",
                  target_stack=["red", "BLUE"])


@query("p13_cards_glassdoor", """
SELECT event_id, CAST(1 AS INT) AS ordinal, CASE WHEN pk % 6 = 0 THEN 'Unknown Company' ELSE company END AS company,
       CASE WHEN pk % 5 = 0 THEN 'Not Specified' ELSE role END AS role,
       CASE WHEN pk % 4 = 0 THEN 'https://listing.example.com/find/page' ELSE concat('https://listing.example.com/find/v?x=', pk) END AS url,
       '' AS stack, product, '' AS location, CAST(NULL AS VARCHAR) AS posted_at FROM postings""", ["postings"])
def _(spark, d):
    return _cards(spark, d, "glassdoor", """concat('<li data-test="jobListing">',
      CASE WHEN pk % 6 = 0 THEN '' ELSE concat('<b data-test="employer-name">', company, '</b>') END,
      CASE WHEN pk % 5 = 0 THEN '' ELSE concat('<b class="JobDetails_jobTitle__Rw_As">', role, '</b>') END,
      CASE WHEN pk % 4 = 0 THEN '' ELSE concat('<a data-test="job-title-link" href="v?x=', pk, '">o</a>') END,
      '<p data-test="job-description-snippet"> ', product, '</p></li>')""")


@query("p13_cards_wellfound", """
SELECT a.event_id, a.company, a.role, concat('https://w.example.com/c/', a.event_id, '/jobs/', a.pk) AS url,
       replace(a.words, ' ', ',') AS stack, a.product, a.location
FROM postings a WHERE list_contains(a.stack, 'red') AND contains(lower(a.role), 'prom')""", ["postings"])
def _(spark, d):
    postings = _spread(spark, d)
    listing = _card_page("""concat('<div data-test="StartupResult"><h2><a>', company, '</a></h2><p class="x description">',
      product, '</p><span class="tag">', replace(words, ' ', '</span><span class="tag">'), '</span><a href="/c/', event_id, '/jobs">j</a></div>')""")
    firm = _card_page("""concat('<li class="job-row"><h3>', role, '</h3><a href="/c/', event_id, '/jobs/', pk,
      '">v</a><span class="my-location">', location, '</span></li>')""")
    home = F.lit("https://w.example.com/")
    listings = postings.select(home.alias("url"), listing.alias("html"))
    firms = postings.select(F.concat(home, F.lit("c/"), "event_id", F.lit("/jobs")).alias("url"), firm.alias("html"))
    rows = html.wellfound_postings(listings, firms, target_role="prom", target_stack=["red"])
    return rows.select(F.split_part("url", F.lit("/"), F.lit(5)).alias("event_id"), "company", "role", "url",
                       F.array_join("stack", ",").alias("stack"), "product", "location")


@query("p13_cards_career_page", """
SELECT page_id, CAST(count(*) AS BIGINT) AS links, min(label) AS first_label FROM (
  SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1)) AS label FROM pages)
GROUP BY page_id""")
def _(spark, d):
    pages = table(spark, d, "pages")
    rows = html.extract_postings(pages, "career_page", as_of(), company=F.lit("org"))
    return rows.where("role <> '' AND url LIKE '%/%'").groupBy("page_id").agg(
        F.count("*").alias("links"), F.min("role").alias("first_label")
    )


@query("p13_cards_generic", """
SELECT event_id, role, CASE WHEN pk % 2 = 0 THEN concat('https://listing.example.com/jobs/', pk) ELSE url END AS url,
       CASE WHEN pk % 5 = 0 THEN 'New York' ELSE '' END AS location FROM postings""", ["postings"])
def _(spark, d):
    card = """concat('<li><h2>', role, '</h2><p>', CASE WHEN pk % 5 = 0 THEN 'new york office' ELSE product END,
      '</p><a href="', CASE WHEN pk % 2 = 0 THEN concat('/jobs/', pk) ELSE url END, '">see</a></li><li>no link</li>')"""
    pages = _spread(spark, d).select(
        "event_id", F.lit("https://listing.example.com/find/page").alias("url"), _card_page(card).alias("html")
    )
    rows = html.extract_postings(pages, "generic", as_of(), keep=("event_id",))
    return rows.select("event_id", "role", "url", "location")


@query("p14_jsonld_titles", """
SELECT event_id, CAST(2 AS INT) AS position, concat('New ', role) AS title FROM postings WHERE pk % 3 <> 1""", ["postings"])
def _(spark, d):
    page = F.expr("""concat('<script>var a="</p>";</script><script type="application/ld+json">{"@type":"',
      CASE WHEN pk % 3 = 1 THEN 'Thing' ELSE 'ItemList' END, '","itemListElement":[{"position":2,"name":"old"},{"position":3,"name":" "}]}</script>
      <script type="application/ld+json">[broken</script><script type="application/ld+json">{"@type":"',
      CASE WHEN pk % 3 = 1 THEN 'Thing' ELSE 'ItemList' END, '","itemListElement":[{"position":2,"name":"  New ', role, '"}]}</script>')""")
    pages = view(spark, d, "postings").select("event_id", feeds.jsonld_titles(page).alias("titles"))
    at = F.explode(F.array(F.lit(2), F.lit(3)))
    rows = pages.select("event_id", "titles", at.alias("position"))
    return rows.select("event_id", "position", feeds.title_at(F.col("titles"), F.col("position")).alias("title")).where("title IS NOT NULL")


@query("p15_career_links", """
SELECT page_id, concat(regexp_extract(url, '^(https?://[^/?#]*)', 1), link) AS link FROM (
  SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS link FROM pages)
WHERE contains(lower(link), 'th') OR contains(lower(link), 'ch')""")
def _(spark, d):
    """Words of the test pages stand for the career words."""
    found = links.career_links(table(spark, d, "pages"), keywords=["th", "ch"])
    return found.select("page_id", "link")


@query("p15_readme_links", """
SELECT page_id, 'Jobs & more' AS label, concat('https://a.example.org/', page_id) AS link FROM pages WHERE page_id % 3 <> 0
UNION ALL SELECT page_id, 'here', concat('https://b.example.org/Careers/', page_id) FROM pages WHERE page_id % 3 <> 0""")
def _(spark, d):
    readme = F.expr("""concat('# Readme\n[Jobs & more](https://a.example.org/', page_id, ') and [here](https://b.example.org/Careers/',
      page_id, ') or [docs](https://c.example.org)')""")
    body = F.when(F.col("page_id") % 3 == 0, "[docs](https://c.example.org) only").otherwise(readme)
    found = links.readme_career_links(table(spark, d, "pages").select("page_id", body.alias("text")))
    return found.select("page_id", "label", "link")


# -- URLs ----------------------------------------------------------------------------------

_ATS_URL = """CASE pk % 7 WHEN 0 THEN concat('https://jobs.lever.co/c', sk, '/', pk)
  WHEN 1 THEN concat('https://boards.greenhouse.io/c', sk, '/jobs/1') WHEN 2 THEN concat('https://grnh.se/', pk)
  WHEN 3 THEN concat('https://jobs.ashbyhq.com/c', sk) WHEN 4 THEN concat('https://x.myworkdayjobs.com/c', sk)
  WHEN 5 THEN 'https://jobs.lever.co/' ELSE url END"""


@query("p16_detect_ats", f"""
SELECT CASE WHEN contains(u, 'jobs.lever.co') THEN 'lever' WHEN contains(u, 'greenhouse.io') OR contains(u, 'grnh.se') THEN 'greenhouse'
  WHEN contains(u, 'ashbyhq.com') THEN 'ashby' WHEN contains(u, 'myworkdayjobs') THEN 'workday' ELSE 'generic' END AS ats,
  count(*) AS postings, min(event_id) AS first_id FROM (SELECT event_id, {_ATS_URL} AS u FROM postings) GROUP BY 1""", ["postings"])
def _(spark, d):
    rows = view(spark, d, "postings").withColumn("ats", urls.detect_ats(F.expr(_ATS_URL)))
    return rows.groupBy("ats").agg(F.count("*").alias("postings"), F.min("event_id").alias("first_id"))


@query("p17_company_slug", f"""
SELECT event_id, CASE pk % 7 WHEN 2 THEN CAST(pk AS VARCHAR) WHEN 4 THEN NULL WHEN 5 THEN '' WHEN 6 THEN NULL
       ELSE concat('c', sk) END AS slug FROM postings""", ["postings"])
def _(spark, d):
    rows = view(spark, d, "postings").withColumn("u", F.expr(_ATS_URL))
    return rows.select("event_id", urls.company_slug("u", urls.detect_ats("u")).alias("slug"))


@query("p18_company_from_url", """
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Big-' ELSE 'Example' END AS kind,
       CASE WHEN page_id % 3 = 0 THEN concat('Big Co', page_id) ELSE 'Example' END AS company FROM pages""")
def _(spark, d):
    pages = table(spark, d, "pages")
    url = F.when(F.col("page_id") % 3 == 0, F.expr("concat('https://WWW.careers.big-co', page_id, '.example.com/x')")).otherwise(F.col("url"))
    kind = F.when(F.col("page_id") % 3 == 0, "Big-").otherwise("Example")
    return pages.select("page_id", kind.alias("kind"), urls.company_from_url(url).alias("company"))


@query("p19_location_hint", """
SELECT CASE WHEN contains(lower(text), 'remote') THEN 'Remote' WHEN contains(lower(text), 'bangalore') THEN 'Bangalore'
  WHEN contains(lower(text), 'bengaluru') THEN 'Bengaluru' WHEN contains(lower(text), 'mumbai') THEN 'Mumbai'
  WHEN contains(lower(text), 'delhi') THEN 'Delhi' WHEN contains(lower(text), 'hyderabad') THEN 'Hyderabad'
  WHEN contains(lower(text), 'pune') THEN 'Pune' WHEN contains(lower(text), 'chennai') THEN 'Chennai'
  WHEN contains(lower(text), 'san francisco') THEN 'San Francisco' WHEN contains(lower(text), 'new york') THEN 'New York'
  WHEN contains(lower(text), 'london') THEN 'London' WHEN contains(lower(text), 'berlin') THEN 'Berlin'
  WHEN contains(lower(text), 'singapore') THEN 'Singapore' WHEN contains(lower(text), 'worldwide') THEN 'Worldwide'
  ELSE '' END AS location, count(*) AS docs, min(doc_id) AS first_doc FROM texts GROUP BY 1""", ["texts"])
def _(spark, d):
    rows = view(spark, d, "texts").withColumn("location", urls.location_hint("text"))
    return rows.groupBy("location").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))


@query("p20_role_slug", """
SELECT doc_id, regexp_replace(regexp_replace(lower(raw_text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
       replace(lower(raw_text), ' ', '-') AS spaced FROM texts""", ["texts"])
def _(spark, d):
    return view(spark, d, "texts").select(
        "doc_id", text.slug("raw_text").alias("slug"), text.space_slug("raw_text").alias("spaced"))


_NORM_SQL = """CASE WHEN NOT regexp_matches(trim(url), '^https?://[^/?#]') THEN '' ELSE concat(
  regexp_extract(trim(url), '^(https?://)', 1), lower(regexp_extract(trim(url), '^https?://([^/?#]*)', 1)),
  coalesce(nullif(regexp_replace(regexp_extract(trim(url), '^https?://[^/?#]*([^?#]*)', 1), '/+$', ''), ''), '/'),
  CASE WHEN contains(url, 'page=2') AND contains(url, 'utm_medium') THEN '?page=2&B=1+a+b&c=' WHEN contains(url, 'page=2') THEN '?page=2'
       WHEN contains(url, 'utm_medium') THEN '?B=1+a+b&c=' ELSE '' END) END"""


@query("p21_normalize_url", f"SELECT seq, {_NORM_SQL} AS url FROM search_results", ["search_results"])
def _(spark, d):
    return view(spark, d, "search_results").select("seq", urls.normalize_url("url").alias("url"))
