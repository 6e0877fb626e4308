import json
from datetime import datetime

from pyspark.sql import functions as F

from postloom.operators import ingest
from postloom.sources import cards, feeds, html, links, snapshots

IN_OFFICE = (
    "Accounts Executive Star Samarth International 1 - 3 years Full Time "
    "In Office | Gurgaon Accounts Executive Accounting Experienced Professionals "
    "Fresher 20 K - 25 K/Month Prize Icon Posted May 16, 2026 12 days left"
)
FROM_HOME = (
    "React.js Developer Internship Pragma Consulting No prior experience required "
    "Full Time Work from Home React.js Developer Internship Software Development "
    "Frontend Development Engineering Students +2 8 K - 12 K/Month Prize Icon Posted May 16, 2026 12 days left"
)
NO_SALARY = (
    "MERN Stack Developer Internship Octalbees No prior experience required "
    "Part Time Work from Home MERN Stack Developer Internship Software Development "
    "Full Stack Development Engineering Students +3 Posted May 16, 2026 12 days left"
)
MANY_CITIES = (
    "HVAC Systems Sales Manager Beijer Ref India Private Limited 4 - 8 years "
    "Full Time In Office | Mumbai, Chennai, Chandigarh HVAC Systems Sales Manager "
    "B2B Sales Account Management Experienced Professionals 40 K - 70 K/Month Prize Icon Posted May 16, 2026 5 days left"
)


def as_of():
    return F.lit("2024-06-15 12:00:00").cast("timestamp")


def test_listing_cards(spark):
    landed = [("/jobs/a-1", IN_OFFICE), ("/internships/b-2", FROM_HOME), ("/internships/c-3", NO_SALARY),
              ("https://o.org/jobs/d-4", MANY_CITIES), ("/jobs/e", ""), ("/jobs/f", "Just a title Posted May 2026"),
              ("/jobs/g", "Sales Intern Bright Works 1-2 years Full Time Hybrid unrelated words follow"),
              ("/jobs/h", "1 - 2 years Full Time In Office nothing before it")]
    rows = {r["href"]: r for r in cards.parse_listing_cards(spark.createDataFrame(landed, "href string, text string")).collect()}
    assert set(rows) == {"/jobs/a-1", "/internships/b-2", "/internships/c-3", "https://o.org/jobs/d-4", "/jobs/g"}
    a, b, c, d = (rows[h] for h, _ in landed[:4])
    assert (a["role"], a["company"], a["location"]) == ("Accounts Executive", "Star Samarth International", "Gurgaon")
    assert a["url"] == "https://unstop.com/jobs/a-1" and a["source"] == "unstop" and a["stack"] == ["Full Time", "In Office", "job"]
    assert a["product"].startswith("20 K") and a["posted_at"] == "May 16, 2026"
    assert (b["role"], b["company"], b["location"]) == ("React.js Developer Internship", "Pragma Consulting", None)
    assert "8 K" in b["product"] and b["stack"] == ["Full Time", "Work from Home", "internship"]
    assert c["product"] is None and c["company"] == "Octalbees"
    assert "Mumbai" in d["location"] and d["company"] == "Beijer Ref India Private Limited" and d["url"] == "https://o.org/jobs/d-4"
    assert (rows["/jobs/g"]["role"], rows["/jobs/g"]["company"]) == ("Sales Intern", "Bright Works")


def test_feeds(spark):
    lever = json.dumps([
        {"text": "Dev", "categories": {"team": None}, "createdAt": 1717200000123, "tags": ["a", 1]},
        {"categories": {"location": "Pune"}, "hostedUrl": "u", "createdAt": 0},
    ])
    df = spark.createDataFrame([("acme", lever), ("bad", "{nope")], "company string, payload string")
    one, two = feeds.flatten_lever(df).orderBy("position").collect()
    assert (one["role"], one["team"], one["location"], one["url"], one["tags"]) == ("Dev", None, "", "", ["a"])
    assert one["posted_at"] == "2024-06-01T00:00:00.123000+00:00"
    assert (two["role"], two["location"], two["posted_at"], two["tags"]) == ("", "Pune", None, [])

    house = json.dumps({"jobs": [{"title": "T", "departments": [], "location": {"name": "L"}}, {"departments": [{"name": "D"}]}]})
    rows = feeds.flatten_greenhouse(spark.createDataFrame([("a", house)], "company string, payload string")).collect()
    assert [(r["role"], r["team"], r["location"]) for r in rows] == [("T", "", "L"), ("", "D", "")]

    board = json.dumps({"data": {"jobBoard": {"jobPostings": [
        {"id": "7", "title": "A", "jobPostingState": "Published", "isRemote": True},
        {"id": "8", "title": "B", "jobPostingState": "Published", "locationName": None, "externalLink": None},
        {"id": "9", "title": "C", "jobPostingState": "Draft"}]}}})
    rows = feeds.flatten_ashby(spark.createDataFrame([("acme", board)], "company string, payload string")).collect()
    assert [(r["role"], r["location"], r["url"]) for r in rows] == [
        ("A", "Remote", "https://jobs.ashbyhq.com/acme/7"), ("B", None, None)]

    feed = json.dumps({"jobs": [
        {"title": "Python Dev", "company_name": "X", "tags": ["Python", 3], "company_description": "y" * 400},
        {"title": "Sales", "tags": ["python"]}]})
    rows = feeds.flatten_remotive(spark.createDataFrame([(feed,)], "payload string"), target_role="dev", target_stack=["python"]).collect()
    assert len(rows) == 1 and rows[0]["location"] == "Remote" and len(rows[0]["product"]) == 300 and rows[0]["stack"] == ["Python"]


def test_html_reader():
    page = html.page_cards("<ul><li>no</li><li><a href='/job/1'>One <b>two</b><br>x</a><p>Pune</p></li></ul><p>un<p>closed", html.PROFILES["generic"])
    assert len(page) == 1 and page[0]["text"] == "One two\nx\nPune" and page[0]["href"] == "/job/1"
    assert html.page_cards("", html.PROFILES["naukri"]) == html.page_cards(None, html.PROFILES["naukri"]) == []
    tree = html.parse_html('<div class="a b" id="m"><span data-x="yes-1"><i>t</i></span></div><span><i>u</i></span>')
    nodes = list(tree.walk())
    for selector, count in (("div.a.b span i", 1), ("div > i", 0), ("span > i", 2), ("#m i, i", 2), ("[data-x*='yes']", 1),
                            ("span[data-x]", 1), ("div:has(i)", 1), ("div.c", 0)):
        assert len(html.select(nodes, selector)) == count, selector


def test_html_tree():
    tree = html.parse_html(
        "<!DOCTYPE html><!-- <p>no</p> --><P Class=x data-q=\"a>b\" hidden>1 < 2 &amp; 3<br/>x<img src=i.png>y</p></b>"
        "<script>if (a<b) '</p>'</script ><a href='?a=1&amp;b=2'>z</a><style>p{}"
    )
    p, script, a, style = tree.children
    assert (p.tag, p.attrs) == ("p", {"class": "x", "data-q": "a>b", "hidden": ""})
    assert [c if isinstance(c, str) else c.tag for c in p.children] == ["1 < 2 & 3", "br", "x", "img", "y"]
    assert script.children == ["if (a<b) '</p>'"] and a.attrs == {"href": "?a=1&b=2"} and style.children == ["p{}"]
    assert html._stripped(tree, " ") == "1 < 2 & 3 x y z"
    assert html._stripped(html.parse_html("<p>" * 5000 + "deep")) == "deep"
    assert html.parse_html("<div <p>a</div>b <").children[-1].endswith("b <") and html.parse_html("").children == []


def test_site_rules(spark):
    def rows(site, body, **rules):
        df = spark.createDataFrame([(1, "https://s.org/list/p", f"<body>{body}</body>")], "page_id long, url string, html string")
        return html.extract_postings(df, site, as_of(), **rules).collect()

    got = rows("naukri", '<div class="srp-jobtuple-root"><a class="title" href="https://a.b/1">Dev</a></div>'
                         '<article class="jobTuple"><a class="jobTitle"></a><a class="comp-name"> Acme </a></article>', searched_role="Go")
    assert [(r["ordinal"], r["role"], r["company"], r["url"]) for r in got] == [(2, "Go", "Acme", "https://www.naukri.com")]
    got = rows("glassdoor", '<p data-test="jobListing"></p>')
    assert (got[0]["company"], got[0]["role"], got[0]["url"]) == ("Unknown Company", "Not Specified", "https://s.org/list/p")
    got = rows("yc_jobs", '<div class="company"><h4><a>Acme</a></h4><div class="job"><a href="../1">Go <b>dev</b></a><a href="/2">Ops</a></div></div>',
               target_role="go")
    assert [(r["company"], r["role"], r["url"]) for r in got] == [("Acme", "Go", "https://s.org/1")]
    got = rows("cutshort", '<script type="application/ld+json">{"@type":"ItemList","itemListElement":[{"position":2,"name":"Two"}]}</script>'
                           '<div class="jEsvIv"><h2><a>One</a></h2><h3>A</h3></div><div class="jEsvIv"><h3>B</h3></div><div class="jEsvIv"></div>')
    assert [(r["role"], r["company"]) for r in got] == [("One", "A"), ("Two", "B")]
    got = rows("career_page", '<div><h2>Go dev</h2><a href="x">y</a><span>Go</span></div><p><a>out</a></p>', target_stack=["go"],
               company=F.lit("acme"))
    assert [(r["company"], r["role"], r["url"], r["stack"]) for r in got] == [("acme", "Go dev", "https://s.org/list/x", ["Go"])]


def test_links(spark):
    df = spark.createDataFrame([(1, "/jobs/a/?x=1", True), (2, "/jobs/a", True), (3, "/jobs", True), (4, " /jobs/b ", False),
                                (5, "/jobs/b/", True), (6, "", True)], "n int, href string, ok boolean")
    got = links.listing_links(df, ["n"], parsed=F.col("ok"))
    assert sorted((r["n"], r["canonical"]) for r in got.collect()) == [(1, "/jobs/a"), (5, "/jobs/b")]
    pages = spark.createDataFrame([("https://x.org/a/", "<a class='k' href='Careers'>c</a><A HREF=\"/about\">jobs</A>")], "url string, html string")
    assert [r["link"] for r in links.career_links(pages).collect()] == ["https://x.org/a/Careers"]


def test_contract_and_encoding(spark):
    base = dict(company="Razorpay", role="Dev", source="remotive", url="u", stack='["Go"]')
    cases = [({}, set()), ({"company": ""}, {"company_blank"}), ({"role": "  "}, {"role_blank"}), ({"url": None}, {"url_blank"}),
             ({"stack": '"Go"'}, {"stack_not_list"}), ({"stack": "[1, 2]"}, {"stack_item_not_text"}), ({"stack": "[]"}, set()),
             ({"stack": "oops"}, set()), ({"stack": '["a", null]'}, {"stack_item_not_text"}), ({"stack": None}, set())]
    rows = [(i, *[{**base, **c}[f] for f in base]) for i, (c, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, company string, role string, source string, url string, stack string")
    got = {r["i"]: set(r["violations"]) for r in ingest.checked(df).collect()}
    assert [got[i] for i in range(len(cases))] == [v for _, v in cases]
    good, bad = ingest.validate_contract(df)
    assert good.count() == 4 and bad.count() == 6

    posting = [(" A ", "Dev", None, None, None, None, None, None), (None, "x", "s", None, ["a"], None, None, "d")]
    p = spark.createDataFrame(posting, "company string, role string, source string, url string, stack array<string>, product string, location string, posted_at string")
    one, two = ingest.encode_events(p, "yard", as_of()).collect()
    assert (one["source"], one["stack"], one["posted_at"], two["company"]) == ("yard", "[]", "2024-06-15T12:00:00+00:00", "")
    only = ingest.encode_events(p, "yard", as_of(), "scraper").collect()
    assert [(r["company"], r["posted_at"]) for r in only] == [("A", "")]


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "jobs")
    assert snapshots.current(spark, path) is None
    for n in range(2):
        assert snapshots.publish(spark.range(n + 1), path) == n
    (tmp_path / "jobs" / "v=7").mkdir()  # a write that never finished
    assert snapshots.current(spark, path).count() == 2
    assert isinstance(datetime.now(), datetime)


def test_pages_are_read_in_one_pass_as_the_tree_reads_them(monkeypatch):
    """The same cards as by the tree, for pages out of odd pieces, and no tree is built."""
    import random

    pieces = [
        "<ul>", "</ul>", "<li>", "</li>", "<LI class=job>", "<div class='individual_internship jEsvIv tag' data-href='/d/1'>", "</div>",
        "<h3 class=\"job-internship-name\">", "</h3>", "<a href='/jobs/1&amp;2'>", "<a title='a>b' class=title href=job>", "</a>",
        "<span class=\"comp-name tag location\">", "</span>", "<article class=\"jobTuple\">", "</article>", "<br/>", "<img alt=x>",
        "text ", " \n ", "a &lt;b&gt;", " < ", "<!-- c<b> -->", "<script>if(a<b){'</div>'}</script>", "<template>t</template>",
        "<style>", "</zz>", "<p class=description>", "</p>", "<h2>", "</h2>", "<div class='job company'>", "2 days ago"]
    chosen = random.Random(7)
    pages = ["".join(chosen.choice(pieces) for _ in range(chosen.randrange(40))) for _ in range(300)]
    nested = html.Profile(cards=("li:has(a) > div:has(span.tag) p", "ul li:has(h3)", "li"), rows="a, span", row_fields=("alt",), fields={
        "title": (("div:has(a) span", "a"), "inner"), "text": ((":self",), "spaced"), "alt": ((":self",), "any")}, skills=("li span", "own"))
    profiles = [*html.PROFILES.values(), nested]
    want = [[html.tree_cards(page, p) for p in profiles] for page in pages]
    monkeypatch.setattr(html, "parse_html", None)
    assert [[html.page_cards(page, p) for p in profiles] for page in pages] == want
    assert sum(len(cards) for per_page in want for cards in per_page) > 300


def test_landed_events_are_compressed_in_bounded_files(spark, tmp_path, monkeypatch):
    from postloom.sources import events

    monkeypatch.setattr(events, "EVENTS_PER_FILE", 40)
    rows = spark.range(100).selectExpr("CAST(id AS STRING) AS event_id", "repeat('a ', 50) AS company").coalesce(1)
    events.write_events(rows, f"{tmp_path}/land")
    assert len(list((tmp_path / "land").glob("*.json.gz"))) == 3
    assert events.read_posting_events(spark, f"{tmp_path}/land").select("event_id").distinct().count() == 100


def test_only_texts_that_may_be_lists_are_read_as_json(spark):
    page = ('<script type="application/ld+json">{broken</script>'
            '<script type="application/ld+json">{"@type":"\\u0049temList","itemListElement":[{"position":1,"name":"escaped"}]}</script>'
            '<script type="application/ld+json">{"@type":"ItemList","itemListElement":[{"position":2,"name":"plain"}]}</script>')
    titles = feeds.jsonld_titles(F.col("page"))
    assert [tuple(t) for t in spark.createDataFrame([(page,)], "page string").select(titles).first()[0]] == [(1, "escaped"), (2, "plain")]
