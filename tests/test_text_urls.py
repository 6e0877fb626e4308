from urllib.parse import parse_qsl, quote_plus, urlencode, urljoin

from pyspark.sql import functions as F

from postloom import lexicon
from postloom.functions import text, urls


def test_strip_words_title(spark, column):
    odd = ["\t a \n", "　x  y ", "", None]
    assert column(text.strip("v"), odd) == [v.strip() if v is not None else None for v in odd]
    assert column(F.array_join(text.words("v"), "|"), ["  a\t b\n\nc ", "", " "]) == ["a|b|c", "", ""]
    names = ["acme-io o.reilly", "they're 3rd ÉTÉ", "x", ""]
    assert column(text.title_case("v"), names) == [n.title() for n in names]
    assert column(text.slug("v"), ["Backend  Engineer (Go)!", "--a--"]) == ["backend-engineer-go", "a"]


def test_normalize_url(spark, column):
    cases = {
        "https://careers.example.com/jobs/backend?utm_source=google": "https://careers.example.com/jobs/backend",
        " HTTP://WWW.X.com:8080// ": "http://www.x.com:8080/",
        "https://x.com?ref=1&a=1&b=&c": "https://x.com/?a=1&b=&c=",
        "https://x.com/p/?q=a%20b~*&UTM_x=1&utm_y=2#top": "https://x.com/p?q=a+b~%2A&UTM_x=1",
        "https://x.com/p?x=%zz&y=%C3%A9+1": "https://x.com/p?x=%25zz&y=%C3%A9+1",
        "ftp://x.com/": "", "x.com/a": "", "https:///a": "", "": "", None: "",
    }
    assert column(urls.normalize_url("v"), list(cases)) == list(cases.values())


def test_query_against_python(spark, column):
    queries = ["a=1&b=2", "a=b=c&d", "x=%E2%82%AC&y=%2B", "k=v%26w&&z=~!*()'", "q=%41+%2e"]
    expected = []
    for q in queries:
        kept = urlencode(parse_qsl(q, keep_blank_values=True))
        expected.append(f"https://h.org/p?{kept}")
    assert column(urls.normalize_url(F.concat(F.lit("https://h.org/p?"), "v")), queries) == expected
    assert quote_plus("~*") == "~%2A"


def test_ats(spark, column):
    cases = {
        "https://jobs.lever.co/stripe/abc123": ("lever", "stripe"),
        "https://jobs.lever.co/razorpay": ("lever", "razorpay"),
        "https://boards.greenhouse.io/notion/jobs/123": ("greenhouse", "notion"),
        "https://grnh.se/abc123": ("greenhouse", "abc123"),
        "https://jobs.ashbyhq.com/linear": ("ashby", "linear"),
        "https://myworkdayjobs.com/atlassian/job/1": ("workday", None),
        "https://careers.stripe.com/jobs/123": ("generic", None),
        "https://jobs.lever.co": ("lever", ""),
    }
    assert column(urls.detect_ats("v"), list(cases)) == [a for a, _ in cases.values()]
    assert column(urls.company_slug("v", urls.detect_ats("v")), list(cases)) == [s for _, s in cases.values()]


def test_company_from_url(spark, column):
    cases = {"https://www.big-co.com/x": "Big Co", "https://careers.acme.io/": "Acme", "https://jobs.acme.co.in": "Acme",
             "https://blog.acme.io": "Acme", "https://localhost/": "localhost", "nothing": "Unknown Company"}
    assert column(urls.company_from_url("v"), list(cases)) == list(cases.values())


def test_resolve_url(spark, column):
    base = "https://x.com/a/b/page?q=1#f"
    refs = ["/j", "j/1", "../j", "./k", "//y.org/z", "https://z.net/q", "?p=2", "#g", "", "../../../up"]
    got = column(urls.resolve_url(F.lit(base), "v"), refs)
    want = [urljoin(base, r) for r in refs]
    want[8] = base
    assert got == want


def test_location_hint(spark, column):
    assert column(urls.location_hint("v"), ["Engineer, New York / Remote", "in BENGALURU", "Paris", None]) == [
        "Remote", "Bengaluru", "", "",
    ]
    assert "remote" == lexicon.LOCATION_WORDS[0]
