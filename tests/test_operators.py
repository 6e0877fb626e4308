from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from postloom import lexicon, schemas
from postloom.operators import contacts, digest, filters, matching, outreach, search, summary, tables

T0 = datetime(2024, 6, 1)


def as_of():
    return F.lit("2024-06-15 12:00:00").cast("timestamp")


def jobs(spark, rows):
    full = [
        {"id": f"j{i}", "company": "Zepto", "role": "Backend Engineer", "source": "remotive", "url": None,
         "stack": ["Go", "Postgres"], "product": "Quick commerce", "location": "Bengaluru", "posted_at": T0,
         "status": "new", "created_at": T0, **r} for i, r in enumerate(rows)
    ]
    return spark.createDataFrame([tuple(r[c] for c in schemas.JOB_COLUMNS) for r in full], schemas.JOB)


def ids(df):
    return [r["id"] for r in df.collect()]


def test_listing(spark):
    df = jobs(spark, [{"posted_at": None}, {"posted_at": T0 + timedelta(1)}, {}, {"stack": None}, {"stack": ["Rust", "gRPC"]},
                      {"role": "Site Reliability Engineer", "status": "applied"}])
    assert ids(tables.list_jobs(df)) == ["j1", "j2", "j3", "j4", "j5", "j0"]
    assert ids(tables.list_jobs(df, sort="oldest"))[-2:] == ["j1", "j0"]
    assert ids(tables.list_jobs(df, stack="Rust, gRPC")) == ["j4"] and ids(tables.list_jobs(df, stack=["rust"])) == []
    assert ids(tables.list_jobs(df, role="site reliability")) == ["j5"] and ids(tables.list_jobs(df, limit=2, offset=1)) == ["j2", "j3"]
    info = tables.page_info(tables.count_jobs(df, status="new"), 2, 2).first()
    assert (info["total"], info["has_more"]) == (5, True)
    for wrong in ({"status": "pending"}, {"sort": "newest"}, {"limit": 501}, {"limit": 0}, {"offset": -1}):
        with pytest.raises(ValueError):
            tables.list_jobs(df, **wrong)


def test_status_stats_board(spark):
    df = jobs(spark, [{}, {"source": None}, {"source": "unknown", "created_at": T0 - timedelta(90)}])
    changes = spark.createDataFrame([("j0", "applied", 1), ("j0", "new", 2), ("j1", "ignored", 1), ("j1", "odd", 2), ("zz", "new", 1)],
                                    "id string, status string, seq int")
    after = tables.set_status(df, changes)
    assert {r["id"]: r["status"] for r in after.collect()} == {"j0": "new", "j1": "ignored", "j2": "new"}
    assert {r["source"]: r["jobs"] for r in tables.stats_by(df, "source", as_of()).collect()} == {"remotive": 1, "unknown": 1}
    assert {r["source"]: r["jobs"] for r in tables.stats_by(df, "source", as_of(), None).collect()} == {"remotive": 1, "unknown": 2}
    one = tables.stats_map(df, as_of(), None).first()
    assert one["by_status"] == {"new": 3}
    counts = {r["board"]: r["cards"] for r in tables.board_counts(after).collect()}
    assert counts == {"discovered": 2, "rejected": 1, "contacted": 0, "applied": 0, "interviewing": 0, "offer": 0}


def test_export(spark, tmp_path):
    df = jobs(spark, [{"posted_at": None, "stack": None}, {"role": "Frontend", "stack": ["React", "TypeScript"]}])
    path = str(tmp_path / "csv")
    tables.export_csv(tables.export_rows(df), path)
    read = spark.read.option("header", True).csv(path)
    assert tuple(read.columns) == schemas.EXPORT_COLUMNS
    assert {r["id"]: (r["stack"], r["posted_at"]) for r in read.collect()} == {
        "j0": (None, None), "j1": ("React,TypeScript", "2024-06-01T00:00:00+00:00")}
    empty = str(tmp_path / "none")
    tables.export_csv(tables.export_rows(df, role="nobody"), empty)
    assert tuple(spark.read.option("header", True).csv(empty).columns) == schemas.EXPORT_COLUMNS


def contact_rows(spark, rows):
    full = [{"id": f"c{i}", "job_id": None, "company": "Acme", "domain": "acme.com", "name": None, "email": None, "role": None,
             "source": "github", "verified": "unverified", "created_at": T0 + timedelta(minutes=i), **r} for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[c] for c in schemas.CONTACT.fieldNames()) for r in full], schemas.CONTACT)


def test_upsert_and_delete(spark):
    old = contact_rows(spark, [{"email": "a@x.com", "name": "Ann", "role": "Dev"}, {"name": "No mail"}])
    new = contact_rows(spark, [{"id": "n0", "email": "a@x.com", "verified": "verified", "source": "linkedin"},
                               {"id": "n1", "email": "a@x.com", "role": "Lead", "verified": "invalid"},
                               {"id": "n2", "email": "b@x.com"}, {"id": "n3"}]).withColumn("seq", F.substring("id", 2, 1).cast("int"))
    got = {r["id"]: r for r in tables.upsert_contacts(old, new).collect()}
    assert set(got) == {"c0", "c1", "n2", "n3"}
    assert (got["c0"]["name"], got["c0"]["role"], got["c0"]["verified"], got["c0"]["source"]) == ("Ann", "Lead", "invalid", "github")
    emails = spark.createDataFrame([("e1", "c0"), ("e2", "c1"), ("e3", None)], "id string, contact_id string")
    gone = old.where("id = 'c0'")
    assert {r["id"]: r["contact_id"] for r in tables.null_references(emails, "contact_id", gone).collect()} == {"e1": None, "e2": "c1", "e3": None}
    assert ids(tables.delete_rows(old, gone)) == ["c1"]


def test_draft_candidates(spark):
    df = jobs(spark, [{"company": "acme"}, {"company": "Ac_e L"}, {"company": "Nobody"}, {"company": "Bad"}, {"company": ""}])
    people = contact_rows(spark, [
        {"company": "ACME Labs", "verified": "verified"}, {"company": "Acme"}, {"company": "Acme", "verified": "invalid"},
        {"company": "Bad Inc", "verified": "invalid"},
    ])
    got = {r["id"]: (r["contact_id"], r["contacts_seen"]) for r in matching.draft_candidates(df, people).collect()}
    assert got == {"j0": ("c0", 3), "j1": ("c0", 1), "j3": (None, 1), "j4": ("c0", 4)}
    few = {r["id"]: r["contact_id"] for r in matching.draft_candidates(df, people, newest=2).collect()}
    assert few == {"j0": "c1", "j1": "c0", "j3": None, "j4": None}
    own = people.withColumn("job_id", F.when(F.col("id") == "c1", "j0"))
    applied = {r["id"]: (r["contact_id"], r["discovery_status"], r["draft_subject"]) for r in matching.apply_candidates(df, own).collect()}
    assert applied["j0"] == ("c1", "complete", None) and applied["j2"] == (None, "pending", "Discovery Pending")


def test_contact_discovery(spark, column):
    shapes = {"ana.fam@d.com": "{first}.{last}@d.com", "afam@d.com": "{fi}{last}@d.com", "Ana@d.com": "{first}@d.com",
              "abc@d.com": "{first}@d.com", "x9@d.com": None, "a.b@d.com": "{first}.{last}@d.com"}
    assert column(contacts.infer_email_pattern("v", F.lit("d.com")), list(shapes)) == list(shapes.values())
    names = ["Alice Smith", "alice", "", None, " Ana Maria  Fam "]
    assert column(contacts.build_email("v", F.lit("{first}.{last}@x.com")), names) == [
        "alice.smith@x.com", "alice.@x.com", None, None, "ana.fam@x.com"]
    assert column(contacts.build_email("v", F.lit("{fi}{last}{li}@x")), names[:1]) == [None]
    assert column(contacts.role_from_bio("v"), ["SRE", "Talent", "three", "artist", None]) == [
        "Engineer", "Recruiter", "Recruiter", "Unknown", "Unknown"]
    votes = spark.createDataFrame([("d.com", "ana.fam@d.com", 2), ("d.com", "bfam@d.com", 1), ("d.com", "noreply@d.com", 0),
                                   ("d.com", "x.y@e.com", 3)], "domain string, email string, seq int")
    domains = spark.createDataFrame([("d.com",), ("none.io",)], "domain string")
    assert {r["domain"]: r["pattern"] for r in contacts.vote_pattern(domains, votes).collect()} == {
        "d.com": "{fi}{last}@d.com", "none.io": "{first}.{last}@none.io"}
    companies = spark.createDataFrame([("Big Co!", None), ("Told", "told.dev"), ("Gone", None)], "company string, suggestion string")
    probes = spark.createDataFrame([("bigco.com", 404), ("bigco.co.in", 301), ("bigco.in", 200)], "candidate string, status_code int")
    assert {r["company"]: r["domain"] for r in contacts.resolve_domain(companies, probes).collect()} == {
        "Big Co!": "bigco.co.in", "Told": "told.dev", "Gone": None}
    mx = spark.createDataFrame([("d.com", 20, "b.d.com."), ("d.com", 10, "a.d.com.")], "domain string, preference int, exchange string")
    assert {r["mx_host"] for r in contacts.pick_mx(domains, mx).collect()} == {"a.d.com", "mail.none.io"}


def test_search(spark):
    rows = [(1, "Backend Engineer - Open Roles", "https://careers.example.com/jobs/backend?utm_source=google", "We are hiring. Apply for this backend engineer position."),
            (2, "Backend Engineer - Open Roles", "https://careers.example.com/jobs/backend", "again"),
            (3, "Backend engineer interview questions", "https://blog.example.com/b", "A tutorial and salary guide for candidates."),
            (4, "jobs apply", "https://m.youtube.com/x", ""), (5, "a", "", ""), (6, "hello", "https://x.org/", None)]
    df = spark.createDataFrame([(*r, "q") for r in rows], "seq int, title string, url string, snippet string, query string")
    got = {r["seq"]: r["reason"] for r in search.score_results(df).collect()}
    assert got == {1: "accepted", 2: "duplicate_url", 3: "noisy_term", 4: "blocked_domain", 5: "missing_url", 6: "low_signal"}
    profile = [(1, "backend engineer", ["Go", "Kubernetes"], "Bangalore", 2026, None, ["notion", "company_careers"], None),
               (2, "dev", None, None, None, None, None, 2)]
    queries = search.search_queries(spark.createDataFrame(
        profile, "profile_id int, role string, stack array<string>, location string, year int, after date, platforms array<string>, max_queries int"))
    one = [r["query"] for r in queries.where("profile_id = 1").orderBy("position").collect()]
    assert len(one) == 2 and 'site:notion.so "backend engineer" "Go" "Kubernetes" "Bangalore" 2026' in one[0] and "inurl:careers" in one[1]
    assert queries.where("profile_id = 2").count() == 2


STRONG = "\nJane Doe\nSenior Software Engineer\n5 years of experience\n\nSkills: Python, FastAPI, Docker, PostgreSQL, React, AWS\n"


def test_profiles(spark):
    texts = [(1, STRONG), (2, "John\nDeveloper\nI have worked with javascript and nodejs for 2 years."), (3, ""), (4, "Software Engineer, Python"), (5, None)]
    got = {r["i"]: r for r in outreach.candidate_profile(spark.createDataFrame(texts, "i int, text string")).collect()}
    assert {"python", "fastapi", "docker", "postgresql"} <= set(got[1]["skills"]) and got[1]["years_experience"] == 5
    assert got[1]["recent_role"] == "senior software" or "engineer" in got[1]["recent_role"]
    assert got[2]["years_experience"] == 2 and "nodejs" in got[2]["skills"]
    assert got[3]["is_empty"] and got[3]["snippet"] == "" and got[5]["is_empty"] and got[4]["years_experience"] is None
    assert got[1]["snippet"].startswith("Role: Software Engineer | Experience: 5+ years | Skills: python")


def test_drafts(spark):
    base = ("j", None, "Ledgerly", "Backend Engineer", "digital payments", ["Go"], "Sam Okafor", ["Go", "Kubernetes"],
            "https://git.example.org/sam", None, 2025, None, None)
    schema = ("job_id string, contact_id string, company string, role string, product string, stack array<string>, your_name string, "
              "your_stack array<string>, github_url string, contact_name string, graduation_year int, availability string, referred_by string")
    df = spark.createDataFrame([base], schema)
    for template in schemas.EMAIL_TEMPLATES:
        row = outreach.draft_emails(df, as_of(), template).first()
        text = row["subject"] + row["body"]
        assert "{" not in text and "Hi there," in row["body"] and "Ledgerly" in text and "None" not in text
        assert not row["subject"].startswith("Subject") and not row["body"].startswith("\n") and len(row["body"].split()) < 160
        picked = any(o in row["body"] for o in lexicon.OBSERVATIONS["fintech"])
        assert picked == (template != "followup")
    assert "A mutual connection" in outreach.draft_emails(df, as_of(), "referral_outreach").first()["body"]
    with pytest.raises(ValueError):
        outreach.draft_emails(df, as_of(), "letter")
    texts = {"Subject: X\n\nPara 1\n\nPara 2": ("X", "Para 1\n\nPara 2"), "Hello\nskipped\nrest": ("", "Hello\nrest"), "": ("", "")}
    subject, body = outreach.split_rendered("t")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", subject.alias("s"), body.alias("b")).collect()
    assert {r["t"]: (r["s"], r["b"]) for r in rows} == texts


def test_digest(spark):
    df = jobs(spark, [{"source": None}, {"url": "u"}, {"posted_at": T0 - timedelta(days=30)}, {"source": "", "location": None, "stack": []}])
    fresh = digest.digest_select(df, F.lit("2024-06-05").cast("timestamp"))
    assert set(ids(fresh)) == {"j0", "j1", "j3"}
    groups = {r["id"]: (r["source"], r["group_position"], r["group_size"], r["index_in_group"]) for r in digest.digest_groups(fresh).collect()}
    assert groups == {"j0": ("unknown", 1, 2, 1), "j1": ("remotive", 2, 1, 1), "j3": ("unknown", 1, 2, 2)}
    people = spark.createDataFrame([("a", "Ada"), ("b", "Bo")], "recipient string, your_name string")
    out = digest.render_digest(fresh.withColumn("recipient", F.lit("a")), people, F.lit("W"), as_of(), ("id",))
    got = {r["recipient"]: r for r in out.collect()}
    assert got["a"]["subject"] == "Your weekly job digest — 3 new roles (W)" and "── UNKNOWN (2 roles) ──" in got["a"]["body"]
    assert "  1. Zepto — Backend Engineer\n📍 Bengaluru  🛠  Go, Postgres\n\n  2. Zepto" in got["a"]["body"]
    assert "🔗 u\n" in got["a"]["body"] and "Roles shown: 3  |  Sources: 2" in got["a"]["body"]
    assert got["b"]["job_count"] == 0 and lexicon.DIGEST_EMPTY in got["b"]["body"]


def test_followups_and_summary(spark):
    rows = [("1", "sent", "2024-06-01T00:00:00Z", None), ("2", "sent", "2024-06-14", None), ("3", "sent", "soon", None),
            ("4", "sent", "2024-06-01", "pending_followup"), ("5", "draft", "2024-06-01", None), ("6", "sent", None, None)]
    df = spark.createDataFrame(rows, "id string, status string, sent_text string, followup_status string")
    assert ids(digest.followups_due(df, as_of())) == ["1"]
    log = spark.createDataFrame([("r1", "scrape", True, None, 5, 3), ("r1", "scrape", True, None, 3, 9), ("r1", "discover", True, 4, None, None),
                                 ("r1", "draft", False, 1, None, None), ("r2", "digest", True, 7, None, None)],
                                "run_id string, task string, ok boolean, n int, jobs_before int, jobs_after int")
    got = {r["run_id"]: r for r in summary.run_summary(log).collect()}
    assert (got["r1"]["jobs_discovered"], got["r1"]["contacts_found"], got["r1"]["emails_drafted"], got["r1"]["errors"]) == (6, 4, 0, 1)
    assert summary.latest_summary(summary.run_summary(log)).first()["digest_sent"] == 7


def test_predicates(spark):
    df = spark.createDataFrame([(1, "Zepto", "Backend Engineer", ["Python"]), (2, "S", "Java Developer", ["Java", None]), (3, "T", "Go lead", None)],
                               "id int, company string, role string, stack array<string>")
    assert ids(filters.stack_filter(df, ["python", "go", "kubernetes"])) == [1, 3]
    assert ids(df.where(filters.stack_matches(["java"]))) == [2] and ids(df.where(filters.stack_matches(["java"], lenient=True))) == [2, 3]
    assert ids(df.where(filters.role_matches("go backend"))) == [1, 3] and df.where(filters.role_matches("")).count() == 3


def test_ranking(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.0, 0.0]), (4, [-1.0, 0.0]), (5, [2.0, 0.0]), (6, [0.45, 0.893])]
    df = spark.createDataFrame(rows, "id int, embedding array<float>")
    ranked = matching.rank_by_profile(df, df.where("id = 1"), ("id",)).collect()
    assert [(r["id"], r["match_score"], r["match_tier"]) for r in ranked] == [
        (1, 1.0, "strong"), (5, 1.0, "strong"), (2, 0.6, "strong"), (6, 0.45, "moderate"), (3, 0.0, "weak"), (4, -1.0, "weak")]


def test_fanned_out_results_are_judged_before_they_are_fanned_out(spark):
    """The texts of the seeds are not in the rows that are shuffled to find the first of a URL."""
    from postloom.operators import search

    seeds = spark.createDataFrame([
        (1, "Careers, apply", "https://a.example.com/x", "hiring open roles"), (2, "tutorial", "https://a.example.com/x", "s"),
        (3, "x", "", "s"), (4, None, "https://b.example.com/", None)], "seq int, title string, url string, snippet string")
    queries = spark.createDataFrame([("p", 0, "q"), ("p", 1, "r"), ("o", 0, "s")], "profile_id string, position int, query string")
    fanned = search.search_fanout(queries, seeds)
    plan = fanned.select("seq", "score", "reason")._jdf.queryExecution().optimizedPlan().toString()
    assert "snippet" not in plan[: plan.index("Generate posexplode")]
    plain = queries.crossJoin(seeds.withColumn("_n", F.col("seq") - 1)).select(
        "profile_id", (F.col("position") * 10 + F.col("_n")).cast("long").alias("seq"), "query", "title", "url", "snippet")
    columns = ["profile_id", "seq", "query", "title", "url", "snippet", "norm_url", "score", "reason", "accepted"]
    got, want = (sorted(map(str, df.select(columns).collect())) for df in (fanned, search.score_results(plain, scope=["profile_id"])))
    assert got == want and len(got) == 12
