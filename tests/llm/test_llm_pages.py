"""WARC archives, URL verdicts and token rollups."""

import gzip
import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from postloom.llm import tokencounts, urlgraph, warc
from postloom.llm.catalog import QUERIES
from llm_helpers import SF, odd_rows

KIND = "page_id long, url string, html string, host string, payload string, digest string, keeper long, bad boolean, n int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "h", "p", "d", 1, True, 1) for i, u, h in rows], KIND)


def archived(spark, rows, path):
    warc.register(spark)
    warc.record_decisions(pages(spark, rows)).write.format("warc").mode("overwrite").save(path)
    return spark.read.format("warc").option("verify", "true").load(path)


def test_archive_of_odd_pages(spark, tmp_path):
    long, longer = "x" * 999 + "é", "y" * 1000
    rows = [(1, "http://a/", long), (2, "http://b/\r\nX: y", long), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"),
            (7, "é", longer), (7, "é", longer), (8, "q", longer), (None, "q", longer), (None, None, "alone" * 300), (9, "z", "日本\r\n\r\n" * 50_000)]
    got = archived(spark, rows, str(tmp_path / "a"))
    seen = got.collect()
    assert len(seen) == len(rows)
    full = {("urn:page:" + str(i if i is not None else ""), (h or "").encode()) for i, _, h in rows}
    for r in seen:
        if r["record_type"] == "response":
            assert (r["record_id"], bytes(r["payload"])) in full and r["refers_to"] is None
            assert hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"] and len(r["payload"]) == r["payload_length"]
        else:
            assert r["payload"] is None and r["payload_digest"] and r["payload_length"] >= 1000
    assert Counter((r["record_id"][9:], r["refers_to"]) for r in seen if r["record_type"] == "revisit") == Counter(
        [("1", "urn:page:2"), ("7", "urn:page:8"), ("7", "urn:page:8"), ("", "urn:page:8")])
    assert {r["target_uri"] for r in seen} == {"http://a/", "http://b/%0D%0AX: y", None, "u", "é", "q", "z"}
    assert archived(spark, [], str(tmp_path / "none")).collect() == []


def test_filters_reach_the_reader(spark, tmp_path):
    rows = [(i, f"http://h{i % 3}/{i}", "payload " * 400 if i % 2 else f"page {i}") for i in range(60)]
    got = archived(spark, rows, str(tmp_path / "b"))
    few = got.filter((F.col("record_type") == "response") & F.col("target_uri").startswith("http://h1/"))
    assert few._jdf.queryExecution().executedPlan().toString().count("Filter") <= 1
    want = {f"urn:page:{i}" for i in range(60) if i % 3 == 1 and (i % 2 == 0 or i == 59)}
    assert {r["record_id"] for r in few.collect()} == want
    slim = spark.read.format("warc").schema("record_id string, record_type string").load(str(tmp_path / "b"))
    assert slim.filter(F.col("record_type").isin("revisit")).count() == 29


def test_payload_is_not_inflated_when_unwanted(tmp_path):
    body = b"z" * 500_000
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <r%d>\r\nContent-Length: %d\r\n\r\n"
    data = b"".join(warc._gzip_member(head % (i, len(body)) + body + b"\r\n\r\n") for i in range(3))
    (tmp_path / "x.warc.gz").write_bytes(data)
    from pyspark.sql.types import StructType
    reader = warc.WarcReader(str(tmp_path), StructType().add("record_id", "string"), False)
    inflated = []
    more = warc._Member.more
    warc._Member.more = lambda self, want: (more(self, want), inflated.append(len(self.data)))[0]
    try:
        found = [x for p in reader.partitions() for b in reader.read(p) for x in b.column(0).to_pylist()]
    finally:
        warc._Member.more = more
    assert found == ["r0", "r1", "r2"] and max(inflated) <= 4 * warc.HEAD


def test_foreign_archives_and_damage(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"
    parts = [record % (i, n, b"p" * n) for i, n in enumerate((0, 5, 9_000_000, 70_000))]
    (tmp_path / "plain.warc").write_bytes(b"".join(parts))
    (tmp_path / "packed.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    warc.register(spark)
    got = spark.read.format("warc").load(str(tmp_path)).collect()
    assert Counter((r["record_id"], len(r["payload"])) for r in got) == Counter({(f"urn:x:{i}", n): 2 for i, n in enumerate((0, 5, 9_000_000, 70_000))})
    one = tmp_path / "one.warc.gz"
    bad = warc._record({"record_type": "response", "record_id": "r", "target_uri": None, "payload_digest": "0" * 40, "refers_to": None,
                        "payload_length": 3, "payload": b"abc"})
    one.write_bytes(warc._gzip_member(bad))
    assert spark.read.format("warc").load(str(one)).count() == 1
    with pytest.raises(PythonException, match="differs from its headers"):
        spark.read.format("warc").option("verify", "true").load(str(one)).collect()


def test_archive_of_the_table(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    largest = defaultdict(list)
    for r in rows:
        largest[(r["html"] or "").encode()].append(r["page_id"])
    want = set()
    for r in rows:
        data = (r["html"] or "").encode()
        keeper = max(largest[data]) if len(data) >= 1000 else r["page_id"]
        same = keeper == r["page_id"]
        want.add((r["page_id"], len(data), hashlib.sha1(data).hexdigest(), "response" if same else "revisit", None if same else keeper))
    assert {tuple(r) for r in QUERIES["op10_warc"](spark, SF).collect()} == want


def brute_verdicts(rows):
    def split(url):
        found = re.search(r"://([^/?#]*)([^?#]*)", url or "")
        return (re.sub("[A-Z]", lambda m: m[0].lower(), found[1]), found[2]) if found else ("", "")

    edges, hosts, said = Counter(), set(), []
    for _, url, html in rows:
        host, path = split(url)
        hosts.add(host)
        fits = [(len(r), r, v) for v, r in urlgraph.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0]))
                and path.startswith(r[r.index("/"):])]
        said.append((host, path, *(max(fits)[1:] if fits else (None, None))))
        for target in re.findall(urlgraph.LINK, html or ""):
            if host and target.lower() != host:
                edges[host, target.lower()] += 1
                hosts.add(target.lower())
    for h in hosts:
        up = re.match(r"^[^.]+\.([^.]+\..+)$", h)
        if up:
            edges[h, up[1]] += urlgraph.PARENT_WEIGHT
            edges[up[1], h] += urlgraph.PARENT_WEIGHT
    score = {}
    for kind, verdict, moves in (("t", "allow", edges), ("d", "block", Counter({(b, a): w for (a, b), w in edges.items()}))):
        seeds = Counter(h for h, _, _, v in said if v == verdict)
        seeds = {h: n / sum(seeds.values()) for h, n in seeds.items()}
        out = Counter()
        for (a, _), w in moves.items():
            out[a] += w
        rank = {h: 0.15 * m for h, m in seeds.items()}
        for _ in range(400):  # to convergence
            nxt = {h: (1 - urlgraph.DAMPING) * m for h, m in seeds.items()}
            for (a, b), w in moves.items():
                if a in rank:
                    nxt[b] = nxt.get(b, 0) + urlgraph.DAMPING * rank[a] * w / out[a]
            rank = nxt
        score[kind] = rank
    both = {h: (score["d"].get(h, 0), score["t"].get(h, 0)) for h in hosts}
    bad = {h for h, (d, t) in both.items() if d - t > urlgraph.MARGIN * (d + t)}
    return Counter((i, h, p, r, v or ("block" if h in bad else "allow")) for (i, *_), (h, p, r, v) in zip(rows, said, strict=True))


def test_verdicts_of_odd_pages(spark):
    link = '<a href="http://{0}/x">a</a> <img SRC = //{0}?q> <a href=/own>b</a>'
    rows = [(1, None, None), (2, "no scheme", ""), (3, "http://A.Example.ORG/es/1", None), (4, "http://example.org/en/12", link.format("net.net")),
            (5, "http://x.com/fr/", link.format("good.net")), (6, "http://y.com/de/", link.format("good.net")), (7, "http://bad.net/", link.format("y.com") * 3),
            (8, "http://good.net/", None), (8, "http://good.net/", None), (9, "http://org", None), (10, "http://org/?a://b/", None),
            (None, "ftp://x.com?/fr/", link.format("x.com")), (11, "http://évil.com/de/é", link.format("évil.com")), (12, "://", None)]
    assert Counter(map(tuple, urlgraph.judge(pages(spark, rows)).collect())) == brute_verdicts(rows)
    verdict = {r["page_id"]: r["verdict"] for r in urlgraph.judge(pages(spark, rows)).collect()}
    assert verdict[7] == "block" and verdict[8] == "allow"
    assert urlgraph.judge(pages(spark, [])).collect() == []


def test_verdicts_do_not_depend_on_other_pages(spark):
    near = '<a href="http://y.com/">'
    rows = [(1, "http://y.com/de/", None), (2, "http://quiet.net/", near), (3, "http://loud.net/", near * 20_000), (4, "http://alone.net/", None)]
    more = [(i, f"http://z.com/de/{i}", None) for i in range(10, 20_010)]
    want = {1: "block", 2: "block", 3: "block", 4: "allow"}
    for beside in ([], more):
        got = urlgraph.judge(pages(spark, rows + beside)).filter("page_id < 10").collect()
        assert {r["page_id"]: r["verdict"] for r in got} == want


def test_verdicts_far_from_the_seeds(spark):
    def link(host):
        return f'<a href="http://{host}/">'

    far = [(i, f"http://h{i}.net/", link(f"h{i - 1}.net" if i > 1 else "y.com")) for i in range(1, 31)]
    good = [(100 + i, f"http://g{i}.net/" if i else "http://good.com/fr/", link(f"g{i + 1}.net" if i < 20 else "mixed.net")) for i in range(21)]
    rows = [(0, "http://y.com/de/", None), (200, "http://mixed.net/", link("y.com")), (201, "http://loud.net/", link("y.com") * 3000), *far, *good]
    verdict = {r["page_id"]: r["verdict"] for r in urlgraph.judge(pages(spark, rows)).collect()}
    assert all(verdict[i] == "block" for i in range(31)) and verdict[201] == "block"
    assert all(verdict[100 + i] == "allow" for i in range(21)) and verdict[200] == "allow"


def test_verdicts_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert Counter(map(tuple, QUERIES["op8_url_filters"](spark, SF).collect())) == brute_verdicts(rows)


def test_rollup_of_the_table(spark):
    encode = tokencounts._encoding(open(tokencounts.RANKS, "rb").read()).encode_ordinary
    rows = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    want, seen = defaultdict(lambda: [0, 0]), set()
    for r in rows:
        if r["text"] not in seen:
            seen.add(r["text"])
            total = want[r["source"], r["lang"]]
            total[0] += 1
            total[1] += len(encode(r["text"]))
    got = QUERIES["op7_token_counts"](spark, SF).collect()
    assert {(r["source"], r["lang"]): [r["docs"], r["tokens"]] for r in got} == dict(want)


def test_rollup_counts_repeated_rows_once(spark, tmp_path):
    rows = [(1, "same text", "a"), (1, "same text", "a"), (None, "no id", "b"), (None, "no id", "b"), (2, "no id either", "c"), (3, "no id either", "d")]
    spark.createDataFrame([(i, t, "en", s) for i, t, s in rows], "doc_id long, text string, lang string, source string").write.parquet(
        str(tmp_path / "documents.parquet"))
    got = QUERIES["op7_token_counts"](spark, str(tmp_path)).collect()
    assert {r["source"]: r["docs"] for r in got} == {"a": 1, "b": 1, "c": 1}


def test_rollup_batches(spark, odd, nothing, tmp_path):
    docs = tokencounts.counted(odd)
    assert {(r["doc_id"], r["n_tokens"] > 0) for r in docs.collect()} == {(i, bool(t)) for i, t, *_ in odd_rows()}
    path = str(tmp_path / "r")
    assert tokencounts.totals(spark, path).collect() == []
    ins = docs.selectExpr("'insert' op", "source", "lang", "tokenizer", "n_tokens", "cast(null as long) old_tokens")
    assert tokencounts.apply_batch(ins, path, "1") and not tokencounts.apply_batch(ins, path, "1")
    once = {(r["source"], r["lang"]): (r["docs"], r["tokens"]) for r in tokencounts.totals(spark, path).collect()}
    assert sum(d for d, _ in once.values()) == len(odd_rows())
    assert tokencounts.apply_batch(ins.limit(0), path, "2")
    ins.groupBy("source", "lang", "tokenizer").agg(F.lit(9).cast("long").alias("docs"), F.lit(9).cast("long").alias("tokens")).write.parquet(
        f"{path}/deltas/batch=broken")
    assert {(r["source"], r["lang"]): (r["docs"], r["tokens"]) for r in tokencounts.totals(spark, path).collect()} == once
    revise = docs.selectExpr("'revise' op", "source", "lang", "tokenizer", "n_tokens + 1 n_tokens", "n_tokens old_tokens")
    tokencounts.apply_batch(revise, path, "3")
    assert sum(r["tokens"] for r in tokencounts.totals(spark, path).collect()) == sum(t for _, t in once.values()) + len(odd_rows())
    tokencounts.compacted(spark, path, str(tmp_path / "c"))
    assert sorted(map(str, tokencounts.totals(spark, str(tmp_path / "c")).collect())) == sorted(map(str, tokencounts.totals(spark, path).collect()))
    delete = docs.selectExpr("'delete' op", "source", "lang", "tokenizer", "n_tokens + 1 n_tokens", "cast(null as long) old_tokens")
    tokencounts.apply_batch(delete, path, "4")
    assert tokencounts.totals(spark, path).collect() == []
    assert tokencounts.counted(nothing).collect() == []


def test_copies_of_a_family_are_deleted_by_count(spark):
    """Of 5,000 copies over groups the first stays; what meets it is one row per group."""
    kind = "doc_id long, text_hash long, source string, lang string, tokenizer string, n_tokens long, row long"
    rows = [(None if i % 5 == 0 else 9_000 - i, 1, f"s{i % 3}", None, "v", 7, i) for i in range(5_000)] + [(3, 2, None, "en", "v", 4, 6_000)]
    changes = tokencounts.further_copies(spark.createDataFrame(rows, kind)).collect()
    gone = Counter()
    for r in changes:
        gone[r["source"], r["lang"]] += r["times"]
    least = min((r for r in rows if r[1] == 1), key=lambda r: (r[0] is None, r[0] or 0, r[6]))
    want = Counter((r[2], r[3]) for r in rows if r[1] == 1)
    want[least[2], least[3]] -= 1
    assert {k: v for k, v in gone.items() if v} == want and len(changes) == 6
