"""Tables laid out by month, by part of the key and with postings, against the plain operators."""

import glob

import pytest
from pyspark.sql import functions as F

from postloom.operators import postings, tables
from postloom.operators.filters import job_predicate
from postloom.sources import monthly, parts, snapshots


@pytest.fixture(scope="module")
def jobs(spark):
    rows = []
    for i in range(300):
        date = None if i % 7 == 0 else f"20{10 + i % 5}-{1 + i % 12:02d}-{1 + i % 28:02d} 0{i % 3}:00:00"
        stack = [["blue", "red"], ["blue"], ["Blue", "red", "red"], [], None, ["red", None, "blue"]][i % 6]
        rows.append((f"j{i:03d}", f"dev {'bolt' if i % 4 else 'ring'}", stack, date, ["new", "applied"][i % 2]))
    rows.append(rows[5])  # a repeated row
    return spark.createDataFrame(rows, "id string, role string, stack array<string>, posted_at string, status string").withColumn(
        "posted_at", F.to_timestamp("posted_at"))


def test_pages_by_month(spark, jobs, tmp_path):
    path = str(tmp_path / "m")
    monthly.write(jobs, path)
    for ask in ({"limit": 5}, {"limit": 7, "offset": 90, "sort": "oldest"}, {"limit": 500, "offset": 250}, {"limit": 3, "status": "new", "stack": "blue", "role": "bolt"},
                {"limit": 5, "role": "nothing"}, {"limit": 20, "offset": 290, "sort": "oldest"}):
        assert monthly.list_jobs(spark, path, **ask).collect() == tables.list_jobs(jobs, **ask).collect(), ask
    plan = monthly.list_jobs(spark, path, limit=5)._jdf.queryExecution().executedPlan().toString()
    held = [n for n in monthly.months(spark, path) if n is not None]
    assert f"posted_month#" in plan and str(max(held)) in plan and str(min(held)) not in plan.partition("PartitionFilters")[2].partition("]")[0]
    with pytest.raises(ValueError):
        monthly.list_jobs(spark, path, limit=0)


def test_pages_of_no_rows_and_of_rows_without_a_date(spark, jobs, tmp_path):
    undated = jobs.withColumn("posted_at", F.lit(None).cast("timestamp"))
    monthly.write(undated, str(tmp_path / "u"))
    assert monthly.list_jobs(spark, str(tmp_path / "u"), limit=9).collect() == tables.list_jobs(undated, limit=9).collect()
    monthly.write(jobs.where("false"), str(tmp_path / "e"))
    assert monthly.list_jobs(spark, str(tmp_path / "e"), limit=9).collect() == []


def test_tags_are_looked_up(spark, jobs, tmp_path):
    path = str(tmp_path / "t")
    postings.write_tags(jobs, path, 8)
    for ask in (("bolt", "blue, red", "new"), (None, ["red"], None), (None, ["blue", "blue"], None), (None, "none, red", None), ("ring", None, "applied"), (None, "", None)):
        got, want = postings.jobs_with(jobs, path, *ask), jobs.where(job_predicate(*ask))
        assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in want.collect()), ask
    found, most = postings.holding_all(spark, path, ["red"])
    assert most == found.count() == jobs.where("array_contains(stack, 'red')").select("id").distinct().count()
    filters = found._jdf.queryExecution().executedPlan().toString().partition("PartitionFilters: [")[2]
    assert "bucket#" in filters[:30]
    postings.write_tags(jobs.where("false"), str(tmp_path / "none"))
    assert postings.jobs_with(jobs, str(tmp_path / "none"), stack="red").count() == 0


def test_company_names_by_their_pieces(spark, tmp_path):
    names = ["Acme", "ACME Corp", "a_me", "Ac", "", None, "Straße 9", "x%y acme", "Ελλάς ΟΔΟΣ", "acmé", "İstanbul", "aaaa", "a\\cme"]
    rows = [(f"c{i:02d}{j}", n, f"2024-01-{1 + i:02d} 00:00:0{j}") for i, n in enumerate(names) for j in range(3)]
    contacts = spark.createDataFrame(rows, "id string, company string, created_at string").withColumn("created_at", F.to_timestamp("created_at"))
    path = str(tmp_path / "c")
    postings.write_companies(contacts, path, 4)
    for asked in (None, "", "acme", "ME co", "a_me", "ac", "%", "acm%orp", "stra", "straßE", "ΟΔΟΣ", "λλάΣ", "istanbul", "İsta", "aaa", "x\\%y", "zzz", "acme%zzz", "_____"):
        got = postings.contacts_by_company(spark, path, asked, 50, 1).collect()
        assert got == tables.contacts_by_company(contacts, asked, 50, 1).select(*got[0].asDict() if got else "*").collect(), asked


def test_no_contacts(spark, tmp_path):
    none = spark.createDataFrame([], "id string, company string, created_at timestamp")
    postings.write_companies(none, str(tmp_path / "c"))
    assert all(postings.contacts_by_company(spark, str(tmp_path / "c"), a).collect() == [] for a in (None, "acme", "a"))


def test_literal_runs():
    assert postings.literals("ab%c_d\\%e") == ["ab", "c", "d%e"] and postings.literals("%_") == [] and postings.grams("abcd") == {"abc", "bcd"}


def _files(path):
    return {f for f in glob.glob(f"{path}/rows-*/_part=*/*.parquet")}


def test_a_change_rewrites_touched_parts_only(spark, jobs, tmp_path):
    path = str(tmp_path / "p")
    rows = jobs.dropDuplicates(["id"]).select("id", "status")
    assert parts.create(rows, path, ["id"], 16) == 0
    before = set(parts.read(spark, path).inputFiles())
    changes = spark.createDataFrame([("j001", "ignored", 1), ("j001", "applied", 2), ("j002", "odd", 3), ("nobody", "new", 1)], "id string, status string, seq int")
    version, touched = parts.change(spark, path, changes, lambda held: tables.set_status(held, changes))
    assert version == 1 and 1 <= touched <= 3
    want = sorted(map(tuple, tables.set_status(rows, changes).select("id", "status").collect()))
    assert sorted(map(tuple, parts.read(spark, path).collect())) == want
    assert sorted(map(tuple, parts.read(spark, path, 0).collect())) == sorted(map(tuple, rows.collect()))
    after = set(parts.read(spark, path).inputFiles())
    assert len({f.split("_part=")[1].split("/")[0] for f in before & after}) >= 16 - touched
    assert parts.change(spark, path, changes.where("false"), lambda held: held) == (1, 0)


def test_a_table_may_start_empty_and_become_empty(spark, tmp_path):
    path, none = str(tmp_path / "p"), spark.createDataFrame([], "id string, status string")
    parts.create(none, path, ["id"], 4)
    assert parts.read(spark, path).collect() == []
    new = spark.createDataFrame([("a", "new"), (None, "new")], "id string, status string")
    parts.change(spark, path, new, lambda held: held.unionByName(new))
    assert parts.read(spark, path).count() == 2
    parts.change(spark, path, new, lambda held: held.where("false"))
    assert parts.read(spark, path).schema == none.schema and parts.read(spark, path).count() == 0
    with pytest.raises(FileExistsError):
        parts.create(new, path, ["id"])


def test_a_rewrite_may_not_leave_its_parts(spark, tmp_path):
    path = str(tmp_path / "p")
    parts.create(spark.range(100), path, ["id"], 16)
    with pytest.raises(Exception, match="does not touch"):
        parts.change(spark, path, spark.range(1), lambda held: held.select((F.col("id") + 1000).alias("id")).union(spark.range(50)))


def test_a_change_is_made_again_after_another_writer(spark, tmp_path):
    path, one = str(tmp_path / "p"), spark.createDataFrame([(1, 0)], "id long, n int")
    parts.create(one, path, ["id"], 4)
    calls = []

    def add(held):
        calls.append(1)
        if len(calls) == 1:
            parts.change(spark, path, one, lambda inner: inner.withColumn("n", F.col("n") + 10))
        return held.withColumn("n", F.col("n") + 1)

    assert parts.change(spark, path, one, add) == (2, 1)
    assert parts.read(spark, path).first()["n"] == 11 and snapshots.newest(spark, path) == 2
