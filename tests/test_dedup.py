import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from postloom.operators import dedup, filters
from postloom.streaming import admission, ingest, windows
from postloom.sources.events import read_posting_events, stream_posting_events, tail_events
from postloom import schemas

START = datetime(2024, 1, 1)
ROWS = "k string, at timestamp, event_id string"


def brute(rows, ttl, limit=1):
    """The rule row by row."""
    windows, kept = {}, set()
    for key, at, eid in sorted(rows, key=lambda r: (r[1], r[2])):
        start, n = windows.get(key, (None, 0))
        if start is None or at >= start + ttl:
            start, n = at, 0
        if n < limit:
            kept.add(eid)
            n += 1
        windows[key] = (start, n)
    return kept


def sample(seed, n, keys, hours, step=60):
    rnd = random.Random(seed)
    return [
        (rnd.choice(keys), START + timedelta(minutes=step * rnd.randrange(hours * 60 // step)), f"e{i:05d}")
        for i in range(n)
    ]


def ids(df):
    return {r["event_id"] for r in df.select("event_id").collect()}


def test_ttl_counts_from_last_accepted(spark):
    days = [0, 3, 7, 8, 14.9, 15]
    rows = [("a", START + timedelta(days=d), str(d)) for d in days]
    got = dedup.dedup_ttl(spark.createDataFrame(rows, ROWS), "k", "at")
    assert ids(got) == {"0", "7", "14.9"}


@pytest.mark.parametrize("limit", [1, 3])
@pytest.mark.parametrize("bound", [200_000, 60, 3])
def test_admission_against_brute_force(spark, limit, bound):
    """Few rows per key, time slices, and slices that are all above the bound give one answer."""
    keys = ["hot"] * 6 + ["b", "c", "d"]
    rows = sample(7, 600, keys, 24 * 5, step=10)
    ttl = timedelta(hours=20)
    got = dedup.admit(spark.createDataFrame(rows, ROWS), "k", "at", "event_id", ttl, limit, max_rows_per_key=bound)
    assert ids(got) == brute(rows, ttl, limit)


def test_state_of_an_earlier_run(spark):
    rows = sample(3, 200, ["x", "y"], 24 * 4)
    cut = START + timedelta(days=2)
    ttl = timedelta(hours=30)
    old = [r for r in rows if r[1] < cut]
    state = [
        (k, int(max((r[1] for r in old if r[0] == k and r[2] in brute(old, ttl)), default=START).timestamp() * 1e6), 1)
        for k in ("x", "y")
    ]
    new = spark.createDataFrame([r for r in rows if r[1] >= cut], ROWS)
    for bound in (10_000, 5):
        got = dedup.admit(new, "k", "at", "event_id", ttl, state=spark.createDataFrame(state, dedup.STATE_SCHEMA),
                          max_rows_per_key=bound)
        assert ids(got) == brute(rows, ttl) - {r[2] for r in old}


def test_keys(spark):
    df = spark.createDataFrame([(" Razorpay ", "Backend Engineer"), ("RAZORPAY", "backend engineer\t")], "company string, role string")
    for key in (dedup.producer_key(), dedup.consumer_key()):
        assert df.select(key.alias("k")).distinct().count() == 1
    assert df.select(dedup.producer_key().alias("k")).first()["k"].startswith("dedup:")


def test_first_and_unique_url(spark):
    df = spark.createDataFrame([("u", 2), ("u", 1), (None, 3), (None, 4), ("w", 5)], "url string, n int")
    known = spark.createDataFrame([("w", 0), (None, 0)], "url string, n int")
    assert {r["n"] for r in dedup.dedup_first(df.where("url is not null"), "url", ["n"]).collect()} == {1, 5}
    assert {r["n"] for r in dedup.unique_url(df, known, ["n"]).collect()} == {1, 3, 4}


def test_filtered_posting_still_suppresses_its_key(spark):
    rows = [
        ("A", "Dev", ["java"], START, "1"), ("A", "Dev", ["go"], START + timedelta(days=1), "2"),
        ("A", "Dev", ["go"], START + timedelta(days=8), "3"), ("B", "Go dev", [], START, "4"),
    ]
    df = spark.createDataFrame(rows, "company string, role string, stack array<string>, seen_at timestamp, event_id string")
    assert ids(dedup.two_stage_dedup(df, ["Go"])) == {"3", "4"}
    assert filters.stack_filter(df, []).count() == 4


# -- streams ---------------------------------------------------------------------------------


def land(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(path)


def run_stream(spark, stream, base):
    stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/check").outputMode(
        "append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


@pytest.mark.parametrize("limit", [1, 3])
def test_stream_equals_batch_over_restarts(spark, tmp_path, limit):
    rows = sorted(sample(11, 400, ["a", "a", "b", "c"], 24 * 20), key=lambda r: r[1])
    ttl = timedelta(days=2)
    base = str(tmp_path)
    for part in range(4):
        land(spark, rows[part * 100: part * 100 + 100], ROWS, f"{base}/in")
        events = spark.readStream.schema(ROWS).json(f"{base}/in")
        out = run_stream(spark, admission.admit_stream(events, "k", "at", "event_id", ttl, limit, "1 hour"), base)
    assert ids(out) == brute(rows, ttl, limit)


WIRE = schemas.POSTING_WIRE


def wire(eid, day, **change):
    row = {
        "company": "TestCorp", "role": "Backend Engineer", "source": "test", "url": f"https://testcorp.com/job/{eid}",
        "stack": '["Python","FastAPI"]', "product": "Developer Tooling", "location": "Remote", "posted_at": "2024-03-01",
        "event_id": eid, "seen_at": START + timedelta(days=day), **change,
    }
    return tuple(row[f] for f in WIRE.fieldNames())


def test_ingest_cases_and_retry(spark, tmp_path):
    base = str(tmp_path)
    batches = [
        [wire("1", 0, company="StreamCorp"), wire("2", 0, company=None), wire("3", 0, role="Other", stack="not-valid-json"),
         wire("1", 0, company="StreamCorp"), wire("4", 0, role="Ints", stack="[1, 2]")],
        [wire("1", 0, company="StreamCorp"), wire("5", 3, company=" streamcorp "), wire("6", 7, company="StreamCorp", source="")],
        [wire("7", 8, company="StreamCorp"), wire("8", 14, company="StreamCorp"), wire("9", 1, role="Late")],
    ]
    for number, rows in enumerate(batches):
        df = spark.createDataFrame(rows, WIRE)
        ingest.ingest_batch(df, number, base, lateness=timedelta(days=5))
        if number == 1:  # a retry of the same micro-batch changes nothing
            ingest.ingest_batch(df, number, base, lateness=timedelta(days=5))
    jobs = ingest.stored_jobs(spark, base)
    got = {(r["company"], r["role"], r["created_at"].day) for r in jobs.collect()}
    assert got == {("StreamCorp", "Backend Engineer", 1), ("TestCorp", "Other", 1), ("StreamCorp", "Backend Engineer", 8),
                   ("StreamCorp", "Backend Engineer", 15)}
    assert jobs.where("role = 'Other'").first()["stack"] is None
    assert jobs.where("source is null").count() == 1
    late = spark.read.schema(WIRE).parquet(f"{base}/late")
    assert ids(late) == {"9"}
    assert ids(spark.read.parquet(f"{base}/quarantine")) == {"4"}


def test_ingest_stream_equals_batch(spark, tmp_path):
    base = str(tmp_path)
    rnd = random.Random(5)
    rows = [wire(f"{i:03d}", 0, company=rnd.choice("AAABC"), seen_at=START + timedelta(hours=3 * i)) for i in range(150)]
    for part in range(3):
        land(spark, rows[part * 50: part * 50 + 50], WIRE, f"{base}/in")
        stream = stream_posting_events(spark, f"{base}/in", files_per_trigger=1)
        ingest.ingest_stream(stream, f"{base}/t", f"{base}/check", max_rows_per_key=20).awaitTermination()
    whole = dedup.dedup_ttl(read_posting_events(spark, f"{base}/in"), dedup.consumer_key())
    assert ingest.stored_jobs(spark, f"{base}/t").count() == whole.count()
    shown = tail_events(read_posting_events(spark, f"{base}/in"), 2).collect()
    assert [r["event_id"] for r in shown] == ["148", "149"] and shown[0]["stack_shown"] == "Python, FastAPI"


# -- NULL keys and instants, long chains, late rows ------------------------------------------------


def odd_sample(seed, n):
    rows = sample(seed, n, [None, "a", "a", "b"], 24 * 30, step=90)
    return [*rows, *[(k, None, f"x{i}") for i, k in enumerate(["a", None, "b"] * 4)]]


@pytest.mark.parametrize("bound", [3, 60, 200_000])
def test_null_keys_and_instants_at_every_bound(spark, bound):
    rows, ttl = odd_sample(21, 500), timedelta(hours=20)
    dated = [r for r in rows if r[1]]
    for limit in (1, 3):
        got = dedup.admit(spark.createDataFrame(rows, ROWS), "k", "at", "event_id", ttl, limit, max_rows_per_key=bound)
        assert ids(got) == brute(dated, ttl, limit)
    assert ids(dedup.undated(spark.createDataFrame(rows, ROWS), "at")) == {r[2] for r in rows if not r[1]}
    far = int((START + timedelta(days=20)).timestamp() * 1e6)
    state = spark.createDataFrame([(None, far, 1), ("a", 0, 1)], dedup.STATE_SCHEMA)
    got = dedup.admit(spark.createDataFrame(rows, ROWS), "k", "at", "event_id", ttl, state=state, max_rows_per_key=bound)
    later = START + timedelta(days=20) + ttl
    assert ids(got) == brute([r for r in dated if r[0] is not None or r[1] >= later], ttl)


def test_a_long_chain_ends_in_seconds(spark):
    df = spark.range(200_000).selectExpr("'k' AS k", "timestamp_seconds(id * 60) AS at", "cast(id AS string) AS event_id")
    assert dedup.admit(df, "k", "at", "event_id", timedelta(minutes=1)).count() == 200_000
    assert dedup.admit(df, "k", "at", "event_id", timedelta(minutes=2), max_rows_per_key=30_000).count() == 100_000


@pytest.mark.parametrize("limit", [1, 3])
def test_batches_lose_no_row(spark, tmp_path, limit):
    rows, ttl, base = odd_sample(31, 400), timedelta(days=2), str(tmp_path)
    parts = [rows[:250], rows[250:330], rows[330:]]
    for part in parts:
        land(spark, part, ROWS, f"{base}/in")
        events = spark.readStream.schema(ROWS).json(f"{base}/in")
        admission.admit_batches(events, f"{base}/t", f"{base}/check", key="k", ts="at", event_id="event_id", ttl=ttl, limit=limit,
                                lateness=timedelta(days=3), max_rows_per_key=40).awaitTermination()
    late, undated = (ids(spark.read.schema(ROWS).parquet(f"{base}/t/{t}")) for t in ("late", "undated"))
    assert undated == {r[2] for r in rows if not r[1]}
    windows, want, high, missed = {}, set(), None, set()
    for part in parts:
        dated = sorted((r for r in part if r[1]), key=lambda r: (r[1], r[2]))
        top = max([r[1] for r in dated] + ([high] if high else []))
        for key, at, eid in dated:
            if high and at < high - timedelta(days=3):
                missed.add(eid)
                continue
            start, n = windows.get(key, (None, 0))
            if start is None or at >= start + ttl:
                start, n = at, 0
            if n < limit:
                want.add(eid)
                n += 1
            windows[key] = (start, n)
        high = top
    assert late == missed and ids(spark.read.schema(ROWS).parquet(f"{base}/t/admitted")) == want
    admission.admit_batch(spark.createDataFrame(parts[2], ROWS), 2, f"{base}/t", "k", "at", "event_id", ttl, limit, timedelta(days=3))
    assert ids(spark.read.schema(ROWS).parquet(f"{base}/t/admitted")) == want


def test_ingest_in_slices_keeps_no_working_tables(spark, tmp_path, monkeypatch):
    rows = [wire(f"{i % 260:03d}", 0, company="AAABC"[i % 260 * 7 % 5], seen_at=START + timedelta(hours=9 * (i % 260))) for i in range(300)]
    rows += [wire("bad", 0, stack="[1, 2]"), wire("undated", 0, seen_at=None)]
    events = spark.createDataFrame(rows, WIRE)
    got = []
    for size in (1_000, 40):
        monkeypatch.setattr(ingest, "SLICE_ROWS", size)
        checks = []
        monkeypatch.setattr(ingest, "shared_dir", lambda s, name, to=tmp_path / str(size): checks.append(f"{to}/{name}") or checks[-1])
        base = f"{tmp_path}/{size}/out"
        for _ in range(2):  # a retry changes nothing
            ingest.ingest_batch(events, 0, base)
        got.append(sorted(map(str, ingest.stored_jobs(spark, base).drop("created_at").collect())))
        assert checks and not any(os.path.exists(c) for c in checks)
        assert ingest.ingest_counters(spark, base).first()[:4] == (262, 0, 1, len(got[-1]))
    assert got[0] == got[1] and len(got[0]) > 20


def test_windows_to_log_are_worked_out_once(spark, tmp_path):
    rows, ran = spark.range(1_000).selectExpr("concat('k', id) AS _k", "id * 86400000000 AS _start", "1 AS _n"), spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            ran.add(batch.num_rows)
            yield batch

    path = f"{tmp_path}/log"
    windows.append_windows(rows.mapInArrow(seen, rows.schema), path, 0)
    assert ran.value == 1_000
    assert windows.known_windows(spark, path, 0, 86_400_000_000 * 1_000, 1, rows).count() == 1_000
