"""Counters of runs from their own writes, and versions with many writers."""

import threading

from pyspark.sql import functions as F

from postloom.operators import runs, summary
from postloom.sources import snapshots
from postloom.streaming import progress


def test_steps_count_what_they_write(spark, tmp_path):
    run = runs.Run(spark, str(tmp_path), "r1")
    asked = run.counted(spark.createDataFrame([("a",), ("b",), ("c",)], "company string"), "companies")
    found = spark.createDataFrame([("a", 1), ("a", 2), ("c", 3), ("d", 4)], "company string, n int")
    assert run.write("discover", lambda: found.join(asked, "company"), companies="companies").count() == 3
    assert run.write("scrape", lambda: spark.range(7), jobs_before=10).count() == 7
    assert run.write("draft", lambda: spark.range(0)).count() == 0
    assert run.write("digest", lambda: spark.range(3).select(F.raise_error(F.lit("no server")).alias("x")), context="digest") is None
    assert run.write("followup", lambda: spark.read.parquet(str(tmp_path / "none"))) is None
    got = summary.run_summary(run.log()).first().asDict()
    assert got == {"run_id": "r1", "jobs_discovered": 7, "contacts_found": 3, "emails_drafted": 0, "followups_drafted": 0, "digest_sent": 0,
                   "companies_processed": 3, "errors": 2}
    errors = {r["task"]: (r["context"], r["detail"]) for r in summary.run_errors(run.log()).collect()}
    assert errors["digest"][0] == "digest" and set(errors) == {"digest", "followup"}
    assert runs.latest(spark, str(tmp_path)) is None and run.publish() == 0
    assert runs.latest(spark, str(tmp_path)).first().asDict() == got


def test_metrics_come_from_the_write(spark, tmp_path):
    got = runs.write_observed(spark.range(100), str(tmp_path / "t"), high=F.max("id"), even=F.count_if(F.col("id") % 2 == 0))
    assert got == {"rows": 100, "high": 99, "even": 50}


def test_no_publisher_is_lost(spark, tmp_path):
    path, numbers = str(tmp_path / "versions"), []

    def publish(name):
        for i in range(4):
            numbers.append(snapshots.commit(spark.createDataFrame([(name, i)], "name string, i int").coalesce(1), path))

    threads = [threading.Thread(target=publish, args=(n,)) for n in "abc"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(numbers) == list(range(12))
    rows = snapshots.history(spark, path).collect()
    assert {(r["name"], r["i"]) for r in rows} == {(n, i) for n in "abc" for i in range(4)} and {r["version"] for r in rows} == set(range(12))


def test_compare_and_set(spark, tmp_path):
    path, row = str(tmp_path / "versions"), spark.createDataFrame([(1,)], "x int").coalesce(1)
    assert snapshots.committed(spark, path) is None and snapshots.history(spark, path) is None
    assert snapshots.commit(row, path, expected=3) is None  # there is no version 3
    assert snapshots.commit(row, path, expected=-1) == 0
    assert snapshots.commit(row, path, expected=-1) is None  # somebody else came first
    won = []
    threads = [threading.Thread(target=lambda v=v: won.append(snapshots.commit(row.select(F.lit(v).alias("x")), path, expected=0))) for v in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(won, key=str) == [1, None, None, None, None]
    assert snapshots.committed(spark, path, 0).first()["x"] == 1


def test_progress_is_logged(spark, tmp_path):
    spark.range(30).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    log = progress.ProgressLog(spark, str(tmp_path / "log"), only="counted")
    spark.streams.addListener(log)
    try:
        seen = progress.observed(stream, "seen", odd=F.count_if(F.col("id") % 2 == 1))
        running = seen.writeStream.queryName("counted").format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        running.awaitTermination()
        progress.wait_logged(spark, str(tmp_path / "log"), running)
    finally:
        spark.streams.removeListener(log)
    rows = progress.progress(spark, str(tmp_path / "log")).collect()
    assert len(rows) >= 3 and sum(r["metrics"]["seen"]["rows"] for r in rows if r["metrics"]) == 30
    assert sum(r["metrics"]["seen"]["odd"] for r in rows if r["metrics"]) == 15
