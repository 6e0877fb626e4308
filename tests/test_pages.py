"""A page of jobs and its counts from one pass."""

import pytest

from postloom.operators import tables


def jobs_of(spark, n):
    return spark.range(n).selectExpr(
        "CAST(id AS STRING) AS id", "IF(id % 3 = 0, 'Ring Smith', 'Clerk') AS role", "array('blue') AS stack", "'new' AS status",
        "IF(id % 7 = 0, NULL, TIMESTAMP '2001-01-01' + make_dt_interval(CAST(id AS INT))) AS posted_at")


@pytest.mark.parametrize(("sort", "limit", "offset"), [("latest", 10, 0), ("oldest", 10, 5), ("latest", 50, 25), ("latest", 5, 900)])
def test_page_and_counts_agree_with_the_two_queries(spark, sort, limit, offset):
    jobs = jobs_of(spark, 100)
    rows, info = tables.page_with_info(jobs, role="ring", sort=sort, limit=limit, offset=offset)
    assert rows == tables.list_jobs(jobs, role="ring", sort=sort, limit=limit, offset=offset).collect()
    assert info == tables.page_info(tables.count_jobs(jobs, role="ring"), limit, offset).first().asDict()


def test_one_job_and_no_rows(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("one-pass", "page")
    try:
        tables.page_with_info(jobs_of(spark, 1000), role="ring", limit=20)
        assert len(tracker.getJobIdsForGroup("one-pass")) == 1
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert tables.page_with_info(jobs_of(spark, 0), limit=20) == ([], {"total": 0, "limit": 20, "offset": 0, "has_more": False})
    assert tables.page_with_info(jobs_of(spark, 50), role="nobody", limit=20)[1]["total"] == 0
    with pytest.raises(ValueError):
        tables.page_with_info(jobs_of(spark, 5), limit=0)
