"""Counters of scheduled runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tasks of a run and the counter each one feeds.
COUNTER_OF_TASK = {
    "discover": "contacts_found",
    "draft": "emails_drafted",
    "followup": "followups_drafted",
    "digest": "digest_sent",
}


def run_summary(log: DataFrame) -> DataFrame:
    """Counters per run.

    ``log``: run_id, task, ok, n (rows the step produced), company, jobs_before, jobs_after, and companies where
    one step asks about several (one otherwise). New jobs are the growth of the table over a scrape, never
    negative; failed steps count as errors.
    """
    n = F.coalesce("n", F.lit(1)).cast("long")
    counters = [
        F.coalesce(F.sum(F.when(F.col("ok") & (F.col("task") == task), n)), F.lit(0)).alias(name)
        for task, name in COUNTER_OF_TASK.items()
    ]
    companies = F.coalesce("companies", F.lit(1)) if "companies" in log.columns else F.lit(1)
    growth = F.greatest(F.col("jobs_after") - F.col("jobs_before"), F.lit(0))
    return log.groupBy("run_id").agg(
        F.coalesce(F.sum(F.when(F.col("task") == "scrape", growth)), F.lit(0)).alias("jobs_discovered"),
        *counters,
        F.coalesce(F.sum(F.when(F.col("ok") & (F.col("task") == "discover"), companies)), F.lit(0)).cast("long").alias("companies_processed"),
        F.count_if(~F.col("ok")).alias("errors"),
    )


def run_errors(log: DataFrame) -> DataFrame:
    """Failed steps with context and detail, one row each."""
    return log.where(~F.col("ok")).select("run_id", "task", "context", "detail")


def latest_summary(summary: DataFrame) -> DataFrame:
    """The last run only."""
    return summary.orderBy(F.desc("run_id")).limit(1)
