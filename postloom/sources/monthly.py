"""Jobs stored by month of their posting date, so that a page in date order reads few months.

Rows without a date are a partition of their own, read last in both orders.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from postloom.operators import tables
from postloom.operators.filters import job_predicate


def write(jobs: DataFrame, path: str) -> None:
    """Write jobs by ``posted_month`` (a number like 202405, null without a date); crowded months are split over tasks."""
    month = (F.year("posted_at") * 100 + F.month("posted_at")).alias("posted_month")
    rows = jobs.select("*", month)
    rows.hint("rebalance", "posted_month").write.partitionBy("posted_month").parquet(f"{path}/rows")
    jobs.sparkSession.createDataFrame([(rows.schema.json(),)], "rows_schema string").coalesce(1).write.parquet(f"{path}/about")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """All rows with their ``posted_month``."""
    schema = StructType.fromJson(json.loads(spark.read.parquet(f"{path}/about").first()["rows_schema"]))
    return spark.read.schema(schema).parquet(f"{path}/rows")


def months(spark: SparkSession, path: str) -> list[int | None]:
    """Months that hold rows, from the names of the folders."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows/posted_month=*")
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(root)
    names = [s.getPath().getName().partition("=")[2] for s in found or []]
    return [int(n) if n.isdigit() else None for n in names]


def _within(chosen: Sequence[int | None]) -> Column:
    dated = [m for m in chosen if m is not None]
    test = F.col("posted_month").isin(*dated) if dated else F.lit(False)
    return test | F.col("posted_month").isNull() if None in chosen else test


def list_jobs(
    spark: SparkSession, path: str, role: str | None = None, stack: Sequence[str] | str | None = None,
    status: str | None = None, sort: str = "latest", limit: int = 50, offset: int = 0,
) -> DataFrame:
    """The same page as ``tables.list_jobs``, from as few months as make it certain.

    Months are searched in the order asked for, twice as many each time, until ``offset + limit`` rows are found.
    """
    held = months(spark, path)
    tables.check_page(limit, offset, sort)
    dated = sorted((m for m in held if m is not None), reverse=sort != "oldest")
    rest: list[int | None] = [*dated, *([None] if None in held else [])]
    rows = stored(spark, path)
    kept = rows.where(job_predicate(role, stack, status))
    chosen: list[int | None] = []
    missing, step = offset + limit, 1
    while rest and missing > 0:
        now, rest = rest[:step], rest[step:]
        missing -= kept.where(_within(now)).limit(missing).count()
        chosen, step = chosen + now, 2 * step
    return tables.list_jobs(rows.where(_within(chosen)), role, stack, status, sort, limit, offset).drop("posted_month")


def new_job_batch(spark: SparkSession, path: str, purpose: str) -> DataFrame:
    """The same jobs as ``tables.new_job_batch``."""
    return list_jobs(spark, path, status="new", limit=tables.BATCH_SIZES[purpose])
