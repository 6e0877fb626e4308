"""Inverted side tables: tags of jobs and three-letter pieces of company names.

Postings are rows (key, value) in folders by hash of the key, with a table of how many values each key has. A search reads
the folders of its keys only and intersects from the rarest key on, which is broadcast while it is counted as small.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from postloom.operators import tables
from postloom.operators.filters import job_predicate

BUCKETS = 64
GRAM = 3
#: Values that may be broadcast after they have been counted.
BROADCAST_ROWS = 500_000


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write(pairs: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Store distinct (key, value); pairs with a null are left out. A crowded key is split over tasks."""
    held = pairs.where("key IS NOT NULL AND value IS NOT NULL").distinct().withColumn("bucket", _bucket(F.col("key"), buckets))
    held.hint("rebalance", "bucket").sortWithinPartitions("bucket", "key").write.partitionBy("bucket").parquet(f"{path}/postings")
    spark = pairs.sparkSession
    stored = spark.read.schema(held.schema).parquet(f"{path}/postings")
    stored.groupBy("bucket", "key").agg(F.count(F.lit(1)).alias("n")).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{path}/keys")
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{path}/about")


def holding_all(spark: SparkSession, path: str, keys: Sequence[str]) -> tuple[DataFrame, int]:
    """(value) of the values that all ``keys`` have, and how many there are at most. At least one key is needed."""
    wanted = sorted(set(keys))
    buckets = spark.read.parquet(f"{path}/about").first()["buckets"]

    def of(table: DataFrame, names: Sequence[str]) -> DataFrame:
        here = F.col("bucket").isin(*[_bucket(F.lit(k), buckets) for k in names])
        return table.where(here & F.col("key").isin(*names))

    postings = spark.read.schema("key string, value string, bucket int").parquet(f"{path}/postings")
    counts = {r["key"]: r["n"] for r in of(spark.read.schema("key string, n long, bucket int").parquet(f"{path}/keys"), wanted).collect()}
    if len(counts) < len(wanted):
        return postings.where(F.lit(False)).select("value"), 0
    first, *others = sorted(wanted, key=lambda k: (counts[k], k))
    found, most = of(postings, [first]).select("value"), counts[first]
    for k in others:
        near = F.broadcast(found) if most <= BROADCAST_ROWS else found
        found = of(postings, [k]).select("value").join(near, "value")
    return found, most


# ------------------------------------------------------------------------------------------------------ tags of jobs

def write_tags(jobs: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Store which jobs (by id) have which tag, as written in their stack."""
    write(jobs.select(F.explode("stack").alias("key"), F.col("id").alias("value")), path, buckets)


def jobs_with(jobs: DataFrame, path: str, role: str | None = None, stack: Sequence[str] | str | None = None,
              status: str | None = None) -> DataFrame:
    """The same jobs as ``filters.job_predicate`` keeps; the tags are looked up in the postings at ``path``."""
    if isinstance(stack, str):
        stack = [s.strip() for s in stack.split(",")] if stack else None
    kept = jobs.where(job_predicate(role, None, status))
    if not stack:
        return kept
    ids, most = holding_all(jobs.sparkSession, path, stack)
    ids = ids.withColumnRenamed("value", "id")
    return kept.join(F.broadcast(ids) if most <= BROADCAST_ROWS else ids, "id", "left_semi").select(*jobs.columns)


# ------------------------------------------------------------------------------------------------- names of companies

def literals(pattern: str) -> list[str]:
    """Runs of a LIKE pattern between its wildcards, a backslash taking the next character as it is."""
    pieces = re.findall(r"\\(.)|([%_])|(.)", pattern, re.S)
    text = "".join("\0" if wild else escaped or plain for escaped, wild, plain in pieces)
    return [run for run in text.split("\0") if run]


def grams(text: str) -> set[str]:
    return {text[i:i + GRAM] for i in range(len(text) - GRAM + 1)}


def write_companies(contacts: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Store contacts by hash of their company, and the three-letter pieces of the distinct names in lower case."""
    contacts.withColumn("_bucket", _bucket(F.col("company"), buckets)).hint("rebalance", "_bucket").write.partitionBy(
        "_bucket").parquet(f"{path}/contacts")
    contacts.sparkSession.createDataFrame([(contacts.schema.json(),)], "rows_schema string").coalesce(1).write.parquet(f"{path}/contacts_about")
    low = F.lower("company")
    pieces = F.transform(F.sequence(F.lit(1), F.char_length(low) - (GRAM - 1)), lambda i: F.substr(low, i, F.lit(GRAM)))
    names = contacts.select("company").where(F.char_length(low) >= GRAM).distinct()
    write(names.select(F.explode(F.array_distinct(pieces)).alias("key"), F.col("company").alias("value")), path, buckets)


def contacts_like(spark: SparkSession, path: str, company: str | None) -> DataFrame:
    """Contacts whose company contains the pattern, ignoring case; no pattern means all.

    Companies that hold every piece of the pattern are checked by the pattern itself, and only their folders are read. A
    pattern whose literal runs are all shorter than three characters has no pieces: the stored contacts are scanned.
    """
    schema = StructType.fromJson(json.loads(spark.read.parquet(f"{path}/contacts_about").first()["rows_schema"]))
    columns = schema.fieldNames()
    stored = spark.read.schema(schema.add("_bucket", "integer")).parquet(f"{path}/contacts")
    if not company:
        return stored.select(*columns)
    low = spark.range(1).select(F.lower(F.lit(company)).alias("low")).first()["low"]
    pieces = set().union(*map(grams, literals(low)))
    matches = F.col("company").ilike(f"%{company}%")
    if not pieces:
        return stored.where(matches).select(*columns)
    found, most = holding_all(spark, path, sorted(pieces))
    buckets = spark.read.parquet(f"{path}/about").first()["buckets"]
    names = found.select(F.col("value").alias("company")).where(matches).withColumn("_bucket", _bucket(F.col("company"), buckets))
    return stored.join(F.broadcast(names) if most <= BROADCAST_ROWS else names, ["_bucket", "company"], "left_semi").select(*columns)


def contacts_by_company(spark: SparkSession, path: str, company: str | None, limit: int = 50, offset: int = 0) -> DataFrame:
    """The same page as ``tables.contacts_by_company``."""
    return tables.newest(contacts_like(spark, path, company), limit, offset)
