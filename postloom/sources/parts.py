"""Tables cut into parts by a hash of their key: a change rewrites the parts that it touches and no others.

A version is a list of (part, folder), published last by ``snapshots.commit``. Parts that a change does not touch keep
their folders and files, so a version costs what its change touches and readers of older versions are not disturbed. Keys
never change; a rewritten row that belongs to an untouched part is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Collection, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from postloom.sources import snapshots

PARTS = 64
_LIST = "part int, folder string, rows_schema string, keys array<string>, parts int"


def part_of(keys: Sequence[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


def _write(rows: DataFrame, path: str, keys: Sequence[str], parts: int, allowed: Collection[int] | None = None) -> dict[int, str]:
    """Write rows to a new folder; its name by part. At most ``parts`` numbers come back to the driver."""
    spark, folder = rows.sparkSession, f"rows-{uuid.uuid4().hex}"
    part = part_of(keys, parts)
    if allowed is not None:
        part = F.when(part.isin(*allowed), part).otherwise(F.raise_error(F.lit("a change moved a row to a part that it does not touch")).cast("int"))
    rows.withColumn("_part", part).hint("rebalance", "_part").write.partitionBy("_part").parquet(f"{path}/{folder}")
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}/_part=*")
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(root)
    return {int(s.getPath().getName()[len("_part="):]): folder for s in found or []}


def _publish(spark: SparkSession, path: str, held: dict[int, str], schema: StructType, keys: Sequence[str], parts: int, after: int) -> int | None:
    about = (schema.json(), list(keys), parts)
    rows = [(None, None, *about), *((p, f, *about) for p, f in sorted(held.items()))]
    return snapshots.commit(spark.createDataFrame(rows, _LIST).coalesce(1), path, expected=after)


def create(rows: DataFrame, path: str, keys: Sequence[str], parts: int = PARTS) -> int:
    """Start a table with ``rows``; version 0."""
    number = _publish(rows.sparkSession, path, _write(rows, path, keys, parts), rows.schema, keys, parts, -1)
    if number is None:
        raise FileExistsError(f"{path} holds a table")
    return number


def read(spark: SparkSession, path: str, version: int | None = None, only: Collection[int] | None = None) -> DataFrame:
    """Rows of a version, the newest by default; of the parts ``only`` if given."""
    listed = snapshots.committed(spark, path, version).collect()
    schema = StructType.fromJson(json.loads(listed[0]["rows_schema"]))
    paths = [f"{path}/{r['folder']}/_part={r['part']}" for r in listed if r["part"] is not None and (only is None or r["part"] in only)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def change(spark: SparkSession, path: str, changed: DataFrame, rewrite: Callable[[DataFrame], DataFrame], tries: int = 20) -> tuple[int, int]:
    """Publish a version in which ``rewrite`` has been applied to the parts that hold the keys in ``changed``.

    Returns the version and the number of parts rewritten. If another writer publishes first, the change is made again on top.
    Without keys in ``changed`` nothing is written and the newest version is returned.
    """
    for _ in range(tries):
        before = snapshots.newest(spark, path)
        listed = snapshots.committed(spark, path, before).collect()
        keys, parts = listed[0]["keys"], listed[0]["parts"]
        touched = {r[0] for r in changed.select(part_of(keys, parts)).distinct().collect()}
        if not touched:
            return before, 0
        schema = read(spark, path, before, ()).schema
        after = rewrite(read(spark, path, before, touched)).select(*schema.fieldNames())
        held = {r["part"]: r["folder"] for r in listed if r["part"] is not None and r["part"] not in touched}
        number = _publish(spark, path, held | _write(after, path, keys, parts, touched), schema, keys, parts, before)
        if number is not None:
            return number, len(touched)
    raise RuntimeError(f"{path} was changed by others in {tries} tries")
