"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.session import shared_dir, use_utc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Slim rows that may be broadcast after they have been counted.
BROADCAST_ROWS = 500_000


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can express it, its DuckDB counterpart."""

    def wrap(build: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: build(use_utc(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql.strip()
        return build

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark removes the shuffle files of a job when it ends. A written table is computed once, so none is needed again.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to a fresh folder under ``spark.checkpoint.dir`` and read it back.

    The lineage ends there and lost executors cost no recomputation. The owner of the checkpoint folder
    clears it; nothing is deleted here because the returned frame is lazy.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession, purpose)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Rows and bytes of an Arrow batch: texts are long, and a batch is held once in the JVM and once in Python.
ARROW_ROWS, ARROW_BYTES = 500, 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df`` for a function that reads whole texts or packs: its session sends small Arrow batches from now on."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return df


def few(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a written table of at most ``most`` slim rows; leave larger ones to a shuffle."""
    return F.broadcast(df) if df.count() <= most else df


#: Rows of one key that may meet in a task when there are too many keys to broadcast.
HOT_ROWS = 10_000


def join_one(rows: DataFrame, one: DataFrame, key: str, weight: str, total: int, keys: int) -> DataFrame:
    """``rows`` joined on ``key`` with ``one``, a table of one row per key; rows of a frequent key never meet.

    ``one`` says in ``weight`` how many rows its key has; they add up to at most ``total``, and there are at most
    ``keys`` keys. Few keys are broadcast whole. Of many, those with more rows than the larger of HOT_ROWS and
    ``2 * total / BROADCAST_ROWS`` are, by division, at most half of BROADCAST_ROWS and are broadcast; the others shuffle.
    """
    if keys <= BROADCAST_ROWS:
        return rows.join(F.broadcast(one), key)
    hot = max(HOT_ROWS, 2 * total // BROADCAST_ROWS)
    heavy, light = F.broadcast(one.filter(F.col(weight) > hot)), one.filter(F.col(weight) <= hot)
    return rows.join(heavy, key).unionByName(rows.join(heavy.select(key), key, "left_anti").join(light, key))


def keyed(docs: DataFrame) -> DataFrame:
    """Each row as a struct beside its key (id and hash of the text), safe from any column names."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col("doc_id").cast("long").alias("key_id"), F.xxhash64("text").alias("key_text"))


def on_key(rows: DataFrame, other: DataFrame) -> Column:
    return rows["key_id"].eqNullSafe(other["doc_id"]) & (rows["key_text"] == other["text_hash"])


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
