"""Token counts as rollups that signed changes keep up to date.

A batch of changes holds inserts, deletes and revised counts of documents. Each becomes a signed number of
documents and tokens; their sums by source, language and tokenizer version are written to a folder named by the
batch, then a commit row is written. A batch that is committed is not applied again; one that broke off is
overwritten as a whole. Totals are sums over the folders of committed batches, so no batch reads the documents of
another, and ``compacted`` folds them into one.

Cases: null and empty texts have 0 tokens; null sources and languages are groups of their own; a revision counts
the new number less the old; groups whose documents and tokens sum to 0 vanish; repeated rows count one by
one; an empty batch commits and changes nothing; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.common import materialise, query, small_batches, table
from postloom.session import shared_dir

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
VERSION = "byte_bpe_50k/1"
#: Splits a text before merging; fixed with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEYS = ["source", "lang", "tokenizer"]


@lru_cache(maxsize=2)
def _encoding(data: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
    return tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def counted(docs: DataFrame, ranks: str = RANKS, version: str = VERSION) -> DataFrame:
    """doc_id, text_hash, source, lang, tokenizer, n_bytes and n_tokens of each whole text, written once.

    The vocabulary is read on the driver and sent with the tasks; its size does not depend on the data.
    """
    data = Path(ranks).read_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(data).encode_ordinary
        for batch in batches:
            n = [len(encode(t.as_py())) if t.is_valid else 0 for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "text_hash", "source", "lang", "n_bytes")), pa.array(n, pa.int64())],
                names=["doc_id", "text_hash", "source", "lang", "n_bytes", "n_tokens"])

    rows = small_batches(docs).select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("source").cast("string"),
                       F.col("lang").cast("string"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return materialise(rows.mapInArrow(run, "doc_id long, text_hash long, source string, lang string, n_bytes long, n_tokens long")
                       .withColumn("tokenizer", F.lit(version)).withColumn("row", F.monotonically_increasing_id()), "token-counts")


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def committed(spark: SparkSession, path: str, batch: str) -> bool:
    return _read(spark, f"{path}/commits/batch={batch}") is not None


def apply_batch(changes: DataFrame, path: str, batch: str) -> bool:
    """Apply one batch; False if it had been committed before.

    ``changes``: op (insert, delete or revise), source, lang, tokenizer, n_tokens and old_tokens (revise only). A column
    ``times``, if there is one, says how many equal changes a row stands for.
    """
    spark = changes.sparkSession
    if committed(spark, path, batch):
        return False
    sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0).otherwise(
        F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce("op", F.lit("null")))))
    tokens = F.when(F.col("op") == "revise", F.col("n_tokens") - F.col("old_tokens")).otherwise(sign * F.col("n_tokens"))
    times = F.col("times") if "times" in changes.columns else F.lit(1)
    changes.groupBy(*KEYS).agg(F.sum(sign * times).cast("long").alias("docs"), F.sum(tokens * times).cast("long").alias("tokens")).write.mode(
        "overwrite").parquet(f"{path}/deltas/batch={batch}")
    spark.createDataFrame([(batch,)], "name string").coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/batch={batch}")
    return True


def totals(spark: SparkSession, path: str) -> DataFrame:
    """Documents and tokens by source, lang and tokenizer over all committed batches."""
    deltas, commits = _read(spark, f"{path}/deltas"), _read(spark, f"{path}/commits")
    if deltas is None or commits is None:
        return spark.createDataFrame([], "source string, lang string, tokenizer string, docs long, tokens long")
    done = commits.select(F.col("name").alias("batch"))
    return deltas.withColumn("batch", F.col("batch").cast("string")).join(done, "batch", "left_semi").groupBy(*KEYS).agg(
        F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 OR tokens <> 0")


def compacted(spark: SparkSession, path: str, into: str) -> None:
    """Start a new rollup at ``into`` with the totals of this one as its first batch."""
    totals(spark, path).write.mode("overwrite").parquet(f"{into}/deltas/batch=compacted")
    spark.createDataFrame([("compacted",)], "name string").coalesce(1).write.mode("overwrite").parquet(f"{into}/commits/batch=compacted")


def further_copies(docs: DataFrame) -> DataFrame:
    """Changes that delete every row of a text but the first (by id, then by row; rows without an id last).

    Copies are counted by text and group, and combine before the shuffle; a text meets one row per group, not its copies.
    """
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")
    groups = docs.groupBy("text_hash", "n_tokens", *KEYS).agg(F.count(F.lit(1)).alias("copies"), F.min(order).alias("least"))
    held = F.struct(F.col("least").alias("least"), *KEYS)
    per_text = groups.groupBy("text_hash", "n_tokens").agg(F.min(held).alias("first"))
    return groups.select("n_tokens", *KEYS, F.col("copies").alias("times")).unionByName(
        per_text.select("n_tokens", *[F.col(f"first.{k}").alias(k) for k in KEYS], F.lit(-1).cast("long").alias("times"))).select(
        F.lit("delete").alias("op"), *KEYS, "n_tokens", F.lit(None).cast("long").alias("old_tokens"), "times")


@query("op7_token_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of distinct texts by source, language and tokenizer version, kept by three batches.

    The first inserts every document with an estimate (a quarter of its bytes), the second revises each to its
    real count, the third deletes every further copy of a text, also rows with the same id or none; the second is sent twice.
    """
    docs = counted(table(spark, sf_dir, "documents"))
    path = shared_dir(spark, "token-rollup")
    guess = F.ceil(F.col("n_bytes") / 4).cast("long")
    keys = [F.col(k) for k in KEYS]
    apply_batch(docs.select(F.lit("insert").alias("op"), *keys, guess.alias("n_tokens"), F.lit(None).cast("long").alias("old_tokens")), path, "b1")
    revised = docs.select(F.lit("revise").alias("op"), *keys, "n_tokens", guess.alias("old_tokens"))
    apply_batch(revised, path, "b2")
    apply_batch(further_copies(docs), path, "b3")
    apply_batch(revised, path, "b2")
    return totals(spark, path)
