"""From documents to token ids: quality filter, near-duplicate removal, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a frame; it is written as Parquet and read again as the
docs of the next one. All stages but the last return the columns of documents, one row per row kept (or, in
the mix, per time it is taken). Empty tables give empty frames; extra columns pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm import jaccard, mixing, pieces, quality
from postloom.llm.common import materialise, table
from postloom.session import use_utc

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as good; all of them where no labels teach it otherwise."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each component of shingle Jaccard links."""
    return jaccard.one_per_component(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: whole texts, to the nearest number of times."""
    return mixing.repeated(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids and their number of each row, which is decoded again as a check (``round_trip``)."""
    return pieces.counted(pieces.encode(docs, check=True))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_filter),
    ("ngram_jaccard_join", near_duplicates),
    ("mixing_sources", mixture),
    ("sentencepiece_encoding", encoding),
]

#: No SQL counterpart: the classifier and the encoder cannot be stated in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(use_utc(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
