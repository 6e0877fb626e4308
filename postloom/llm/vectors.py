"""Vectors of a table in shards and queries in packs, met pair by pair.

A shard holds about ``SHARD_ROWS`` vectors, a pack about ``PACK_ROWS`` queries, both less than twice as many. Every shard meets
every pack in one row of a product of their files, so Python holds one shard and one pack at a time, whatever the table's
size. Vectors of different length count as filled up with zeros.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.llm.common import materialise, small_batches

SHARD_ROWS = 4096
PACK_ROWS = 2048
#: Ranges of a table. Spark finds their bounds on the driver, from rows in proportion to their number.
MOST_RANGES = 1000

_PACKED = "ids binary, vectors binary"


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(good, F.lit(False))


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of float64, filled up with zeros."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def read_packed(ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    names = np.frombuffer(ids, np.int64)
    return names, np.frombuffer(vectors, np.float64).reshape(len(names), -1)


def _pack(width: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, rows = np.empty(0, np.int64), np.empty((0, width))

        def row(n: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([names[:n].tobytes()], pa.binary()), pa.array([np.ascontiguousarray(rows[:n]).tobytes()], pa.binary())],
                names=["ids", "vectors"])

        for batch in batches:
            names = np.r_[names, batch.column(0).to_numpy()]
            rows = np.vstack([rows, matrix(batch.column(1), width)])
            while len(names) >= 2 * most:
                yield row(most)
                names, rows = names[most:], rows[most:]
        if len(names):
            yield row(len(names))

    return run


def packed(rows: DataFrame, width: int, count: int, most: int, order: list[Column], purpose: str) -> DataFrame:
    """(ids, vectors) of ``rows(vec_id, vector)`` in ``order``, in parts of about ``most``."""
    ranges = max(1, min(-(-count // most), MOST_RANGES))
    ranged = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("vec_id", "vector")
    return materialise(ranged.mapInArrow(_pack(width, most), _PACKED), purpose)


def pairs(shards: DataFrame, packs: DataFrame) -> DataFrame:
    """One row for each shard and pack: (ids, vectors, query_ids, queries).

    A product of the files of both, some packs at a time in a task: a join on numbers would need a copy of each shard per pack
    and of each pack per shard, and Spark would broadcast the copies by the size of the few packs that they are made from.
    """
    asked = packs.select(F.col("ids").alias("query_ids"), F.col("vectors").alias("queries"))
    return shards.select("ids", "vectors").hint("shuffle_replicate_nl").crossJoin(asked)


Search = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def search_pairs(met: DataFrame, search: Search, score: str) -> DataFrame:
    """(query_id, vec_id, score) that ``search(ids, vectors, query_ids, queries)`` finds in every pair."""
    kind = pa.int64() if score == "long" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = [c[i].as_py() for c in batch.columns]
                found = search(*read_packed(*one[:2]), *read_packed(*one[2:]))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, (pa.int64(), pa.int64(), kind), strict=True)],
                                                 names=["query_id", "vec_id", "score"])

    return small_batches(met).mapInArrow(run, f"query_id long, vec_id long, score {score}")


def ranked(found: DataFrame, k: int, best: Column) -> DataFrame:
    """The first ``k`` of each query in the order ``best``, then by id. Spark keeps k per query before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(best, "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
