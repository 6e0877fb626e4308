"""Exact top-k search by inner product, block at a time.

Vectors become integer weights of terms (the dimensions). Rows sorted by their heaviest terms are cut into
blocks; a block keeps the rows (its forward index) and the largest and smallest weight of each term. For
a query the sum over terms of the larger product bounds every score in the block. Blocks are scored from the
highest bound down, until no bound reaches the query's k-th score.

Cases: vectors that are null or hold null or non-finite components, and rows without id, take no part; an empty
vector scores 0 with every other; rows that repeat a query's id are its own, and the smallest of their vectors is
asked; ties go to the smaller id; an
empty table gives no rows; other columns are ignored. A score outside 64 bits raises.
"""

from __future__ import annotations

from operator import mul

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.common import query, table
from postloom.llm.vectors import PACK_ROWS, SHARD_ROWS, finite, packed, pairs, ranked, search_pairs

SCALE = 256
BLOCK_ROWS = 256


def _product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in float64 while sums stay below 2^53, else as Python integers."""
    width = max(1, left.shape[1])
    if np.abs(left).max(initial=0) * np.abs(right).max(initial=0) * width < 2.0**53:
        return (left @ right.T).astype(np.int64)
    one, two = ([[int(x) for x in r] for r in rows.tolist()] for rows in (left, right))
    whole = np.array([[sum(map(mul, p, q)) for q in two] for p in one], object).reshape(len(left), len(right))
    if any(abs(x) >= 2**63 for r in whole for x in r):
        raise OverflowError("a score does not fit 64 bits")
    return whole.astype(np.int64)


def _whole(rows: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * rows)


def block_search(k: int, block_rows: int = BLOCK_ROWS):
    """Search of one shard for a pack of queries; both hold integer rows."""

    def search(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray):
        cuts = range(0, len(ids), block_rows)
        blocks = []
        for c in cuts:
            order = np.argsort(ids[c:c + block_rows], kind="stable")
            blocks.append((ids[c:c + block_rows][order], rows[c:c + block_rows][order]))
        high = np.array([b.max(0, initial=-np.inf) if b.size else b.sum(0) for _, b in blocks])
        low = np.array([b.min(0, initial=np.inf) if b.size else b.sum(0) for _, b in blocks])
        bound = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
        bound += np.abs(bound) * 1e-9 + 1e-6  # sums in float64: never below the true bound
        turn = np.argsort(-bound, axis=1, kind="stable")
        best = np.full((len(query_ids), k), np.iinfo(np.int64).min)
        named = np.full((len(query_ids), k), np.iinfo(np.int64).max)
        there = np.zeros((len(query_ids), k), bool)
        for r in range(len(blocks)):
            now = turn[:, r]
            open_ = ~there[:, -1] | (bound[np.arange(len(now)), now] >= best[:, -1])
            if not open_.any():
                break
            for b in np.unique(now[open_]):
                which = np.flatnonzero(open_ & (now == b))
                names, held = blocks[b]
                scores = _product(queries[which], held)
                own = names[None, :] == query_ids[which][:, None]
                masked = np.where(own, np.iinfo(np.int64).min, scores)
                top = np.argsort(-masked.astype(np.float64) if np.abs(masked[~own]).max(initial=0) < 2**53 else ~masked,
                                 axis=1, kind="stable")[:, :k]
                at = np.arange(len(which))[:, None]
                s = np.hstack([best[which], scores[at, top]])
                n = np.hstack([named[which], names[top]])
                t = np.hstack([there[which], ~own[at, top]])
                order = np.lexsort((n, ~s, ~t), axis=1)[:, :k]
                best[which], named[which], there[which] = s[at, order], n[at, order], t[at, order]
        at = np.nonzero(there)
        return query_ids[at[0]], named[at], best[at]

    return search


def top_k(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest inner products of integer vectors.

    ``rows`` and ``queries`` have vec_id and vector (whole numbers as doubles).
    """
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("width")).first()
    asked = queries.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    weight = F.transform("vector", lambda x, i: F.struct(F.abs(x).alias("w"), (2 * i + F.when(x < 0, 1).otherwise(0)).alias("term")))
    heavy = F.sort_array(weight, asc=False)
    keyed = rows.withColumn("first", F.get(heavy, 0)["term"]).withColumn("second", F.get(heavy, 1)["term"])
    shards = packed(keyed, size["width"], size["n"], SHARD_ROWS, [F.col("first"), F.col("second"), F.col("vec_id")], "topk-shards")
    packs = packed(asked, size["width"], asked.count(), PACK_ROWS, [F.col("vec_id")], "topk-queries")
    return ranked(search_pairs(pairs(shards, packs), block_search(k), "long"), k, F.col("score").desc())


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and floor(256 x) of the vectors that take part."""
    return vectors.filter(finite(F.col("embedding")) & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda x: F.floor(SCALE * x.cast("double")).cast("double")).alias("vector"))


@query("op3_exact_topk", """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest scores of every 50th vector against all others."""
    rows = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.filter("vec_id % 50 = 0"), 5)
