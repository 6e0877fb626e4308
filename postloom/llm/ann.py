"""Approximate nearest neighbours by multi-index hashing.

Codes are the signs of the components after a learned rotation (iterative quantisation, fitted on at most
``SAMPLE`` rows, the first by the hash of their id). A code of 64 bits is split into 8 substrings, each with an
index from its value to rows. Two codes within RADIUS = 8 * (PROBE + 1) - 1 bits agree in some substring
up to PROBE bits, so probing the values within PROBE bits of each of the query's substrings retrieves every
code within the radius. Codes beyond the radius are dropped, the others are ranked by their vectors.

Every row is indexed. On evenly spread vectors of 64 dimensions the 10 nearest lie up to about 30 bits away, which
is why the radius is wide; recall is measured in tests.

Cases: vectors that are null, zero or hold null or non-finite components, and rows without id, take no part; rows that
repeat a query's id are its own, and the smallest of their vectors is asked; ties go to the smaller id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.common import materialise, query, table
from postloom.llm.vectors import PACK_ROWS, SHARD_ROWS, finite, matrix, packed, pairs, ranked, search_pairs

SAMPLE = 20_000
ROUNDS = 20
BITS, PARTS, PROBE = 64, 8, 3
RADIUS = PARTS * (PROBE + 1) - 1
_COUNTS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def learn_rotation(sample: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection to ``bits`` directions such that signs lose little: principal directions, then rotated.

    Vectors with fewer dimensions than bits are first turned into ``bits`` random directions.
    """
    mean = sample.mean(0)
    centred = sample - mean
    draw = np.random.default_rng(7)
    width = sample.shape[1]
    if width >= bits:
        base = np.linalg.svd(centred.T @ centred)[0][:, :bits]
    else:
        base = draw.normal(size=(width, bits)) / np.sqrt(bits)
    turn = np.linalg.qr(draw.normal(size=(bits, bits)))[0]
    low = centred @ base
    for _ in range(ROUNDS):
        left, _, right = np.linalg.svd(np.where(low @ turn > 0, 1.0, -1.0).T @ low)
        turn = (left @ right).T
    return mean, base @ turn


def codes(rows: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Codes as PARTS bytes per row."""
    return np.packbits((rows - mean) @ projection > 0, axis=1)


def _neighbours(probe: int) -> np.ndarray:
    """For each byte, the bytes within ``probe`` bits of it."""
    flips = np.flatnonzero(_COUNTS <= probe).astype(np.uint8)
    return np.arange(256, dtype=np.uint8)[:, None] ^ flips[None, :]


def hash_search(k: int, mean: np.ndarray, projection: np.ndarray, probe: int = PROBE, radius: int = RADIUS):
    """Search of one shard: index its substrings, probe, drop codes beyond the radius, rank by distance."""

    def search(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray):
        near = _neighbours(probe)
        held, asked = codes(rows, mean, projection), codes(queries, mean, projection)
        index = []
        for p in range(held.shape[1]):
            order = np.argsort(held[:, p], kind="stable")
            index.append((order, np.searchsorted(held[order, p], np.arange(257))))
        lists: dict[tuple[int, int], np.ndarray] = {}

        def probed(p: int, value: int) -> np.ndarray:
            if (p, value) not in lists:
                order, starts = index[p]
                lists[p, value] = np.concatenate([order[starts[v]:starts[v + 1]] for v in near[value].tolist()])
            return lists[p, value]

        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for q, name in enumerate(query_ids):
            found = np.zeros(len(ids), bool)
            for p in range(held.shape[1]):
                found[probed(p, int(asked[q, p]))] = True
            at = np.flatnonzero(found)
            at = at[_COUNTS[held[at] ^ asked[q]].sum(1) <= radius]
            at = at[ids[at] != name]
            if len(at):
                far = np.sqrt(((rows[at] - queries[q]) ** 2).sum(1))
                first = np.lexsort((ids[at], far))[:k]
                out.append((np.full(len(first), name), ids[at][first], far[first]))
        if not out:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        return tuple(map(np.concatenate, zip(*out, strict=True)))

    return search


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector of the rows that take part."""
    return vectors.filter(finite(F.col("embedding")) & F.col("vec_id").isNotNull() & F.exists(
        "embedding", lambda x: x != 0)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))


def _sample(rows: DataFrame, width: int, most: int = SAMPLE) -> np.ndarray:
    """The first ``most`` vectors by the hash of their id; a row of zeros if there are none.

    The last hash is found first, on executors and from hashes alone: a limit that is collected sends that many vectors of every partition.
    """
    place = F.xxhash64("vec_id")
    last = rows.select(place.alias("place")).orderBy("place").limit(most).agg(F.max("place").alias("last")).first()["last"]
    if last is None:
        return np.zeros((1, width))
    first = rows.filter(place <= last).orderBy(place, "vec_id").limit(most).select("vector").toArrow()
    return np.vstack([matrix(chunk, width) for chunk in first.column("vector").chunks])


def nearest(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest by Euclidean distance that the index retrieves.

    Both inputs have vec_id and vector. If a query retrieves fewer than ``k`` within the radius (small or odd tables),
    it is searched again with every code, so that fewer come back only if there are fewer rows.
    """
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("width")).first()
    width, asked = max(1, size["width"]), queries.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    mean, projection = learn_rotation(_sample(rows, width))
    shards = packed(rows, width, size["n"], SHARD_ROWS, [F.xxhash64("vec_id"), F.col("vec_id")], "ann-shards")
    n_asked = asked.count()
    packs = packed(asked, width, n_asked, PACK_ROWS, [F.col("vec_id")], "ann-queries")
    met = pairs(shards, packs)
    found = materialise(ranked(search_pairs(met, hash_search(k, mean, projection), "double"), k, F.col("score")), "ann-found")
    own = rows.groupBy("vec_id").agg(F.count(F.lit(1)).alias("own"))
    short = asked.join(found.groupBy("query_id").agg(F.count(F.lit(1)).alias("got")), F.col("vec_id") == F.col("query_id"), "left").join(
        own, "vec_id").filter(F.coalesce("got", F.lit(0)) < F.least(F.lit(k), F.lit(size["n"]) - F.col("own"))).select("vec_id", "vector")
    again = packed(short, width, n_asked, PACK_ROWS, [F.col("vec_id")], "ann-again")
    if again.isEmpty():
        return found
    wide = search_pairs(pairs(shards, again), hash_search(k, mean, projection, 8, BITS), "double")
    return found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(
        ranked(wide, k, F.col("score")))


@query("op6_approximate_neighbours")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every 100th vector among all others."""
    rows = usable(table(spark, sf_dir, "embeddings"))
    return nearest(rows, rows.filter("vec_id % 100 = 0"), 10)
