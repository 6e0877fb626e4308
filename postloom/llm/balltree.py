"""Ranked lexical search, exact, by a forest of sparse ball trees over the documents.

A document is a sparse vector of impacts: the integer weight of a term times its saturated frequency. A query is the
vector of its terms' counts, so a score is an inner product of integers. Documents sorted by their heaviest terms are
cut into shards, and each shard has a ball tree: a node has an integer centre, the terms that its documents hold and a radius
rounded upwards. No document below a node scores more than ``q . centre + |q| * radius``, where the query counts only in the
terms of the node. A query descends best first, scores the documents of a leaf in 64-bit integers, and stops when no
bound reaches its k-th score. A first round over the most promising shard of each query gives all shards that k-th score to start from.

Only terms that some query of the block asks for become dimensions. Queries are worked off in blocks of bounded terms; a
block's terms and weights are held by every task.

Cases: null and empty texts have no term, count in no statistic and are never found; a query without known terms finds
nothing; of rows that repeat a query's id the smallest text is asked; a null query id is an id; repeated documents are ranked
one by one; a null doc_id counts as the smallest; equal scores go to the smaller doc_id; texts and terms of any length are
counted whole; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postloom.llm.common import materialise, query, small_batches, table

TOP = 10
SHARD_DOCS, LEAF_DOCS = 4096, 32
#: Terms of queries worked off together, and numbers of a dense matrix of queries.
BLOCK_TERMS = 50_000
DENSE = 4_000_000
#: Most partitions of a table of shards; beyond it a task builds several.
PARTITIONS = 20_000
_NO_ID = -(2**63)
#: Every byte of a term as it is, A-Z as a-z, all other ASCII as a space.
_FOLD = bytes((b | 32) if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a text in UTF-8: runs of letters, digits and everything beyond ASCII."""
    return text.translate(_FOLD).split() if text else []


def weight_of(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


# ------------------------------------------------------------------------------------------------------- trees

def _flat(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of runs, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


@dataclass
class Tree:
    """A ball tree over sparse rows. Node i holds the rows ``nodes[i, 0]`` to ``nodes[i, 1]``, its children are ``nodes[i, 2:]``
    (-1: a leaf); its centre lists (``centre_at``) the terms of its rows with their whole-number coordinates."""

    ids: np.ndarray
    rows_at: np.ndarray
    term: np.ndarray
    impact: np.ndarray
    vocabulary: np.ndarray
    nodes: np.ndarray
    radius: np.ndarray
    centre_at: np.ndarray
    centre_term: np.ndarray
    centre: np.ndarray


_FIELDS = {"ids": np.int64, "rows_at": np.int64, "term": np.int32, "impact": np.int64, "vocabulary": np.int32, "nodes": np.int64,
           "radius": np.float64, "centre_at": np.int64, "centre_term": np.int32, "centre": np.int64}
_TREE = "shard long, " + ", ".join(f"{name} binary" for name in _FIELDS)


def read_tree(held: list[bytes]) -> Tree:
    parts = [np.frombuffer(b, kind) for b, kind in zip(held, _FIELDS.values(), strict=True)]
    parts[5] = parts[5].reshape(-1, 4)
    return Tree(*parts)


def _away(term: np.ndarray, impact: np.ndarray, at: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of rows from a dense centre, and by how much rounding may have lowered them."""
    there, own = centre[term], centre @ centre
    parts = (impact - there) ** 2
    value = np.add.reduceat(parts - there**2, at) + own
    size = np.add.reduceat(parts + there**2, at) + own
    return np.maximum(value, 0), size * (len(centre) + 64) * 2.0**-52


def build_tree(ids: np.ndarray, rows_at: np.ndarray, terms: np.ndarray, impacts: np.ndarray, leaf: int = LEAF_DOCS) -> Tree:
    """A tree over rows (row i has terms and impacts ``rows_at[i]`` to ``rows_at[i + 1]``, at least one).

    A node is halved along the line between two of its rows that lie far apart.
    """
    vocabulary, local = np.unique(terms, return_inverse=True)
    order = np.arange(len(ids))
    lengths = np.diff(rows_at)
    nodes, radius, centres = [[0, len(ids), -1, -1]], [], []
    i = 0
    while i < len(nodes):  # parents before children
        start, stop = nodes[i][:2]
        rows = order[start:stop]
        at = _flat(rows_at[rows], lengths[rows])
        term, impact = local[at], impacts[at].astype(np.float64)
        cuts = np.r_[0, np.cumsum(lengths[rows])[:-1]]
        centre = np.floor(np.bincount(term, impact, len(vocabulary)) / len(rows))
        value, low = _away(term, impact, cuts, centre)
        radius.append(float(np.nextafter(np.sqrt((value + low).max() * (1 + 2.0**-40)), np.inf)))
        held = np.flatnonzero(np.bincount(term, minlength=len(vocabulary)))
        centres.append((held, centre[held].astype(np.int64)))
        if stop - start > leaf:
            ends = []
            far = int(value.argmax())
            for _ in range(2):
                dense = np.zeros(len(vocabulary))
                one = slice(cuts[far], cuts[far] + lengths[rows[far]])
                dense[term[one]] = impact[one]
                ends.append(dense)
                far = int(_away(term, impact, cuts, dense)[0].argmax())
            along = np.add.reduceat(impact * (ends[0] - ends[1])[term], cuts)
            order[start:stop] = rows[np.argsort(along, kind="stable")]
            middle = (start + stop) // 2
            nodes[i][2:] = len(nodes), len(nodes) + 1
            nodes += [[start, middle, -1, -1], [middle, stop, -1, -1]]
        i += 1
    at = _flat(rows_at[:-1][order], lengths[order])
    return Tree(ids[order], np.r_[0, np.cumsum(lengths[order])], local[at].astype(np.int32), impacts[at], vocabulary.astype(np.int32),
                np.array(nodes, np.int64), np.array(radius), np.r_[0, np.cumsum([len(h) for h, _ in centres])],
                np.concatenate([h for h, _ in centres]).astype(np.int32), np.concatenate([c for _, c in centres]))


@dataclass
class Asked:
    """Queries: ids, and per query (``at``) its terms with their counts. Floors: no score below it is among the best."""

    ids: list[int | None]
    at: np.ndarray
    term: np.ndarray
    count: np.ndarray
    floor: np.ndarray

    def dense(self, some: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
        """Counts of the queries ``some`` in the terms of a shard."""
        lengths = np.diff(self.at)[some]
        at = _flat(self.at[some], lengths)
        place = np.minimum(np.searchsorted(vocabulary, self.term[at]), len(vocabulary) - 1)
        there = vocabulary[place] == self.term[at]
        out = np.zeros((len(some), len(vocabulary)), np.int64)
        out[np.repeat(np.arange(len(some)), lengths)[there], place[there]] = self.count[at[there]]
        return out


def node_bounds(tree: Tree, counts: np.ndarray, most: int | None = None) -> np.ndarray:
    """No document below node j scores more for query i than the number at (i, j); of the first ``most`` nodes only."""
    n = len(tree.nodes) if most is None else most
    end = tree.centre_at[n]
    centre, held = np.zeros((n, counts.shape[1])), np.zeros((n, counts.shape[1]))
    node = np.repeat(np.arange(n), np.diff(tree.centre_at[:n + 1]))
    centre[node, tree.centre_term[:end]] = tree.centre[:end]
    held[node, tree.centre_term[:end]] = 1
    counts = counts.astype(np.float64)
    reach = np.sqrt((counts**2) @ held.T * (1 + 2.0**-30)) * tree.radius[:n]
    return (counts @ centre.T + reach) * (1 + 2.0**-30) + 1


def search_tree(tree: Tree, asked: Asked, k: int, some: np.ndarray | None = None) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], int]:
    """(query, doc ids, scores) of up to ``k`` documents that may be among the best, and how many documents were scored.

    ``asked.floor`` rises with what is found, so that the next shard of a task starts from there.
    """
    some = np.arange(len(asked.ids)) if some is None else some
    found, scored = [], 0
    step = max(1, DENSE // max(1, len(tree.vocabulary)))
    for part in (some[i:i + step] for i in range(0, len(some), step)):
        counts = asked.dense(part, tree.vocabulary)
        part, counts = part[counts.any(1)], counts[counts.any(1)]
        if not len(part):
            continue
        root = node_bounds(tree, counts, 1)[:, 0] >= asked.floor[part]
        part, counts = part[root], counts[root]
        bounds = node_bounds(tree, counts) if len(part) else None
        for i, q in enumerate(part.tolist()):
            names, scores, least = np.empty(0, np.int64), np.empty(0, np.int64), int(asked.floor[q])
            heap = [(-bounds[i, 0], 0)]
            while heap and -heap[0][0] >= least:
                start, stop, left, right = tree.nodes[heapq.heappop(heap)[1]].tolist()
                if left >= 0:
                    for child in (left, right):
                        if bounds[i, child] >= least:
                            heapq.heappush(heap, (-bounds[i, child], child))
                    continue
                a, b = tree.rows_at[start], tree.rows_at[stop]
                score = np.add.reduceat(tree.impact[a:b] * counts[i][tree.term[a:b]], tree.rows_at[start:stop] - a)
                scored += stop - start
                good = score >= max(least, 1)
                names, scores = np.r_[names, tree.ids[start:stop][good]], np.r_[scores, score[good]]
                if len(names) >= k:
                    first = np.lexsort((names, -scores))[:k]
                    names, scores = names[first], scores[first]
                    least = max(least, int(scores[-1]))
            if len(names):
                found.append((q, names, scores))
            asked.floor[q] = least
    return found, scored


# ---------------------------------------------------------------------------------------------------- documents

def counted(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n (terms of the text) and, of the vocabulary's terms that it holds, number and frequency."""
    shared = docs.sparkSession.sparkContext.broadcast({term: i for i, term in enumerate(vocabulary)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            n, held = [], []
            for text in batch.column(1).cast(pa.binary()):
                words = terms_of(text.as_py())
                n.append(len(words))
                held.append(Counter(filter(known.__contains__, words)))
            cuts = pa.array(np.r_[0, np.cumsum([len(h) for h in held], dtype=np.int64)], pa.int32())
            terms = pa.array([known[t] for t in chain.from_iterable(held)], pa.int32())
            times = pa.array(list(chain.from_iterable(h.values() for h in held)), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(cuts, terms),
                                              pa.ListArray.from_arrays(cuts, times)], names=["doc_id", "n", "terms", "times"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.col("text"))
    return small_batches(rows).mapInArrow(run, "doc_id long, n long, terms array<int>, times array<int>")


def impacts(held: DataFrame, weights: np.ndarray, documents: int, length: int) -> DataFrame:
    """doc_id, terms, impacts and the three heaviest terms of the documents with an impact above 0."""
    shared = held.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = np.diff(batch.column(2).offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), lengths)
            term, times = (batch.column(i).flatten().to_numpy().astype(np.int64) for i in (2, 3))
            spread = 25 + (75 * documents * batch.column(1).to_numpy()) // length
            value = shared.value[term] * ((1_000_000_000 * times) // (1000 * times + 8 * spread[row]))
            order = np.lexsort((term, -value, row))
            order = order[value[order] > 0]
            row, term, value = row[order], term[order], value[order]
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            there = np.flatnonzero(np.diff(cuts))
            heavy = [np.where(cuts[there] + j < cuts[there + 1], term[np.minimum(cuts[there] + j, len(term) - 1)] if len(term) else 0, -1) for j in range(3)]
            at = pa.array(np.r_[cuts[there], len(term)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(there)), pa.ListArray.from_arrays(at, pa.array(term, pa.int32())), pa.ListArray.from_arrays(at, pa.array(value)),
                 *(pa.array(h, pa.int32()) for h in heavy)], names=["doc_id", "terms", "impacts", "first", "second", "third"])

    return held.mapInArrow(run, "doc_id long, terms array<int>, impacts array<long>, first int, second int, third int")


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted documents of a partition to trees of SHARD_DOCS documents."""
    number = TaskContext.get().partitionId() << 24
    ids, lengths, terms, values = [], [], [], []

    def tree() -> pa.RecordBatch:
        nonlocal number
        made = build_tree(np.concatenate(ids), np.r_[0, np.cumsum(np.concatenate(lengths))], np.concatenate(terms), np.concatenate(values))
        for part in (ids, lengths, terms, values):
            part.clear()
        number += 1
        return pa.RecordBatch.from_arrays([pa.array([number - 1]), *(pa.array([getattr(made, f).astype(kind).tobytes()], pa.binary()) for f, kind in _FIELDS.items())],
                                          names=["shard", *_FIELDS])

    held = 0
    for batch in batches:
        for start in range(0, batch.num_rows, SHARD_DOCS):
            part = batch.slice(start, SHARD_DOCS)
            if held and held + part.num_rows > SHARD_DOCS:
                yield tree()
                held = 0
            ids.append(part.column(0).to_numpy())
            lengths.append(np.diff(part.column(1).offsets.to_numpy()))
            terms.append(part.column(1).flatten().to_numpy())
            values.append(part.column(2).flatten().to_numpy())
            held += part.num_rows
    if held:
        yield tree()


def forest(rows: DataFrame) -> DataFrame:
    """The trees of a written table of impacts, one row each. Documents with the same heaviest terms lie side by side."""
    parts = min(PARTITIONS, max(1, -(-rows.count() // SHARD_DOCS)))
    order = ["first", "second", "third", "doc_id"]
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "terms", "impacts")
    return materialise(small_batches(ranged).mapInArrow(_trees, _TREE), "ball-trees")


# ------------------------------------------------------------------------------------------------------ queries

def asked_terms(items: DataFrame) -> DataFrame:
    """item_id, terms and counts of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [Counter(terms_of(t.as_py())) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([list(h) for h in held], pa.list_(pa.binary())), pa.array([list(h.values()) for h in held], pa.list_(pa.int64()))],
                names=["item_id", "terms", "counts"])

    return items.groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min("text").alias("text")).mapInArrow(
        run, "item_id long, terms array<binary>, counts array<long>")


def _best_shards(trees: DataFrame, asked: Asked) -> dict[int, int]:
    """Per query the shard with the highest bound of its root."""
    shared = trees.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros(len(shared.value.ids))
        where = np.zeros(len(best), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                tree = read_tree([c[i].as_py() or b"" for c in batch.columns[1:]])
                step = max(1, DENSE // max(1, len(tree.vocabulary)))
                for some in (np.arange(j, min(j + step, len(best))) for j in range(0, len(best), step)):
                    counts = shared.value.dense(some, tree.vocabulary)
                    bound = np.where(counts.any(1), node_bounds(tree, counts, 1)[:, 0], 0)
                    more = bound > best[some]
                    best[some[more]], where[some[more]] = bound[more], batch.column(0)[i].as_py()
        there = np.flatnonzero(best > 0)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(where[there]), pa.array(best[there])], names=["query", "shard", "bound"])

    # of the rows and the inner nodes only the roots are needed
    roots = trees.select("shard", *(F.col(f) if f in ("vocabulary", "nodes", "radius", "centre_at", "centre_term", "centre") else F.lit(None).cast("binary").alias(f)
                                    for f in _FIELDS))
    found = small_batches(roots).mapInArrow(run, "query long, shard long, bound double")
    return {r["query"]: r["shard"] for r in found.groupBy("query").agg(F.max_by("shard", F.struct("bound", "shard")).alias("shard")).collect()}


def _searched(trees: DataFrame, asked: Asked, k: int, only: dict[int, int] | None = None) -> DataFrame:
    """(query, doc_id, score): what every shard finds; with ``only``, each query in its one shard."""
    shared = trees.sparkSession.sparkContext.broadcast((asked, only))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, chosen = shared.value
        queries = Asked(queries.ids, queries.at, queries.term, queries.count, queries.floor.copy())
        for batch in batches:
            for i in range(batch.num_rows):
                some = None if chosen is None else np.array([q for q, s in chosen.items() if s == batch.column(0)[i].as_py()], np.int64)
                found, _ = search_tree(read_tree([c[i].as_py() for c in batch.columns[1:]]), queries, k, some)
                for q, names, scores in found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), q)), pa.array(names), pa.array(scores)], names=["query", "doc_id", "score"])

    if only is not None:
        trees = trees.filter(F.col("shard").isin(sorted(set(only.values()))))
    return small_batches(trees).mapInArrow(run, "query long, doc_id long, score long")


def _ranked(found: DataFrame, k: int, by: str) -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.col("score").desc(), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _block(docs: DataFrame, block: DataFrame, k: int) -> DataFrame | None:
    """(item_id, doc_id, score, rank) for a block of queries; None if no document is found."""
    spark = docs.sparkSession
    queries = block.collect()  # bounded: a block has about BLOCK_TERMS terms
    vocabulary = sorted({bytes(t) for r in queries for t in r["terms"]})
    number = {t: i for i, t in enumerate(vocabulary)}
    if not vocabulary:
        return None
    held = materialise(counted(docs, vocabulary), "lexical-counts")
    size = held.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    if not size["documents"]:
        return None
    weights = np.zeros(len(vocabulary), np.int64)
    for r in held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect():  # bounded by the block
        weights[r["term"]] = weight_of(size["documents"], r["df"])
    trees = forest(materialise(impacts(held, weights, size["documents"], size["length"]), "lexical-impacts"))
    asked = Asked([r["item_id"] for r in queries], np.r_[0, np.cumsum([len(r["terms"]) for r in queries], dtype=np.int64)],
                  np.array([number[bytes(t)] for r in queries for t in r["terms"]], np.int64),
                  np.array([c for r in queries for c in r["counts"]], np.int64), np.ones(len(queries), np.int64))
    first = _ranked(_searched(trees, asked, k, _best_shards(trees, asked)), k, "query").filter(F.col("rank") == k)
    for r in first.collect():  # one row per query at most
        asked.floor[r["query"]] = r["score"]
    names = spark.createDataFrame([(q, i) for q, i in enumerate(asked.ids)], "query long, item_id long")
    best = _ranked(_searched(trees, asked, k), k, "query")
    return materialise(best.join(F.broadcast(names), "query").select("item_id", "doc_id", "score", "rank"), "lexical-found")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents ``docs(doc_id, text)`` of each query ``items(item_id, text)``."""
    spark = docs.sparkSession
    queries = materialise(asked_terms(items), "lexical-queries")
    blocks = max(1, -(-(queries.agg(F.sum(F.size("terms")).alias("n")).first()["n"] or 0) // BLOCK_TERMS))
    found = [_block(docs, queries.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), k) for b in range(blocks)]
    out = spark.createDataFrame([], "item_id long, doc_id long, score long, rank int")
    for part in found:
        out = out if part is None else out.unionByName(part)
    return out.select("item_id", F.col("rank").cast("int").alias("rank"), _known_id(F.col("doc_id")).alias("doc_id"), "score")


def _known_id(doc_id: Column) -> Column:
    return F.when(doc_id != _NO_ID, doc_id)


@query("op12_ranked_search", r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
items AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
asked AS (SELECT item_id, term, count(*) AS times FROM items GROUP BY item_id, term),
whole AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM docs WHERE len(terms) > 0),
words AS (SELECT rid, doc_id, len(terms) AS n, unnest(terms) AS term FROM docs),
tfs AS (SELECT rid, doc_id, n, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY rid, doc_id, n, term),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), whole),
impacts AS (SELECT rid, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))) AS x
  FROM tfs JOIN weights USING (term), whole),
scored AS (SELECT item_id, rid, doc_id, CAST(sum(times * x) AS BIGINT) AS score FROM impacts JOIN asked USING (term) GROUP BY item_id, rid, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of every benchmark item."""
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
