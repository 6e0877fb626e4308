"""Quality classifier on document statistics.

Statistics of a whole text, standardised, go through random Fourier features, which approximate a Gaussian
kernel. Every partition of labelled rows adds up its part of the normal equations; their sum gives the ridge
weights. An isotonic fit over bins of raw scores turns scores into probabilities.

Labels are learned only from rows with ``crc32(doc_id as text) mod 4 <> 2``: remainders 0 and 1 fit the
ridge, 3 the calibration (all of them both, where either part is empty). All such rows are used.

Cases: null and empty texts have statistics of their own (zeros) and get a score; a null label is no label;
labels of one document are averaged; a null id is not held out and has no label; repeated rows are scored one
by one; with no labels every score is 0.5, and with one class only that class's label; empty tables give no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.common import few, keyed, materialise, on_key, query, small_batches, table

THRESHOLD = 0.7
HELD_OUT = 2
FEATURES = 256
RIDGE = 1.0
SEED = 20240
BINS = 2048
#: Partial sums of one row of the matrix that a task adds at a time.
FAN_IN = 256
STATISTICS = (
    "chars", "words", "word_len", "long_word", "upper", "lower", "digit", "space", "newline", "stop", "mark", "symbol",
    "bracket", "beyond", "distinct", "top_word", "repeat", "line_repeat", "line_words", "pair_repeat", "short_word",
)
_NAMES = [f"s_{n}" for n in STATISTICS]
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), *((n, pa.float64()) for n in _NAMES)])
_DDL = ", ".join(["doc_id long", "text_hash long", *(f"{n} double" for n in _NAMES)])


def _byte_classes() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    kinds[65:91], kinds[97:123], kinds[48:58] = 1, 2, 3
    kinds[[32, 9, 11, 12]], kinds[[10, 13]] = 4, 5
    for k, chars in ((6, b".?"), (7, b",;:'\"-!"), (8, b"#$%&*+/=@\\^_`|~"), (9, b"()[]{}<>")):
        kinds[list(chars)] = k
    kinds[128:] = 10
    return kinds


_KIND = _byte_classes()


def statistics(text: str | None) -> list[float]:
    """The statistics of one text, in the order of STATISTICS."""
    if not text:
        return [0.0] * len(STATISTICS)
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    parts = np.bincount(_KIND[data], minlength=11)[1:] / len(data)
    words = text.split()
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()] or [""]
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        np.log1p(len(text)), np.log1p(len(words)), float(lengths.mean()), float(np.log1p(lengths.max())),
        *parts.tolist(), len(counts) / n, max(counts.values(), default=0) / n, sum(map(eq, words, words[1:])) / n,
        1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), 1 - pairs / max(1, len(words) - 1),
        float((lengths <= 2).mean()),
    ]


def _read_statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([statistics(x.as_py()) for x in batch.column(1)], np.float64).reshape(-1, len(STATISTICS))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c) for c in rows.T)], schema=_SCHEMA)


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every whole text, written once."""
    return materialise(small_batches(docs).select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        _read_statistics, _DDL), "quality-statistics")


def remainder(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(4)), F.lit(-1))


@dataclass(frozen=True)
class Features:
    """Random Fourier features of standardised statistics: a fixed draw for a fixed seed."""

    mean: np.ndarray
    scale: np.ndarray

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        draw = np.random.default_rng(SEED)
        width = len(STATISTICS)
        turn = draw.normal(0, 1 / np.sqrt(width), (width, FEATURES))
        shift = draw.uniform(0, 2 * np.pi, FEATURES)
        held = np.clip((rows - self.mean) / self.scale, -6, 6)
        waves = np.sqrt(2 / FEATURES) * np.cos(held @ turn + shift)
        return np.hstack([np.ones((len(rows), 1)), waves])


@dataclass(frozen=True)
class Model:
    features: Features
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return self.features(rows) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(rows), self.knots, self.levels)


def _rows(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names], 1).astype(float)


def normal_equations(train: DataFrame, features: Features, fan_in: int = FAN_IN) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y over all rows: one partial sum per partition, added by row of the matrix in rounds of at most ``fan_in``.

    Partial sums come in the order of their partitions, so that reruns add in the same order. No group holds more than
    ``fan_in`` rows of the matrix, however many partitions there are.
    """
    kind = pa.schema([("i", pa.int32()), ("part", pa.int32()), ("row", pa.list_(pa.float64()))])
    ddl = "i int, part int, row array<double>"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                z = features(_rows(batch, _NAMES))
                part = z.T @ np.hstack([z, _rows(batch, ["quality"])])
                total = part if total is None else total + part
        if total is not None:
            part = TaskContext.get().partitionId()
            flat = pa.ListArray.from_arrays(np.arange(len(total) + 1, dtype=np.int32) * total.shape[1], total.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([part] * len(total), pa.int32()), flat], schema=kind)

    def add(group: pa.Table) -> pa.Table:
        rows = group.sort_by("part").column("row").combine_chunks()
        summed = rows.flatten().to_numpy().reshape(len(rows), -1).sum(0)
        return pa.table([group.column("i")[:1], pa.array([group.column("part")[0].as_py() // fan_in], pa.int32()), pa.array([summed.tolist()])], schema=kind)

    summed = materialise(train.mapInArrow(partial, ddl), "quality-sums")
    parts = summed.agg(F.max("part")).first()[0] + 1
    while parts > 0:
        summed = summed.groupBy("i", F.expr(f"part div {fan_in}")).applyInArrow(add, ddl)
        parts = -(-parts // fan_in) if parts > fan_in else 0
    whole = np.array([r["row"] for r in sorted(summed.collect(), key=lambda r: r["i"])])
    return whole[:, :-1], whole[:, -1]


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising levels of ``y`` along sorted ``x``: neighbours that fall are pooled, knots are pool means."""
    pools: list[list[float]] = []
    for a, b, w in zip(x, y, weight, strict=True):
        pools.append([a * w, b * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    at = np.array(pools)
    return at[:, 0] / at[:, 2], np.clip(at[:, 1] / at[:, 2], 0, 1)


def fit(statistics_: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on every labelled row that is not held out; None without such rows."""
    marks = labels.filter(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.avg("quality").alias("quality"))
    marked = materialise(statistics_.join(marks, "doc_id").withColumn("_part", remainder(F.col("doc_id"))).filter(
        F.col("_part") != HELD_OUT), "quality-marked")
    spread = marked.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_part") == 3).alias("c"),
                        *(f(n).alias(f"{f.__name__}_{n}") for n in _NAMES for f in (F.avg, F.stddev_pop))).first()
    if not spread["n"]:
        return None
    scale = np.array([spread[f"stddev_pop_{n}"] for n in _NAMES])
    features = Features(np.array([spread[f"avg_{n}"] for n in _NAMES]), np.where(scale > 1e-9, scale, 1.0))
    split = 0 < spread["c"] < spread["n"]
    left, right = normal_equations(marked.filter("_part <> 3") if split else marked, features)
    weights = np.linalg.solve(left + RIDGE * np.eye(len(left)), right)
    ridge = Model(features, weights, np.zeros(1), np.zeros(1))

    def raw_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array(ridge.raw(_rows(batch, _NAMES))), pa.array(_rows(batch, ["quality"])[:, 0])], names=["raw", "quality"])

    raw = (marked.filter("_part = 3") if split else marked).mapInArrow(raw_scores, "raw double, quality double")
    bins = raw.groupBy(F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(2.0), "raw")) * (BINS / 3)).alias("bin")).agg(
        F.avg("raw").alias("x"), F.avg("quality").alias("y"), F.count(F.lit(1)).alias("w")).orderBy("bin").collect()
    knots, levels = isotonic(*(np.array([r[c] for r in bins], float) for c in "xyw"))
    return Model(features, weights, knots, levels)


def scored(statistics_: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, text_hash and score of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_rows(batch, _NAMES)) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(score)],
                                             names=["doc_id", "text_hash", "score"])

    return statistics_.mapInArrow(run, "doc_id long, text_hash long, score double")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    stats = document_statistics(docs)
    return scored(stats, fit(stats, labels)).select(
        "doc_id", (remainder(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that are predicted good; without labels nothing is rejected."""
    stats = document_statistics(docs)
    model = fit(stats, labels)
    if model is None:
        return docs
    rejected = materialise(scored(stats, model).filter(F.col("score") < THRESHOLD).select(
        "doc_id", "text_hash").distinct(), "quality-rejected")
    rows, rejected = keyed(docs), few(rejected)
    return rows.join(rejected, on_key(rows, rejected), "left_anti").select("row.*")


@query("op5_quality_classifier")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
