"""Line de-duplication that can be taken back: sharded cuckoo filters over exact tables of reference counts.

The index is a folder of versions. A version holds ``counts`` (key, n_docs), the exact number of documents that hold
each line key, and ``filters`` (shard, filter), a cuckoo filter per shard with the keys held by at least ``min_docs``
documents. A change adds documents or takes documents away: it is summed per key before the shuffle, merged into the counts,
and keys that pass the threshold upwards or downwards are inserted into, or deleted from, the filter of their shard. Taking
away what was added gives the counts and filters' keys as they were, and lines come back in the texts.

A text is cleaned in two steps. The filters say which of its lines may be frequent (no frequent line is missed); texts
without such a line are finished there and never shuffled. The lines left are checked against the exact counts, so a false
positive drops nothing.

A key is the line without white space ``[\\x20\\x09-\\x0D]`` at both ends, with A-Z in lower case, as a hash of 128 bits; keys of
fewer than ``min_chars`` code points are never counted or dropped. A document counts once per key, however often it
repeats the line.

Scale: a shard holds at most SHARD_KEYS frequent keys; filters are held by tasks up to FILTER_BYTES in all, beyond that every line goes to the
exact check, with the same result. A line that many documents share is summed before the shuffle when counted, and meets
its count by broadcast, or salted, when checked.

Cases: a null or empty text is one empty line; every row is a document, so repeated rows and ids count one by one; texts that
are equal lose the same lines; a null id is an id; lines and texts of any length are handled whole; an empty
table gives an index without keys and no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.common import BROADCAST_ROWS, materialise, query, small_batches, table
from postloom.session import shared_dir
from postloom.sources import snapshots

MIN_DOCS, MIN_CHARS = 10, 1
#: Fewest shards, and frequent keys of a shard beyond which shards are doubled.
SHARDS, SHARD_KEYS = 16, 50_000
#: Filters that a task may hold in all; beyond it lines are checked without them.
FILTER_BYTES = 64 << 20
#: Parts of a key's exact entry when the frequent keys are too many to broadcast.
SALTS = 16
SLOTS = 4
KICKS = 500
#: Share of the slots that may be used.
FULL = 0.8
_SPACE = b" \t\n\x0b\x0c\r"
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_COUNTS = "k1 long, k2 long, n_docs long"
_FILTERS = "shard int, n_keys long, filter binary, shards int"


# ---------------------------------------------------------------------------------------------- cuckoo filter

def _mixed(x: np.ndarray) -> np.ndarray:
    """A second hash of 64-bit numbers: multiply and shift."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


class Cuckoo:
    """Buckets of four 16-bit fingerprints; the other bucket of a fingerprint is found from the bucket and it alone.

    Equal fingerprints in equal buckets are stored as often as inserted, so a deletion takes away one key only.
    """

    def __init__(self, slots: np.ndarray) -> None:
        self.slots = slots
        self.mask = np.uint64(len(slots) - 1)

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        buckets = 1
        while buckets * SLOTS * FULL < keys:
            buckets *= 2
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def read(cls, held: bytes) -> Cuckoo:
        return cls(np.frombuffer(held, np.uint16).reshape(-1, SLOTS).copy())

    def tobytes(self) -> bytes:
        return self.slots.tobytes()

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mixed = _mixed(keys)
        prints = (mixed >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        first = mixed & self.mask
        return prints, first, self._other(first, prints)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return bucket ^ (_mixed(prints) & self.mask)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        prints, first, second = self._places(keys)
        wanted = prints[:, None]
        return ((self.slots[first] == wanted) | (self.slots[second] == wanted)).any(1)

    def insert(self, keys: np.ndarray) -> bool:
        """Add all keys; False if there is no room (the filter is then to be built anew, larger)."""
        prints, *buckets = self._places(keys)
        left = np.arange(len(keys))
        for bucket in buckets:  # all that find a free slot at once, first in one bucket, then in the other
            left = left[np.argsort(bucket[left], kind="stable")]
            at = bucket[left]
            nth = np.arange(len(at)) - np.searchsorted(at, at)
            used = self.slots[at] != 0
            fits = nth < SLOTS - used.sum(1)
            slot = np.argsort(used, axis=1, kind="stable")[np.flatnonzero(fits), nth[fits]]
            self.slots[at[fits], slot] = prints[left[fits]]
            left = left[~fits]
        turn = np.random.default_rng(1)
        for moved, at in zip(prints[left].tolist(), buckets[0][left].tolist(), strict=True):
            for slot in turn.integers(0, SLOTS, KICKS).tolist():
                moved, self.slots[at, slot] = int(self.slots[at, slot]), moved
                at = int(self._other(np.array([at], np.uint64), np.array([moved], np.uint16))[0])
                if self._put(moved, at):
                    break
            else:
                return False
        return True

    def _put(self, fingerprint: int, bucket: int) -> bool:
        free = np.flatnonzero(self.slots[bucket] == 0)
        if len(free):
            self.slots[bucket, free[0]] = fingerprint
        return len(free) > 0

    def delete(self, keys: np.ndarray) -> None:
        """Take away keys that were inserted."""
        for fingerprint, one, two in zip(*(x.tolist() for x in self._places(keys)), strict=True):
            for bucket in (one, two):
                at = np.flatnonzero(self.slots[bucket] == fingerprint)
                if len(at):
                    self.slots[bucket, at[0]] = 0
                    break
            else:
                raise ValueError("a key was to be deleted that the filter does not hold")


# --------------------------------------------------------------------------------------------------- line keys

def line_keys(text: bytes, min_chars: int = MIN_CHARS) -> list[bytes]:
    """Per line of a text its key of 16 bytes, empty where the line is too short."""
    keys = []
    for line in text.translate(_FOLD).split(b"\n"):
        bare = line.strip(_SPACE)
        chars = len(bare) if min_chars < 2 else len(bare.decode("utf-8", "replace"))
        keys.append(hashlib.blake2b(bare, digest_size=16).digest() if chars >= min_chars else b"")
    return keys


def _numbers(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def change(docs: DataFrame, sign: int, min_chars: int = MIN_CHARS) -> DataFrame:
    """(k1, k2, n_docs): how many documents hold each key, times ``sign``; summed before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [key for text in batch.column(0).cast(pa.binary()) for key in set(line_keys(text.as_py() or b"", min_chars)) if key]
            yield pa.RecordBatch.from_arrays([pa.array(k) for k in _numbers(held)], names=["k1", "k2"])

    keys = small_batches(docs.select("text")).mapInArrow(run, "k1 long, k2 long")
    return keys.groupBy("k1", "k2").agg((F.count(F.lit(1)) * sign).cast("long").alias("n_docs"))


# ------------------------------------------------------------------------------------------------------- index

def _filters_after(held: pa.Table, moves: pa.Table) -> pa.Table:
    """The filter of one shard after its moves (k1, move: 1 now frequent, -1 no longer, 0 frequent before and after)."""
    shard = (held if len(held) else moves).column("shard")[0].as_py()
    keys, move = moves.column("k1").to_numpy(), moves.column("move").to_numpy()
    now = int((move >= 0).sum())
    current = Cuckoo.read(held.column("filter")[0].as_py()) if len(held) else Cuckoo.sized(now)
    current.delete(keys[move < 0])
    done, size = now <= FULL * current.slots.size and current.insert(keys[move > 0]), now
    while not done:  # no room: the exact table gives all keys for a larger one
        current = Cuckoo.sized(size)
        done, size = current.insert(keys[move >= 0]), 2 * size
    return pa.table({"shard": pa.array([shard], pa.int32()), "n_keys": pa.array([now], pa.int64()), "filter": pa.array([current.tobytes()], pa.binary())})


class LineIndex:
    """Versions of the counts and filters in one folder that all executors share.

    A version is whole once its filters are, which are written last; an interrupted change leaves the version before it.
    The number of shards is a power of two that grows with the frequent keys; on growth the filters are built anew.
    """

    def __init__(self, spark: SparkSession, folder: str, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.min_docs, self.min_chars = max(1, min_docs), min_chars

    def version(self) -> int | None:
        """The newest whole version; None is the empty index."""
        return max(snapshots.versions(self.spark, f"{self.folder}/filters"), default=None)

    def counts(self, version: int | None = None) -> DataFrame:
        return self._table("counts", _COUNTS, version)

    def filters(self, version: int | None = None) -> DataFrame:
        return self._table("filters", _FILTERS, version)

    def _table(self, name: str, schema: str, version: int | None) -> DataFrame:
        version = self.version() if version is None else version
        if version is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/v={version}")

    def apply(self, added: DataFrame | None = None, removed: DataFrame | None = None) -> int:
        """Add and take away documents (rows with ``text``) as one new version; its number.

        Raises if a document is taken away whose lines the index does not hold; the index stays as it was.
        """
        old = self.version()
        merged = self.counts(old).withColumn("was", F.col("n_docs"))
        for docs, sign in ((added, 1), (removed, -1)):
            if docs is not None:
                merged = merged.unionByName(change(docs, sign, self.min_chars).withColumn("was", F.lit(0).cast("long")))
        merged = materialise(merged.groupBy("k1", "k2").agg(F.sum("n_docs").alias("n_docs"), F.sum("was").alias("was")), "line-counts")
        frequent, before = F.col("n_docs") >= self.min_docs, F.col("was") >= self.min_docs
        seen = merged.agg(F.count_if(F.col("n_docs") < 0).alias("wrong"), F.count_if(frequent).alias("frequent")).first()
        if seen["wrong"]:
            raise ValueError("a document was to be taken away that the index does not hold")
        new = 0 if old is None else old + 1
        merged.filter("n_docs > 0").select("k1", "k2", "n_docs").write.mode("overwrite").parquet(f"{self.folder}/counts/v={new}")
        held = self.filters(old)
        had = held.agg(F.coalesce(F.first("shards"), F.lit(SHARDS)).alias("n")).first()["n"]
        shards = had
        while shards * SHARD_KEYS < seen["frequent"]:
            shards *= 2
        if shards > had:
            held, before = held.limit(0), F.lit(False)
        moves = merged.filter(frequent | before).select(
            F.pmod("k1", F.lit(shards)).cast("int").alias("shard"), "k1", F.when(frequent & before, 0).when(frequent, 1).otherwise(-1).alias("move"))
        made = held.select("shard", "filter").groupBy("shard").cogroup(moves.groupBy("shard")).applyInArrow(
            _filters_after, "shard int, n_keys long, filter binary")
        made.withColumn("shards", F.lit(shards)).write.mode("overwrite").parquet(f"{self.folder}/filters/v={new}")
        return new

    # ---------------------------------------------------------------------------------------------- cleaning

    def _probe(self, version: int | None):
        """A mapInArrow function that numbers texts and adds to each the lines that the filters do not rule out."""
        held = self.filters(version)
        size = held.agg(F.coalesce(F.sum(F.length("filter")), F.lit(0)).alias("bytes"), F.coalesce(F.first("shards"), F.lit(SHARDS)).alias("n")).first()
        shards, shared, min_chars = size["n"], None, self.min_chars
        if size["bytes"] <= FILTER_BYTES:
            shared = self.spark.sparkContext.broadcast({r["shard"]: r["filter"] for r in held.select("shard", "filter").collect()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = None if shared is None else {s: Cuckoo.read(b) for s, b in shared.value.items()}
            number = TaskContext.get().partitionId() << 33
            for batch in batches:
                lines = [line_keys(text.as_py() or b"", min_chars) for text in batch.column(1).cast(pa.binary())]
                cuts = np.r_[0, np.cumsum([len(x) for x in lines], dtype=np.int64)]
                there = np.array([len(key) > 0 for x in lines for key in x], bool)
                k1, k2 = _numbers([key for x in lines for key in x])
                maybe = np.ones(len(k1), bool)
                if filters is not None:
                    shard = k1 % shards
                    for s in np.unique(shard).tolist():
                        of = np.flatnonzero(shard == s)
                        maybe[of] = filters[s].holds(k1[of]) if s in filters else False
                at = np.flatnonzero(there)[maybe]
                lists = np.searchsorted(at, cuts)
                place = at - np.repeat(cuts[:-1], np.diff(lists))
                fields = pa.StructArray.from_arrays([pa.array(place, pa.int32()), pa.array(k1[maybe]), pa.array(k2[maybe])], names=["line", "k1", "k2"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(range(number, number + len(lines)), pa.int64()), pa.array(np.diff(cuts)),
                     pa.ListArray.from_arrays(pa.array(lists, pa.int32()), fields)], names=["doc_id", "text", "row", "n_lines", "maybe"])
                number += len(lines)

        return run

    def cleaned(self, docs: DataFrame, version: int | None = None) -> DataFrame:
        """doc_id, text without its frequent lines, n_lines (before) and n_dropped of each row of ``docs(doc_id, text)``."""
        version = self.version() if version is None else version
        rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
        # written once: texts with a possibly frequent line and texts without part ways here
        probed = materialise(small_batches(rows).mapInArrow(self._probe(version), (
            "doc_id long, text string, row long, n_lines long, maybe array<struct<line: int, k1: long, k2: long>>")), "lines-probed")
        whole = probed.filter("size(maybe) = 0").select("doc_id", "text", "n_lines", F.lit(0).cast("long").alias("n_dropped"))
        suspect = probed.filter("size(maybe) > 0")
        lines = suspect.select("row", F.inline("maybe"))
        frequent = self.counts(version).filter(F.col("n_docs") >= self.min_docs).select("k1", "k2")
        if frequent.count() <= BROADCAST_ROWS:
            sure = lines.join(F.broadcast(frequent), ["k1", "k2"])
        else:
            salted = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            sure = lines.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["k1", "k2", "salt"])
        drops = sure.groupBy("row").agg(F.collect_list("line").alias("drop"))  # at most the lines of one text
        named = suspect.join(drops, "row", "left").select("doc_id", "text", "n_lines", F.coalesce("drop", F.array().cast("array<int>")).alias("drop"))
        return whole.unionByName(small_batches(named).mapInArrow(_without, "doc_id long, text string, n_lines long, n_dropped long"))


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the lines at the places ``drop``."""
    for batch in batches:
        texts, dropped = [], []
        for text, drop in zip(batch.column(1).cast(pa.binary()), batch.column(3).to_pylist(), strict=True):
            gone = set(drop)
            texts.append(b"\n".join(line for i, line in enumerate(text.as_py().split(b"\n")) if i not in gone))
            dropped.append(len(gone))
        kept = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.r_[0, np.cumsum([len(t) for t in texts], dtype=np.int64)]), pa.py_buffer(b"".join(texts)))
        yield pa.RecordBatch.from_arrays([batch.column(0), kept.cast(pa.string()), batch.column(2), pa.array(dropped, pa.int64())],
                                         names=["doc_id", "text", "n_lines", "n_dropped"])


@query("op13_line_dedup", r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line, unnest(range(length(text) - length(replace(text, chr(10), '')) + 1)) AS i FROM docs),
keyed AS (SELECT rid, line, i, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
frequent AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10),
judged AS (SELECT k.rid, k.line, k.i, f.key IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT d.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM docs d JOIN judged j ON d.rid = j.rid GROUP BY d.rid, d.doc_id""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that at least 10 documents hold."""
    docs = table(spark, sf_dir, "documents")
    index = LineIndex(spark, shared_dir(spark, "line-index"))
    version = index.apply(added=docs)
    return index.cleaned(docs, version).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
