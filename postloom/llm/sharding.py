"""Sharding over fixed virtual slots with a versioned slot-to-shard map.

Records hash into ``slots`` virtual slots (a fixed number, so a map has a proven size). Bytes and rows are
summed per slot; a map gives each slot a shard. Rebalancing and adding a shard edit the map, never the hash,
so only the records of moved slots move. Every version of a map is a Parquet folder ``version=N``.

Cases: a null text has size 1 and the CRC of no bytes (0); a null id hashes by its text; repeated rows are
placed one by one; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postloom.llm.common import materialise, query, table
from postloom.session import shared_dir

SLOTS = 4096
MAP_SCHEMA = "slot int, shard int, bytes long, rows long"


def slot_of(key: Column, fallback: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a record: its key decides, for a null key the fallback."""
    return F.pmod(F.xxhash64(key, F.when(key.isNull(), fallback)), F.lit(slots)).cast("int")


def sized_records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of each record, without its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        slot_of(F.col("doc_id"), F.col("text"), slots).alias("virtual_slot"),
    )


def slot_loads(records: DataFrame) -> DataFrame:
    """Bytes and rows per slot; combined before the shuffle, at most one row per slot."""
    return records.groupBy(F.col("virtual_slot").alias("slot")).agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def first_map(loads: DataFrame, shards: int, slots: int = SLOTS) -> list[tuple[int, int, int, int]]:
    """Slots by falling bytes, each to the lightest shard. ``loads`` has at most ``slots`` rows."""
    seen = {r["slot"]: (r["bytes"], r["rows"]) for r in loads.collect()}
    heap = [(0, s) for s in range(shards)]
    out = []
    for slot in sorted(range(slots), key=lambda s: (-seen.get(s, (0, 0))[0], s)):
        size, rows = seen.get(slot, (0, 0))
        load, shard = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, shard))
        out.append((slot, shard, size, rows))
    return sorted(out)


def edited_map(entries: list[tuple[int, int, int, int]], loads: DataFrame, shards: int,
               tolerance: float = 0.01) -> list[tuple[int, int, int, int]]:
    """Move as few slots as needed from heavy shards to light ones, for new loads or a new shard count.

    The largest slot that fits between the heaviest and the lightest shard moves, until the two differ by
    at most ``tolerance`` of the mean. Slots of shards that no longer exist move first.
    """
    seen = {r["slot"]: (r["bytes"], r["rows"]) for r in loads.collect()}
    size = {slot: seen.get(slot, (0, 0))[0] for slot, *_ in entries}
    shard = {slot: s for slot, s, *_ in entries}
    load = [0] * shards
    for slot, s in shard.items():
        if s < shards:
            load[s] += size[slot]
    for slot in sorted((x for x, s in shard.items() if s >= shards), key=lambda x: (-size[x], x)):
        shard[slot] = min(range(shards), key=lambda s: (load[s], s))
        load[shard[slot]] += size[slot]
    mean = sum(load) / shards
    for _ in range(len(entries)):
        low, high = min(range(shards), key=lambda s: (load[s], s)), max(range(shards), key=lambda s: (load[s], -s))
        gap = load[high] - load[low]
        fits = [x for x, s in shard.items() if s == high and 0 < size[x] < gap]
        if gap <= tolerance * mean or not fits:
            break
        slot = min(fits, key=lambda x: (abs(gap / 2 - size[x]), x))
        shard[slot] = low
        load[high] -= size[slot]
        load[low] += size[slot]
    return sorted((slot, s, *seen.get(slot, (0, 0))) for slot, s in shard.items())


def write_map(spark: SparkSession, entries: list[tuple[int, int, int, int]], path: str, version: int) -> None:
    """Store one version of a map; writing the same version again replaces it."""
    spark.createDataFrame(entries, MAP_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP_SCHEMA).parquet(f"{path}/version={version}")


def place(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Give each record its shard and its place in it, gapless from 0.

    A place is the rows of earlier slots of the shard plus the rank within the slot, so that a shard of any
    size is numbered by as many tasks as it has slots. The map is broadcast: it has one row per slot.
    """
    offsets = slot_map.select(
        F.col("slot").alias("virtual_slot"), "shard",
        (F.sum("rows").over(Window.partitionBy("shard").orderBy("slot")) - F.col("rows")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32"))
    return records.join(F.broadcast(offsets), "virtual_slot").select(
        "doc_id", "size", "text_crc32", "shard", "virtual_slot",
        (F.col("_before") + rank - 1).cast("long").alias("slot"))


@query("op1_sharding")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of near equal bytes."""
    records = materialise(sized_records(table(spark, sf_dir, "documents")), "shard-records")
    maps = shared_dir(spark, "shard-map")
    write_map(spark, first_map(slot_loads(records), 8), maps, 1)
    placed = place(records, read_map(spark, maps, 1))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(1).alias("map_version"))
