"""Sharding against a plain recomputation from the stored map."""

import zlib
from collections import defaultdict

from postloom.llm import sharding
from postloom.llm.catalog import QUERIES
from llm_helpers import SF


def brute_map(loads, shards, slots):
    """Slots by falling bytes, each to the shard with the fewest bytes so far."""
    held = [0] * shards
    chosen = {}
    for slot in sorted(range(slots), key=lambda s: (-loads.get(s, 0), s)):
        shard = min(range(shards), key=lambda s: (held[s], s))
        chosen[slot] = shard
        held[shard] += loads.get(slot, 0)
    return chosen


def test_shards_and_places_follow_the_map(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op1_sharding"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    loads = defaultdict(int)
    for r in got:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        loads[r["virtual_slot"]] += r["size"]
    chosen = brute_map(loads, 8, sharding.SLOTS)
    assert all(r["shard"] == chosen[r["virtual_slot"]] for r in got)
    order = sorted(got, key=lambda r: (r["shard"], r["virtual_slot"], r["doc_id"], r["size"], r["text_crc32"]))
    place = defaultdict(int)
    for r in order:
        assert r["slot"] == place[r["shard"]]
        place[r["shard"]] += 1


def test_an_edited_map_is_a_new_version_that_moves_few_slots(spark, tmp_path):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('w', CAST(id % 90 AS INT)) AS text")
    records = sharding.sized_records(docs)
    loads = sharding.slot_loads(records)
    first = sharding.first_map(loads, 4)
    sharding.write_map(spark, first, str(tmp_path), 1)
    sharding.write_map(spark, sharding.edited_map(first, loads, 5), str(tmp_path), 2)
    one, two = ({r["doc_id"]: r["shard"] for r in sharding.place(records, sharding.read_map(spark, str(tmp_path), v)).collect()} for v in (1, 2))
    moved = [i for i in one if one[i] != two[i]]
    assert set(two.values()) == set(range(5)) and all(two[i] == 4 for i in moved) and len(moved) <= 3000 * 0.25
    sizes = defaultdict(int)
    for i, s in two.items():
        sizes[s] += i % 90 + 1
    assert max(sizes.values()) <= 1.03 * min(sizes.values())
