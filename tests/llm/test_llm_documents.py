"""Sharding, mixing, classifier and Jaccard join against brute force and on odd rows."""

import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postloom.llm import common, jaccard, mixing, quality, sharding
from postloom.llm.catalog import QUERIES
from postloom.llm.components import components
from llm_helpers import SF, odd_rows, shingles, words


def placed_rows(records):
    loads = sharding.slot_loads(records)
    spark = records.sparkSession
    entries = sharding.first_map(loads, 8)
    return sharding.place(records, spark.createDataFrame(entries, sharding.MAP_SCHEMA)).collect(), entries, loads


def test_sharding_odd_rows(odd, nothing):
    rows, _, _ = placed_rows(sharding.sized_records(odd))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in odd_rows())
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert placed_rows(sharding.sized_records(nothing))[0] == []


def test_sharding_balances_and_edits(spark, tmp_path):
    records = sharding.sized_records(spark.read.parquet(f"{SF}/documents.parquet"))
    rows, entries, loads = placed_rows(records)
    load = Counter()
    for r in rows:
        load[r["shard"]] += r["size"]
    assert max(load.values()) - min(load[s] for s in range(8)) <= max(r["size"] for r in rows)
    grown = sharding.edited_map(entries, loads, 9)
    moved = [(a, b) for a, b in zip(entries, grown, strict=True) if a[1] != b[1]]
    grown_load = Counter()
    for _, shard, size, _ in grown:
        grown_load[shard] += size
    total = sum(load.values())
    assert sum(a[2] for a, _ in moved) < 0.2 * total and max(grown_load.values()) - min(grown_load.values()) <= 0.25 * total / 9
    shrunk = sharding.edited_map(grown, loads, 8)
    assert {s for _, s, *_ in shrunk} <= set(range(8))
    for version, m in enumerate((entries, grown, grown)):
        sharding.write_map(spark, m, str(tmp_path), min(version, 1))
    assert [tuple(r) for r in sharding.read_map(spark, str(tmp_path), 1).orderBy("slot").collect()] == grown


def brute_targets(sizes):
    total, order = 1.5 * sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    capped = set()
    while True:
        left = total - sum(2 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in order if x not in capped) for s in order if s not in capped}
        over = {s for s in share if share[s] > 2 * sizes[s]}
        if not over:
            return {s: float(2 * sizes[s]) if s in capped else share[s] for s in order}
        capped |= over


def check_mix(rows):
    sizes = Counter()
    taken = Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = brute_targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5


def test_mixing_against_water_filling(spark, odd, nothing):
    rows = mixing.mix(odd).collect()
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((i, len(words(t))) for i, t, *_ in odd_rows())
    check_mix(rows)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_mix(mixing.mix(docs, block_words=64).collect())
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert mixing.mix(nothing).collect() == []


def test_schedule_is_even(spark):
    targets = spark.createDataFrame([(0, "a", 40_000, 60_000.0), (1, "b", 30_000, 20_000.0), (2, "c", 10_000, 10_000.0)],
                                    "sid int, source string, source_size long, target double")
    plan = mixing.stream_plan(targets, 100)
    got = [(r["position"], r["sid"]) for r in mixing.schedule(plan, 100).orderBy("position").collect()]
    assert Counter(s for _, s in got) == {0: 600, 1: 200, 2: 100}
    for n in (50, 200, 450, 900):
        seen = Counter(s for _, s in got[:n])
        assert all(abs(seen[s] - n * p / 9) < 12 for s, p in ((0, 6), (1, 2), (2, 1)))


def test_mix_repeats_rows(odd, nothing):
    rows = mixing.repeated(odd).collect()
    assert mixing.repeated(odd).columns == odd.columns and all(words(r["text"]) for r in rows)
    assert max(Counter((r["size"]) for r in rows).values()) <= 2
    assert mixing.repeated(nothing).collect() == []


def test_mix_shares_repeats_among_equal_rows(spark):
    docs = [(1, "five words are in here", "a")] * 400 + [(2, "five words are in there", "b")] * 1000
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    target = {r["source"]: r["target"] / 5 for r in mixing.mix(df).select("source", "target").distinct().collect()}
    got = Counter(r["source"] for r in mixing.repeated(df).collect())
    assert all(abs(got[s] - t) <= 1 for s, t in target.items())


def test_classifier_on_held_out_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r["doc_id"]: r for r in quality.judge(docs, labels).collect()}
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [i for i in marks if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert sum(got[i]["predicted"] == marks[i] for i in held) / len(held) > 0.93
    flipped = labels.withColumn("quality", F.when(quality.remainder(F.col("doc_id")) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in quality.judge(docs, flipped).collect()}
    assert all(abs(again[i] - got[i]["score"]) < 1e-6 for i in got)


def test_normal_equations_against_numpy(spark):
    draw = np.random.default_rng(4)
    width = len(quality.STATISTICS)
    rows = draw.normal(size=(500, width))
    marks = draw.integers(0, 2, 500)
    train = spark.createDataFrame([(*map(float, r), int(m)) for r, m in zip(rows, marks)],
                                  ", ".join([*(f"s_{n} double" for n in quality.STATISTICS), "quality int"])).repartition(11)
    features = quality.Features(np.zeros(width), np.ones(width))
    z = features(rows)
    for fan_in in (2, 3, 11, 256):  # any number of rounds gives the same sums
        left, right = quality.normal_equations(train, features, fan_in)
        assert np.allclose(left, z.T @ z) and np.allclose(right, z.T @ marks)


def test_isotonic_against_the_min_max_formula():
    draw = np.random.default_rng(6)
    for n in (1, 2, 7, 40):
        x, y, w = np.sort(draw.normal(size=n)), draw.random(n), draw.integers(1, 9, n).astype(float)
        want = [max(min(np.average(y[j:k + 1], weights=w[j:k + 1]) for k in range(i, n)) for j in range(i + 1)) for i in range(n)]
        knots, levels = quality.isotonic(x, y, w)
        assert np.all(np.diff(levels) > 0) and np.allclose(sorted(set(np.round(want, 9))), np.round(levels, 9))
        assert np.all(np.diff(knots) > 0)


def test_classifier_odd_rows(spark, odd, nothing):
    kind = "doc_id long, quality int, toxic int, score string"
    labels = spark.createDataFrame([(1, 1, 0, ""), (1, 0, 0, ""), (2, None, 0, ""), (3, 0, 0, ""), (4, 1, 0, ""), (8, 1, 0, ""), (None, 1, 0, "")], kind)
    rows = quality.judge(odd, labels).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, *_ in odd_rows())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] is not None for r in rows)
    none = labels.limit(0)
    assert {r["score"] for r in quality.judge(odd, none).collect()} == {0.5}
    assert quality.accepted(odd, none).count() == len(odd_rows()) and quality.accepted(odd, labels).columns == odd.columns
    assert quality.judge(nothing, labels).collect() == [] and quality.accepted(nothing, labels).collect() == []


def brute_components(rows):
    sets, parent, links = [shingles(t) for _, t in rows], list(range(len(rows))), Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
                links[i] += 1
                links[j] += 1
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return Counter((doc, len(sets[i]), least.get(root(i)), links[i]) for i, (doc, _) in enumerate(rows))


@pytest.fixture(params=["broadcast", "frequent keys apart"])
def bounds(request, monkeypatch):
    """Joins with tables of one row per key: all keys few, or too many with some frequent."""
    if request.param != "broadcast":
        monkeypatch.setattr(common, "BROADCAST_ROWS", 4)
        monkeypatch.setattr(common, "HOT_ROWS", 3)


def test_jaccard_odd_rows(odd, nothing, bounds):
    assert Counter(map(tuple, jaccard.jaccard_join(odd).collect())) == brute_components([(i, t) for i, t, *_ in odd_rows()])
    assert jaccard.jaccard_join(nothing).collect() == [] and jaccard.one_per_component(nothing).collect() == []
    kept = jaccard.one_per_component(odd)
    left = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert kept.columns == odd.columns
    assert {(i, t) for i, t in left if shingles(t)} == {(i, t) for i, t, *_ in odd_rows() if i not in (2, 4, 9) and shingles(t) and (i, t) != (None, odd_rows()[0][1])}
    assert sum(not shingles(t) for _, t in left) == sum(not shingles(t) for _, t, *_ in odd_rows())
    assert Counter(i for i, _ in left)[13] == 1


def test_jaccard_families(spark, bounds):
    import random

    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(rnd.choices(vocabulary, k=40))
    rows = []
    for family in range(12):
        base = rnd.choices(vocabulary, k=rnd.choice((6, 30, 80, 150)))
        for _ in range(12):
            w = list(base)
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            rows.append((len(rows), " ".join(w) + (" " + passage if family % 3 == 0 else "")))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, jaccard.jaccard_join(docs).collect())) == brute_components(rows)


def test_rows_of_a_frequent_key_never_meet(spark, monkeypatch):
    """5,000 of 9,000 rows have one key; no task of the join reads more than a share of them."""
    rows = spark.range(9000, numPartitions=6).selectExpr("id", "IF(id < 5000, 1, id) AS k")
    one = rows.groupBy("k").agg(F.count("*").alias("held"), F.min("id").alias("least"))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1000)
    monkeypatch.setattr(common, "HOT_ROWS", 100)
    joined = common.join_one(rows, one, "k", "held", 9000, 4001)
    assert {(r["id"], r["least"]) for r in joined.collect()} == {(i, 0 if i < 5000 else i) for i in range(9000)} and joined.count() == 9000
    place = joined.filter("k = 1").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert place <= 1500


def test_jaccard_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert Counter(map(tuple, QUERIES["op9_jaccard_join"](spark, SF).collect())) == brute_components(rows)


def test_components_of_chains_and_hubs(spark, bounds):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(50)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_the_schedule_decides_the_order_of_the_mix(spark, monkeypatch):
    docs = spark.range(600).selectExpr("id AS doc_id", "repeat('w ', 50) AS text", "array('a', 'b', 'c')[id % 3] AS source")
    rows = mixing.mix(docs, block_words=64).collect()
    taken = [(r["position"], r["source"], r["size"]) for r in rows if r["taken"]] + [(r["again"], r["source"], r["size"]) for r in rows if r["again"] is not None]
    assert all((r["position"] is not None) == (r["taken"] > 0) and (r["again"] is None or r["again"] > r["position"]) for r in rows)
    taken.sort()
    target = {r["source"]: r["target"] for r in rows}
    whole, seen = sum(target.values()), Counter()
    for n, (_, source, size) in enumerate(taken):  # every first part of the mix has the sources near their shares
        seen[source] += size
        if n > 60:
            assert all(abs(seen[s] / sum(seen.values()) - target[s] / whole) < 0.08 for s in target)
    order = mixing.repeated(docs, in_order=True).select("doc_id").collect()
    monkeypatch.setattr(mixing, "van_der_corput", lambda n, digits=0: F.lit(0.5))
    other = mixing.mix(docs, block_words=64).collect()
    assert {(r["doc_id"], r["position"]) for r in other} != {(r["doc_id"], r["position"]) for r in rows}
    assert mixing.repeated(docs, in_order=True).select("doc_id").collect() != order


def test_sharding_against_the_map(spark):
    """The map's bytes recomputed from the records, and the shard of every row from the map."""
    records = sharding.sized_records(spark.read.parquet(f"{SF}/documents.parquet"))
    rows, entries, _ = placed_rows(records)
    held, slot = Counter(), {}
    for r in records.collect():
        held[r["virtual_slot"]] += r["size"]
        slot[r["doc_id"]] = r["virtual_slot"]
    shard = {e[0]: e[1] for e in entries}
    assert {e[0]: e[2] for e in entries if e[2]} == dict(held) and set(shard) == set(range(sharding.SLOTS))
    assert all(r["shard"] == shard[slot[r["doc_id"]]] for r in rows) and len(rows) == len(slot)


def test_meetings_of_near_copies_in_many_groups_are_counted_some_at_a_time():
    groups, per, tokens = 100, 10, 50
    sets = np.arange(groups * per)
    one = np.tile(np.arange(tokens, dtype=np.uint32) * 7, len(sets))
    batch = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((
        [3], [one.tobytes()], [(sets + 1000).tobytes()], [np.repeat(sets, tokens).astype(np.uint16).tobytes()],
        [np.concatenate([sets // per - 50, np.full(len(sets), 7)]).tobytes()]), jaccard._CHUNK, strict=True)], schema=jaccard._CHUNK)
    met, most = {}, 0
    tracemalloc.start()
    for rows in jaccard._meetings(iter([batch])):
        most = max(most, tracemalloc.get_traced_memory()[1])
        for a, b, *sides in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            for home, other, side in zip((a, b), (b, a), sides, strict=True):
                for name, hits, least in np.frombuffer(side, np.int64).reshape(-1, 3).tolist():
                    assert (name - 1000) // per - 50 == home and least == 7
                    met[name, other] = met.get((name, other), 0) + hits
        tracemalloc.clear_traces()
    tracemalloc.stop()
    assert met == {(name + 1000, g - 50): tokens for name in sets.tolist() for g in range(groups)}
    assert most < 40_000_000


def test_meetings_of_a_family_have_rows_by_its_groups_however_many_its_sets():
    groups, tokens, rows = 20, 50, {}
    for per in (30, 400):
        sets = np.arange(groups * per)
        batch = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((
            [3], [np.tile(np.arange(tokens, dtype=np.uint32), len(sets)).tobytes()], [sets.tobytes()],
            [np.repeat(sets, tokens).astype(np.uint16).tobytes()],
            [np.concatenate([sets // per, np.full(len(sets), 7)]).tobytes()]), jaccard._CHUNK, strict=True)], schema=jaccard._CHUNK)
        rows[per], met = 0, Counter()
        for part in jaccard._meetings(iter([batch])):
            rows[per] += part.num_rows
            for a, b, *sides in zip(*(c.to_pylist() for c in part.columns), strict=True):
                for other, side in zip((b, a), sides, strict=True):
                    for name, hits, _ in np.frombuffer(side, np.int64).reshape(-1, 3).tolist():
                        met[name, other] += hits
        assert met == {(name, g): tokens for name in sets.tolist() for g in range(groups)}
    assert rows[30] <= rows[400] <= groups * groups


def test_groups_follow_from_the_sets_not_from_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP_SETS", 100)
    monkeypatch.setattr(jaccard, "GROUP_TOKENS", 5000)
    frame = type(spark.range(0))
    plain = frame.repartitionByRange
    draw = np.random.default_rng(8)
    sets = [np.sort(draw.integers(0, 2**63, int(draw.integers(1, 60))).astype(np.uint64)) for _ in range(700)]
    core = spark.createDataFrame([(k, len(x), bytearray(x.tobytes())) for k, x in enumerate(sets)], "cls long, n long, tokens binary")
    by_parts = []
    for parts in (1, 40):
        monkeypatch.setattr(frame, "repartitionByRange", lambda df, n, *cols, parts=parts: plain(df, parts, *cols))
        found = [(r["grp"], r["cls"], bytes(r["tokens"])) for r in jaccard.token_groups(core).collect()]
        assert sorted((c, t) for _, c, t in found) == [(k, x.tobytes()) for k, x in enumerate(sets)]
        by_parts.append(sorted(found))
    assert by_parts[0] == by_parts[1]
    held, size = Counter(g for g, *_ in found), Counter()
    for g, _, t in found:
        size[g] += len(t) // 8
    assert max(held.values()) <= 100 and max(size.values()) < 5060 and len(held) <= 700 // 100 + sum(map(len, sets)) // 5000 + 1
    ends = sorted((min(t[:16] for h, _, t in found if h == g), max(t[:16] for h, _, t in found if h == g)) for g in held)
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


def test_jaccard_families_over_groups_and_partitions(spark, monkeypatch):
    """Links within and between groups that go on over the ends of partitions, some of which hold no set."""
    monkeypatch.setattr(jaccard, "GROUP_SETS", 7)
    frame = type(spark.range(0))
    plain = frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange", lambda df, n, *cols: plain(df, 30, *cols))
    draw = np.random.default_rng(9)
    rows = []
    for family in range(6):
        base = [f"f{family}w{i}" for i in range(90)]
        for copy in range(9):
            text = list(base)
            for at in draw.integers(0, 90, int(draw.integers(0, 4))):
                text[at] = f"c{copy}"
            rows.append((len(rows), " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, jaccard.jaccard_join(docs).collect())) == brute_components(rows)
    assert jaccard.jaccard_join(docs.limit(0)).collect() == []
