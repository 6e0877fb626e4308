"""Exact and approximate search against brute force."""

import numpy as np
import pytest

from postloom.llm import ann, topk, vectors
from postloom.llm.catalog import QUERIES
from llm_helpers import SF

KIND = "vec_id long, embedding array<double>, label int, vector string, part int, score int"


@pytest.fixture(scope="module")
def table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    return np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)


def test_top_k_table(spark, table):
    ids, x = table
    whole = np.floor(256 * x).astype(int)
    want = []
    for i in np.flatnonzero(ids % 50 == 0):
        score = whole @ whole[i]
        order = [j for j in np.lexsort((ids, -score)) if j != i][:5]
        want += [(ids[i], r + 1, ids[j], score[j]) for r, j in enumerate(order)]
    assert sorted(map(tuple, QUERIES["op3_exact_topk"](spark, "/root/testdata/sf0.01").collect())) == sorted(want)


def test_recall_of_the_index(spark, table):
    ids, x = table
    got = {}
    for r in QUERIES["op6_approximate_neighbours"](spark, "/root/testdata/sf0.01").collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    hits = total = 0
    for i in np.flatnonzero(ids % 100 == 0):
        far = np.sqrt(((x - x[i]) ** 2).sum(1))
        mine = [got[ids[i]][r] for r in range(1, 11)]
        assert all(abs(far[ids == v][0] - s) < 1e-12 for v, s in mine) and mine == sorted(mine, key=lambda m: (m[1], m[0]))
        hits += len({ids[j] for j in np.lexsort((ids, far)) if j != i} and {ids[j] for j in [j for j in np.lexsort((ids, far)) if j != i][:10]} & {v for v, _ in mine})
        total += 10
    assert hits / total >= 0.9


def test_block_search_prunes_and_stays_exact():
    rnd = np.random.default_rng(2)
    rows = np.floor(rnd.normal(0, 40, (1500, 8)))
    rows[:200] *= 20
    rows[700:760] = rows[5]
    ids = rnd.permutation(1500)
    queries = np.vstack([rows[:40], rows[700:703]])
    names = np.r_[ids[:40], ids[700:703]]
    q, v, s = topk.block_search(7, 64)(ids, rows, names, queries)
    for i, name in enumerate(names):
        score = rows @ queries[i]
        want = [(ids[j], int(score[j])) for j in np.lexsort((ids, -score)) if ids[j] != name][:7]
        assert sorted(zip(v[q == name].tolist(), s[q == name].tolist(), strict=True)) == sorted(want)


def test_large_weights_are_exact():
    big = np.array([[2.0**40, 1.0], [2.0**40, 3.0], [-(2.0**20), 2.0]])
    q, v, s = topk.block_search(2)(np.array([1, 2, 3]), big[:, :], np.array([9]), np.array([[2.0**20, 1.0]]))
    assert sorted(zip(v.tolist(), s.tolist(), strict=True)) == [(1, 2**60 + 1), (2, 2**60 + 3)]
    with pytest.raises(OverflowError):
        topk.block_search(2)(np.array([1]), np.array([[2.0**40]]), np.array([9]), np.array([[2.0**40]]))


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, []), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]),
            (8, [0.0, 0.0]), (9, [2.0]), (None, [1.0, 1.0]), (100, [1.0, 0.0]), (100, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, "x", 1, 1) for i, v in rows], KIND)
    exact = topk.quantised(df)
    got = [tuple(r) for r in topk.top_k(exact, exact.filter("vec_id % 50 = 0"), 3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 9, 131072), (0, 2, 1, 65536), (0, 3, 100, 65536), (100, 1, 9, 131072), (100, 2, 0, 65536), (100, 3, 1, 65536)]
    usable = ann.usable(df)
    found = [tuple(r) for r in ann.nearest(usable, usable.filter("vec_id % 100 = 0"), 10).orderBy("query_id", "rank").collect()]
    half = 0.5**0.5
    assert found == [(0, 1, 1, 0.0), (0, 2, 100, 0.0), (0, 3, 100, 0.0), (0, 4, 2, half), (0, 5, 9, 1.0),
                     (100, 1, 0, 0.0), (100, 2, 1, 0.0), (100, 3, 2, half), (100, 4, 9, 1.0)]
    none = df.limit(0)
    assert topk.top_k(topk.quantised(none), topk.quantised(none), 3).collect() == []
    assert ann.nearest(ann.usable(none), ann.usable(none), 3).collect() == []


def test_smallest_vector_of_a_query_id_is_asked(spark):
    rows = [(0, [9.0, 9.0]), (0, [1.0, 5.0]), (0, [1.0, 2.0]), (0, [5.0, 1.0]), (1, [1.0, 2.5]), (2, [9.0, 8.0])]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "vec_id long, vector array<double>").coalesce(1)
        asked = df.filter("vec_id = 0")
        assert [r["score"] for r in topk.top_k(df.filter("vec_id = 2"), asked, 1).collect()] == [25]
        assert [(r["vec_id"], r["score"]) for r in ann.nearest(df, asked, 1).collect()] == [(1, 0.5)]


def test_queries_run_on_the_small_table(spark):
    assert QUERIES["op3_exact_topk"](spark, SF).count() == 50 and QUERIES["op6_approximate_neighbours"](spark, SF).count() == 50


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_shards_and_packs_are_not_copied(spark):
    width, rnd = 3, np.random.default_rng(4)
    rows = spark.createDataFrame([(i, rnd.normal(size=width).tolist()) for i in range(500)], "vec_id long, vector array<double>").cache()
    order = [rows["vec_id"]]
    shards, packs = vectors.packed(rows, width, 500, 60, order, "t-shards"), vectors.packed(rows.filter("vec_id % 2 = 0"), width, 250, 100, order, "t-packs")
    met = vectors.pairs(shards, packs)
    plan = _plan(met)
    assert "CartesianProduct" in plan and "Broadcast" not in plan and "Exchange" not in plan
    pairs = [(i, q) for r in met.collect() for i in np.frombuffer(r["ids"], np.int64).tolist() for q in np.frombuffer(r["query_ids"], np.int64).tolist()]
    assert sorted(pairs) == [(i, q) for i in range(500) for q in range(0, 500, 2)]


def test_a_range_may_hold_several_shards(spark, monkeypatch):
    monkeypatch.setattr(vectors, "MOST_RANGES", 2)
    rows = spark.createDataFrame([(i, [float(i)]) for i in range(500)], "vec_id long, vector array<double>")
    held = [np.frombuffer(r["ids"], np.int64).tolist() for r in vectors.packed(rows, 1, 500, 60, [rows["vec_id"]], "t-shards").collect()]
    assert sorted(sum(held, [])) == list(range(500)) and max(map(len, held)) < 120 and len(held) > 2


def test_the_sample_is_the_first_by_hash(spark):
    rows = spark.createDataFrame([(i % 300, [float(i)] * (i % 3 + 1)) for i in range(400)], "vec_id long, vector array<double>").repartition(5)
    want = rows.selectExpr("xxhash64(vec_id) AS h", "vec_id", "vector").collect()
    want = [r["vector"] for r in sorted(want, key=lambda r: (r["h"], r["vec_id"]))]
    for most in (1, 37, 1000):
        got = ann._sample(rows, 3, most)
        assert got.shape == (min(most, 400), 3)
        first = {tuple(v + [0.0] * (3 - len(v))) for v in want[:most + 1]}  # one more: the last hash may be that of two rows
        assert set(map(tuple, got.tolist())) <= first
    assert ann._sample(rows.limit(0), 3).tolist() == [[0.0, 0.0, 0.0]]
