"""Ranked search by ball trees against plain scoring of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
from llm_helpers import SCHEMA, SF, odd_rows

from postloom.llm import balltree
from postloom.llm.catalog import QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    held = [(i, c, n) for i, c, n in held if n]
    count, length = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = set()
    for item, text in items:
        found = []
        for i, c, n in held:
            m = 25 + (75 * n * count) // length
            score = sum(times * math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                        for t, times in Counter(terms(text)).items() if t in c)
            if score > 0:
                found.append((-score, -(2**63) if i is None else i, i))
        out |= {(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: x[:2])[:k])}
    return out


def words(rnd, n):
    return " ".join(rnd.choices([f"w{i}" for i in range(400)], weights=[1 / (i + 1) for i in range(400)], k=n))


def corpus():
    rnd = random.Random(11)
    docs = [(i, words(rnd, rnd.choice([1, 3, 20, 80, 300]))) for i in range(900)]
    passages = [words(rnd, 25) + f" rare{i} rare{i}b" for i in range(12)]
    docs += [(900 + i, f"{words(rnd, 30)} {passages[i % 12]} {words(rnd, 10)}") for i in range(60)]
    docs += [(2000 - i, docs[3][1]) for i in range(20)] + [(3000, passages[0])] * 3
    return docs, list(enumerate(passages)) + [(90, "w0 w0 w0 W1"), (91, "never seen"), (92, ""), (93, None), (None, "w7 w9"), (90, "zz")]


def items_of(items):
    return [(i, t) for i, t in items if (i, t) != (90, "zz")]  # of a repeated id the smallest text is asked


def test_small_corpus(spark, monkeypatch):
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    q = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items_of(items))
    assert set(map(tuple, balltree.ranked(d, q).collect())) == want
    monkeypatch.setattr(balltree, "BLOCK_TERMS", 120)  # several blocks of queries
    assert set(map(tuple, balltree.ranked(d, q).collect())) == want
    assert set(map(tuple, balltree.ranked(d, q, 3).collect())) == brute(docs, items_of(items), 3)


def sparse(rnd, rows, width):
    """Documents of common light terms; some hold heavy ones."""
    held = []
    for i in range(rows):
        term = np.unique(rnd.integers(0, width // 2, rnd.integers(1, 12)))
        if i % 40 == 0:
            term = np.r_[term, width // 2 + rnd.integers(0, width // 2, 3)]
        term = np.unique(term)
        held.append((term, np.where(term < width // 2, rnd.integers(1, 2**24, len(term)), rnd.integers(2**32, 2**33, len(term)))))
    at = np.r_[0, np.cumsum([len(t) for t, _ in held])]
    return at, np.concatenate([t for t, _ in held]), np.concatenate([v for _, v in held])


def asked(rnd, n, width):
    each = [np.unique(np.r_[rnd.integers(0, width // 2, 4), width // 2 + rnd.integers(0, width // 2, 2), width + 5]) for _ in range(n)]
    return balltree.Asked(list(range(n)), np.r_[0, np.cumsum([len(e) for e in each])], np.concatenate(each),
                          np.concatenate([rnd.integers(1, 4, len(e)) for e in each]), np.ones(n, np.int64))


def test_bounds_hold_and_subtrees_are_pruned():
    rnd = np.random.default_rng(3)
    ids = rnd.permutation(3000)
    at, term, impact = sparse(rnd, 3000, 60)
    tree = balltree.build_tree(ids, at, term, impact)
    asks = asked(rnd, 25, 60)
    counts = asks.dense(np.arange(25), tree.vocabulary)
    held = np.zeros((3000, len(tree.vocabulary)), np.int64)
    held[np.repeat(np.arange(3000), np.diff(tree.rows_at)), tree.term] = tree.impact
    scores = counts @ held.T
    bounds = balltree.node_bounds(tree, counts)
    for j, (start, stop, *_) in enumerate(tree.nodes.tolist()):
        assert (scores[:, start:stop].max(1) <= bounds[:, j]).all()
    found, scored = balltree.search_tree(tree, asks, 5)
    got = {q: sorted(zip((-s).tolist(), n.tolist(), strict=True))[:5] for q, n, s in found}
    for q in range(25):
        order = np.lexsort((tree.ids, -scores[q]))[:5]
        assert got[q] == [(-scores[q, i], tree.ids[i]) for i in order if scores[q, i] > 0]
    assert scored < 0.35 * 25 * 3000  # fails if nothing is pruned
    _, again = balltree.search_tree(tree, asks, 5)  # with the floors found before
    assert again <= scored


def test_large_impacts_stay_exact():
    at, term = np.array([0, 1, 2, 4]), np.array([0, 0, 0, 1])
    tree = balltree.build_tree(np.array([7, 5, 6]), at, term, np.array([2**60, 2**60 + 1, 2**60, 1]), leaf=1)
    asks = balltree.Asked([1], np.array([0, 2]), np.array([0, 1]), np.array([2, 1]), np.ones(1, np.int64))
    found, _ = balltree.search_tree(tree, asks, 3)
    assert sorted((int(s), int(n)) for _, names, scores in found for n, s in zip(names, scores, strict=True)) == [(2**61, 7), (2**61 + 1, 6), (2**61 + 2, 5)]


def test_odd_rows(odd, nothing, spark):
    items = [(1, "alpha1 beta2 gamma3 zeta9"), (2, "日本 é"), (3, "x" * 70_000), (4, "ab end")]
    q = spark.createDataFrame(items, "item_id long, text string")
    docs = [(i, t) for i, t, *_ in odd_rows()]
    assert set(map(tuple, balltree.ranked(odd, q).collect())) == brute(docs, items)
    assert balltree.ranked(nothing, q).collect() == [] and balltree.ranked(odd, q.limit(0)).collect() == []
    assert balltree.ranked(spark.createDataFrame([(1, None)], "doc_id long, text string"), q).collect() == []
    assert spark.createDataFrame([], SCHEMA).isEmpty()


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = QUERIES["op12_ranked_search"](spark, SF)
    assert set(map(tuple, got.select("item_id", "rank", "doc_id", "score").collect())) == brute(docs, items)
