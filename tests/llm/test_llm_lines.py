"""Line de-duplication against a plain version, its filters, and taking documents back."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from llm_helpers import SCHEMA, SF, odd_rows

from postloom.llm import linededup
from postloom.llm.catalog import QUERIES
from postloom.llm.linededup import Cuckoo, LineIndex

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(_LOWER)


def brute(texts, counted=None, min_docs=10, min_chars=1):
    held = Counter()
    for text in texts if counted is None else counted:
        held.update({k for k in map(key, (text or "").split("\n")) if len(k) >= min_chars})
    out = []
    for text in texts:
        lines = (text or "").split("\n")
        kept = [line for line in lines if held[key(line)] < min_docs or len(key(line)) < min_chars]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def line_texts(n=400):
    rnd = random.Random(8)
    pool = [f"line {i}" for i in range(60)]
    odd = ["", "  ", " ", "É", "é", "A", "a ", "\ta", "x\x0b", "日本"]
    return ["\n".join(rnd.choices(pool, weights=[1 / (i + 1) for i in range(60)], k=rnd.randint(1, 9)) + rnd.choices(odd, k=rnd.randint(0, 4))
                      + [f"own {i}"]) for i in range(n)]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)


def got(df):
    return [(r["text"], r["n_lines"], r["n_dropped"]) for r in sorted(df.collect(), key=lambda r: r["doc_id"])]


@pytest.mark.parametrize("few", [True, False])
def test_cleaned_texts(spark, tmp_path, monkeypatch, few):
    if not few:  # as with more frequent keys than a task may hold
        monkeypatch.setattr(linededup, "FILTER_BYTES", -1)
        monkeypatch.setattr(linededup, "BROADCAST_ROWS", -1)
        monkeypatch.setattr(linededup, "SHARD_KEYS", 1)
    texts = line_texts()
    index = LineIndex(spark, str(tmp_path / "index"), min_docs=12)
    index.apply(added=frame(spark, texts))
    assert (index.filters().count() > 16) is not few
    assert got(index.cleaned(frame(spark, texts))) == brute(texts, min_docs=12)


def test_changes_are_taken_back(spark, tmp_path):
    texts = line_texts()
    index = LineIndex(spark, str(tmp_path / "index"), min_docs=12)
    first, second = frame(spark, texts[:150]), frame(spark, texts[150:])
    rows = lambda: (sorted(map(tuple, index.counts().collect())), sorted((r["shard"], r["n_keys"]) for r in index.filters().collect() if r["n_keys"]))
    assert index.version() is None and got(index.cleaned(first)) == [(t, t.count("\n") + 1, 0) for t in texts[:150]]
    assert index.apply(added=first) == 0
    before = rows()
    assert got(index.cleaned(frame(spark, texts))) == brute(texts, texts[:150], 12)
    assert index.apply(added=second) == 1
    assert got(index.cleaned(frame(spark, texts))) == brute(texts, min_docs=12)
    assert index.apply(removed=second) == 2 and rows() == before
    assert got(index.cleaned(frame(spark, texts))) == brute(texts, texts[:150], 12)
    assert index.apply(added=second, removed=first) == 3
    assert got(index.cleaned(frame(spark, texts))) == brute(texts, texts[150:], 12)
    assert got(index.cleaned(frame(spark, texts), version=0)) == brute(texts, texts[:150], 12)
    with pytest.raises(ValueError):
        index.apply(removed=first)
    assert index.version() == 3
    index.apply(removed=second)
    assert index.counts().isEmpty() and index.filters().filter("n_keys > 0").isEmpty()


def test_filter_holds_what_was_inserted():
    keys = np.random.default_rng(4).integers(-2**63, 2**63 - 1, 30_000)
    cuckoo = Cuckoo.sized(20_000)
    assert cuckoo.insert(keys[:20_000]) and cuckoo.holds(keys[:20_000]).all()
    assert cuckoo.holds(keys[20_000:]).mean() < 0.01
    cuckoo.delete(keys[:9_000])
    assert cuckoo.holds(keys[9_000:20_000]).all() and cuckoo.holds(keys[:9_000]).mean() < 0.01
    again = Cuckoo.read(cuckoo.tobytes())
    assert again.insert(keys[20_000:]) and again.holds(keys[9_000:]).all()
    again.delete(keys[9_000:])
    assert not again.slots.any()
    with pytest.raises(ValueError):
        again.delete(keys[:1])
    full = Cuckoo(np.zeros((64, 4), np.uint16))
    assert full.insert(keys[:240]) and full.holds(keys[:240]).all()  # nearly full: fingerprints are moved
    assert not Cuckoo(np.zeros((2, 4), np.uint16)).insert(keys[:9])


def test_odd_rows(odd, nothing, spark, tmp_path):
    index = LineIndex(spark, str(tmp_path / "index"), min_docs=2)
    index.apply(added=odd)
    texts = [t for _, t, *_ in odd_rows()]
    want = sorted(((i, *b) for (i, *_), b in zip(odd_rows(), brute(texts, min_docs=2), strict=True)), key=repr)
    assert sorted(map(tuple, index.cleaned(odd).select("doc_id", "text", "n_lines", "n_dropped").collect()), key=repr) == want
    assert index.cleaned(nothing).collect() == []
    empty = LineIndex(spark, str(tmp_path / "none"))
    empty.apply(added=spark.createDataFrame([], SCHEMA))
    assert empty.counts().isEmpty() and empty.cleaned(nothing).collect() == []


def test_hot_line_and_copies(spark, tmp_path):
    texts = ["shared\nown " + str(i) for i in range(3000)] + ["copy\nof one text\n\nshared "] * 2000 + ["x\n" * 5000]
    index = LineIndex(spark, str(tmp_path / "index"))
    index.apply(added=frame(spark, texts))
    assert got(index.cleaned(frame(spark, texts))) == brute(texts)


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {(r["doc_id"], n, gone, hashlib.sha256(kept.encode()).hexdigest()) for r, (kept, n, gone) in zip(docs, brute([r["text"] for r in docs]), strict=True)}
    assert set(map(tuple, QUERIES["op13_line_dedup"](spark, SF).collect())) == want
