"""Encoding against the library, for any chunk size; the pipeline stage by stage."""

import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from postloom.llm import jaccard, pieces, quality
from postloom.llm.catalog import QUERIES
from llm_helpers import SF, odd_rows, words

ODD = ["a  b", " lead", "trail ", "tab\tq", "new\nline", "\n", " \n \n  x", "\ufb01 \u2460", "日本語テキスト", "   ", "\r\n", "x" * 300, "ab" * 200,
       "aaaa bbbb" * 30, "<s> <0x41>", "\U0001d518\U0001d518 x", "a\x00b", "the" * 40, " " * 50, "x" + " " * 33 + "y", "1234567890" * 9]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


@pytest.fixture(scope="module")
def encoder():
    with open(pieces.MODEL, "rb") as file:
        return pieces.Encoder(file.read())


def samples():
    rnd = random.Random(1)
    return ODD + ["".join(rnd.choice("abcdeehnott  \n.é日<>\u2582ST1") for _ in range(rnd.randint(1, 120))) for _ in range(150)]


def test_same_ids_as_the_library(encoder, library):
    for text in samples():
        ids = np.frombuffer(encoder.encode(text), np.int32).tolist()
        assert ids == library.encode(text), text
        assert encoder.decode(ids) == text


def by_chunks(encoder, text, chunk):
    edge = 2 * encoder.pieces.longest
    parts = [text[max(0, k * chunk - edge):k * chunk + chunk + edge] for k in range(-(-len(text) // chunk))]
    seen = [pieces._bounds(encoder, p, k, len(parts), chunk, edge) for k, p in enumerate(parts)]
    before, steps = {(0, 0, -1): {(0, 0, -1): 0.0}}, []
    for k, (t, begin, stop, shift) in enumerate(seen):
        m = {pieces._moved(a, shift): {pieces._moved(b, shift): v for b, v in row.items()}
             for a, row in encoder.transfer(t, begin, stop, k == 0, k == len(parts) - 1).items()}
        steps.append((m, before))
        before = pieces.product(before, m)
    state, out = max(before[(0, 0, -1)], key=before[(0, 0, -1)].get), []
    for (m, prior), (t, begin, stop, shift) in zip(reversed(steps), reversed(seen), strict=True):
        score = prior[(0, 0, -1)]
        entry = max((s for s in score if state in m.get(s, {})), key=lambda s: score[s] + m[s][state])
        out.append(encoder.trace(t, begin, stop, None if entry[2] == -1 else pieces._moved(entry, -shift), pieces._moved(state, -shift)))
        state = entry
    return np.frombuffer(b"".join(reversed(out)), np.int32).tolist()


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 20, 50])
def test_chunks_of_any_size(encoder, library, chunk):
    for text in samples():
        if len(text) > chunk:
            assert by_chunks(encoder, text, chunk) == library.encode(text), text


def test_products_are_associative(encoder):
    text = "internationalisation of the thethethe words" * 3
    edge = 2 * encoder.pieces.longest
    ms = []
    for k in range(4):
        t, b, s, shift = pieces._bounds(encoder, text[max(0, k * 9 - edge):k * 9 + 9 + edge], k, 99, 9, edge)
        ms.append({pieces._moved(a, shift): {pieces._moved(c, shift): v for c, v in r.items()}
                   for a, r in encoder.transfer(t, b, s, k == 0, False).items()})
    assert pieces.product(pieces.product(ms[0], ms[1]), pieces.product(ms[2], ms[3])) == pieces.product(
        pieces.product(ms[0], pieces.product(ms[1], ms[2])), ms[3])


def test_short_texts_are_solved_by_the_max_plus_step(library, monkeypatch):
    with open(pieces.MODEL, "rb") as file:
        fresh = pieces.Encoder(file.read())
    solved, step = [], pieces.Pieces.forward
    monkeypatch.setattr(pieces.Pieces, "forward", lambda self, text, *a: solved.append(text) or step(self, text, *a))
    text = "some words, some words\nof a shorter \U0001d518 text"
    assert np.frombuffer(fresh.encode(text), np.int32).tolist() == library.encode(text)
    assert {"\u2581some", "\u2581words", "\u2581\U0001d518"} <= set(solved) and len(solved) == len(set(solved))


def test_few_parts_are_kept(encoder, library):
    parts = pieces.Parts(encoder.pieces, pieces.SPACE, most=3)
    for word in ["the", "of", "the", "and", "the", "or", "the", "if", "the", "so", "of"] * 5:
        assert np.frombuffer(parts[word], np.int32).tolist() == library.encode(word)
        assert len(parts) <= 3 and len(parts.older) <= 3


@pytest.mark.parametrize("block", [1, 40, 1 << 17])
def test_a_batch_takes_the_step_side_by_side(library, monkeypatch, block):
    with open(pieces.MODEL, "rb") as file:
        fresh = pieces.Encoder(file.read())
    alone, step = [], pieces.Pieces.forward
    monkeypatch.setattr(pieces.Pieces, "forward", lambda self, text, *a: alone.append(text) or step(self, text, *a))
    monkeypatch.setattr(pieces, "SIDE_CHARS", block)
    texts = [*samples(), None, "", *samples()]
    assert [np.frombuffer(x, np.int32).tolist() for x in fresh.encode_all(texts)] == [library.encode(t or "") for t in texts]
    assert all(len(part) > pieces.SIDE_PART for part in alone)


def test_pairs_by_courses_of_merges(encoder):
    rnd, model = random.Random(2), encoder.pieces
    pairs = [(p[:k], p[k:]) for p in rnd.sample(sorted(model.ids), 3000) for k in range(1, len(p)) if p[:k] in model.ids and p[k:] in model.ids]
    pairs += [(rnd.choice(pairs)[1], rnd.choice(pairs)[0]) for _ in range(10000)]
    fits = [model.fits(model.ids[a], model.ids[b]) for a, b in pairs]
    assert fits == [model.merged(a + b) == [a, b] for a, b in pairs] and 0 < sum(fits) < len(fits)


def test_a_worker_keeps_no_solutions_after_a_task():
    with open(pieces.MODEL, "rb") as file:
        run = pieces._encode_short(file.read(), True)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some words\nin a text", "x" * 300])], names=["doc_id", "text"])
    assert sum(b.num_rows for b in run(iter([batch]))) == 2
    with open(pieces.MODEL, "rb") as file:
        left = pieces._loaded(file.read())
    assert not any((left.parts, left.parts.older, left.words, left.words.older, left.pieces.pairs))


def test_encode_odd_rows(spark, odd, nothing, library):
    got = pieces.encode(odd, chunk=700, giant=1000, check=True).collect()
    assert Counter((r["doc_id"], tuple(r["token_ids"])) for r in got) == Counter((i, tuple(library.encode(t or ""))) for i, t, *_ in odd_rows())
    assert all(r["round_trip"] for r in got) and max(r["n_chunks"] for r in got) == 172
    encoded = spark.createDataFrame([(r["doc_id"], r["token_ids"]) for r in got], "doc_id long, token_ids array<int>")
    assert Counter(map(tuple, pieces.decode(encoded).collect())) == Counter((i, (t or "").replace("\u2581", " ")) for i, t, *_ in odd_rows())
    assert pieces.encode(nothing, check=True).collect() == []


def test_query_matches_the_library(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op2_sentencepiece"](spark, SF).collect()
    assert {r["doc_id"]: r["token_ids"] for r in got} == {i: library.encode(t) for i, t in texts.items()}
    assert all(r["round_trip"] and r["n_tokens"] == len(r["token_ids"]) for r in got)


def test_pipeline_decodes_what_it_encodes(spark, odd):
    rows = corpus_pipeline.encoding(spark, odd, SF).collect()
    assert len(rows) == len(odd_rows()) and all(r["round_trip"] is True for r in rows) and max(r["n_chunks"] for r in rows) > 1


def test_pipeline_stage_by_stage(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bad = {r["doc_id"] for r in quality.judge(docs, labels).filter("predicted = 0").collect()}
    kept = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    rows = {r["doc_id"]: r for r in kept.collect()}
    assert kept.columns == columns and set(rows) == {r["doc_id"] for r in docs.collect()} - bad
    least = {r["component_id"] for r in jaccard.jaccard_join(kept).collect()}
    single = corpus_pipeline.STAGES[1][1](spark, kept, SF)
    ids = [r["doc_id"] for r in single.collect()]
    assert single.columns == columns and len(ids) == len(set(ids)) and set(ids) == least
    mixed = corpus_pipeline.STAGES[2][1](spark, single, SF)
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert mixed.columns == columns and set(times) <= least and max(times.values()) == 2
    total = sum(len(words(rows[i]["text"])) for i in ids)
    assert abs(sum(n * len(words(rows[i]["text"])) for i, n in times.items()) - 1.5 * total) < 0.1 * total
    final = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r["doc_id"] for r in final) == times
    assert all(r["token_ids"] == library.encode(rows[r["doc_id"]]["text"]) for r in final)


def test_pipeline_odd_and_empty(spark, odd, nothing):
    for docs in (odd, nothing):
        frame = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            frame = stage(spark, frame, SF)
            assert frame.columns == docs.columns
            frame = spark.createDataFrame(frame.collect(), docs.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, frame, SF).count() == frame.count()
