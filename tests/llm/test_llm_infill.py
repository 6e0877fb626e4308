"""Fill-in-middle against a plain version on code points, and its round trip."""

import hashlib
import random

import numpy as np
import pytest
from llm_helpers import SF, odd_rows
from pyspark.sql import functions as F

from postloom.llm import infill
from postloom.llm.catalog import QUERIES


def brute(doc_id, text):
    text = text or ""
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def unit_texts():
    rnd = random.Random(5)
    letters = ["a", "<", ">", "P", "S", "M", "é", "日", "\U0001f600", "\n", "́", "\x00"]
    return [(i, "".join(rnd.choices(letters, k=rnd.choice([0, 1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 40, 333])))) for i in range(1500)]


def made(rows, spark):
    df = infill.transformed(rows)
    out = df.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output",
                    infill.restored(F.col("output"), F.col("form")).alias("back")).collect()
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("partitions", [1, 7])
def test_random_units(spark, partitions):
    rows = unit_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    want = sorted(((i, *brute(i, t), t) for i, t in rows), key=repr)
    assert made(df, spark) == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_odd_rows(odd, nothing, spark):
    assert made(odd, spark) == sorted(((i, *brute(i, t), t or "") for i, t, *_ in odd_rows()), key=repr)
    assert made(nothing, spark) == []


def test_marks_in_words():
    for text in ("", "a", "é", "日本語" * 5, "\U0001f600x" * 9, "12345678", "1234567é"):
        data = np.frombuffer(text.encode(), np.uint8)
        ends = infill.Ends(data, np.array([0, len(data)]))
        n = len(text)
        assert ends.before(np.array([len(data)]))[0] == n
        assert ends.after(np.arange(n + 1)).tolist() == [len(text[:k].encode()) for k in range(n + 1)]


def test_bytes_that_are_no_utf8_do_not_crash(spark):
    df = spark.createDataFrame([(i, bytes([0x80, 0xFF, 0x41, 0xC3, 0xA9, 0xBF][i % 6:])) for i in range(30)], "doc_id long, raw binary")
    rows = infill.transformed(df.select("doc_id", F.expr("cast(raw as string)").alias("text")))
    back = rows.select(F.hex(infill.restored(F.col("output"), F.col("form"))).alias("h"), "n").collect()
    assert len(back) == 30 and all(r["n"] >= 1 for r in back)


def test_other_shares(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("some words here").alias("text"), F.lit(1).alias("form"))
    assert infill.transformed(df, plain_percent=100).filter("form <> 'plain'").isEmpty()
    assert infill.transformed(df, plain_percent=0, spm_percent=100).filter("form <> 'spm'").isEmpty()
    assert infill.transformed(df, seed="2").exceptAll(infill.transformed(df)).count() > 200


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = set()
    for i, t in docs:
        n, form, p, m, out = brute(i, t)
        want.add((i, n, form, p, m, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert set(map(tuple, QUERIES["op11_fill_in_middle"](spark, SF).collect())) == want
