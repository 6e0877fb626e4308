"""Odd rows and brute-force helpers of these tests."""

import random
import re

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size int, cls string, row string, "
          "part int, key_id string, times int, score double, taken string, component string")


def words(text):
    return WORD.findall(text or "")


def shingles(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def odd_rows():
    """Nulls, empty and very long texts, repeated rows and ids, near copies, other white space."""
    rnd = random.Random(3)
    base = [rnd.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rnd.randint(0, 30)) for _ in range(120)]
    near = [*base[:60], "changed", *base[61:]]
    far = [*base[:30], *(f"other{i}" for i in range(90))]
    texts = [
        (1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join(base).upper()), (5, None), (6, ""), (6, ""),
        (7, " \t\n "), (8, "one two"), (9, "ONE two"), (10, "one\u00a0two"), (11, "x" * 70_000), (12, "ab " * 40_000),
        (None, " ".join(base)), (None, "no id at all but a text of its own"), (13, "dup dup dup dup dup dup"), (13, "dup dup dup dup dup dup"),
        (14, "é 日本 \u2581 end"), (15, "line\nline\nline"), (16, "tab\ttab  two "),
    ]
    return [(i, t, [None, "en", "de"][k % 3], [None, "s1", "s2", "s\u00e9"][k % 4], len(t or ""), k, "c", "r", k, "k", k, 0.5, "t", "x")
            for k, (i, t) in enumerate(texts)]
