"""Spelling variants against brute force over all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebook.llm import variants

DOCS = "doc_id long, text string"


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    out = {}
    for w in n:
        others = [v for v in n if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form = best if best is not None and n[best] >= 2 * n[w] else None
        out[w] = (form, n[w], len(others), n[form] if form else None)
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w] += (root,)
    return out


def table(df):
    return {r.word: (r.form, r.n, r.n_near, r.form_n, r.root) for r in variants.spelling_variants(df).collect()}


def test_against_brute_force(spark):
    r = random.Random(3)
    stems = ["house", "garden", "aaaaa", "aaaaaa", "abababab", "ÿtréma", "straße", "ÀÀÀÀÀÀ", "q" * 700]
    words = []
    for i, s in enumerate(stems):
        words += [s] * (60 + 3 * i)
        for _ in range(14):
            k, at = r.choice("idr"), r.randrange(len(s))
            c = r.choice("abxyé")
            words += [{"i": s[:at] + c + s[at:], "d": s[:at] + s[at + 1 :], "r": s[:at] + c + s[at + 1 :]}[k]] * r.choice((2, 3, 4, 7, 20))
    r.shuffle(words)
    words = [w.upper() if w.isascii() and r.random() < 0.3 else w for w in words]
    rows = [(i % 50, " ".join(words[i::400])) for i in range(400)] + [(None, "house House housé"), (7, None), (8, ""), (9, "12 -- 漢字")]
    rows += rows[:40]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(c) for c in ("word", "n", "key", "id", "root", "left")}).repartition(7)
    want = brute(rows)
    assert table(df) == want and sum(v[0] is not None for v in want.values()) > 20 and max(v[2] for v in want.values()) > 10


def test_chains_reach_their_root(spark):
    chain = ["bcdefg", "acdefg", "aadefg", "aaaefg", "aaaafg", "aaaaag"]  # each one letter from the next, and twice as common
    rows = [(next(i for i in range(99) if all(zlib.crc32(f"{i}:{w}".encode()) % 97 for w in chain)), " ".join(w for i, w in enumerate(chain) for _ in range(3 * 2**i)))]
    got = table(spark.createDataFrame(rows, DOCS))
    assert got == brute(rows) and got["bcdefg"][4] == "aaaaag" and got["aaaaag"][4] == "aaaaag"


def test_equal_keys_are_told_by_their_strings(spark, monkeypatch):
    """With a hash that hardly tells anything apart, the result is the same."""
    monkeypatch.setattr(variants, "mixed", lambda x: x % np.uint64(5))
    rows = [(i, w) for i, w in enumerate(["planet", "planets", "planét", "garden", "gardens", "gxrden"] * 7 + ["planet", "garden"] * 9)]
    assert table(spark.createDataFrame(rows, DOCS)) == brute(rows)


def test_keys_without_a_letter_are_those_of_the_shorter_word():
    key, at, owner, first = variants.deletion_keys(["banana", "anana", "bannana", "bnnana", "xyzzy"])
    of = lambda w, i: int(key[(owner == w) & (at == i)][0])
    assert of(0, 0) == of(1, -1) and of(2, 2) == of(2, 3) == of(0, -1) and of(0, 1) == of(3, 1) and len(set(key[at < 0].tolist())) == 5
    assert first[(owner == 2) & (at == 2)][0] and not first[(owner == 2) & (at == 3)][0]


@pytest.mark.parametrize("rows", [[], [(1, None), (None, ""), (2, "one two 3")]])
def test_nothing_to_group(spark, rows):
    assert variants.spelling_variants(spark.createDataFrame(rows, DOCS)).collect() == []
    with pytest.raises(ValueError):
        variants.spelling_variants(spark.createDataFrame(rows, DOCS), ratio=1)
