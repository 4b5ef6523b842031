"""Weak supervision: counts against plain Python, the estimate against a plain loop, edges, held-out labels."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebook.llm import rules
from tidebook.llm._common import read

DOCS = "doc_id long, text string"
CLEAN = "The river runs past the old mill and the weir, where herons wait in the reeds. "
TEXTS = [
    None, "", " \n\t ", "short text", " ".join(f"word{i}" for i in range(400)) + ".", CLEAN * 1 + "Nobody has counted them since the bridge was closed for repairs last spring.",
    "a b c d e f g h " * 30, "x\ny\nx\n\n x\nx\n", "BUY NOW!! " * 40, "##$$ %% | <> && ** " * 20, "Ünï çødé 漢字 🙂 " * 9, "one two three " * 30, "w " * 5000, "a\x0bb\x0cc\rd " * 20,
]


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(None, "one two"), (3, "short text")], DOCS)
    got = rules.judge_quality(df.withColumns({c: F.lit(c) for c in ("n_words", "votes", "posterior", "one", "kept")})).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        text = "one two" if r.doc_id is None else TEXTS[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(text)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept) and 0 <= r.posterior <= 1


@pytest.mark.parametrize("width", [1, 2, 3, 5, 8, 11])
def test_repeated_windows_of_any_width(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, width - 1, width, 40, 200):
        ids = rng.integers(0, 3, n)
        seen = Counter(tuple(ids[i : i + width]) for i in range(n - width + 1))
        covered = {j for i in range(n - width + 1) if seen[tuple(ids[i : i + width])] > 1 for j in range(i, i + width)}
        assert rules.repeated(ids, width) == len(covered)


def test_votes_follow_the_rules(spark):
    a = rules.Rule("a", "p", "q", good=0.1, bad=0.5, least=2)
    b = rules.Rule("b", "p", "q", good=0.6, bad=0.2)
    c = rules.Between("c", "p", "q", good=1, good_to=2, bad=0.5, bad_to=4)
    df = spark.createDataFrame([(0, 1), (0, 10), (1, 10), (3, 10), (5, 10), (15, 10), (50, 10), (0, 0)], "p long, q long")
    assert ["".join(r) for r in df.select(a.vote(), b.vote(), c.vote()).collect()] == ["0--", "+--", "+--", "00-", "-00", "-++", "-+-", "000"]


def loop(votes, many, steps=400):
    """The same estimate, text by text and rule by rule."""
    prior, good, bad, ask = 0.8, [0.99] * len(votes[0]), [0.2] * len(votes[0]), 0.05 * sum(many)

    def posterior(v):
        g, b = prior, 1 - prior
        for x, rg, rb in zip(v, good, bad, strict=True):
            g *= rg if x > 0 else 1 - rg if x < 0 else 1
            b *= rb if x < 0 else 1 - rb if x > 0 else 1
        return g / (g + b)

    for _ in range(steps):
        p = [posterior(v) for v in votes]
        share = sum(q * n for q, n in zip(p, many, strict=True))
        new = [], []
        for j in range(len(good)):
            g = [sum(q * n for v, q, n in zip(votes, p, many, strict=True) if v[j] in s) for s in ((1,), (1, -1))]
            b = [sum((1 - q) * n for v, q, n in zip(votes, p, many, strict=True) if v[j] in s) for s in ((-1,), (1, -1))]
            new[0].append((g[0] + ask * 0.8 * 0.99) / (g[1] + ask * 0.8))
            new[1].append(max((b[0] + ask * 0.2 * 0.2) / (b[1] + ask * 0.2), 1 - new[0][-1]))
        prior, good, bad = (share + ask * 0.8) / (sum(many) + ask), *new
    return [posterior(v) for v in votes]


def test_estimate_against_a_plain_loop():
    rng = np.random.default_rng(2)
    votes = np.unique(rng.choice([-1, 0, 1, 1, 1], (40, 5)), axis=0)
    many = rng.integers(1, 90, len(votes)).astype(float)
    want = loop(votes.tolist(), many.tolist())
    model = rules.estimate(votes, many, steps=400)
    assert model.posterior(votes) == pytest.approx(want, abs=1e-6)
    ten = rules.estimate(votes, many * 1e7, steps=400)
    assert ten.posterior(votes) == pytest.approx(want, abs=1e-6)  # the number of texts changes nothing
    assert rules.estimate(np.zeros((0, 5)), np.zeros(0)).prior == 0.8


def test_accuracies_are_found():
    """Votes drawn from known accuracies: the estimate comes near them, although it never sees a label."""
    rng = np.random.default_rng(4)
    right_good, right_bad = np.array([0.97, 0.99, 0.95, 0.98, 0.9]), np.array([0.6, 0.4, 0.7, 0.5, 0.5])
    kind = rng.random(60_000) < 0.85
    hit = np.where(kind[:, None], rng.random((60_000, 5)) < right_good, rng.random((60_000, 5)) >= right_bad)
    votes, many = np.unique(np.where(rng.random((60_000, 5)) < 0.05, 0, np.where(hit, 1, -1)), axis=0, return_counts=True)
    model = rules.estimate(votes, many.astype(float))
    assert model.right_good == pytest.approx(right_good, abs=0.02) and model.right_bad == pytest.approx(right_bad, abs=0.15) and math.isclose(model.prior, 0.85, abs_tol=0.05)


def test_nothing_to_judge(spark):
    assert rules.judge_quality(spark.createDataFrame([], DOCS)).collect() == []
    with pytest.raises(ValueError):
        rules.judge_quality(spark.createDataFrame([], DOCS), rules=())


def test_labels_agree(spark):
    """Labels, which the method never reads: bad texts go, good ones stay."""
    sf = "/root/testdata/sf0.01"
    kept = rules.judge_quality(read(spark, sf, "documents")).where("n_words >= 20").join(read(spark, sf, "labels").where("quality is not null"), "doc_id")
    n = {(r.quality, r.kept): r["count"] for r in kept.groupBy("quality", "kept").count().collect()}
    assert n[0, False] >= 0.95 * (n[0, False] + n.get((0, True), 0)) and n.get((1, False), 0) <= 0.02 * n[1, True]
