"""op8's search: windows are found by a lead term, at a cost that does not grow with the windows that cannot match."""

from __future__ import annotations

import time

import numpy as np

from tidebook.llm import decontam


def segment(terms: np.ndarray) -> decontam.Segment:
    """One document of these terms."""
    order = np.argsort(terms, kind="stable")
    known, counts = np.unique(terms, return_counts=True)
    return decontam.Segment({"n_words": [len(terms)], "firsts": [0], "terms": known, "counts": counts, "postings": np.arange(len(terms))[order]})


def block(windows: np.ndarray) -> decontam.Block:
    terms, number = np.unique(windows[windows >= 0], return_inverse=True)
    made = np.full(windows.shape, -1, np.int32)
    made[windows >= 0] = number
    return decontam.Block(terms, made, [["x"]] * len(windows))


def test_windows_with_all_terms_in_the_segment():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 400, 3000)
    windows = rng.integers(0, 420, (2000, 4))
    windows[::5, 2:] = -1
    b = block(windows)
    for seg in (segment(text), segment(text[:40]), segment(np.array([10**6]))):
        have, local = b.inside(seg)
        want = [i for i, w in enumerate(windows) if set(w[w >= 0].tolist()) <= set(seg.terms.tolist())]
        assert have.tolist() == want
        assert all((seg.terms[x[x >= 0]] == w[w >= 0]).all() and (x >= 0).sum() == (w >= 0).sum() for x, w in zip(local, windows[have], strict=True))


def test_no_windows_or_no_words():
    empty = decontam.Block(np.empty(0, np.int64), np.empty((0, 10), np.int32), [])
    assert len(empty.inside(segment(np.arange(5)))[0]) == 0 and len(block(np.arange(10)[None, :]).inside(segment(np.empty(0, np.int64)))[0]) == 0


def test_cost_follows_what_matches():
    rng = np.random.default_rng(2)
    seg = segment(np.minimum(rng.zipf(1.2, 85_000), 10**6))
    own = seg.terms[rng.integers(0, len(seg.terms), (2000, 10))]
    others = rng.integers(2 * 10**6, 3 * 10**7, (522_000, 10))
    others[:, :6] = seg.terms[:50][rng.integers(0, 50, (522_000, 6))]  # common words of the segment in all of them
    few, many = block(np.concatenate([own, others[:18_000]])), block(np.concatenate([own, others]))

    def seconds(b):
        best = 9.0
        for _ in range(5):
            began = time.perf_counter()
            found = b.inside(seg)[0]
            best = min(best, time.perf_counter() - began)
        assert len(found) == 2000
        return best

    assert seconds(many) < 2 * seconds(few) + 0.005
