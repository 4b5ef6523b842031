"""Vector codes against plain Python, and the bounds against every distance."""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebook.llm import codes

VECTORS = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=4, entries=256, rounds=4):
    """(vec_id, code, error, label error), sorted, and the digest: whole numbers, every part against every entry."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    v = [[math.floor(1024 * x) for x in r[1]] for r in kept]
    first = sorted((r[0], r[1], i) for i, r in enumerate(kept) if r[0] is not None)[:entries]
    size = len(v[0]) // parts
    cut = lambda x, p: x[p * size : (p + 1) * size]
    books = [[cut(v[i], p) for _, _, i in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda x, p: min((far(cut(x, p), e), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        met = [defaultdict(list) for _ in range(parts)]
        for x in v:
            for p in range(parts):
                met[p][best(x, p)[1]].append(cut(x, p))
        books = [[[sum(c) // len(c) for c in zip(*met[p][i], strict=True)] if i in met[p] else e for i, e in enumerate(books[p])] for p in range(parts)]
    found = [[best(x, p) for p in range(parts)] for x in v]
    error = [sum(d for d, _ in f) for f in found]
    label = defaultdict(int)
    for r, e in zip(kept, error, strict=True):
        label[r[2]] += e
    out = [(r[0], "".join(f"{i:02x}" for _, i in f), e, label[r[2]]) for r, f, e in zip(kept, found, error, strict=True)]
    return sorted(out, key=repr), hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def got(df, **options):
    rows = codes.vector_codes(df, **options).collect()
    return sorted(((r.vec_id, r.code, r.error, r.label_error) for r in rows), key=repr), {r.codebooks_sha256 for r in rows}


def rows_of(n, size, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.2, (n, size)).astype(np.float32)
    return [(int(i), [float(a) for a in row], None if i % 7 == 0 else int(i % 3)) for i, row in enumerate(x)]


@pytest.mark.parametrize(("n", "size", "entries"), [(90, 16, 16), (40, 4, 256), (70, 20, 8)])
def test_against_plain_numbers(spark, n, size, entries):
    rows = rows_of(n, size)
    rows += [(n, None, 1), (n + 1, [None] * size, 1), (n + 2, [float("nan")] * size, None), (n + 3, [float("inf")] + [0.0] * (size - 1), 2)]
    rows += [(n + 4, rows[3][1], 1), (3, rows[3][1], 0), (None, rows[5][1], None), (n + 5, [0.0] * size, 0), (n + 6, [-0.0001] * size, 0)]  # repeats, ties, no id
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit(c) for c in ("v", "code", "error", "part")}).repartition(5)
    want, digest = plain(rows, entries=entries)
    assert got(df, entries=entries) == (want, {digest})


def test_bounds_never_lose_the_nearest():
    rng = np.random.default_rng(9)
    for size in (1, 2, 3, 5, 16, 33):
        book = rng.integers(-400, 400, (60, size))
        book[7] = book[3]  # ties go to the lower index
        parts = np.concatenate([rng.integers(-400, 400, (300, size)), book, np.zeros((2, size), int), np.full((2, size), 16_000_000)])
        entry, distance = codes.nearest(parts, book)
        every = ((parts[:, None, :] - book[None]) ** 2).sum(axis=2)
        assert (distance == every.min(axis=1)).all() and (entry == every.argmin(axis=1)).all()


def test_coarse_outlines_lie_below_fine_ones_and_drop_most_of_what_is_apart():
    rng = np.random.default_rng(3)
    book = rng.integers(-30, 30, (256, 16)) + rng.integers(-900, 900, (256, 1))
    parts = book[rng.integers(0, 256, 500)] + rng.integers(-20, 20, (500, 16))
    a, b = codes.Outline(parts), codes.Outline(book)
    every = ((parts[:, None, :] - book[None]) ** 2).sum(axis=2)
    low = [((m[:, None, :] - n[None]) ** 2).sum(axis=2) + (r[:, None] - s[None]) ** 2 for (m, r), (n, s) in zip(a.levels, b.levels, strict=True)]
    assert len(low) == 2 and all((x <= every + 1e-6).all() for x in low) and (low[0] <= every.min(axis=1)[:, None]).mean() < 0.1


def test_rows_without_a_measure(spark):
    """Other lengths and components that are too large have no code; a label of such rows only has no sum."""
    rows = rows_of(20, 8) + [(100, [0.5] * 7, 9), (101, [], 9), (102, [1e6] + [0.0] * 7, 9), (103, [0.25] * 12, 1)]
    found = {r.vec_id: r for r in codes.vector_codes(spark.createDataFrame(rows, VECTORS)).collect()}
    assert len(found) == 24 and all(found[i].code is None and found[i].error is None for i in (100, 101, 102, 103))
    assert found[100].label_error is None and found[103].label_error == found[1].label_error
    assert sorted((r.vec_id, r.code, r.error) for r in found.values() if r.code) == sorted(x[:3] for x in plain(rows_of(20, 8))[0])


def test_nothing_to_code(spark):
    assert codes.vector_codes(spark.createDataFrame([], VECTORS)).collect() == []
    only = codes.vector_codes(spark.createDataFrame([(1, None, 1), (2, [1.0, 2.0, 3.0], 1)], VECTORS)).collect()
    assert [(r.vec_id, r.code, r.label_error) for r in only] == [(2, None, None)] and only[0].codebooks_sha256 == hashlib.sha256(b"").hexdigest()
    with pytest.raises(ValueError):
        codes.vector_codes(spark.createDataFrame([], VECTORS), entries=300)
