"""The book after every update against a plain dictionary."""

from __future__ import annotations

import random

import pytest

from tidebook.operators import events

UPDATES = "coin string, side string, price double, size double, seq long, exch_time_ms long"


@pytest.mark.parametrize(("block_ms", "n"), [(1000, 3), (50, 1), (10**9, 5)])
def test_book_history(spark, block_ms, n):
    r = random.Random(n)
    rows, t = [], 0
    for i in range(900):
        t += r.choice((0, 1, 1, 5, 700))  # blocks without updates too
        rows.append((r.choice("AB"), r.choice(("bid", "ask")), r.randint(1, 25) / 4, r.choice((0.0, 0.0, 1.0, 2.5, None)), i, t))
    df = spark.createDataFrame([*rows, (None, "bid", 1.0, 1.0, 900, t), ("A", None, 1.0, 1.0, 901, t), ("A", "bid", None, 1.0, 902, t)], UPDATES)
    got = {x.seq: x for x in events.book_history(df.repartition(5), n, block_ms=block_ms).collect()}
    assert set(got) == set(range(900))
    books = {c: {"bid": {}, "ask": {}} for c in "AB"}
    for coin, side, price, size, seq, _ in rows:
        levels = books[coin][side]
        if size:
            levels[price] = size
        else:
            levels.pop(price, None)
        x = got[seq]
        for s in ("bid", "ask"):
            best = sorted(books[coin][s].items(), reverse=s == "bid")[:n]
            assert x.coin == coin and x[f"{s}_px"] == [p for p, _ in best] and x[f"{s}_sz"] == [z for _, z in best]


def test_no_updates(spark):
    assert events.book_history(spark.createDataFrame([], UPDATES)).collect() == []
