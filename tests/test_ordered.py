"""Windows, labels and matches on streams against their batch forms, over shuffled micro-batches with late rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidebook.functions import book
from tidebook.operators import asof
from tidebook.operators import features as batch
from tidebook.streaming import ordered

L = "array<double>"
BOOKS = f"coin string, exch_time_ms long, recv_ts_ns long, bid_px {L}, bid_sz {L}, ask_px {L}, ask_sz {L}"
TRADES = "coin string, exch_time_ms long, recv_ts_ns long, tid long, px double, sz double"
FAR = 10**7


@pytest.fixture(scope="module")
def rocks(spark):
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    yield ordered.with_rocksdb(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)


def books(n=90, seed=3):
    r, out = random.Random(seed), []
    for c in "AB":
        t, mid = 100_000, 400
        for i in range(n):
            t, mid = t + r.choice((200, 400, 1000)), mid + r.choice((-1, 0, 1))
            sides = [[mid + s * (k + 1) / 2 for k in range(4)] for s in (-1, 1)]
            out.append((c, t, t * 10**6 + i, sides[0], [float(r.randint(1, 20)) for _ in range(4)], sides[1], [float(r.randint(1, 20)) for _ in range(4)]))
        out.append((c, t, t * 10**6 + n, sides[0], [99.0] * 4, sides[1], [99.0] * 4))  # the same time again: the first received counts
    return out


def batches(rows, seed=1, spread_ms=1500, n=5):
    """Rows in an order that goes back in time by less than the watermark's delay, in n micro-batches."""
    r = random.Random(seed)
    rows = sorted(rows, key=lambda x: x[1] + r.random() * spread_ms)
    size = -(-len(rows) // n)
    return [rows[i : i + size] for i in range(0, len(rows), size)]


def stream(spark, path, parts, schema):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(str(path))


def run(df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c_{name}").start()
    q.awaitTermination(300)
    return df.sparkSession.table(name).collect()


def last(rows):
    """A book far ahead, so that the watermark passes all others."""
    far = max(r[1] for r in rows) + FAR
    return [[(c, far, far * 10**6, [1.0], [1.0], [2.0], [1.0]) for c in "AB"]]


def test_features_equal_the_batch(rocks, tmp_path):
    rows = books()
    late = ("A", 100_001, 1, [1.0], [1.0], [2.0], [1.0])  # far behind the watermark: dropped
    parts = batches(rows)
    got = run(ordered.features(stream(rocks, tmp_path / "in", [*parts, [late], *last(rows)], BOOKS), 8, 10.0, 12, -1.0, "3 seconds"), tmp_path, "live_features")
    got = {(r.coin, r.exch_time_ms): r for r in got if r.exch_time_ms < FAR}
    df = batch.dedup_books(book.with_spread(rocks.createDataFrame(rows, BOOKS)))
    flow = batch.with_flow(df, 8)
    want = flow.join(batch.liquidity_signal(df, 10.0, 12, -1.0), ["coin", "exch_time_ms"]).collect()
    assert len(got) == len(want) == 180
    for w in want:
        g = got[w.coin, w.exch_time_ms]
        for name in ("ofi", "log_ret_1", "realized_vol", "momentum", "liquidity_z"):
            assert (g[name] is None) == (w[name] is None) and (w[name] is None or g[name] == pytest.approx(w[name], abs=1e-9)), name
        assert g.depth == w.depth_within_10bps and g.liquidity_drought == w.liquidity_drought


def test_labels_equal_the_batch(rocks, tmp_path):
    rows, horizons = books(60, 5), [100, 1000, 5000]
    got = run(ordered.forward_returns(stream(rocks, tmp_path / "in", [*batches(rows), *last(rows)], BOOKS), horizons, "3 seconds"), tmp_path, "live_labels")
    first = batch.dedup_books(rocks.createDataFrame(rows, BOOKS))
    want = asof.forward_returns(book.with_microprice(book.with_spread(first)), horizons).collect()
    end = {c: max(r[1] for r in rows if r[0] == c) for c in "AB"}
    found = {(r.coin, r.exch_time_ms, r.horizon_ms): r for r in got if r.exch_time_ms + r.horizon_ms <= end[r.coin]}
    n = 0
    for w in want:
        for h in horizons:
            if w[f"fwd_logret_mid_{h}ms"] is not None:
                g, n = found[w.coin, w.exch_time_ms, h], n + 1
                assert g.fwd_logret_mid == pytest.approx(w[f"fwd_logret_mid_{h}ms"], abs=1e-12) and g.fwd_logret_microprice == pytest.approx(w[f"fwd_logret_microprice_{h}ms"], abs=1e-12)
    assert n == len(found) > 250


def test_matches_equal_the_batch(rocks, tmp_path):
    rows, r = books(50, 7), random.Random(2)
    times = [x[1] for x in rows if x[0] == "A"]
    trades = [("A", t + r.choice((-1, 0, 0, 7)), t * 10**6 + i, i, 10.0, 1.0) for i, t in enumerate(times)] + [("A", 99_000, 1, 900, 10.0, 1.0), ("C", times[3], 1, 901, 10.0, 1.0)]
    far = max(times) + FAR
    b = stream(rocks, tmp_path / "b", [*batches(rows), *last(rows)], BOOKS)
    t = stream(rocks, tmp_path / "t", [*batches(trades, 4), [(c, far, 1, 999, 1.0, 1.0) for c in "AC"]], TRADES)
    got = {x.tid: x for x in run(ordered.book_before_trade(t, b, "3 seconds"), tmp_path, "live_matches") if x.tid < 999}
    priced = book.with_spread(rocks.createDataFrame(rows, BOOKS)).withColumn("book_ms", F.col("exch_time_ms"))
    want = asof.book_before_trade(rocks.createDataFrame(trades, TRADES), priced, ["mid", "book_ms"]).collect()
    assert len(got) == len(want) == len(trades)
    assert all((got[w.tid].mid, got[w.tid].book_ms) == (w.mid, w.book_ms) for w in want) and got[900].mid is None and got[901].mid is None
