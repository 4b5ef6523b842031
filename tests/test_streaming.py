from __future__ import annotations

import time

import pytest

from pyspark.sql import functions as F

from tidebook.functions import book, liquidity, quotes, rates, slippage, ticks
from tidebook.streaming import keyed


def run(spark, tmp_path, batches, schema, transform, mode, name):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = transform(stream).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_gaps_across_batches(spark, tmp_path):
    batches = [[("c", "A", 0), ("c", "A", 10)], [("c", "A", 100), ("c", "B", 5000)], [("c", "A", 50), ("c", "A", 120)]]
    got = run(spark, tmp_path, batches, "channel string, coin string, exch_time_ms long", lambda s: keyed.gaps(s, 60), "append", "gaps")
    assert [tuple(r) for r in got] == [("c", "A", 100, 90)]


def test_latest_funding(spark, tmp_path):
    batches = [[("A", None, 0.1, 1), ("A", "HlPerp", 0.3, 1)], [("A", None, 0.2, 2), ("A", "Other", 9.0, 5)], [("A", None, 0.0, 1)]]
    got = run(spark, tmp_path, batches, "coin string, venue string, rate double, recv_ts_ns long", lambda s: keyed.latest_funding(s, "HlPerp"), "update", "funding")
    assert tuple(got[-1]) == ("A", 0.2, 0.3)


def test_books(spark, tmp_path):
    batches = [[("A", "bid", 100.0, 1.0, 1), ("A", "bid", 99.0, 2.0, 2), ("A", "ask", 101.0, 3.0, 3)], [("A", "bid", 100.0, 0.0, 4), ("A", "ask", 100.5, 1.0, 5)]]
    got = run(spark, tmp_path, batches, "coin string, side string, price double, size double, seq long", lambda s: keyed.books(s, 5), "update", "books")
    assert got[-1].bid_px == [99.0] and got[-1].ask_px == [100.5, 101.0] and got[-1].ask_sz == [1.0, 3.0]


def test_spread_by_window(spark, tmp_path):
    schema = "coin string, recv_ts_ns long, bid_px array<double>, ask_px array<double>"
    batches = [[("A", s * 10**9, [100.0], [101.0])] for s in (0, 30, 300, 301)]
    got = run(spark, tmp_path, batches, schema, lambda s: keyed.spread_by_window(s), "append", "spreads")
    assert got[0].n == 2 and got[0].spread_bps == pytest.approx(1 / 100.5 * 1e4)


def test_scalars_on_a_stream(spark, tmp_path):
    """Spread, microprice, imbalance, slippage, depth, rates, ticks and quotes: the same columns on a stream as on a table."""
    ladder = "array<double>"
    schema = f"coin string, bid_px {ladder}, bid_sz {ladder}, ask_px {ladder}, ask_sz {ladder}, funding double"
    rows = [("A", [40.25 - i, 40.0 - i], [3.0, 1.5 + i], [40.5 + i, 41.0 + i], [2.0, 8.0], 1e-5 * i) for i in range(6)] + [("B", [], [], [], [], 0.0)]

    def scalars(df):
        df = liquidity.with_depth(book.with_imbalance(book.with_microprice(book.with_spread(df)), (2,)), 300.0)
        df = rates.with_apr(slippage.with_slippage(df, [1, 4], "buy"))
        tick = ticks.tick_size("ask_px")
        quote = quotes.symmetric_quote("microprice", F.lit(0.0), 5.0, 1.0, 2.0, F.lit(False))
        extra = {"tick": tick, "down": ticks.round_to_tick(F.col("mid"), F.lit(0.5), "down"), "fee": rates.fee(F.col("mid"), 1.5), "quote": quote, "paid": rates.funding_payment(F.lit(2.0), "mid", "funding")}
        return df.withColumns(extra | {"at": book.depth_at(F.col("best_bid"), "bid_px", "bid_sz"), "crossed": book.is_crossed(F.col("best_bid"), F.col("best_ask")), "best": book.levels("bid_px", "bid_sz", 1, "bid")})

    want = scalars(spark.createDataFrame(rows, schema)).collect()
    got = run(spark, tmp_path, [rows[:3], rows[3:]], schema, scalars, "append", "scalars")
    assert len(want[0]) > 20 and sorted(map(repr, got)) == sorted(map(repr, want))


def test_capture_stats_count_messages(spark, tmp_path):
    stats = keyed.CaptureStats()
    spark.streams.addListener(stats)
    try:
        run(spark, tmp_path, [[("c", "A", i)] for i in range(4)], "channel string, coin string, exch_time_ms long", lambda s: s, "append", "counted")
        for _ in range(100):
            if stats.ended:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(stats)
    assert stats.messages == 4 and stats.batches >= 4 and stats.ended == 1 and stats.rate > 0
