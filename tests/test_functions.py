from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tidebook.functions import book, liquidity, quotes, rates, slippage, tails, ticks

LADDER = "bid_px array<double>, bid_sz array<double>, ask_px array<double>, ask_sz array<double>"


def one(df):
    return df.first().asDict()


@pytest.fixture(scope="module")
def books(spark):
    rows = [([100.0, 99.0], [2.0, 3.0], [101.0, 102.0], [1.0, 4.0])]
    return spark.createDataFrame(rows, LADDER)


def test_spread_and_microprice(books):
    r = one(book.with_microprice(book.with_spread(books)))
    assert r["mid"] == 100.5 and r["spread_abs"] == 1.0
    assert r["spread_bps"] == pytest.approx(1 / 100.5 * 1e4)
    assert r["microprice"] == pytest.approx(302 / 3)


def test_empty_side_and_zero_mid(spark):
    df = spark.createDataFrame([([], [], [101.0], [1.0]), ([0.0], [0.0], [0.0], [0.0])], LADDER)
    empty, zero = book.with_imbalance(book.with_microprice(book.with_spread(df)), (5,)).collect()
    assert empty.best_bid is None and empty.mid is None and empty.spread_bps is None
    assert zero.spread_bps is None and zero.microprice == 0.0 and zero.tob_imbalance == 0.0 and zero.imbalance_d5 == 0.0


def test_depth_imbalance(spark):
    df = spark.createDataFrame([([1.0], [1.0, 2.0, 3.0], [1.0], [3.0, 2.0, 1.0])], LADDER)
    assert one(book.with_imbalance(df, (3,)))["imbalance_d3"] == pytest.approx(-1 / 6)


def test_short_book_options(spark):
    df = spark.createDataFrame([([1.0], [1.0, 2.0, 4.0], [1.0], [3.0, 2.0, 1.0])], LADDER)
    assert one(book.with_imbalance(df, (5,)))["imbalance_d5"] == pytest.approx(-0.12, abs=0.005)
    assert one(book.with_imbalance(df, (5,), short_book="pad"))["imbalance_d5"] == pytest.approx(-0.0196, abs=0.0001)
    with pytest.raises(ValueError):
        book.depth_imbalance("bid_sz", "ask_sz", 5, short_book="other")


def test_level_weights(spark):
    df = spark.range(1)
    assert one(df.select(book.level_weights(3).alias("w")))["w"] == [3.0, 2.0, 1.0]
    assert one(df.select(book.level_weights(3, "exp_decay").alias("w")))["w"] == [1.0, 0.5, 0.25]
    with pytest.raises(ValueError):
        book.level_weights(3, "other")


@pytest.mark.parametrize(("size", "vwap", "filled"), [(3.0, 305 / 3, 3.0), (10.0, (101 + 204 + 515) / 8, 8.0), (0.0, None, 0.0)])
def test_walk(spark, size, vwap, filled):
    df = spark.createDataFrame([([101.0, 102.0, 103.0], [1.0, 2.0, 5.0])], "p array<double>, s array<double>")
    w = df.select(slippage.walk("p", "s", size).alias("w")).first().w
    assert w.filled == filled and (w.vwap is None if vwap is None else w.vwap == pytest.approx(vwap))


def test_slippage_sides(books):
    df = book.with_spread(books)
    r = one(slippage.with_slippage(df, [1], "sell"))
    assert r["slippage_bps_1"] == pytest.approx(0.5 / 100.5 * 1e4)
    e = df.select(slippage.estimate(3, "buy").alias("e")).first().e
    assert e.fully_filled and e.vwap == pytest.approx(305 / 3)
    with pytest.raises(ValueError):
        slippage.with_slippage(df, [1.2, 1.7], "buy")


def test_depth_within(spark):
    df = spark.createDataFrame([([99.5, 98.0], [4.0, 9.0], [100.5, 102.0], [6.0, 9.0])], LADDER).withColumn("mid", F.lit(100.0))
    assert one(liquidity.with_depth(df, 100))["depth_within_100bps"] == 10.0
    assert one(df.withColumn("mid", F.lit(0.0)).select(liquidity.depth_within_bps(100).alias("d")))["d"] == 0.0


def test_rates(spark):
    r = one(spark.range(1).select(rates.annualized(F.lit(0.0000125)).alias("a"), rates.funding_payment(F.lit(2.0), F.lit(100.0), F.lit(0.01)).alias("p"), rates.fee(F.lit(-1000.0), 1.5).alias("f")))
    assert r["a"] == pytest.approx(0.1157, abs=1e-3) and r["p"] == 2.0 and r["f"] == pytest.approx(0.15)


def test_ticks(spark):
    df = spark.createDataFrame([([100.0, 100.5, 102.0],), ([7.0],)], "p array<double>")
    assert [r.t for r in df.select(ticks.tick_size("p").alias("t")).collect()] == [0.5, 0.01]
    r = one(spark.range(1).select(*[ticks.round_to_tick(F.lit(10.3), F.lit(t), d).alias(n) for n, t, d in (("down", 0.5, "down"), ("up", 0.5, "up"), ("same", 0.0, "up"))]))
    assert (r["down"], r["up"], r["same"]) == (10.0, 10.5, 10.3)


def test_levels_and_crossed(spark):
    df = spark.createDataFrame([([98.0, 100.0, 99.0], [1.0, 2.0, 3.0])], "p array<double>, s array<double>")
    r = one(df.select(book.levels("p", "s", 2, "bid").alias("b"), book.levels("p", "s", 2, "ask").alias("a")))
    assert [x.px for x in r["b"]] == [100.0, 99.0] and [x.px for x in r["a"]] == [98.0, 99.0]
    assert one(spark.range(1).select(book.is_crossed(F.lit(2.0), F.lit(1.0)).alias("x"), book.is_crossed(F.lit(None), F.lit(1.0)).alias("y"))) == {"x": True, "y": False}


def test_quotes(spark):
    q = lambda inv, dry: spark.range(1).select(quotes.symmetric_quote(F.lit(100.0), F.lit(float(inv)), 10, 0.5, 1.0, F.lit(dry)).alias("q")).first().q
    assert q(0, False).bid_px == pytest.approx(99.9) and q(0, False).ask_sz == 0.5
    assert q(1, False).bid_sz == 0.0 and q(-1, False).ask_sz == 0.0 and q(0, True).bid_px is None and q(0, None).bid_sz == 0.5


def test_tails(spark):
    """Two-sided tails against exact sums, closed forms and values of published tables, on either side of every switch."""
    value = lambda c: spark.range(1).select(c.alias("v")).first().v
    lit = lambda *v: [F.lit(x) for x in v]
    for x in (0.5, 1.0, 3.25, 40.0, 1e6):
        assert value(tails.log_gamma(x)) == pytest.approx(math.lgamma(x), rel=1e-13, abs=1e-13)
    assert value(tails.log_gamma_step(1e9, 0.5)) == pytest.approx(0.5 * math.log(1e9) - 1 / 8e9, rel=1e-14)
    assert value(tails.beta_inc(2.0, 3.0, 0.5)) == pytest.approx(0.6875) and value(tails.beta_inc(2.0, 3.0, 0.0)) == 0.0 and value(tails.beta_inc(2.0, 3.0, 1.0)) == 1.0
    for x in (0.0, 0.3, 1.0, 1.999, 2.0, 3.5, 8.0):
        assert value(tails.erfc(x)) == pytest.approx(math.erfc(x), rel=1e-11)
    for hits, n in ((223, 278), (8, 10), (0, 5), (4, 9), (5020, 10_000)):
        exact = min(1.0, 2 * sum(math.comb(n, i) for i in range(min(hits, n - hits) + 1)) / 2**n)
        assert value(tails.binomial_two_sided(*lit(hits, n))) == pytest.approx(exact, rel=1e-9)
    assert value(tails.binomial_two_sided(*lit(5, 10))) == 1.0 and value(tails.binomial_two_sided(*lit(0, 0))) is None
    assert value(tails.correlation_p(*lit(0.36306433582563885, 873))) == pytest.approx(1.3617509011686383e-28, rel=1e-9)
    assert value(tails.correlation_p(*lit(0.632, 10))) == pytest.approx(0.05, abs=2e-4)  # the 5 % point of r for 8 degrees
    assert value(tails.correlation_p(*lit(1.0, 10))) == 0.0 and value(tails.correlation_p(*lit(0.0, 10))) == pytest.approx(1.0) and value(tails.correlation_p(*lit(0.5, 2))) is None
    for t, df in ((2.228, 10), (1.0, 1)):
        assert value(tails.t_two_sided(*lit(t, df))) == pytest.approx({10: 0.05, 1: 0.5}[df], abs=2e-5)
    assert value(tails.t_two_sided(*lit(4.587, 10))) == pytest.approx(0.001, abs=2e-6) and value(tails.t_two_sided(*lit(1.0, 0))) is None
    assert value(tails.t_two_sided(*lit(1.959963984540054, 10**9))) == pytest.approx(0.05, rel=1e-7)  # near the normal distribution
    assert value(tails.normal_two_sided(F.lit(-1.959963984540054))) == pytest.approx(0.05)
