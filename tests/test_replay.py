"""Backtests against a plain loop over every event, and their rules one by one."""

from __future__ import annotations

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidebook.config import Backtest, Fees, InventoryAware, Settings, Symmetric
from tidebook.operators import features, replay, risk, strategies

#: Unequal sizes, so that the microprice (37.3) is not the mid (37.375).
BOOK = {"bid_px": [37.25, 37.0, 36.75], "bid_sz": [4.0, 9.0, 2.0], "ask_px": [37.5, 38.0, 38.25], "ask_sz": [16.0, 1.0, 7.0], "best_bid": 37.25, "best_ask": 37.5, "mid": 37.375, "microprice": 37.3,
        "sigma": 1.5, "liquidity_drought": None}
LADDER = "bid_px array<double>, bid_sz array<double>, ask_px array<double>, ask_sz array<double>"


def touching(size):
    return lambda book, held: (book["best_bid"], size, book["best_ask"], size)


@pytest.mark.parametrize("seed", range(6))
def test_a_queue_is_served_before_us(seed):
    """Volumes in any portions: what reaches us is what is beyond the queue each time it is served out, as told by a plain loop."""
    r = random.Random(seed)
    queue, gone, plain, total = r.choice((3.5, 8.0, 0.25)), 0.0, 0.0, 0.0
    for _ in range(60):
        volumes = [r.randint(1, 12) / 4 for _ in range(r.randint(0, 5))]
        reached, gone = replay.served(volumes, queue, gone)
        want = []
        for i, v in enumerate(volumes):
            plain += v
            if plain >= queue:
                want, plain = [*want, (i, plain - queue)], 0.0
        assert reached == want and gone == plain
        total += sum(volumes)
    assert total > 0


def test_a_side_keeps_its_place_at_its_price_only():
    side = replay.Side(True)
    side.move(37.25, 4.0, 1.0, 0.5)
    assert list(side.fills([(0, 37.25, 1.5), (1, 37.0, 9.0)])) == [] and side.gone == 1.5
    side.move(37.25, 6.0, 1.0, 0.5)  # the same price: what is gone stays gone, the queue is new
    assert list(side.fills([(0, 37.25, 2.0), (1, 37.25, 3.25)])) == [(0, 0.5), (1, 0.25)] and side.left == 0.25
    side.move(37.0, 9.0, 1.0, 0.5)
    assert side.gone == 0.0
    side.move(36.5, 0.0, 1.0, 0.5)  # nothing is shown there, so nothing is ever reached
    assert list(side.fills([(0, 36.5, 100.0)])) == [] and side.gone == 0.0
    side.move(None, 0.0, 0.0, 0.5)
    assert list(side.fills([(0, 36.5, 100.0)])) == []


def test_quotes_go_to_the_grid_away_from_the_market():
    desk = replay.Desk(lambda book, held: (37.1, 1.0, 37.6, 2.0), 0.5)
    desk.quote(BOOK, 0.25)
    bid, ask = desk.sides["A"], desk.sides["B"]
    assert (bid.price, bid.queue, bid.left) == (37.0, 4.5, 1.0) and (ask.price, ask.left) == (37.75, 2.0) and ask.queue == float("inf")
    assert replay.rounded(37.13, 0.0, True) == 37.13
    assert desk.interval([("A", 1, 37.0, 3.0), ("B", 2, 37.75, 50.0), ("A", 3, 37.0, 2.0)]) == [(3, "buy", 37.0, 0.5)] and desk.held == 0.5


def test_rules():
    naive = strategies.build("naive_mm", Settings(symmetric=Symmetric(20.0, 0.25, 2.0)))
    assert naive(BOOK, 0.0) == pytest.approx((37.3 * 0.998, 0.25, 37.3 * 1.002, 0.25))
    assert naive(BOOK, 2.0)[1::2] == (0.0, 0.25) and naive(BOOK, -2.5)[1::2] == (0.25, 0.0) and naive(BOOK | {"liquidity_drought": True}, 0.0) == strategies.NONE
    leaning = strategies.build("inventory_mm", Settings(inventory_aware=InventoryAware(0.02, 60.0, 10.0, 5.0, 0.5, 1.0)))
    risk_ = 0.02 * 1.5**2 * 10
    assert leaning(BOOK, 2.0) == pytest.approx((37.375 - 2 * risk_ - risk_ / 2, 0.5, 37.375 - 2 * risk_ + risk_ / 2, 0.5))
    assert leaning(BOOK | {"sigma": 0.0}, 0.0)[0] == pytest.approx(37.375 * (1 - 1e-4))  # never closer than the least spread
    with pytest.raises(ValueError):
        strategies.build("other")


@pytest.fixture(scope="module")
def market(spark):
    r = random.Random(1)
    books, trades, ctx, tick = [], [], [], 149
    for i in range(300):
        tick += r.choice([-1, 0, 0, 1])
        t, coin = i * 1000, "XY"[i % 2]
        bid, ask = [(tick - k) / 4 for k in range(5)], [(tick + 1 + k) / 4 for k in range(5)]
        books.append((coin, t, t * 10**6, bid, [float(r.randint(1, 9)) for _ in bid], ask, [float(r.randint(1, 9)) for _ in ask]))
        for k in range(r.choice((0, 1, 1, 3))):
            trades.append((coin, r.choice("AB"), r.choice([bid[0], ask[0], ask[1]]), float(r.randint(1, 15)), t + r.choice([0, 0, 1, 900]), t * 10**6 + k, 10 * i + k))
        if i % 10 == 0:
            ctx.append(("XY"[i % 20 > 9], t * 10**6, 0.001, 37.0))
    ctx.append(("ONLY", 5, 0.1, 1.0))
    b = spark.createDataFrame(books, f"coin string, exch_time_ms long, recv_ts_ns long, {LADDER}")
    b = b.withColumns({"best_bid": F.col("bid_px")[0], "best_ask": F.col("ask_px")[0], "liquidity_drought": F.lit(None).cast("boolean")}).withColumn("mid", (F.col("best_bid") + F.col("best_ask")) / 2)
    t = spark.createDataFrame(trades, "coin string, side string, px double, sz double, exch_time_ms long, recv_ts_ns long, tid long")
    return b, t, spark.createDataFrame(ctx, "coin string, recv_ts_ns long, funding double, oracle_px double")


def plain_replay(books, trades, size, share=0.5):
    """One coin, event by event, quotes at the touch."""
    at = sorted([(t[4], 1, t[5], t[6], t) for t in trades] + [(b[1], 0, 0, 0, b) for b in books], key=lambda e: e[:4])
    rest, gone, left, fills = {}, {"bid": 0.0, "ask": 0.0}, {"bid": 0.0, "ask": 0.0}, []
    for time, kind, _, _, x in at:
        if kind == 0:
            for side, px, sz in (("bid", x[3], x[4]), ("ask", x[5], x[6])):
                if rest.get(side, (None,))[0] != px[0]:
                    gone[side] = 0.0
                rest[side], left[side] = (px[0], sz[0]), size
            continue
        side = "bid" if x[1] == "A" else "ask"
        if side in rest and x[2] == rest[side][0]:
            gone[side] += x[3]
            need = share * rest[side][1]
            if gone[side] >= need:
                got, gone[side] = min(gone[side] - need, left[side]), 0.0
                if got > 0:
                    left[side] -= got
                    fills.append((time, "buy" if side == "bid" else "sell", x[2], got))
    return fills


def test_fills_against_a_plain_replay(market):
    b, t, _ = market
    out = replay.fills(b, t, {"two": touching(2.0), "nine": touching(9.0)}).collect()
    for coin in "XY":
        books, trades = ([tuple(r) for r in df.where(F.col("coin") == coin).collect()] for df in (b, t))
        for run, size in (("two", 2.0), ("nine", 9.0)):
            mine = sorted((r for r in out if (r.run, r.coin) == (run, coin)), key=lambda r: r.seq)
            assert [(r.timestamp_ms, r.side, r.price, r.size) for r in mine] == plain_replay(books, trades, size) and len(mine) > 20
            assert [r.seq for r in mine] == list(range(1, len(mine) + 1)) and all(r.fee == pytest.approx(r.price * r.size * 1.5e-4) for r in mine)


def test_fills_of_a_tape_in_stretches(market):
    b, t, _ = market
    rules = {"two": touching(2.0), "nine": touching(9.0)}
    parts = replay.stretches(replay.tape(b, t), replay.tape(b, t).select("ts_ms"), 100)
    counts = [p.count() for p in parts]
    assert len(counts) > 3 and sum(counts) == b.count() + t.count() and max(counts) < 200
    assert sorted(replay.fills(b, t, rules, stretch=100).collect()) == sorted(replay.fills(b, t, rules).collect())


def test_report_follows_from_the_fills(market):
    b, t, ctx = market
    filled = replay.fills(b, t, {"r": touching(2.0)}, Backtest(), Fees()).cache()
    kept = replay.accounts(filled, b, ctx, ["r"], 1000.0).cache()
    report = {r.coin: r for r in replay.report(filled, kept, 1000.0).collect()}
    assert set(report) == {"X", "Y", "ONLY"} and report["ONLY"].final_equity == 1000.0 and report["ONLY"].n_fills == 0
    for coin in "XY":
        mine = sorted((r for r in filled.where(F.col("coin") == coin).collect()), key=lambda r: r.seq)
        signed = [r.size if r.side == "buy" else -r.size for r in mine]
        last_mid = b.where(F.col("coin") == coin).orderBy(F.desc("exch_time_ms")).first().mid
        got = report[coin]
        assert got.n_fills == len(mine) and got.fees_paid == pytest.approx(sum(r.fee for r in mine)) and got.turnover_usd == pytest.approx(sum(r.price * r.size for r in mine))
        cash = 1000.0 - sum(s * r.price for s, r in zip(signed, mine, strict=True)) - got.fees_paid - got.funding_paid
        assert got.final_equity == pytest.approx(cash + sum(signed) * last_mid) and got.total_return_pct == pytest.approx((got.final_equity / 1000 - 1) * 100) and got.max_drawdown <= 0
        assert kept.where((F.col("coin") == coin) & F.col("equity").isNotNull()).count() == 150


def plain_positions(fills):
    """(inventory, average, realized) after each (signed size, price), lot by lot of one average."""
    held = average = realized = 0.0
    for by, price in fills:
        closed = min(abs(by), abs(held)) * (1 if held > 0 else -1) if by * held < 0 else 0.0
        realized += closed * (price - average)
        opened = by + closed
        held_left = held - closed
        if opened:
            average = (held_left * average + opened * price) / (held_left + opened)
        held = held_left + opened
        yield held, average, realized


@pytest.mark.parametrize("block_ms", [7_000, 86_400_000])
def test_positions_against_a_loop(spark, block_ms):
    r = random.Random(block_ms)
    rows = [(c, i * 500, i, r.choice(("buy", "sell")), r.randint(300, 400) / 8, r.choice((0.25, 0.5, 1.0, 3.0)), 0.125) for c in "XYZ" for i in range(150)]
    df = spark.createDataFrame(rows, "coin string, timestamp_ms long, n long, side string, price double, size double, fee double")
    got = {(x.coin, x.n): x for x in risk.positions(df.repartition(5), order=["timestamp_ms", "n"], block_ms=block_ms).collect()}
    assert len(got) == len(rows)
    for c in "XYZ":
        mine = [x for x in rows if x[0] == c]
        for x, want in zip(mine, plain_positions([(x[5] if x[3] == "buy" else -x[5], x[4]) for x in mine]), strict=True):
            p = got[c, x[2]]
            assert (p.inventory, p.avg_price, p.realized) == pytest.approx(want) and p.fees == pytest.approx(0.125 * (x[2] + 1))


def test_a_closed_position_keeps_its_price_until_the_next_fill(spark):
    rows = [("A", 0, "buy", 20.0, 0.1, 0.0), ("A", 1, "buy", 26.0, 0.2, 0.0), ("A", 2, "sell", 30.0, 0.3, 0.0), ("A", 3, "sell", 31.0, 2.0, 0.0), ("A", 4, "buy", 29.0, 5.0, 0.0)]
    df = spark.createDataFrame(rows, "coin string, timestamp_ms long, side string, price double, size double, fee double")
    got = sorted(risk.positions(df).collect(), key=lambda x: x.timestamp_ms)
    assert [x.avg_price for x in got] == pytest.approx([20.0, 24.0, 24.0, 31.0, 29.0]) and [x.inventory for x in got] == pytest.approx([0.1, 0.3, 0.0, -2.0, 3.0])
    assert got[2].inventory == 0.0 and got[-1].realized == pytest.approx(0.3 * 6 + 2 * 2)


def test_columns_to_lists_as_arrow_does_and_faster():
    ladder = [[float(i + k) for k in range(20)] for i in range(5_000)]
    batch = pa.RecordBatch.from_pydict({
        "px": pa.array([None, [], [1.5, None], *ladder], pa.list_(pa.float64())), "coin": [None, "Y", *["X"] * 5_001], "ts": pa.array([None, 2**62, *range(5_001)], pa.int64()),
        "mid": [None, 0.5, *[1.25] * 5_001], "dry": [None, True, *[False] * 5_001], "state": pa.array([None, b"a", *[b""] * 5_001], pa.binary()), "none": pa.array([None] * 5_003, pa.string()),
    })
    for b in (batch, batch.slice(2, 400), batch.slice(0, 1), batch.slice(0, 0)):
        assert [replay.values(c) for c in b.columns] == [c.to_pylist() for c in b.columns]
    took = {}
    for name, f in (("arrow", lambda c: c.to_pylist()), ("ours", replay.values)):
        began = time.perf_counter()
        f(batch["px"])
        took[name] = time.perf_counter() - began
    assert took["ours"] < took["arrow"] / 2


def test_prepared_books_pick_books_once(spark, market, tmp_path):
    market[0].select("coin", "exch_time_ms", "recv_ts_ns", "bid_px", "bid_sz", "ask_px", "ask_sz").write.parquet(f"{tmp_path}/source")
    out = features.prepared_books(spark.read.parquet(f"{tmp_path}/source"))
    assert out.count() == 300 and not any("/source/" in f for f in out.inputFiles())
