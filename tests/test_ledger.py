"""The set-based ledger against a plain loop over the events of each coin."""

from __future__ import annotations

import random

import pytest

from tidebook.operators import ledger

DAY = 86_400_000
FILLS = "coin string, timestamp_ms long, side string, price double, size double, fee double, seq long"
CTX = "coin string, recv_ts_ns long, funding double, oracle_px double"
BOOKS = "coin string, exch_time_ms long, recv_ts_ns long, mid double"


def loop(fills, ctx, books, start):
    """{(coin, kind, seq): (inventory, payment, held payment, cash, funding, held, equity)}."""
    out = {}
    for coin in {x[0] for x in [*fills, *ctx, *books]}:
        events = [(f[1], 1, f[6], f) for f in fills if f[0] == coin] + [(c[1] // 10**6, 2, c[1], c) for c in ctx if c[0] == coin and None not in c] + [(b[1], 0, b[2], b) for b in books if b[0] == coin]
        cash, inv, paid, held, clock, last, rate, oracle = start, 0.0, 0.0, 0.0, None, None, None, None
        for t, kind, seq, e in sorted(events, key=lambda x: x[:3]):
            step = 0.0 if rate is None else inv * rate * oracle * (t - last) / 3_600_000
            charge = 0.0
            if kind == 1:
                signed = e[4] if e[2] == "buy" else -e[4]
                inv += signed
                cash -= signed * e[3] + e[5]
            elif kind == 2:
                rate, oracle = e[2], e[3]
                charge = 0.0 if clock is None else inv * oracle * rate * (t - clock) / 3_600_000
                clock, cash, paid = t, cash - charge, paid + charge
            last, held = t, held + step
            out[coin, kind, seq] = (inv, charge, step, cash, paid, held, cash + inv * e[3] if kind == 0 else None)
    return out


@pytest.mark.parametrize("block_ms", [DAY, 40_000])
def test_ledger_against_a_loop(spark, block_ms):
    r = random.Random(block_ms)
    at = lambda: r.randrange(0, 400) * 1000  # noqa: E731  # many equal times, and blocks without events
    fills = [(c, at(), r.choice(("buy", "sell")), r.choice((90.0, 101.5)), r.choice((0.5, 2.0)), 0.01, i) for c in "AB" for i in range(60)]
    ctx = [(c, at() * 10**6 + i, r.choice((-0.002, 0.001, 0.5)), r.choice((95.0, 120.0))) for c in "AC" for i in range(25)] + [("A", 5, None, 1.0), ("A", 6, 0.1, None)]
    books = [(c, at(), i, 100.0 + i) for c in "AB" for i in range(40)]
    events = ledger.account_events(spark.createDataFrame(fills, FILLS), spark.createDataFrame(ctx, CTX), spark.createDataFrame(books, BOOKS))
    got = ledger.ledger(events.repartition(6), 1000.0, block_ms=block_ms).collect()
    want = loop(fills, ctx, books, 1000.0)
    assert len(got) == len(want) == 120 + 50 + 80
    for x in got:
        w = want[x.coin, x.kind, x.seq]
        assert (x.inventory, x.payment, x.held_payment, x.cash, x.funding_paid, x.held_paid) == pytest.approx(w[:6])
        assert (x.equity is None) == (w[6] is None) and (w[6] is None or x.equity == pytest.approx(w[6]))


def test_the_first_observation_only_starts_the_clock(spark):
    fills = spark.createDataFrame([("A", 0, "buy", 10.0, 3.0, 0.0, 1), ("A", 5_400_000, "sell", 10.0, 2.0, 0.0, 2)], FILLS)
    ctx = spark.createDataFrame([("A", h * 3_600_000 * 10**6, 0.01, 50.0) for h in (1, 2)], CTX)
    rows = {(r.kind, r.seq): r for r in ledger.ledger(ledger.account_events(fills, ctx), 0.0).collect()}
    first, second = (rows[2, h * 3_600_000 * 10**6] for h in (1, 2))
    assert first.payment == 0.0 and second.payment == pytest.approx(1 * 50 * 0.01) and second.cash == pytest.approx(-10.0 - 0.5)
    assert second.held_paid == pytest.approx((3 * 0.5 + 1 * 0.5) * 50 * 0.01) and second.equity is None


def test_nothing_happened(spark):
    assert ledger.ledger(ledger.account_events(spark.createDataFrame([], FILLS), spark.createDataFrame([], CTX)), 1.0).collect() == []
