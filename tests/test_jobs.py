"""The four jobs on a scripted feed: from sockets to reports."""

from __future__ import annotations

import dataclasses
import json
import random

import pytest

from tidebook import config, jobs
from tidebook.sources import normalize, sinks

BOOKS = 160


def script() -> list[str]:
    """Books a second apart whose ladders move by whole ticks, each followed by a trade somewhere inside."""
    r, out, mid = random.Random(4), [], 50_000
    for i in range(BOOKS):
        mid += r.choice([-1, 0, 1])
        time = 1_704_067_200_000 + 1000 * i
        sides = [[{"px": str(mid + s * (k + 1)), "sz": str(r.randint(1, 9) / 4), "n": 1} for k in range(20)] for s in (-1, 1)]
        out.append(json.dumps({"channel": "l2Book", "data": {"coin": "BTC", "time": time, "levels": sides}}))
        side = r.choice("AB")
        px = mid + (-1 if side == "A" else 1) * r.randint(6, 10)
        out.append(json.dumps({"channel": "trades", "data": [{"coin": "BTC", "side": side, "px": str(px), "sz": "6", "time": time + 1, "hash": "0x0", "tid": i}]}))
    out.append(json.dumps({"channel": "activeAssetCtx", "data": {"coin": "BTC", "ctx": {"funding": "0.0001", "oraclePx": "50000"}}}))
    return out


class Scripted:
    """A connection that has the script once, and then nothing."""

    def __init__(self, url):
        self.replies = iter(script())

    def send(self, text):
        pass

    def recv(self, timeout):
        reply = next(self.replies, None)
        if reply is None:
            raise TimeoutError
        return reply


def polled(url, body):
    return [["BTC", [["HlPerp", {"fundingRate": "0.0002", "nextFundingTime": 7, "fundingIntervalHours": 8}]]], ["OTHER", []]]


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("jobs"))
    s = config.Settings(symbols=("BTC",))
    s = dataclasses.replace(s, capture=dataclasses.replace(s.capture, data_dir=root, ws_url="ws://scripted"))
    last = jobs.collect(spark, s, "http://scripted", 20, connect=f"{__name__}:Scripted", fetch=f"{__name__}:polled")
    assert len(last) == 2
    jobs.main(["normalize", "--data", root])
    return root


def test_collected_messages_are_all_normalized(spark, data):
    feed = {t: normalize.read_table(spark, f"{data}/normalized/feed", t) for t in ("l2book", "trades", "asset_ctx")}
    assert {t: df.count() for t, df in feed.items()} == {"l2book": BOOKS, "trades": BOOKS, "asset_ctx": 1}
    assert feed["trades"].select("tid").distinct().count() == BOOKS
    polls = normalize.read_table(spark, f"{data}/normalized/funding", "predicted_funding").collect()
    assert polls and {(p.coin, p.venue, p.funding_rate, p.funding_interval_hours) for p in polls} == {("BTC", "HlPerp", 0.0002, 8)}


def test_study_report(spark, data, tmp_path):
    jobs.main(["study", "--data", data, "--out", str(tmp_path), "--symbol", "btc"])
    rows = sinks.read_results(spark, f"{tmp_path}/research_csv").collect()
    assert {(r.feature, r.horizon_ms) for r in rows} == {(f, h) for f in jobs.SIGNALS for h in config.Research().horizons_ms}
    assert len(rows) == 25 and all(r.coin == "BTC" and r.n > 0 for r in rows)
    assert [(r.horizon_ms, r.feature) for r in rows] == sorted((r.horizon_ms, r.feature) for r in rows)  # as written
    again = sinks.read_results(spark, f"{tmp_path}/research_json").collect()
    assert sorted((r.feature, r.horizon_ms, r.n) for r in again) == sorted((r.feature, r.horizon_ms, r.n) for r in rows)


def test_backtest_report(spark, data, tmp_path):
    jobs.main(["backtest", "--data", data, "--out", str(tmp_path), "--symbol", "BTC"])
    summary = {r.run: r for r in sinks.read_results(spark, f"{tmp_path}/summary_json").collect()}
    assert set(summary) == {"naive_mm", "inventory_mm"} and summary["naive_mm"].n_fills > 0
    fills = sinks.read_results(spark, f"{tmp_path}/fills_csv").collect()
    equity = sinks.read_results(spark, f"{tmp_path}/equity_csv").collect()
    for some in (fills, equity):
        times = [(r.run, r.coin, r.timestamp_ms) for r in some]
        assert times == sorted(times)
    for run, r in summary.items():
        mine = [f for f in fills if f.run == run]
        assert len(mine) == r.n_fills and sum(f.fee for f in mine) == pytest.approx(r.fees_paid)
        assert sum(e.run == run for e in equity) == BOOKS
