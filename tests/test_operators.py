from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidebook.functions import book
from tidebook.operators import asof, blocks, events, features, ranks, risk, stats, study

DAY = 86_400_000


@pytest.fixture(scope="module")
def series(spark):
    """Two coins with uneven steps over several blocks, some of them empty."""
    rng = np.random.default_rng(0)
    rows = []
    for coin in ("X", "Y"):
        t = 0
        for i in range(120):
            t += int(rng.choice([5, 40, 300, 2500]))
            rows.append((coin, t, float(rng.integers(1, 50)), i))
    return spark.createDataFrame(rows, "coin string, exch_time_ms long, v double, i long").cache()


@pytest.mark.parametrize("rows", [1, 3, 25])
def test_blocks_equal_plain_windows(series, rows):
    frame = lambda w: F.sum("v").over(w.rowsBetween(-rows, 0))
    ours = blocks.over_history(series, rows, lambda d, w: d.withColumn("s", frame(w)), block_ms=500)
    plain = series.withColumn("s", frame(Window.partitionBy("coin").orderBy("exch_time_ms")))
    assert sorted(map(tuple, ours.select(*plain.columns).collect())) == sorted(map(tuple, plain.collect()))


def test_lookback_equals_plain_range(series):
    f = lambda w: F.sum("v").over(w.rangeBetween(-700, 0))
    ours = blocks.over_lookback(series, 700, lambda d, w: d.withColumn("s", f(w)), block_ms=500)
    plain = series.withColumn("s", f(Window.partitionBy("coin").orderBy("exch_time_ms")))
    assert sorted(map(tuple, ours.select(*plain.columns).collect())) == sorted(map(tuple, plain.collect()))


def test_running(series):
    ours = blocks.running(series, {"s": F.col("v")}, block_ms=500)
    plain = series.withColumn("s", F.sum("v").over(Window.partitionBy("coin").orderBy("exch_time_ms")))
    assert sorted(map(tuple, ours.select("coin", "i", "s").collect())) == sorted(map(tuple, plain.select("coin", "i", "s").collect()))


@pytest.mark.parametrize("direction", ["forward", "backward"])
def test_asof_brute_force(spark, series, direction):
    rows = [(r.coin, r.exch_time_ms, r.v) for r in series.collect()]
    q = [(c, t, i) for i, (c, t) in enumerate([(c, t) for c in ("X", "Y", "Z") for t in range(-100, 90_000, 1111)] + [(r[0], r[1]) for r in rows[::9]])]
    got = asof.asof(spark.createDataFrame(q, "coin string, at long, q long"), series, ["v"], "coin", "at", "exch_time_ms", direction, block_ms=2000)
    want = {}
    for c, t, i in q:
        near = [(x, v) for k, x, v in rows if k == c and (x >= t if direction == "forward" else x <= t)]
        want[i] = (min(near) if direction == "forward" else max(near))[1] if near else None
    assert {r.q: r.v for r in got.collect()} == want


def test_forward_returns_and_index(spark):
    df = spark.createDataFrame([("A", t, float(p), float(p)) for t, p in ((0, 100), (100, 101), (200, 102), (300, 104))], "coin string, exch_time_ms long, mid double, microprice double")
    out = asof.forward_returns(df, [100], block_ms=150).orderBy("exch_time_ms").collect()
    assert out[0].fwd_logret_mid_100ms == pytest.approx(np.log(101 / 100)) and out[3].fwd_logret_mid_100ms is None
    t = spark.createDataFrame([("A", x) for x in (0, 100, 250, 400, 900)], "coin string, exch_time_ms long")
    got = {r.exch_time_ms: r.fwd_idx for r in asof.forward_index(t, 250, block_ms=200).collect()}
    assert got == {0: 2, 100: 3, 250: 4, 400: 4, 900: 5}


def test_order_flow(spark):
    rows = [("A", 0, 100.0, 101.0, [5.0], [5.0]), ("A", 1, 100.0, 101.0, [8.0], [2.0]), ("A", 2, 101.0, 102.0, [4.0], [3.0]), ("A", 3, 100.0, 101.0, [7.0], [6.0])]
    df = spark.createDataFrame(rows, "coin string, exch_time_ms long, best_bid double, best_ask double, bid_sz array<double>, ask_sz array<double>")
    got = [r.ofi for r in features.with_flow(df.withColumn("mid", (F.col("best_bid") + F.col("best_ask")) / 2)).orderBy("exch_time_ms").collect()]
    assert got == [None, 6.0, 4.0 + 2.0, -4.0 - 6.0]


def test_drought(spark):
    depth = [100.0] * 15 + [98.0, 5.0, 4.0, 6.0, 5.0]
    rows = [("A", i, [99.9], [d], [100.1], [0.0], 100.0) for i, d in enumerate(depth)]
    df = spark.createDataFrame(rows, "coin string, exch_time_ms long, bid_px array<double>, bid_sz array<double>, ask_px array<double>, ask_sz array<double>, mid double")
    flags = [r.liquidity_drought for r in features.with_liquidity(df, 100, 10, -2.5, block_ms=7).orderBy("exch_time_ms").collect()]
    assert flags[15:17] == [True, True] and not any(flags[:15])


def test_dedup_keeps_first_received(spark):
    rows = [("A", 1, 20, [1.0]), ("A", 1, 10, [2.0]), ("A", 2, 30, [3.0])]
    df = spark.createDataFrame(rows, "coin string, exch_time_ms long, recv_ts_ns long, bid_px array<double>").withColumns({c: F.col("bid_px") for c in ("bid_sz", "ask_px", "ask_sz")})
    assert sorted((r.exch_time_ms, r.recv_ts_ns) for r in features.dedup_books(df).collect()) == [(1, 10), (2, 30)]


def test_split_is_chronological(spark):
    df = spark.createDataFrame([("A", t) for t in (0, 10, 20, 30, 40, 1000)], "coin string, exch_time_ms long")
    assert [r.exch_time_ms for r in stats.chronological_split(df, 0.5).where("not is_train").collect()] == [1000]


def test_book_from_updates(spark):
    rows = [("A", "bid", 100.0, 1.0, 1), ("A", "bid", 99.0, 2.0, 2), ("A", "bid", 100.0, 0.0, 3), ("A", "ask", 101.0, 1.0, 4), ("A", "ask", 101.0, 5.0, 5)]
    b = events.book_from_updates(spark.createDataFrame(rows, "coin string, side string, price double, size double, seq long")).first()
    assert [(x.px, x.sz) for x in b.bids] == [(99.0, 2.0)] and [(x.px, x.sz) for x in b.asks] == [(101.0, 5.0)]


def cells(spark, n=80, seed=3):
    rng = np.random.default_rng(seed)
    x, c, e = rng.normal(size=n).round(1), rng.normal(size=n), rng.normal(size=n)
    y = 0.5 * x + 0.2 * c + e + np.roll(e, 1)
    return x, c, y, spark.createDataFrame([("A", "f", 1000, i * 1000, float(a), float(b), float(d)) for i, (a, b, d) in enumerate(zip(x, c, y, strict=True))], "coin string, feature string, horizon_ms long, exch_time_ms long, x double, c double, y double")


def test_information_coefficient(spark):
    x, _, y, df = cells(spark)
    r = stats.information_coefficient(df).first()

    def ranks(v):
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])

    assert r.pearson == pytest.approx(np.corrcoef(x, y)[0, 1]) and r.spearman == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1])
    assert stats.information_coefficient(df.limit(9)).first().pearson is None


@pytest.mark.parametrize("lags", [1, 7])
@pytest.mark.parametrize("controls", [[], ["c"]])
def test_hac_matches_the_matrix_form(spark, lags, controls):
    x, c, y, df = cells(spark)
    lag = spark.createDataFrame([("A", 1000, lags)], "coin string, horizon_ms long, lags int")
    o = stats.hac_regression(df, controls, lag).first()
    a = np.column_stack([np.ones(len(x)), x, *([c] if controls else [])])
    beta = np.linalg.lstsq(a, y, rcond=None)[0]
    s = a * (y - a @ beta)[:, None]
    cov = s.T @ s
    for j in range(1, lags + 1):
        g = s[j:].T @ s[:-j]
        cov += (1 - j / (lags + 1)) * (g + g.T)
    inv = np.linalg.inv(a.T @ a)
    assert o["beta"] == pytest.approx(beta) and o["t"] == pytest.approx(beta / np.sqrt(np.diag(inv @ cov @ inv)))
    assert o["p"] == pytest.approx([math.erfc(abs(z) / math.sqrt(2)) for z in o["t"]]) and (o["n"], o["lags"]) == (80, lags)


def test_hac_without_a_solution(spark):
    _, _, _, df = cells(spark)
    lag = spark.createDataFrame([("A", 1000, 3)], "coin string, horizon_ms long, lags int")
    for few, controls in ((df.where("exch_time_ms < 29000"), []), (df.withColumn("c", F.col("x") * 2 + 1), ["c"]), (df.withColumn("x", F.lit(0.0)), [])):
        r = stats.hac_regression(few, controls, lag).first()
        assert r.n > 0 and r.beta is None and r.t is None and r.p is None


@pytest.mark.parametrize("k", [1, 2, 5])
def test_inverse(spark, k):
    a = np.random.default_rng(k).normal(size=(40, k)) * 10.0 ** np.arange(k)
    a = a.T @ a
    got = spark.createDataFrame([(a.ravel().tolist(),)], "a array<double>").select(stats.inverse(F.col("a"), k).alias("i")).first().i
    assert np.array(got).reshape(k, k) @ a == pytest.approx(np.eye(k), abs=1e-8)


def test_ranks_are_shared_only_by_equal_sets_of_times(spark):
    """Horizons with the same valid times share ranks; with others they have their own."""
    rng = np.random.default_rng(8)
    x = {f: rng.integers(0, 9, 60).astype(float) for f in "fg"}
    y = {h: rng.normal(size=60) for h in (1, 2, 3)}
    off = {("f", 1): set(), ("f", 2): set(), ("f", 3): {5, 58, 59}, ("g", 1): {0}, ("g", 2): set(), ("g", 3): {7, 58, 59}}
    rows = [("A", f, h, i, x[f][i], None if i in off[f, h] else y[h][i]) for f in "fg" for h in (1, 2, 3) for i in range(60)]
    df = spark.createDataFrame([(c, f, h, i, float(a), None if b is None else float(b)) for c, f, h, i, a, b in rows], "coin string, feature string, horizon_ms long, exch_time_ms long, x double, y double")
    mean_rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    got = {(r.feature, r.horizon_ms): r for r in stats.information_coefficient(df).collect()}
    for key, skip in off.items():
        have = [i for i in range(60) if i not in skip]
        want = np.corrcoef(mean_rank(x[key[0]][have]), mean_rank(y[key[1]][have]))[0, 1]
        assert got[key].n == len(have) and got[key].spearman == pytest.approx(want)


def test_net_of_cost(spark):
    df = spark.createDataFrame([("A", "f", 1, 0.5, 0.001, 2.0), ("A", "f", 1, -0.5, -0.001, 2.0), ("A", "f", 1, 0.1, 0.001, 2.0)], "coin string, feature string, horizon_ms long, x double, y double, spread_bps double")
    limits = spark.createDataFrame([("A", "f", 0.2)], "coin string, feature string, threshold double")
    r = stats.net_of_cost(df, limits, 1.0).first()
    assert r.net_n == 2 and r.net_mean_bps == pytest.approx(6.0) and r.net_t is None


@pytest.mark.parametrize("share", [0.0, 0.05, 0.5, 0.75, 1.0])
def test_quantile_is_exact_and_sorts_only_its_bracket(spark, share):
    rng = np.random.default_rng(int(share * 100))
    groups = {"wide": rng.normal(size=6000), "ties": rng.integers(-2, 3, 3000).astype(float), "one": np.array([7.5]), "zeros": np.array([-0.0, 0.0, 0.0, -1.0]), "skew": np.exp(rng.normal(size=4000) * 6)}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("one", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r.g: r.quantile for r in ranks.quantile(df, "v", share, ["g"], accuracy=200).collect()}
    assert got == pytest.approx({g: np.quantile(x, share) for g, x in groups.items()})
    held = ranks.quantile(df, "v", share, ["g"], accuracy=1000)
    held.collect()
    text = held._jdf.queryExecution().executedPlan().toString()
    assert text.count("Window") >= 1
    node, most = held._jdf.queryExecution().executedPlan().executedPlan(), 0
    todo = [node]
    while todo:
        x = todo.pop()
        if x.nodeName() == "Window":
            child = x.children().head()
            while not child.metrics().contains("numOutputRows"):
                child = child.plan() if "QueryStage" in child.nodeName() else child.children().head()
            most = max(most, child.metrics().get("numOutputRows").get().value())
        if "QueryStage" in x.nodeName():
            todo.append(x.plan())
        todo += [x.children().apply(i) for i in range(x.children().size())]
    assert 0 < most < 400  # of some 13,000 values; the groups of fewer than 1,000 are whole


def test_position_fold(spark):
    fills = [("sell", 40.0, 3.0, 0.0), ("sell", 44.0, 1.0, 0.25), ("buy", 37.0, 2.0, 0.0), ("buy", 45.0, 6.0, 0.5)]
    df = spark.createDataFrame([(fills,)], "f array<struct<side:string,price:double,size:double,fee:double>>")
    p = df.select(risk.position("f").alias("p")).first().p
    assert (p.inventory, p.avg_price, p.realized, p.fees) == (4.0, 45.0, 2 * 4.0 - 2 * 4.0, 0.75)


def test_risk_report(spark):
    equity = [100.0, 110.0, 90.0, 120.0, 119.0]
    df = spark.createDataFrame([("A", i * 1000, e) for i, e in enumerate(equity)], "coin string, timestamp_ms long, equity double")
    r = risk.risk_report(df).first()
    d = np.diff(equity)
    assert r.max_drawdown == pytest.approx(-20 / 110) and r.value_at_risk == pytest.approx(-np.percentile(d, 5)) and r.expected_shortfall == pytest.approx(20.0)
    assert r.sharpe == pytest.approx(d.mean() / d.std() * np.sqrt(4 / 4 * 365 * 86400))


@pytest.mark.parametrize("share", [0.05, 0.5, 0.75])
def test_quantile_is_exact(spark, share):
    rng = np.random.default_rng(int(share * 100))
    rows = [(g, None if rng.random() < 0.1 else float(v)) for g, n in (("a", 1), ("b", 2), ("c", 997)) for v in rng.normal(size=n).round(1)]
    rows += [("d", None), ("e", -0.0), ("e", 0.0), ("e", 1.0)]
    got = {r.g: r.quantile for r in ranks.quantile(spark.createDataFrame(rows, "g string, v double"), "v", share, ["g"]).collect()}
    want = {g: np.percentile([v for k, v in rows if k == g and v is not None], share * 100) for g in {k for k, v in rows if v is not None}}
    assert got == pytest.approx(want)


def test_sigma_brute_force(spark):
    rng = np.random.default_rng(4)
    times = np.cumsum(rng.choice([5, 40, 300, 900], 150)).tolist()
    mids = (100 + rng.integers(-8, 8, 150) / 4).tolist()
    df = spark.createDataFrame([("A", t, m) for t, m in zip(times, mids, strict=True)], "coin string, exch_time_ms long, mid double")
    for r in features.with_sigma(df, 700, block_ms=500).collect():
        inside = [m for t, m in zip(times, mids, strict=True) if r.exch_time_ms - 700 <= t <= r.exch_time_ms]
        assert r.sigma == pytest.approx(np.std(np.diff(inside)) if len(inside) >= 3 else 0.0, abs=1e-12)


@pytest.mark.parametrize("scheme", ["linear_decay", "uniform", "exp_decay"])
@pytest.mark.parametrize("short", ["truncate", "pad"])
def test_depth_imbalance_of_ragged_ladders(spark, scheme, short):
    rng = np.random.default_rng(7)
    rows = [(i, rng.integers(1, 30, rng.integers(0, 9)).astype(float).tolist(), rng.integers(1, 30, rng.integers(0, 9)).astype(float).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, b array<double>, a array<double>")
    for r in df.select("i", book.depth_imbalance("b", "a", 6, scheme, short).alias("x")).collect():
        _, b, a = rows[r.i]
        width = 6 if short == "pad" else max(len(b[:6]), len(a[:6]))
        weight = {"linear_decay": lambda k: width - k, "uniform": lambda k: 1.0, "exp_decay": lambda k: 0.5**k}[scheme]
        x, y = (sum(v * weight(k) for k, v in enumerate(side[:6])) for side in (b, a))
        assert r.x == pytest.approx((x - y) / (x + y) if x + y else 0.0, abs=1e-12)


def test_positions_follow_the_account(spark):
    """Over batches, by coin, in order, against the fold of one array."""
    rng = np.random.default_rng(2)
    rows = [(c, t, t, str(rng.choice(["buy", "sell"])), float(rng.integers(90, 110)), float(rng.integers(1, 9)) / 8, 0.25) for c in "XY" for t in range(300)]
    df = spark.createDataFrame(rows, "coin string, timestamp_ms long, tid long, side string, price double, size double, fee double")
    ordered = F.array_sort(F.collect_list(F.struct("timestamp_ms", "tid", "side", "price", "size", "fee")))
    want = {r.coin: r.p for r in df.groupBy("coin").agg(risk.position(ordered).alias("p")).collect()}
    last = {r.coin: r for r in risk.positions(df.repartition(5), order=["timestamp_ms", "tid"]).where("timestamp_ms = 299").collect()}
    for coin, p in want.items():
        r = last[coin]
        assert (r.inventory, r.avg_price, r.realized, r.fees) == pytest.approx((p.inventory, p.avg_price, p.realized, p.fees))
        assert df.limit(1).select(risk.unrealized(F.struct(F.lit(r.inventory).alias("inventory"), F.lit(r.avg_price).alias("avg_price")), F.lit(101.0)).alias("u")).first().u == pytest.approx((101.0 - p.avg_price) * p.inventory)


def test_study_against_a_plain_one(spark):
    """Every cell's figures, told again over arrays."""
    rng = np.random.default_rng(11)
    n, h = 120, 2000
    ticks = 400 + np.cumsum(rng.choice([-1, 0, 1], n))
    sizes = rng.integers(1, 40, (2, n, 5)).astype(float)
    rows = [("Z", i * 1000, i * 10**9, [float(ticks[i] - k) for k in range(5)], sizes[0, i].tolist(), [float(ticks[i] + 1 + k) for k in range(5)], sizes[1, i].tolist()) for i in range(n)]
    ladder = "array<double>"
    books = spark.createDataFrame(rows, f"coin string, exch_time_ms long, recv_ts_ns long, bid_px {ladder}, bid_sz {ladder}, ask_px {ladder}, ask_sz {ladder}")
    books = books.withColumns({c: F.array().cast("array<bigint>") for c in ("bid_n", "ask_n")})
    got = study.study(books, ["tob_imbalance", "imbalance_d5"], ["spread_bps"], [h], 4.5).collect()
    mid, spread = ticks + 0.5, 1e4 / (ticks + 0.5)
    y = np.log(mid[2:] / mid[:-2])
    w = np.arange(5, 0, -1)
    top = lambda a, b: (a - b) / (a + b)
    xs = {"tob_imbalance": top(sizes[0, :, 0], sizes[1, :, 0]), "imbalance_d5": top(sizes[0] @ w, sizes[1] @ w)}
    times = np.arange(n) * 1000
    train = times <= 0.7 * times[-1]
    test = np.flatnonzero(~train[: n - 2])
    assert {r.feature for r in got} == set(xs)
    for r in got:
        x, out = xs[r.feature][test], y[test]
        assert r.n == len(test) and r.pearson == pytest.approx(np.corrcoef(x, out)[0, 1])
        beta = np.polyfit(x, out, 1)
        assert r.ols_beta == pytest.approx(beta[0]) and r.ols_r2 == pytest.approx(np.corrcoef(x, out)[0, 1] ** 2)
        both = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x, spread[test]]), out, rcond=None)[0]
        assert r.ols_beta_ctrl == pytest.approx(both[1])
        limit = np.percentile(np.abs(xs[r.feature][train]), 75)
        net = (out * 1e4 * np.sign(x) - (spread[test] + 9))[np.abs(x) > limit]
        assert r.threshold == pytest.approx(limit) and r.net_n == len(net) and r.net_mean_bps == pytest.approx(net.mean())
        moved = (x != 0) & (out != 0)
        assert r.hit_rate == pytest.approx(np.mean(np.sign(x[moved]) == np.sign(out[moved])))
        hits, many = int((np.sign(x[moved]) == np.sign(out[moved])).sum()), int(moved.sum())
        assert r.hit_rate_p == pytest.approx(min(1.0, 2 * sum(math.comb(many, i) for i in range(min(hits, many - hits) + 1)) / 2**many))
