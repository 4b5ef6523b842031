"""One query per operator, over the tables derived from events. Derived doubles are rounded, as rolling
and running arithmetic is not bit-equal between engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Backtest, Fees, InventoryAware, Settings, Symmetric
from ..functions import book as bk
from ..functions import liquidity, quotes, rates, slippage, ticks
from ..operators import asof, events, features, ledger, replay, risk, stats, strategies
from ..sources import capture, raw
from ..store import stored
from .derived import Market, market

#: The reference's horizons are for 5 s books; these fit the derived tables' cadence.
HORIZONS = (60_000, 300_000, 600_000, 1_800_000, 3_600_000)
GAP_MS, SIGMA_MS = 1_500_000, 3_600_000
FEATURES = ["tob_imbalance", "imbalance_d5", "imbalance_d10", "imbalance_d20", "ofi"]
CONTROLS = ["spread_bps", "realized_vol", "momentum"]
KEY = ["event_id", "coin"]
#: Books of one time go in the order of their events.
TIES = ("event_id",)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[Market], DataFrame]) -> Callable[[Market], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(market(spark, sf_dir))
    return f


def r(c: Column | str, places: int = 8) -> Column:
    """Rounded, with -0.0 as 0.0."""
    return F.round(bk.col(c), places) + F.lit(0.0)


def rounded(df: DataFrame, *names: str, places: int = 8) -> DataFrame:
    return df.withColumns({n: r(n, places) for n in names})


def top(m: Market) -> DataFrame:
    return bk.with_microprice(bk.with_spread(m.l2book))


@query
def spread_imbalance_by_coin(m: Market) -> DataFrame:
    df = bk.with_imbalance(top(m), (5,))
    return df.groupBy("coin").agg(F.count(F.lit(1)).alias("n"), r(F.avg("spread_bps"), 6).alias("avg_spread_bps"), r(F.avg("tob_imbalance"), 6).alias("avg_imbalance"))


@query
def spread_summary(m: Market) -> DataFrame:
    return rounded(bk.with_spread(m.l2book).select(*KEY, "best_bid", "best_ask", "mid", "spread_abs", "spread_bps"), "spread_bps")


@query
def microprice(m: Market) -> DataFrame:
    return rounded(top(m).select(*KEY, "microprice", "microprice_dev_bps"), "microprice", "microprice_dev_bps")


@query
def tob_imbalance(m: Market) -> DataFrame:
    return bk.with_imbalance(m.l2book, ()).select(*KEY, r("tob_imbalance").alias("tob_imbalance"))


def _depth(scheme: str) -> Callable[[Market], DataFrame]:
    return lambda m: bk.with_imbalance(m.l2book, (5, 10, 20), scheme).select(*KEY, *[r(f"imbalance_d{n}").alias(f"imbalance_d{n}") for n in (5, 10, 20)])


for _scheme in bk.SCHEMES:
    QUERIES[f"depth_imbalance_{_scheme}"] = lambda spark, sf_dir, f=_depth(_scheme): f(market(spark, sf_dir))


@query
def slippage_buy(m: Market) -> DataFrame:
    df = slippage.with_slippage(bk.with_spread(m.l2book), [5, 40, 200], "buy")
    return df.select(*KEY, *[r(f"slippage_bps_{s}").alias(f"slippage_bps_{s}") for s in (5, 40, 200)])


@query
def slippage_sell(m: Market) -> DataFrame:
    got = slippage.estimate(40.0, "sell")
    df = bk.with_spread(m.l2book).withColumn("e", got)
    return df.select(*KEY, r("e.filled_size").alias("filled_size"), "e.fully_filled", r("e.vwap").alias("vwap"), r("e.slippage_bps").alias("slippage_bps"))


@query
def depth_within_bps(m: Market) -> DataFrame:
    df = bk.with_spread(m.l2book)
    return df.select(*KEY, liquidity.depth_within_bps(2).alias("depth_within_2bps"), liquidity.depth_within_bps(5).alias("depth_within_5bps"))


@query
def funding_apr(m: Market) -> DataFrame:
    return rates.with_apr(m.asset_ctx).select("coin", "recv_ts_ns", "funding", r("funding_apr", 6).alias("funding_apr"))


@query
def funding_payment(m: Market) -> DataFrame:
    return m.asset_ctx.select("coin", "recv_ts_ns", r(rates.funding_payment(F.lit(2.5), "oracle_px", "funding")).alias("payment"))


@query
def fees(m: Market) -> DataFrame:
    f = Fees()
    notional = F.col("px") * F.col("sz") * F.when(F.col("side") == "A", -1).otherwise(1)
    return m.trades.select("tid", "coin", r(rates.fee(notional, f.maker_bps)).alias("maker_fee"), r(rates.fee(notional, f.taker_bps)).alias("taker_fee"))


@query
def tick_size(m: Market) -> DataFrame:
    return m.l2book.select(*KEY, ticks.tick_size("ask_px").alias("tick_size"))


@query
def round_to_tick(m: Market) -> DataFrame:
    df = top(m)
    return df.select(*KEY, ticks.round_to_tick(F.col("microprice"), F.lit(0.5), "down").alias("bid_tick_px"), ticks.round_to_tick(F.col("microprice"), F.lit(0.5), "up").alias("ask_tick_px"))


@query
def dedup_books(m: Market) -> DataFrame:
    """Every 50th book comes again, a nanosecond later and twice as large; the original stays."""
    again = m.l2book.where("event_id % 50 = 0").withColumns({"recv_ts_ns": F.col("recv_ts_ns") + 1, "bid_sz": F.transform("bid_sz", lambda x: x * 2)})
    kept = features.dedup_books(m.l2book.unionByName(again), TIES)
    return kept.select("coin", "exch_time_ms", "recv_ts_ns", bk.top("bid_sz").alias("bid_sz0"))


@query
def top_levels(m: Market) -> DataFrame:
    """Three best levels of ladders that were turned round."""
    df = m.l2book.withColumns({c: F.reverse(c) for c in ("bid_px", "bid_sz", "ask_px", "ask_sz")})
    df = df.withColumns({"b": bk.levels("bid_px", "bid_sz", 3, "bid"), "a": bk.levels("ask_px", "ask_sz", 3, "ask")})
    cols = [F.get(side, F.lit(i))[f].alias(f"{side}{i}_{f}") for side in ("b", "a") for i in range(3) for f in ("px", "sz")]
    return df.select(*KEY, *cols, bk.is_crossed(F.get("b", F.lit(0))["px"], F.get("a", F.lit(0))["px"]).alias("crossed"))


def _updates(m: Market) -> DataFrame:
    size = F.when(F.col("sz") < 4, F.lit(0.0)).otherwise(F.col("sz"))
    side = F.when(F.col("side") == "A", "bid").otherwise("ask")
    return m.trades.select("coin", side.alias("side"), F.col("px").alias("price"), size.alias("size"), F.col("tid").alias("seq"), "exch_time_ms")


@query
def book_history(m: Market) -> DataFrame:
    """Five best levels of either side after every update, and whether they cross."""
    kept = events.book_history(_updates(m), 5)
    at = lambda c, i: F.get(c, F.lit(i))
    cols = [at(f"{s}_{c}", i).alias(f"{s}{i}_{c}") for s in ("bid", "ask") for i in range(5) for c in ("px", "sz")]
    return kept.select("coin", F.col("seq").alias("tid"), *cols, bk.is_crossed(at("bid_px", 0), at("ask_px", 0)).alias("crossed"))


@query
def book_from_updates(m: Market) -> DataFrame:
    """Trades as level updates: sizes of whole numbers below 4 remove the level."""
    kept = events.book_from_updates(_updates(m), 5)
    one = lambda s: kept.select("coin", F.lit(s).alias("side"), F.posexplode(f"{s}s").alias("level", "x")).select("coin", "side", "level", "x.px", "x.sz")
    return one("bid").unionByName(one("ask"))


@query
def depth_at_price(m: Market) -> DataFrame:
    """Size shown at the price of each book's own trade."""
    t = m.trades.select(F.col("tid").alias("event_id"), "side", "px")
    df = m.l2book.join(t, "event_id")
    return df.select(*KEY, F.when(F.col("side") == "A", bk.depth_at(F.col("px"), "bid_px", "bid_sz")).otherwise(bk.depth_at(F.col("px"), "ask_px", "ask_sz")).alias("depth"))


def _flow(m: Market) -> DataFrame:
    return features.with_flow(top(m).select(*KEY, "exch_time_ms", "best_bid", "best_ask", "mid", F.slice("bid_sz", 1, 1).alias("bid_sz"), F.slice("ask_sz", 1, 1).alias("ask_sz")), ties=TIES)


@query
def ofi(m: Market) -> DataFrame:
    return _flow(m).select(*KEY, "ofi")


@query
def realized_vol(m: Market) -> DataFrame:
    return _flow(m).select(*KEY, r("log_ret_1", 9).alias("log_ret_1"), r("realized_vol", 9).alias("realized_vol"))


@query
def momentum(m: Market) -> DataFrame:
    return _flow(m).select(*KEY, r("momentum", 9).alias("momentum"))


@query
def liquidity_zscore(m: Market) -> DataFrame:
    df = features.liquidity_signal(bk.with_spread(m.l2book), 5.0, 60, -2.0, TIES, ties=TIES)
    return df.select(*KEY, "depth_within_5bps", r("liquidity_z", 6).alias("liquidity_z"))


@query
def drought_flag(m: Market) -> DataFrame:
    df = features.liquidity_signal(bk.with_spread(m.l2book), 5.0, 60, -2.0, TIES, ties=TIES)
    return df.select(*KEY, "liquidity_drought")


@query
def price_sigma(m: Market) -> DataFrame:
    return features.with_sigma(top(m).select(*KEY, "exch_time_ms", "mid"), SIGMA_MS).select(*KEY, r("sigma", 7).alias("sigma"))


@query
def gaps(m: Market) -> DataFrame:
    return features.gaps(m.l2book.select(*KEY, "exch_time_ms"), GAP_MS).select(*KEY, "gap_ms")


@query
def median_interval(m: Market) -> DataFrame:
    return features.median_interval(m.l2book)


@query
def forward_returns(m: Market) -> DataFrame:
    df = asof.forward_returns(top(m).select(*KEY, "exch_time_ms", "mid", "microprice"), list(HORIZONS), ties=TIES)
    cols = [f"fwd_logret_{p}_{h}ms" for h in HORIZONS for p in ("mid", "microprice")]
    return df.select(*KEY, *[r(c, 9).alias(c) for c in cols])


@query
def forward_index(m: Market) -> DataFrame:
    return asof.forward_index(m.l2book.select("coin", "exch_time_ms"), 600_000)


@query
def trade_book_match(m: Market) -> DataFrame:
    return asof.book_before_trade(m.trades, top(m), ["mid", "event_id"], ties=TIES).select("tid", "coin", "mid", "event_id")


@query
def latest_funding(m: Market) -> DataFrame:
    return rounded(asof.latest_funding(m.asset_ctx, m.predicted_funding, "HlPerp"), "current_apr", "predicted_apr", places=6)


@query
def funding_by_venue(m: Market) -> DataFrame:
    p = m.predicted_funding
    return p.groupBy("coin", "venue", "funding_interval_hours").agg(F.count(F.lit(1)).alias("n"), F.sum("funding_rate").alias("rate"), F.max("next_funding_time_ms").alias("next_ms"))


def _message(channel: str, data: Column) -> Column:
    """A raw log line."""
    return F.concat(F.lit('{"recv_ts_ns":'), F.col("recv_ts_ns").cast("string"), F.lit(f',"channel":"{channel}","data":'), data, F.lit("}")).alias("value")


def _noise(lines: DataFrame) -> DataFrame:
    """The lines among blank, broken and foreign ones."""
    junk = lines.select(F.explode(F.array(F.lit(""), F.lit("{broken"), F.lit('{"recv_ts_ns":1,"channel":"pong","data":{}}'))).alias("value"))
    return raw.envelope(lines.unionByName(junk))


@query
def parse_l2book(m: Market) -> DataFrame:
    side = lambda s: F.transform(F.arrays_zip(f"{s}_px", f"{s}_sz", f"{s}_n"), lambda x: F.struct(x[f"{s}_px"].cast("string").alias("px"), x[f"{s}_sz"].cast("string").alias("sz"), x[f"{s}_n"].alias("n")))
    data = F.to_json(F.struct("coin", F.col("exch_time_ms").alias("time"), F.array(side("bid"), side("ask")).alias("levels")))
    b = raw.l2book(_noise(m.l2book.select(_message(raw.L2_CHANNEL, data))))
    return b.select("coin", "exch_time_ms", "recv_ts_ns", F.get("bid_px", F.lit(19)).alias("bid_px19"), F.get("ask_sz", F.lit(3)).alias("ask_sz3"), F.size("bid_n").alias("levels"), F.aggregate("ask_n", F.lit(0).cast("long"), lambda a, x: a + x).alias("orders"))


@query
def parse_trades(m: Market) -> DataFrame:
    one = F.struct("coin", "side", F.col("px").cast("string").alias("px"), F.col("sz").cast("string").alias("sz"), F.col("exch_time_ms").alias("time"), "tid", F.col("trade_hash").alias("hash"))
    return raw.trades(_noise(m.trades.select(_message(raw.TRADE_CHANNEL, F.to_json(F.array(one)))))).drop("trade_hash")


@query
def parse_asset_ctx(m: Market) -> DataFrame:
    ctx = F.struct(F.col("funding").cast("string").alias("funding"), F.col("oracle_px").cast("string").alias("oraclePx"), F.lit("n/a").alias("midPx"))
    rows = raw.asset_ctx(_noise(m.asset_ctx.select(_message(raw.CONTEXT_CHANNEL, F.to_json(F.struct("coin", ctx.alias("ctx")))))))
    return rows.select("coin", "recv_ts_ns", "funding", "oracle_px", "mid_px")


@query
def parse_predicted_funding(m: Market) -> DataFrame:
    info = F.to_json(F.struct(F.col("funding_rate").cast("string").alias("fundingRate"), F.col("next_funding_time_ms").alias("nextFundingTime"), F.col("funding_interval_hours").alias("fundingIntervalHours")))
    venue = F.concat(F.lit('["'), F.col("venue"), F.lit('",'), info, F.lit("]"))
    polls = m.predicted_funding.groupBy("coin", "recv_ts_ns").agg(F.array_join(F.collect_list(venue), ",").alias("v"))
    data = F.concat(F.lit('[["'), F.col("coin"), F.lit('",['), F.col("v"), F.lit(',["None",null]]]]'))
    return raw.predicted_funding(_noise(polls.select(_message(raw.PREDICTED_CHANNEL, data))))


@query
def log_hours(m: Market) -> DataFrame:
    """Messages per UTC date and hour of the raw log."""
    lines = capture.log_lines(m.trades.select("recv_ts_ns", F.lit(raw.TRADE_CHANNEL).alias("channel"), F.lit("[]").alias("data")))
    return lines.groupBy("date", "hour").agg(F.count(F.lit(1)).alias("n"))


@query
def symbol_scan(m: Market) -> DataFrame:
    return m.trades.where("coin = 'ETH' and px >= 9990").select("tid", "coin", "side", "px", "sz")


def _labelled(m: Market) -> DataFrame:
    df = stored(features.feature_table(m.l2book, ties=TIES), "features")
    return asof.forward_returns(stats.chronological_split(stats.with_history(df)), list(HORIZONS), ("mid",), ties=TIES)


def _cells(m: Market, train: bool, labelled: DataFrame | None = None) -> DataFrame:
    part = (_labelled(m) if labelled is None else labelled).where(F.col("is_train") == train)
    return stats.long_form(part, FEATURES, list(HORIZONS), keep=("event_id", "spread_bps", "realized_vol", "momentum"))


@query
def chrono_split(m: Market) -> DataFrame:
    df = stats.chronological_split(m.l2book.select(*KEY, "exch_time_ms"))
    return df.select(*KEY, "is_train")


@query
def train_threshold(m: Market) -> DataFrame:
    df = stats.chronological_split(features.feature_table(m.l2book, ties=TIES)).where("is_train")
    long = df.select("coin", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("x")) for f in FEATURES])).alias("f")).select("coin", "f.*")
    return rounded(stats.thresholds(long), "threshold")


@query
def information_coefficient(m: Market) -> DataFrame:
    tested = stored(_labelled(m).where("is_train = false"), "labelled")
    return rounded(stats.information_coefficient(_cells(m, False, tested), ("exch_time_ms", *TIES)), "pearson", "spearman", "pearson_p", "spearman_p", places=7)


@query
def hit_rate(m: Market) -> DataFrame:
    return rounded(stats.directional_accuracy(_cells(m, False)), "hit_rate", "hit_rate_p")


@query
def net_of_cost(m: Market) -> DataFrame:
    labelled = stored(_labelled(m), "labelled")
    train = _cells(m, True, labelled).where(F.col("horizon_ms") == HORIZONS[0])
    out = stats.net_of_cost(_cells(m, False, labelled), stats.thresholds(train), Fees().taker_bps)
    return rounded(out, "net_mean_bps", "net_pct_positive", "net_t", "net_p", places=5)


@query
def ols_univariate(m: Market) -> DataFrame:
    pairs = _cells(m, False).dropna(subset=["x", "y"])
    spread = (F.stddev_pop("x") > 0) & (F.stddev_pop("y") > 0)
    fit = lambda f: F.when(spread, f)
    out = pairs.groupBy(*stats.CELL).agg(fit(F.regr_slope("y", "x")).alias("beta"), fit(F.regr_r2("y", "x")).alias("r2"))
    return rounded(out, "beta", "r2", places=7)


@query
def maxlags(m: Market) -> DataFrame:
    return _lags(m)


def _lags(m: Market) -> DataFrame:
    h = F.explode(F.array(*[F.lit(x).cast("long") for x in HORIZONS])).alias("horizon_ms")
    out = features.median_interval(m.l2book).select("coin", "median_interval_ms", h)
    return out.select("coin", "horizon_ms", stats.maxlags(F.col("horizon_ms"), F.col("median_interval_ms")).alias("lags"))


def _regression(m: Market, controls: list[str]) -> DataFrame:
    tested = stored(_labelled(m).where("is_train = false"), "labelled")
    fit = stats.hac_regression(_cells(m, False, tested), controls, _lags(m), TIES, tested)
    of_x = lambda c, places: r(F.get(c, F.lit(1)), places).alias(c)
    return fit.select(*stats.CELL, "n", of_x("beta", 9), of_x("t", 5), of_x("p", 7), r("r2", 8).alias("r2"))


@query
def hac_regression(m: Market) -> DataFrame:
    return _regression(m, [])


@query
def hac_regression_controls(m: Market) -> DataFrame:
    return _regression(m, CONTROLS)


@query
def merged_events(m: Market) -> DataFrame:
    order = Window.partitionBy("coin", F.floor(F.col("ts_ms") / 86_400_000)).orderBy("ts_ms", "kind", "recv_ts_ns", "seq")
    all_ = events.merged_events(m.l2book, m.trades, m.asset_ctx)
    return all_.select("coin", "ts_ms", "kind", "recv_ts_ns", "seq", F.row_number().over(order).alias("nth_of_day"))


SETTINGS = Settings(
    symmetric=Symmetric(half_spread_bps=0.5, quote_size=0.5, max_inventory=5.0),
    inventory_aware=InventoryAware(risk_aversion=1e-4, vol_lookback_s=3600.0, decay_s=300.0, max_inventory=5.0, quote_size=0.5, half_spread_bps=0.5),
)


def _quotes(df: DataFrame, quote: Column) -> DataFrame:
    q = df.withColumn("q", quote)
    return q.select(*KEY, r("q.bid_px", 7).alias("bid_px"), "q.bid_sz", r("q.ask_px", 7).alias("ask_px"), "q.ask_sz")


@query
def quotes_naive(m: Market) -> DataFrame:
    s = SETTINGS.symmetric
    inventory = (F.col("event_id") % 13 - 6).cast("double")
    return _quotes(top(m), quotes.symmetric_quote("microprice", inventory, s.half_spread_bps, s.quote_size, s.max_inventory, F.col("event_id") % 17 == 0))


@query
def quotes_inventory(m: Market) -> DataFrame:
    s = SETTINGS.inventory_aware
    inventory = (F.col("event_id") % 13 - 6).cast("double")
    df = features.with_sigma(top(m).select(*KEY, "exch_time_ms", "mid"), SIGMA_MS)
    return _quotes(df, quotes.inventory_quote("mid", F.col("sigma"), inventory, s.risk_aversion, s.decay_s, s.half_spread_bps, s.quote_size, s.max_inventory, F.col("event_id") % 17 == 0))


def _signed_fills(m: Market) -> DataFrame:
    """The trades as our fills: takers' sales are our buys."""
    f = rates.fee(F.col("px") * F.col("sz"), Fees().maker_bps)
    return m.trades.select("coin", "tid", F.col("exch_time_ms").alias("timestamp_ms"), F.when(F.col("side") == "A", "buy").otherwise("sell").alias("side"), F.col("px").alias("price"), F.col("sz").alias("size"), f.alias("fee"))


@query
def cash_and_inventory(m: Market) -> DataFrame:
    out = risk.cash_and_inventory(_signed_fills(m), 100_000.0, order=["timestamp_ms", "tid"])
    # fees are whole multiples of 0.000009375: a hair more keeps exact halves from falling by the noise of a running sum
    return out.select("tid", "coin", r(F.col("cash") + 2e-7, 6).alias("cash"), "inventory")


def _ledger(m: Market) -> DataFrame:
    books = top(m).select("coin", "exch_time_ms", "recv_ts_ns", "mid")
    return ledger.ledger(ledger.account_events(_signed_fills(m), m.asset_ctx, books, seq="tid"), 100_000.0)


@query
def funding_accrual(m: Market) -> DataFrame:
    """What every funding observation charges for the inventory of the fills, and what holding it cost meanwhile."""
    rows = _ledger(m).where(F.col("kind") == events.FUNDING)
    return rows.select("coin", F.col("seq").alias("recv_ts_ns"), "inventory", *[r(c, 5).alias(c) for c in ("payment", "funding_paid", "held_paid")])


@query
def marked_equity(m: Market) -> DataFrame:
    """Equity at every book, funding paid included."""
    rows = _ledger(m).where(F.col("kind") == events.BOOK)
    # as in cash_and_inventory, a hair more keeps exact halves from falling by noise
    return rows.select("coin", "ts_ms", "inventory", r("funding_paid", 5).alias("funding_paid"), r(F.col("equity") + 2e-7, 4).alias("equity"))


@query
def inventory_volatility(m: Market) -> DataFrame:
    held = _signed_fills(m).select("tid", "coin", "timestamp_ms", F.when(F.col("side") == "buy", F.col("size")).otherwise(-F.col("size")).alias("inventory"))
    return risk.inventory_volatility(held, 30).select("tid", "coin", r("inventory_vol", 7).alias("inventory_vol"))


@query
def turnover(m: Market) -> DataFrame:
    return rounded(risk.turnover(_signed_fills(m)), "turnover_usd", "fees_paid", places=4)


def _curve(m: Market) -> DataFrame:
    """Equity of one unit held and marked at each mid."""
    return top(m).select("event_id", "coin", F.col("exch_time_ms").alias("timestamp_ms"), (F.lit(100.0) + F.col("mid") - 10_000).alias("equity"))


@query
def drawdown(m: Market) -> DataFrame:
    return risk.drawdowns(_curve(m)).select(*KEY, r("drawdown").alias("drawdown"))


@query
def sharpe_var_es(m: Market) -> DataFrame:
    return rounded(risk.risk_report(_curve(m)), "sharpe", "max_drawdown", "value_at_risk", "expected_shortfall", places=6)


@query
def average_cost(m: Market) -> DataFrame:
    """The position at the end of each day, carried over from the coin's first fill on, and what it would gain at that
    day's last price."""
    day = F.floor(F.col("timestamp_ms") / 86_400_000).alias("day")
    p = risk.positions(_signed_fills(m), order=["timestamp_ms", "tid"])
    last = p.groupBy("coin", day).agg(F.max_by(F.struct("price", *risk.POSITION), F.struct("timestamp_ms", "tid")).alias("p"))
    gain = risk.unrealized(F.col("p"), F.col("p.price"))
    return last.select("coin", "day", "p.inventory", r("p.avg_price", 5).alias("avg_price"), r("p.realized", 4).alias("realized"), r("p.fees", 4).alias("fees_paid"), r(gain, 4).alias("unrealized"))


MAKERS = ("naive_mm", "inventory_mm")


def _filled(m: Market) -> tuple[DataFrame, DataFrame]:
    of = ["coin", "exch_time_ms", "recv_ts_ns", "bid_px", "bid_sz", "ask_px", "ask_sz"]
    prepared = features.prepared_books(m.l2book.select(*of), sigma_ms=SIGMA_MS)
    books = stored(prepared.select(*of, *replay.SIGNALS), "books", narrow=False)
    return books, replay.fills(books, m.trades, {n: strategies.build(n, SETTINGS) for n in MAKERS}, Backtest(), Fees())


@query
def backtest_report(m: Market) -> DataFrame:
    books, filled = _filled(m)
    filled = stored(filled, "fills", narrow=False)
    return replay.report(filled, stored(replay.accounts(filled, books, m.asset_ctx, MAKERS), "accounts", narrow=False))


@query
def backtest_fills(m: Market) -> DataFrame:
    return _filled(m)[1].drop("seq")


@query
def backtest_equity(m: Market) -> DataFrame:
    books, filled = _filled(m)
    return replay.equity_curve(replay.accounts(filled, books, m.asset_ctx, MAKERS))


@query
def imbalance_study(m: Market) -> DataFrame:
    """The whole study: a row per coin, feature and horizon."""
    from ..operators.study import study

    out = study(m.l2book, FEATURES, CONTROLS, list(HORIZONS), Fees().taker_bps, ties=TIES)
    out = rounded(out, *[c for c in out.columns if c.startswith(("pearson", "spearman", "hit", "ols")) and "beta" not in c], "threshold", places=7)
    return rounded(rounded(out, "ols_beta", "ols_beta_ctrl", places=9), "net_mean_bps", "net_pct_positive", "net_p", places=5)
