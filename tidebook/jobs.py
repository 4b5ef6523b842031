"""The four jobs as command lines: collect, normalize, study and backtest.

    python -m tidebook.jobs collect --config settings.yaml
    python -m tidebook.jobs normalize --data data
    python -m tidebook.jobs study --data data --out reports
    python -m tidebook.jobs backtest --data data --out reports --strategy naive_mm --symbol BTC
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .operators import features, replay, strategies
from .operators.study import study
from .sources import capture, sinks
from .sources.normalize import Outcome, normalize, read_table
from .store import stored

SIGNALS = ["tob_imbalance", "imbalance_d5", "imbalance_d10", "imbalance_d20", "ofi"]
CONTROLS = ["spread_bps", "realized_vol", "momentum"]


def collect(spark: SparkSession, s: config.Settings, rest_url: str, seconds: float | None = None, **options: str) -> list[dict]:
    """Records the feed and the funding polls to data_dir/raw until the time is over, or for ever. Returns the queries'
    last progress. What was received and is not yet in the log outlives the process in data_dir/raw/_journal, where data_dir
    is a folder of the driver's file system; elsewhere the option journal names one."""
    for source in (capture.MarketFeed, capture.FundingPoll):
        spark.dataSource.register(source)
    c, root = s.capture, f"{s.capture.data_dir}/raw"
    own = {} if "://" in root else {"journal": f"{root}/_journal"}
    common = {"coins": ",".join(s.symbols)} | own | options
    feed = {"url": c.ws_url, "ping_s": str(c.ping_s), "backoff_base_s": str(c.backoff_base_s), "backoff_max_s": str(c.backoff_max_s), "jitter_s": str(c.jitter_s), "gap_s": str(c.gap_s)}
    streams = [spark.readStream.format("market_feed").options(**common, **feed).load(), spark.readStream.format("funding_poll").options(**common, url=rest_url).load()]
    running = [capture.record(m, f"{root}/{n}", f"{root}/_checkpoints/{n}") for n, m in zip(("feed", "funding"), streams, strict=True)]
    try:
        if seconds is None:
            spark.streams.awaitAnyTermination()
        else:
            spark.streams.awaitAnyTermination(int(seconds))
    finally:
        last = [q.lastProgress for q in running]
        for q in running:
            q.stop()
    return last


def normalized(spark: SparkSession, data_dir: str) -> list[Outcome]:
    """The recorded logs to typed tables: a set of tables for each of the two logs."""
    return [normalize(spark, f"{data_dir}/raw/{n}", f"{data_dir}/normalized/{n}") for n in ("feed", "funding")]


def run_study(spark: SparkSession, s: config.Settings, out_dir: str, books: DataFrame | None = None) -> DataFrame:
    """The study of all symbols; results as CSV and JSON below out_dir, by symbol and horizon."""
    if books is None:
        books = read_table(spark, f"{s.capture.data_dir}/normalized/feed", "l2book", list(s.symbols))
    r = s.research
    results = study(books, SIGNALS, CONTROLS, list(r.horizons_ms), s.fees.taker_bps, s.analytics.depths, r.train_fraction, r.threshold_quantile)
    results = results.orderBy("coin", "horizon_ms", "feature")
    sinks.write_csv(results.coalesce(1), f"{out_dir}/research_csv")
    sinks.write_json(results.coalesce(1), f"{out_dir}/research_json")
    return results


def run_backtest(spark: SparkSession, s: config.Settings, out_dir: str, names: Sequence[str] = ("naive_mm", "inventory_mm"), tables: Sequence[DataFrame] | None = None) -> DataFrame:
    """Replays the market makers; writes summary (JSON), fills and equity (CSV) below out_dir, and returns the summary."""
    if tables is None:
        tables = [read_table(spark, f"{s.capture.data_dir}/normalized/feed", t, list(s.symbols)) for t in ("l2book", "trades", "asset_ctx")]
    books, trades, ctx = tables
    a = s.analytics
    lookback = int(s.inventory_aware.vol_lookback_s * 1000)
    prepared = stored(features.prepared_books(books, a.depths, a.depth_bps, a.window_rows, a.drought_z, lookback), "books", narrow=False)
    made = {n: strategies.build(n, s) for n in names}
    path = f"{out_dir}/replay"
    replay.fills(prepared, trades, made, s.backtest, s.fees).write.mode("overwrite").parquet(f"{path}/fills")  # replayed once
    fills = spark.read.parquet(f"{path}/fills")
    replay.accounts(fills, prepared, ctx, names, s.backtest.starting_cash).write.mode("overwrite").parquet(f"{path}/accounts")
    accounts = spark.read.parquet(f"{path}/accounts")
    summary = replay.report(fills, accounts, s.backtest.starting_cash)
    sinks.write_json(summary.orderBy("run", "coin").coalesce(1), f"{out_dir}/summary_json")
    for name, rows in (("fills", fills.drop("seq")), ("equity", replay.equity_curve(accounts))):
        sinks.write_csv(rows.orderBy("run", "coin", "timestamp_ms"), f"{out_dir}/{name}_csv")
    return summary


def main(argv: Sequence[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tidebook.jobs")
    p.add_argument("job", choices=("collect", "normalize", "study", "backtest"))
    p.add_argument("--config")
    p.add_argument("--data", help="the data folder, instead of the settings' one")
    p.add_argument("--out", default="reports")
    p.add_argument("--symbol", action="append", help="once per symbol; all of the settings without")
    p.add_argument("--strategy", action="append")
    p.add_argument("--seconds", type=float)
    p.add_argument("--rest-url", default="")
    o = p.parse_args(argv)
    over = {k: v for k, v in (("TIDEBOOK_DATA_DIR", o.data),) if v}
    s = config.load(o.config, over or None)
    if o.symbol:
        s = config.dataclasses.replace(s, symbols=tuple(x.strip().upper() for x in o.symbol))
    spark = SparkSession.builder.appName(f"tidebook {o.job}").getOrCreate()
    if o.job == "collect":
        print(collect(spark, s, o.rest_url, o.seconds))
    elif o.job == "normalize":
        print(normalized(spark, s.capture.data_dir))
    elif o.job == "study":
        run_study(spark, s, o.out).show(200, truncate=False)
    else:
        run_backtest(spark, s, o.out, tuple(o.strategy or ("naive_mm", "inventory_mm"))).select("run", "coin", "n_fills", F.round("final_equity", 2).alias("final_equity")).show()


if __name__ == "__main__":
    main()
