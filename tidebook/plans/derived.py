"""Order-book tables made from the `events` table, since no market data is at hand: per coin a walk of
the bid in ticks, 20 levels a side, a trade a millisecond after each book, a context every tenth."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import running

LEVELS = 20


@dataclass
class Market:
    l2book: DataFrame
    trades: DataFrame
    asset_ctx: DataFrame
    predicted_funding: DataFrame


def walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "value")
    coin = F.when(F.col("user_id") % 3 == 0, "BTC").when(F.col("user_id") % 3 == 1, "ETH").otherwise("SOL")
    base = events.select("event_id", coin.alias("coin"), F.unix_millis(F.col("ts").cast("timestamp")).alias("exch_time_ms"), F.round(F.col("value") * 100).cast("long").alias("v"))
    moved = running(base, {"_moved": F.col("v") % 5 - 2}, order=["event_id"])
    return moved.withColumns({"bid_tick": 20000 + F.col("_moved"), "spr": 1 + F.col("event_id") % 3}).drop("_moved")


def ladder(of) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), of)


def market(spark: SparkSession, sf_dir: str) -> Market:
    w = walk(spark, sf_dir)
    e, v, bid, spr = F.col("event_id"), F.col("v"), F.col("bid_tick"), F.col("spr")
    ns = F.lit(1_000_000).cast("long")
    books = w.select(
        "event_id", "coin", "exch_time_ms", (F.col("exch_time_ms") * ns).alias("recv_ts_ns"),
        ladder(lambda i: (bid - i) * F.lit(0.5)).alias("bid_px"),
        ladder(lambda i: (1 + (e * 31 + i * 17 + v * 7) % 97) / F.lit(8.0)).alias("bid_sz"),
        ladder(lambda i: 1 + (e + i) % 9).alias("bid_n"),
        ladder(lambda i: (bid + spr + i) * F.lit(0.5)).alias("ask_px"),
        ladder(lambda i: (1 + (e * 37 + i * 13 + v * 11) % 97) / F.lit(8.0)).alias("ask_sz"),
        ladder(lambda i: 1 + (e + i) % 9).alias("ask_n"),
    )
    even = v % 2 == 0
    later = F.col("exch_time_ms") + 1
    trades = w.select(
        "coin", F.when(even, "A").otherwise("B").alias("side"), F.when(even, (bid - v % 3) * F.lit(0.5)).otherwise((bid + spr + v % 3) * F.lit(0.5)).alias("px"),
        ((1 + v % 128) / F.lit(8.0)).alias("sz"), later.alias("exch_time_ms"), (later * ns).alias("recv_ts_ns"), e.alias("tid"), F.concat(F.lit("0x"), F.hex(e)).alias("trade_hash"),
    )
    ctx = w.where(e % 10 == 0).select(
        "coin", (F.col("exch_time_ms") * ns + 2_000_000).alias("recv_ts_ns"), ((e % 21 - 10) / F.lit(1048576.0)).alias("funding"), ((2 * bid + spr) * F.lit(0.25)).alias("oracle_px")
    )
    venues = F.array(*[F.struct(F.lit(n).alias("venue"), F.lit(float(i)).alias("o"), F.lit(h).cast("long").alias("funding_interval_hours")) for i, (n, h) in enumerate((("HlPerp", 1), ("BinPerp", 8), ("BybitPerp", 8)))])
    predicted = ctx.select("coin", "recv_ts_ns", "funding", F.explode(venues).alias("x")).select(
        "coin", "x.venue", (F.col("funding") + F.col("x.o") / 1048576).alias("funding_rate"), F.expr("recv_ts_ns div 3600000000000 * 3600000 + 3600000").alias("next_funding_time_ms"),
        "x.funding_interval_hours", "recv_ts_ns",
    )
    return Market(books, trades, ctx, predicted)
