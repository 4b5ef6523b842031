"""Raw JSON lines to typed tables, batch or streaming: projections and one explode, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import ASSET_CTX, CONTEXT_NUMBERS, L2BOOK, PREDICTED_FUNDING, TRADES

# Channels of the four tables: fixed names.
L2_CHANNEL, TRADE_CHANNEL, CONTEXT_CHANNEL, PREDICTED_CHANNEL = "l2Book", "trades", "activeAssetCtx", "predictedFundingsPoll"


def read_raw(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(recv_ts_ns, channel, data, file) of every line that is JSON; blank and malformed ones are left out."""
    lines = spark.read.text(path, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("file"))
    return envelope(lines, "file")


def envelope(lines: DataFrame, *keep: str) -> DataFrame:
    """Lines (value) to recv_ts_ns, channel and data, a JSON string. A generator reads all three at once, and filters on them stay
    above it: a line is made and parsed once."""
    rows = lines.select(*keep, F.json_tuple("value", "recv_ts_ns", "channel", "data").alias("recv_ts_ns", "channel", "data"))
    rows = rows.where(F.col("channel").isNotNull() & F.col("data").isNotNull())
    return rows.select(F.col("recv_ts_ns").try_cast("long").alias("recv_ts_ns"), "channel", "data", *keep)


def _parsed(parsed: Column) -> Column:
    """The value, or no row for null, from a generator: below filters on its fields, so that it is parsed once."""
    return F.explode(F.filter(F.array(parsed), lambda x: x.isNotNull()))


def _typed(df: DataFrame, schema: str, *keep: str) -> DataFrame:
    names = [c.split()[0] for c in schema.replace(", ", ",").split(",")]
    return df.select(*names, *keep)


def l2book(raw: DataFrame, *keep: str) -> DataFrame:
    """Six ladder arrays of each book message."""
    level = "struct<px:string,sz:string,n:long>"
    book = F.from_json("data", f"coin string, time long, levels array<array<{level}>>")
    rows = raw.where(F.col("channel") == L2_CHANNEL).select("recv_ts_ns", _parsed(book).alias("b"), *keep)
    rows = rows.where(F.col("b.coin").isNotNull())

    def of(side: int, name: str, kind: str) -> Column:
        return F.transform(F.coalesce(F.get("b.levels", F.lit(side)), F.array().cast(f"array<{level}>")), lambda x: x[name].try_cast(kind))

    ladders = {f"{s}_{n}": of(i, k, t) for i, s in enumerate(("bid", "ask")) for n, k, t in (("px", "px", "double"), ("sz", "sz", "double"), ("n", "n", "long"))}
    rows = rows.withColumns(ladders | {"coin": F.col("b.coin"), "exch_time_ms": F.col("b.time")})
    return _typed(rows, L2BOOK, *keep)


def trades(raw: DataFrame, *keep: str) -> DataFrame:
    """One row per trade of each message."""
    one = "struct<coin:string,side:string,px:string,sz:string,time:long,tid:long,hash:string>"
    rows = raw.where(F.col("channel") == TRADE_CHANNEL).select("recv_ts_ns", F.explode(F.from_json("data", f"array<{one}>")).alias("t"), *keep)
    rows = rows.select(
        "t.coin", "t.side", F.col("t.px").try_cast("double").alias("px"), F.col("t.sz").try_cast("double").alias("sz"),
        F.col("t.time").alias("exch_time_ms"), "recv_ts_ns", "t.tid", F.col("t.hash").alias("trade_hash"), *keep,
    )
    return _typed(rows, TRADES, *keep)


def asset_ctx(raw: DataFrame, *keep: str) -> DataFrame:
    """The context's numbers; one that is missing or no number is null."""
    fields = ",".join(f"{k}:string" for k in CONTEXT_NUMBERS)
    rows = raw.where(F.col("channel") == CONTEXT_CHANNEL).select("recv_ts_ns", F.from_json("data", f"coin string, ctx struct<{fields}>").alias("c"), *keep)
    rows = rows.where(F.col("c.coin").isNotNull())
    return _typed(rows.withColumns({"coin": F.col("c.coin")} | {v: F.col(f"c.ctx.{k}").try_cast("double") for k, v in CONTEXT_NUMBERS.items()}), ASSET_CTX, *keep)


def predicted_funding(raw: DataFrame, *keep: str) -> DataFrame:
    """One row per coin and venue of each poll: [[coin, [[venue, {...}]]]]. Venues without figures are
    left out; a missing interval is 0."""
    rows = raw.where(F.col("channel") == PREDICTED_CHANNEL)
    rows = rows.select("recv_ts_ns", F.explode(F.from_json("data", "array<array<string>>")).alias("c"), *keep)
    rows = rows.select("recv_ts_ns", F.get("c", F.lit(0)).alias("coin"), F.explode(F.from_json(F.get("c", F.lit(1)), "array<array<string>>")).alias("v"), *keep)
    info = F.from_json(F.get("v", F.lit(1)), "fundingRate string, nextFundingTime long, fundingIntervalHours long")
    rows = rows.select("recv_ts_ns", "coin", F.get("v", F.lit(0)).alias("venue"), info.alias("i"), *keep).where("i.fundingRate is not null")
    rows = rows.withColumns(
        {
            "funding_rate": F.col("i.fundingRate").try_cast("double"),
            "next_funding_time_ms": F.col("i.nextFundingTime"),
            "funding_interval_hours": F.coalesce("i.fundingIntervalHours", F.lit(0)).cast("long"),
        }
    )
    return _typed(rows, PREDICTED_FUNDING, *keep)


PARSERS = {"l2book": l2book, "trades": trades, "asset_ctx": asset_ctx, "predicted_funding": predicted_funding}
