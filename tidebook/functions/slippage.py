"""Walking a ladder with a market order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .book import col, ratio


def walk(px: Column | str, sz: Column | str, size: float | Column) -> Column:
    """struct(vwap, filled) of an order of that size; less is filled if the ladder ends, and vwap is
    null if nothing is."""
    want = size if isinstance(size, Column) else F.lit(float(size))
    start = F.struct(F.lit(0.0).alias("cost"), F.lit(0.0).alias("filled"))

    def take(acc: Column, level: Column) -> Column:
        got = F.greatest(F.lit(0.0), F.least(level["s"], want - acc["filled"]))
        return F.struct((acc["cost"] + got * level["p"]).alias("cost"), (acc["filled"] + got).alias("filled"))

    zipped = F.zip_with(col(px), col(sz), lambda p, s: F.struct(p.alias("p"), s.alias("s")))
    return F.aggregate(zipped, start, take, lambda a: F.struct(ratio(a["cost"], a["filled"]).alias("vwap"), a["filled"].alias("filled")))


def slippage_bps(vwap: Column, mid: Column, side: str) -> Column:
    """Cost against the mid, positive if it hurts."""
    if side not in ("buy", "sell"):
        raise ValueError(f"unknown side {side!r}")
    return ratio(vwap - mid, mid) * (10_000 if side == "buy" else -10_000)


def estimate(size: float, side: str) -> Column:
    """struct(side, requested_size, filled_size, fully_filled, vwap, mid, slippage_bps) of the row's book."""
    walked = walk("ask_px", "ask_sz", size) if side == "buy" else walk("bid_px", "bid_sz", size)
    return F.struct(
        F.lit(side).alias("side"),
        F.lit(float(size)).alias("requested_size"),
        walked["filled"].alias("filled_size"),
        (walked["filled"] >= size - 1e-12).alias("fully_filled"),
        walked["vwap"].alias("vwap"),
        F.col("mid").alias("mid"),
        slippage_bps(walked["vwap"], F.col("mid"), side).alias("slippage_bps"),
    )


def with_slippage(df: DataFrame, sizes: list[float], side: str) -> DataFrame:
    """slippage_bps_{size} for each size in base units; a buy walks the asks. Sizes whose whole part
    agrees would share a name and are refused."""
    names = [f"slippage_bps_{int(s)}" for s in sizes]
    if len(set(names)) < len(names):
        raise ValueError(f"sizes {sizes} give the same column names")
    px, sz = ("ask_px", "ask_sz") if side == "buy" else ("bid_px", "bid_sz")
    return df.withColumns({n: slippage_bps(walk(px, sz, s)["vwap"], F.col("mid"), side) for n, s in zip(names, sizes, strict=True)})
