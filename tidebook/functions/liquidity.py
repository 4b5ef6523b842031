"""Depth near the mid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .book import col


def depth_within_bps(bps: float, mid: Column | str = "mid") -> Column:
    """Sizes of both sides at most `bps` from the mid; 0 for a mid of 0."""
    m = col(mid)
    limit = m * bps / 10_000

    def side(px: str, sz: str, away: callable) -> Column:
        near = F.zip_with(col(px), col(sz), lambda p, s: F.when(away(p) <= limit, s).otherwise(F.lit(0.0)))
        return F.aggregate(near, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))

    both = side("bid_px", "bid_sz", lambda p: m - p) + side("ask_px", "ask_sz", lambda p: p - m)
    return F.when(m == 0, F.lit(0.0)).otherwise(both)


def with_depth(df: DataFrame, bps: float) -> DataFrame:
    """depth_within_{bps}bps, named by the whole part."""
    return df.withColumn(f"depth_within_{int(bps)}bps", depth_within_bps(bps))
