"""Quotes of the two market makers, as columns, for a given inventory."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .book import col


def _sided(bid: Column, ask: Column, inventory: Column, size: float, cap: float, drought: Column) -> Column:
    drought = F.coalesce(drought, F.lit(False))
    return F.struct(
        F.when(~drought, bid).alias("bid_px"),
        F.when(~drought & (inventory < cap), F.lit(size)).otherwise(F.lit(0.0)).alias("bid_sz"),
        F.when(~drought, ask).alias("ask_px"),
        F.when(~drought & (inventory > -cap), F.lit(size)).otherwise(F.lit(0.0)).alias("ask_sz"),
    )


def symmetric_quote(microprice: Column | str, inventory: Column, half_spread_bps: float, size: float, cap: float, drought: Column) -> Column:
    """Both sides of the microprice, half the spread away."""
    m = col(microprice)
    half = m * half_spread_bps / 10_000
    return _sided(m - half, m + half, inventory, size, cap, drought)


def inventory_quote(
    mid: Column | str, sigma: Column, inventory: Column, risk_aversion: float, decay_s: float, half_spread_bps: float, size: float, cap: float, drought: Column
) -> Column:
    """Around a price that leans against the inventory, the more so the more volatile the mid is."""
    m = col(mid)
    risk = risk_aversion * sigma * sigma * decay_s
    centre, half = m - inventory * risk, F.greatest(half_spread_bps / 10_000 * m, 0.5 * risk)
    return _sided(centre - half, centre + half, inventory, size, cap, drought)
