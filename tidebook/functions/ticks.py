"""Price increments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .book import col

LEAST_GAP = 1e-12
DEFAULT_TICK = 0.01


def tick_size(prices: Column | str) -> Column:
    """Least gap between distinct prices of a ladder; 0.01 where there is none."""
    p = F.array_sort(F.array_distinct(col(prices)))
    n = F.size(p)
    gaps = F.when(n > 1, F.zip_with(F.slice(p, F.lit(2), n - 1), F.slice(p, F.lit(1), n - 1), lambda b, a: b - a))
    return F.coalesce(F.array_min(F.filter(gaps, lambda g: g > LEAST_GAP)), F.lit(DEFAULT_TICK))


def round_to_tick(price: Column, tick: Column, direction: str) -> Column:
    """Down or up to the next multiple, to 10 decimals; unchanged where the tick is not positive."""
    if direction not in ("down", "up"):
        raise ValueError(f"unknown direction {direction!r}")
    steps = (F.floor if direction == "down" else F.ceil)(price / F.when(tick > 0, tick))
    return F.when(tick > 0, F.round(steps * tick, 10)).otherwise(price)
