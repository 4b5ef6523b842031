"""Funding rates and fees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .book import col

HOURS_PER_YEAR = 24 * 365


def annualized(hourly: Column | str) -> Column:
    """Hourly rate compounded over a year."""
    return F.pow(1 + col(hourly), F.lit(HOURS_PER_YEAR)) - 1


def with_apr(df: DataFrame, rate: str = "funding") -> DataFrame:
    return df.withColumn(f"{rate}_apr", annualized(rate))


def funding_payment(position: Column | str, oracle_px: Column | str, rate: Column | str) -> Column:
    """What a position pays; a long one pays a positive rate."""
    return col(position) * col(oracle_px) * col(rate)


def fee(notional: Column | str, bps: float) -> Column:
    """Maker or taker fee, whichever rate is given."""
    return F.abs(col(notional)) * bps / 10_000
