"""Mean and spread over long frames by differences of running sums, at a cost that does not grow with the frame.

A frame's count, sum and sum of squares are those up to its last row less those before its first. Values are centred on their
key's mean first, and every term is cut in two: a multiple of a step so coarse that a double holds all sums of such multiples
exactly, and the small rest. So the differences lose nothing to the length of the series or to a jump elsewhere in it.
What rounding may have left of a spread of equal values is taken for none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import stored
from .asof import asof
from .blocks import BLOCK_MS, over_history, running

SUMS = ("_n", "_s", "_r", "_q", "_p")
#: Share of a frame's squares that rounding may leave of the difference that its spread is.
ROUNDING = 1e-14


def running_moments(df: DataFrame, value: str, key: str, order: list[str], time: str, block_ms: int) -> DataFrame:
    """df, stored, with the row's number _i in its key from 1, _x, the value less the key's mean, and up to it the count _n, the sum
    (_s and its rest _r) and the sum of squares (_q and _p) of _x; null values are left out of these."""
    df = stored(df, "values", narrow=False)
    v, zero = F.col(value), F.lit(0.0)
    centre = df.groupBy(key).agg(F.coalesce(F.avg(v), zero).alias("_c"), F.count(F.lit(1)).alias("_rows"), F.min(v).alias("_least"), F.max(v).alias("_most"))
    far = F.greatest(F.col("_most") - F.col("_c"), F.col("_c") - F.col("_least"))
    step = lambda size: F.when(size > 0, F.pow(F.lit(2.0), F.ceil(F.log2(size)) - 51)).otherwise(F.lit(1.0))
    centre = centre.select(key, "_c", step(F.col("_rows") * far).alias("_unit"), step(F.col("_rows") * far * far).alias("_unit2"))
    df = df.join(centre, key).withColumn("_x", v - F.col("_c"))
    df = df.withColumns({"_1": F.coalesce("_x", zero), "_2": F.coalesce(F.col("_x") * F.col("_x"), zero)})
    coarse = {c: F.rint(F.col(c) / F.col(s)) * F.col(s) for c, s in (("_1", "_unit"), ("_2", "_unit2"))}
    sums = {"_i": F.lit(1).cast("long"), "_n": F.col("_x").isNotNull().cast("long")}
    for c, whole, rest in (("_1", "_s", "_r"), ("_2", "_q", "_p")):
        sums |= {whole: coarse[c], rest: F.col(c) - coarse[c]}
    return stored(running(df, sums, key, order, time, block_ms).drop("_c", "_unit", "_unit2", "_1", "_2"), "moments", narrow=False)


def frame(before: Callable[[str], Column]) -> tuple[Column, Column, Column]:
    """Count, mean and sum of squares about it of the rows up to one, less those that `before` tells the sums of."""
    n, s, r, q, p = (F.col(c) - before(c) for c in SUMS)
    total, squares = s + r, q + p
    m2 = squares - total * total / n
    return n, F.when(n > 0, total / n), F.when(n > 0, F.when(m2 > ROUNDING * squares, m2).otherwise(F.lit(0.0)))


def over_rows(df: DataFrame, value: str, rows: int, key: str = "coin", order: list[str] | None = None, time: str = "exch_time_ms", block_ms: int = BLOCK_MS) -> DataFrame:
    """df with _n, _x, _mean and _m2 of the last `rows` rows of the value: its count, the row's own value and the mean, both less the
    key's mean, and the sum of squares about the mean."""
    told = running_moments(df, value, key, order or [time], time, block_ms)
    left = told.select(key, (F.col("_i") + rows).alias("_i"), *[F.col(c).alias(f"_b{c}") for c in SUMS])
    both = told.join(left, [key, "_i"], "left")
    n, mean, m2 = frame(lambda c: F.coalesce(f"_b{c}", F.lit(0)))
    return both.select(*df.columns, n.alias("_n"), "_x", mean.alias("_mean"), m2.alias("_m2"))


def rolling_deviation(least: int) -> Column:
    """The sample deviation of a frame of over_rows; null below `least` values."""
    return F.when(F.col("_n") >= least, F.sqrt(F.col("_m2") / (F.col("_n") - 1)))


def step_deviation(df: DataFrame, value: str, lookback_ms: int, key: str = "coin", time: str = "exch_time_ms", block_ms: int = BLOCK_MS) -> DataFrame:
    """df with sigma: the population deviation of the steps of the value between the rows of the last lookback_ms, this one
    included; 0 below three rows. Rows are one per time. The steps are those that come after the window's first row,
    which a forward as-of match finds."""
    steps = over_history(df, 1, lambda d, w: d.withColumn("_change", F.col(value) - F.lag(value).over(w)), key, [time], time, block_ms)
    told = running_moments(steps, "_change", key, [time], time, block_ms)
    ends = told.withColumn("_since", F.col(time) - lookback_ms)
    first = told.select(key, time, *[F.col(c).alias(f"_b{c}") for c in SUMS])
    both = asof(ends, first, [f"_b{c}" for c in SUMS], key, "_since", time, "forward", block_ms=block_ms)
    n, _, m2 = frame(lambda c: F.col(f"_b{c}"))
    return both.select(*df.columns, F.when(n < 2, F.lit(0.0)).otherwise(F.sqrt(m2 / n)).alias("sigma"))
